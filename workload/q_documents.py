"""Catalogue, schedule and manifest documents built from suppliers, parts, orders and the feed.

A catalogue holds twenty suppliers as stores and four hundred parts as products; a schedule
holds the days of one month; a manifest holds the files of one day. So documents stay small
and their number grows with the tables. Some records are damaged by their number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import documents as DOC
from workload.base import part, query
from workload.feed import table
from workload.q_delivery import day_stores


def _record(**fields) -> F.Column:
    """JSON text of one record from name and JSON-value columns."""
    pieces = []
    for name, value in fields.items():
        pieces += [F.lit(f'{"," if pieces else "{"}"{name}":'), value]
    return F.concat(*pieces, F.lit("}"))


def _quoted(value) -> F.Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _list(records) -> F.Column:
    return F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(records)), ","), F.lit("]"))


# ---- catalogues -------------------------------------------------------------------------
STORE_ID = (
    "CASE WHEN s_suppkey % 17 = 3 THEN concat('S', CAST(s_suppkey - 1 AS {t})) "
    "WHEN s_suppkey % 23 = 5 THEN 'bad id' ELSE concat('S', CAST(s_suppkey AS {t})) END"
)
PRODUCT_ID = (
    "CASE WHEN p_partkey % 101 = 7 THEN concat('P', CAST(p_partkey - 1 AS {t})) "
    "ELSE concat('P', CAST(p_partkey AS {t})) END"
)


def catalogs(spark, folder):
    stores = table(spark, folder, "supplier").select(
        F.expr("s_suppkey div 20").alias("reference_id"),
        _record(
            store_id=_quoted(F.expr(STORE_ID.format(t="STRING"))),
            name=_quoted(F.expr("if(s_suppkey % 11 = 4, '', s_name)")),
            state=F.lit('"SP"'),
            timezone=_quoted(F.expr("if(s_suppkey % 13 = 6, 'UTC', 'America/Sao_Paulo')")),
            active=F.expr("if(s_suppkey % 29 = 9, '\"yes\"', if(s_suppkey % 7 = 2, 'false', 'true'))"),
        ).alias("record"),
    )
    products = table(spark, folder, "part").select(
        F.expr("p_partkey div 400").alias("reference_id"),
        _record(
            product_id=_quoted(F.expr(PRODUCT_ID.format(t="STRING"))),
            name=_quoted(F.expr("if(p_partkey % 67 = 8, '', p_name)")),
            category=F.expr("if(p_partkey % 59 = 3, 'null', concat('\"', p_type, '\"'))"),
        ).alias("record"),
    )
    both = (
        stores.groupBy("reference_id")
        .agg(_list("record").alias("stores"))
        .join(products.groupBy("reference_id").agg(_list("record").alias("products")), "reference_id")
    )
    version = F.expr("if(reference_id % 4 = 3, '\"1\"', '1')")
    return both.select(
        "reference_id",
        _record(schema_version=version, stores=F.col("stores"), products=F.col("products")).alias(
            "document"
        ),
    )


part(
    "store_records",
    [],
    f"SELECT *, s_suppkey // 20 AS reference_id, {STORE_ID.format(t='VARCHAR')} AS id FROM supplier",
)
part(
    "product_records",
    [],
    f"SELECT *, p_partkey // 400 AS reference_id, {PRODUCT_ID.format(t='VARCHAR')} AS id FROM part",
)


@query(
    "check_catalog",
    ["store_records", "product_records"],
    """
    , found AS (
      SELECT DISTINCT reference_id, 'CATALOG_SCHEMA_VERSION' AS code, NULL AS field, NULL AS value,
             1 AS n FROM store_records WHERE reference_id % 4 = 3
      UNION ALL SELECT reference_id, 'INVALID_CATALOG', 'stores', NULL, 1 FROM store_records
      WHERE id = 'bad id'
      UNION ALL SELECT reference_id, 'DUPLICATE_REFERENCE', 'store_id', id, count(*) - 1
      FROM store_records WHERE id <> 'bad id' GROUP BY reference_id, id HAVING count(*) > 1
      UNION ALL SELECT reference_id, 'INVALID_CATALOG', 'name', id, 1 FROM store_records
      WHERE id <> 'bad id' AND s_suppkey % 11 = 4
      UNION ALL SELECT reference_id, 'INVALID_CATALOG', 'store_metadata', id, 1 FROM store_records
      WHERE id <> 'bad id' AND (s_suppkey % 13 = 6 OR s_suppkey % 29 = 9)
      UNION ALL SELECT reference_id, 'DUPLICATE_REFERENCE', 'product_id', id, count(*) - 1
      FROM product_records GROUP BY reference_id, id HAVING count(*) > 1
      UNION ALL SELECT reference_id, 'INVALID_CATALOG', 'name', id, 1 FROM product_records
      WHERE p_partkey % 67 = 8
      UNION ALL SELECT reference_id, 'INVALID_CATALOG', 'category', id, 1 FROM product_records
      WHERE p_partkey % 59 = 3)
    SELECT reference_id, code, field, value, CAST(sum(n) AS BIGINT) AS count FROM found
    GROUP BY ALL
    """,
)
def check_catalog(spark, folder):
    found = DOC.check_catalog(catalogs(spark, folder))
    return found.groupBy("reference_id", "code", "field", "value").agg(F.sum("count").alias("count"))


@query(
    "active_stores",
    ["store_records"],
    "SELECT DISTINCT reference_id, id AS store_id FROM store_records "
    "WHERE id <> 'bad id' AND s_suppkey % 29 <> 9 AND s_suppkey % 7 <> 2",
)
def active_stores(spark, folder):
    return DOC.active_stores(catalogs(spark, folder))


# ---- schedules --------------------------------------------------------------------------
WINDOW_ID = (
    "CASE WHEN d % 19 = 1 THEN 'W-x' WHEN d % 23 = 2 THEN 'bad id' "
    "ELSE concat('W', CAST(d AS {t})) END"
)


def order_days(spark, folder):
    """Day number, month and stores of the orders, one row per day."""
    day = F.col("o_orderdate").cast("date")
    store = F.concat(F.lit("S"), F.lpad((F.col("o_custkey") % 12 + 1).cast("string"), 2, "0"))
    return (
        table(spark, folder, "orders")
        .select(
            F.datediff(day, F.lit("1990-01-01").cast("date")).alias("d"),
            (F.year(day) * 100 + F.month(day)).alias("reference_id"),
            store.alias("store_id"),
        )
        .groupBy("d", "reference_id")
        .agg(F.array_sort(F.collect_set("store_id")).alias("stores"))
    )


def schedules(spark, folder):
    stores = F.expr("""
        CASE WHEN d % 17 = 3 THEN array() WHEN d % 13 = 4 THEN concat(stores, slice(stores, 1, 1))
             WHEN d % 29 = 5 THEN concat(stores, array('S99')) ELSE stores END""")
    listed = F.concat(F.lit("["), F.array_join(F.transform(stores, _quoted), ","), F.lit("]"))
    windows = order_days(spark, folder).select(
        "reference_id",
        _record(
            window_id=_quoted(F.expr(WINDOW_ID.format(t="STRING"))),
            source_system=F.lit('"pos"'),
            stores=listed,
            starts_at=_quoted(F.expr("if(d % 37 = 7, '2026-01-01T00:00:00', '2026-01-01T00:00:00-03:00')")),
            ends_at=_quoted(F.expr("if(d % 31 = 6, '2026-01-01T03:00:00Z', '2026-01-01T03:00:01Z')")),
        ).alias("record"),
    )
    version = F.expr("if(reference_id % 100 = 12, '2', '1')")
    return (
        windows.groupBy("reference_id")
        .agg(_list("record").alias("windows"))
        .select(
            "reference_id",
            _record(schema_version=version, windows=F.col("windows")).alias("document"),
        )
    )


part(
    "order_days",
    [],
    f"""
    SELECT *, {WINDOW_ID.format(t="VARCHAR")} AS window_id FROM (
      SELECT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS d,
             CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS reference_id,
             list_sort(list(DISTINCT 'S' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0'))) AS stores
      FROM orders GROUP BY ALL)
    """,
)


@query(
    "check_schedule",
    ["order_days"],
    """
    , found AS (
      SELECT DISTINCT reference_id, 'SCHEDULE_SCHEMA_VERSION' AS code, NULL AS field, NULL AS value,
             1 AS n FROM order_days WHERE reference_id % 100 = 12
      UNION ALL SELECT reference_id, 'INVALID_SCHEDULE_WINDOW', NULL, NULL, 1 FROM order_days
      WHERE window_id = 'bad id'
      UNION ALL SELECT reference_id, 'DUPLICATE_SCHEDULE_WINDOW', 'window_id', window_id, count(*) - 1
      FROM order_days WHERE window_id <> 'bad id' GROUP BY reference_id, window_id HAVING count(*) > 1
      UNION ALL SELECT reference_id, 'INVALID_SCHEDULE_STORES', 'window_id', window_id, 1
      FROM order_days WHERE window_id <> 'bad id' AND (d % 17 = 3 OR d % 13 = 4 OR d % 29 = 5)
      UNION ALL SELECT reference_id, 'INVALID_DELIVERY_INTERVAL', 'window_id', window_id, 1
      FROM order_days WHERE window_id <> 'bad id' AND (d % 31 = 6 OR d % 37 = 7))
    SELECT reference_id, code, field, value, CAST(sum(n) AS BIGINT) AS count FROM found GROUP BY ALL
    """,
)
def check_schedule(spark, folder):
    days = order_days(spark, folder)
    active = days.select("reference_id", F.explode("stores").alias("store_id")).distinct()
    found = DOC.check_schedule(schedules(spark, folder), active)
    return found.groupBy("reference_id", "code", "field", "value").agg(F.sum("count").alias("count"))


def window_requests(spark, folder):
    """One delivery per order day, asking for the window of that day."""
    return order_days(spark, folder).select(
        F.concat(F.lit("D"), F.col("d").cast("string")).alias("batch_id"),
        "reference_id",
        F.expr("if(d % 19 = 1, 'W-x', concat('W', cast(d as string)))").alias("window_id"),
        F.lit("pos").alias("source_system"),
    )


part(
    "window_matches",
    ["order_days"],
    """
    SELECT 'D' || CAST(q.d AS VARCHAR) AS batch_id, w.n, w.d AS match
    FROM order_days q LEFT JOIN (SELECT reference_id, window_id, count(*) AS n, min(d) AS d
                                 FROM order_days GROUP BY ALL) w
    ON q.reference_id = w.reference_id
       AND w.window_id = CASE WHEN q.d % 19 = 1 THEN 'W-x' ELSE 'W' || CAST(q.d AS VARCHAR) END
    """,
)


@query(
    "expected_stores",
    ["window_matches"],
    """
    SELECT DISTINCT batch_id, unnest(CASE WHEN d % 17 = 3 THEN [] WHEN d % 29 = 5 AND d % 13 <> 4
                                     THEN stores || ['S99'] ELSE stores END) AS store_id
    FROM window_matches JOIN order_days ON d = match WHERE n = 1
    """,
)
def expected_stores(spark, folder):
    return DOC.expected_stores(window_requests(spark, folder), schedules(spark, folder))


@query(
    "window_issues",
    ["window_matches"],
    "SELECT batch_id, 'UNKNOWN_OR_DUPLICATE_WINDOW' AS code FROM window_matches "
    "WHERE coalesce(n, 0) <> 1",
)
def window_issues(spark, folder):
    return DOC.window_issues(window_requests(spark, folder), schedules(spark, folder))


# ---- manifests --------------------------------------------------------------------------
def manifests(spark, folder, backwards: bool = False):
    """One manifest per business day; damage by day number and by the day/store mix."""
    rows = day_stores(spark, folder)
    path = F.expr("""
        CASE WHEN mix % 41 = 0 THEN concat('../', path) WHEN mix % 43 = 0 THEN 'S00.csv'
             WHEN mix % 47 = 0 THEN 'S00.csv' WHEN mix % 53 = 0 THEN 'S01.CSV' ELSE path END""")
    digest = F.sha2(F.concat_ws("/", "batch_id", "path"), 256)
    entry = _record(
        path=_quoted(path),
        row_count=F.expr("if(mix % 59 = 0, '\"7\"', cast(sold_rows as string))"),
        sha256=_quoted(F.when(F.col("mix") % 61 == 0, F.upper(digest)).otherwise(digest)),
        store_id=_quoted(F.col("store_id")),
    )
    entry = F.when(F.col("mix") % 67 == 0, "17").otherwise(entry)
    ordered = F.array_sort(F.collect_list(F.struct("store_no", entry.alias("entry"))))
    if backwards:
        ordered = F.reverse(ordered)
    grouped = rows.groupBy("batch_id", "day_no").agg(
        F.array_join(F.transform(ordered, lambda item: item["entry"]), ",").alias("entries")
    )
    day = "day_no % {0} = {1}"
    return grouped.select(
        F.col("batch_id").alias("delivery_id"),
        F.when(F.expr(day.format(97, 5)), F.lit("{broken")).otherwise(
            F.concat(
                F.lit("{"),
                F.when(F.expr(day.format(31, 3)), F.lit('"note":1,')).otherwise(""),
                F.lit('"schema_version":'),
                F.when(F.expr(day.format(29, 4)), F.lit("1.5")).otherwise("1"),
                F.lit(',"batch_id":'),
                F.when(F.expr(day.format(23, 6)), F.lit("12")).otherwise(_quoted("batch_id")),
                F.lit(',"source_system":"pos","window_id":"W1"'),
                F.when(F.expr(day.format(19, 7)), F.lit(',"correction_of":null')).otherwise(""),
                F.lit(',"files":'),
                F.when(F.expr(day.format(37, 8)), F.lit('{"a":1}')).otherwise(
                    F.concat(F.lit("["), F.col("entries"), F.lit("]"))
                ),
                F.lit(',"zero_movement":'),
                F.when(F.expr(day.format(17, 9)), F.lit('["S01","S01"]'))
                .when(F.expr(day.format(3, 0)), F.lit('["S12","S11"]'))
                .otherwise("[]"),
                F.lit("}"),
            )
        ).alias("document"),
    )


part(
    "entries",
    ["day_stores"],
    """
    SELECT *, CASE WHEN mix % 41 = 0 THEN '../' || path WHEN mix % 43 = 0 OR mix % 47 = 0
                   THEN 'S00.csv' WHEN mix % 53 = 0 THEN 'S01.CSV' ELSE path END AS file,
           mix % 59 <> 0 AND mix % 61 <> 0 AS valid,
           CASE WHEN mix % 67 = 0 THEN 'INVALID' WHEN mix % 41 = 0 THEN 'UNSAFE'
                WHEN mix % 43 = 0 OR mix % 47 = 0 THEN 'NAMED'
                WHEN mix % 53 = 0 THEN 'UNSAFE' ELSE 'NAMED' END AS state
    FROM day_stores WHERE day_no % 97 <> 5 AND day_no % 37 <> 8
    """,
)
part(
    "named",
    ["entries"],
    """
    SELECT *, row_number() OVER (PARTITION BY batch_id, file ORDER BY store_no) AS occurrence
    FROM entries WHERE state = 'NAMED'
    """,
)
part("days", ["day_stores"], "SELECT DISTINCT batch_id, day_no FROM day_stores")


@query(
    "check_manifest",
    ["entries", "named", "days"],
    """
    , found AS (
      SELECT batch_id, 'INVALID_MANIFEST' AS code, NULL AS field, NULL AS value FROM days
      WHERE day_no % 97 = 5
      UNION ALL SELECT batch_id, 'UNSUPPORTED_SCHEMA_VERSION', NULL, NULL FROM days
      WHERE day_no % 97 = 5 OR day_no % 29 = 4
      UNION ALL SELECT batch_id, 'INVALID_MANIFEST_FIELD', 'batch_id', NULL FROM days
      WHERE day_no % 97 = 5 OR day_no % 23 = 6
      UNION ALL SELECT batch_id, 'INVALID_MANIFEST_FIELD', unnest(['source_system', 'window_id']), NULL
      FROM days WHERE day_no % 97 = 5
      UNION ALL SELECT batch_id, 'INVALID_MANIFEST_FIELD', 'correction_of', NULL FROM days
      WHERE day_no % 97 <> 5 AND day_no % 19 = 7
      UNION ALL SELECT batch_id, 'UNKNOWN_MANIFEST_FIELDS', 'note', NULL FROM days
      WHERE day_no % 97 <> 5 AND day_no % 31 = 3
      UNION ALL SELECT batch_id, 'INVALID_MANIFEST_FILES', NULL, NULL FROM days
      WHERE day_no % 97 = 5 OR day_no % 37 = 8
      UNION ALL SELECT batch_id, 'INVALID_MANIFEST_FILE', NULL, NULL FROM entries
      WHERE state = 'INVALID'
      UNION ALL SELECT batch_id, 'UNSAFE_PATH', 'file', file FROM entries WHERE state = 'UNSAFE'
      UNION ALL SELECT batch_id, 'DUPLICATE_MANIFEST_FILE', 'file', file FROM named
      WHERE occurrence > 1
      UNION ALL SELECT batch_id, 'INVALID_MANIFEST_FILE', 'file', file FROM named
      WHERE occurrence = 1 AND NOT valid
      UNION ALL SELECT batch_id, 'INVALID_ZERO_CONFIRMATION', NULL, NULL FROM days
      WHERE day_no % 97 = 5 OR day_no % 17 = 9)
    SELECT batch_id AS delivery_id, code, field, value, count(*) AS count FROM found GROUP BY ALL
    """,
)
def check_manifest(spark, folder):
    return DOC.check_manifest(manifests(spark, folder))


@query(
    "manifest_files",
    ["named"],
    "SELECT batch_id AS delivery_id, file AS path, sha256(batch_id || '/' || path) AS sha256, "
    "sold_rows AS row_count, store_id FROM named WHERE occurrence = 1 AND valid",
)
def manifest_files(spark, folder):
    return DOC.manifest_files(manifests(spark, folder)).drop("position")


@query(
    "manifest_zeros",
    ["days"],
    "SELECT batch_id AS delivery_id, unnest(['S11', 'S12']) AS store_id FROM days "
    "WHERE day_no % 97 <> 5 AND day_no % 17 <> 9 AND day_no % 3 = 0",
)
def manifest_zeros(spark, folder):
    return DOC.manifest_zeros(manifests(spark, folder))


@query(
    "manifest_identity",
    ["day_stores"],
    """
    , texts AS (
      SELECT batch_id, day_no, '[' || string_agg(e, ',' ORDER BY e) || ']' AS files FROM (
        SELECT batch_id, day_no, CASE WHEN mix % 67 = 0 THEN '17' ELSE
          '{"path":"' || CASE WHEN mix % 41 = 0 THEN '../' || path
                              WHEN mix % 43 = 0 OR mix % 47 = 0 THEN 'S00.csv'
                              WHEN mix % 53 = 0 THEN 'S01.CSV' ELSE path END || '","row_count":'
          || CASE WHEN mix % 59 = 0 THEN '"7"' ELSE CAST(sold_rows AS VARCHAR) END || ',"sha256":"'
          || CASE WHEN mix % 61 = 0 THEN upper(sha256(batch_id || '/' || path))
                  ELSE sha256(batch_id || '/' || path) END || '","store_id":"' || store_id || '"}'
          END AS e FROM day_stores) GROUP BY ALL)
    SELECT batch_id AS delivery_id, sha256(CASE WHEN day_no % 97 = 5 THEN '{}' ELSE
      '{"batch_id":' || CASE WHEN day_no % 23 = 6 THEN '12' ELSE '"' || batch_id || '"' END
      || CASE WHEN day_no % 19 = 7 THEN ',"correction_of":null' ELSE '' END
      || ',"files":' || CASE WHEN day_no % 37 = 8 THEN '{"a":1}' ELSE files END
      || CASE WHEN day_no % 31 = 3 THEN ',"note":1' ELSE '' END
      || ',"schema_version":' || CASE WHEN day_no % 29 = 4 THEN '1.5' ELSE '1' END
      || ',"source_system":"pos","window_id":"W1","zero_movement":'
      || CASE WHEN day_no % 17 = 9 THEN '["S01","S01"]'
             WHEN day_no % 3 = 0 THEN '["S11","S12"]' ELSE '[]' END || '}' END) AS manifest_hash
    FROM texts
    """,
)
def manifest_identity(spark, folder):
    return DOC.manifest_identity(manifests(spark, folder, backwards=True))
