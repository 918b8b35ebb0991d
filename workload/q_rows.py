"""The row contract over the feed rendered as text, with deterministic damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import delivery as D
from tillclose.operators import revisions as R
from tillclose.operators import row_contract as RC
from tillclose.schemas import BUSINESS_FIELDS
from workload.base import part, query
from workload.feed import feed_cents, money, stored, table

# Fixed test values: for each residue of the row number, the field damaged and its new text.
DAMAGE = [
    (0, "sale_id", "-x"),
    (1, "line_id", ""),
    (2, "source_system", "other"),
    (3, "store_id", "S99"),
    (4, "store_id", "X 1"),
    (5, "product_id", "P999999999"),
    (6, "product_id", "P#1"),
    (7, "revision", "0"),
    (8, "revision", "00012"),
    (9, "revision", "1e3"),
    (10, "revision", "2147483648"),
    (11, "revision", "１"),
    (12, "quantity", "0"),
    (13, "quantity", "1000001"),
    (14, "quantity", "+1"),
    (15, "quantity", "000000000001"),
    (16, "quantity", "0000000000001"),
    (17, "operation", "upsert"),
    (18, "operation", ""),
    (19, "unit_price_brl", " 1.00"),
    (20, "unit_price_brl", "1.000"),
    (21, "unit_price_brl", "1000000000.00"),
    (22, "unit_price_brl", "1e3"),
    (23, "unit_price_brl", ".5"),
    (24, "unit_price_brl", "1000000.5"),
    (25, "line_discount_brl", "-1.00"),
    (26, "line_discount_brl", "99999999999999999.00"),
    (27, "line_discount_brl", "9999999999999999.99"),
    (28, "sold_at", "2026-01-01T12:00:00"),
    (29, "sold_at", "2026-02-30T12:00:00Z"),
    (30, "sold_at", "2026-01-01T12:00:00+24:00"),
    (31, "sold_at", "2026-01-01T12:00:60Z"),
    (32, "sold_at", "0001-01-01T00:00:00Z"),
    (33, "sold_at", "9999-12-31T23:59:59-23:59"),
    (34, "sold_at", "2026-01-01T12:00:00.1234567Z"),
    (35, "sold_at", "2026-01-01T12:00:00.123456-03:00"),
    (36, "source_updated_at", "0001-01-01T00:00:00Z"),
    (37, "source_updated_at", "9999-12-31T23:59:59.999999-00:01"),
    (39, "quantity", "5\n"),
    (40, "sold_at", "1800-06-01T00:00:00+20:00"),
]
RESIDUES = 97


#: What the texts of a row are made from: numbers, which travel narrower than the texts.
NUMBERS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "store_no",
    "quantity", "unit_cents", "discount_cents",
]


def numbers(spark, folder):
    return feed_cents(spark, folder).select(*NUMBERS)


def _texts():
    """Every text of a row and its damage, by name."""
    residue = (F.col("l_orderkey") * 3 + F.col("l_partkey")) % RESIDUES
    stamp = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    store = F.concat(F.lit("S"), F.lpad(F.col("store_no").cast("string"), 2, "0"))
    text = {
        "source_system": F.lit("pos"),
        "store_id": store,
        "sale_id": F.col("l_orderkey").cast("string"),
        "line_id": F.col("l_linenumber").cast("string"),
        "revision": day.cast("string"),
        "operation": F.when(F.col("l_returnflag") == "R", "CANCEL").otherwise("UPSERT"),
        "product_id": F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
        "sold_at": stamp,
        "quantity": F.col("quantity").cast("string"),
        "unit_price_brl": (F.col("unit_cents").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("string"),
        "line_discount_brl": (F.col("discount_cents").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("string"),
        "source_updated_at": stamp,
    }
    damaged = {}
    for name in BUSINESS_FIELDS:
        value = text[name]
        for number, field, bad in DAMAGE:
            if field == name:
                value = F.when(residue == number, F.lit(bad)).otherwise(value)
        damaged[name] = value
    batch = F.when(F.col("l_linestatus") == "F", "B1").otherwise("B2")
    line = (F.col("l_partkey") * 53 + F.col("l_suppkey") * 7 + F.col("quantity")).cast("int")
    return damaged | {
        "batch_id": batch,
        "run_id": F.concat(F.lit("run-"), batch),
        "source_file": F.concat(store, F.lit(".csv")),
        "source_line": line,
        "width_ok": residue != 38,
        "header_ok": ~((F.col("store_no") == 7) & (F.col("l_linestatus") == "O")),
        "row_id": F.concat_ws("-", "l_orderkey", "l_linenumber", line),
    }


def as_texts(rows, *carried):
    """Rows as a CSV reader would hand them over, without their raw payload, and what else they carry."""
    return rows.select(*(text.alias(name) for name, text in _texts().items()), *carried)


def raw_fields(spark, folder):
    """Rows as a CSV reader would hand them over, before any join and without their raw payload."""
    return as_texts(numbers(spark, folder))


def with_payload(rows):
    header = F.array(*map(F.lit, BUSINESS_FIELDS)).alias("header")
    return rows.withColumn("raw_payload", F.to_json(F.struct(header, F.array(*BUSINESS_FIELDS).alias("values"))))


def raw(spark, folder):
    """Rows as a CSV reader would hand them over, before any join."""
    return with_payload(raw_fields(spark, folder))


def declared_files(spark, folder):
    """One declared file per batch and store."""
    rows = feed_cents(spark, folder)
    store = F.concat(F.lit("S"), F.lpad(F.col("store_no").cast("string"), 2, "0"))
    return rows.select(
        F.when(F.col("l_linestatus") == "F", "B1").otherwise("B2").alias("batch_id"),
        F.concat(store, F.lit(".csv")).alias("path"),
        F.lit("pos").alias("source_system"),
        store.alias("store_id"),
    ).distinct()


def active_stores(spark, folder):
    number = table(spark, folder, "orders").select((F.col("o_custkey") % 12 + 1).alias("n"))
    return (
        number.distinct()
        .filter("n <> 5")
        .select(F.concat(F.lit("S"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("store_id"))
    )


def known_products(spark, folder):
    return (
        table(spark, folder, "part")
        .filter("p_size <> 13")
        .select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"))
    )


REFERENCES = ["declared_source", "declared_store", "store_known", "product_known"]


def checked(spark, folder):
    """The references are tables of their own, so Spark knows how small they are and leaves the rows where they are.
    What is compared with them are four texts; the others, and the payload as wide as all of them, are written down
    after the rows have travelled to their products."""
    texts = _texts()
    compared = [texts[name].alias(name) for name in ("batch_id", "source_file", "store_id", "product_id")]
    known = RC.with_references(
        numbers(spark, folder).select(*NUMBERS, *compared),
        stored(declared_files(spark, folder), "files"),
        stored(active_stores(spark, folder), "stores"),
        stored(known_products(spark, folder), "products"),
    )
    return with_payload(as_texts(known.select(*NUMBERS, *REFERENCES), *REFERENCES))


def bronze(spark, folder):
    return RC.bronze_rows(checked(spark, folder))


# ---- the same in SQL --------------------------------------------------------------------
def _damaged(name: str, text: str) -> str:
    cases = " ".join(
        f"WHEN {number} THEN '{bad}'" for number, field, bad in DAMAGE if field == name
    )
    return f"CASE k {cases} ELSE {text} END AS {name}" if cases else f"{text} AS {name}"


_STORE = "'S' || lpad(CAST(store_no AS VARCHAR), 2, '0')"
_STAMP = "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')"
_TEXT = {
    "source_system": "'pos'",
    "store_id": _STORE,
    "sale_id": "CAST(l_orderkey AS VARCHAR)",
    "line_id": "CAST(l_linenumber AS VARCHAR)",
    "revision": "CAST(day_no AS VARCHAR)",
    "operation": "CASE WHEN l_returnflag = 'R' THEN 'CANCEL' ELSE 'UPSERT' END",
    "product_id": "'P' || CAST(l_partkey AS VARCHAR)",
    "sold_at": _STAMP,
    "quantity": "CAST(quantity AS VARCHAR)",
    "unit_price_brl": f"CAST({money('unit_cents')} AS VARCHAR)",
    "line_discount_brl": f"CAST({money('discount_cents')} AS VARCHAR)",
    "source_updated_at": _STAMP,
}
part(
    "raw",
    ["cents"],
    "SELECT "
    + ", ".join(_damaged(name, _TEXT[name]) for name in BUSINESS_FIELDS)
    + f""", CASE WHEN l_linestatus = 'F' THEN 'B1' ELSE 'B2' END AS batch_id,
    {_STORE} || '.csv' AS source_file, line AS source_line, k <> 38 AS width_ok,
    NOT (store_no = 7 AND l_linestatus = 'O') AS header_ok,
    concat_ws('-', l_orderkey, l_linenumber, line) AS row_id,
    'pos' AS declared_source, {_STORE} AS declared_store
    FROM (SELECT *, (l_orderkey * 3 + l_partkey) % {RESIDUES} AS k,
                 CAST(l_partkey * 53 + l_suppkey * 7 + quantity AS INT) AS line FROM cents)
    """,
)
part("active_stores", [], """SELECT DISTINCT 'S' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0')
     AS store_id FROM orders WHERE o_custkey % 12 + 1 <> 5""")
part("products", [], "SELECT 'P' || CAST(p_partkey AS VARCHAR) AS product_id FROM part WHERE p_size <> 13")

_ID = "[A-Za-z0-9][A-Za-z0-9_.-]{0,63}"
_WHEN = (
    "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?"
    "(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"
)


def _number(field: str, maximum: int) -> str:
    return (
        f"CASE WHEN regexp_full_match({field}, '[0-9]{{1,12}}') AND "
        f"CAST({field} AS BIGINT) BETWEEN 1 AND {maximum} THEN CAST({field} AS BIGINT) END"
    )


def _amount(field: str, maximum: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({field}, '[0-9]+([.][0-9]{{1,2}})?') AND length({field}) <= 32 "
        f"AND try_cast({field} AS DECIMAL(38,2)) <= CAST('{maximum}' AS DECIMAL(38,2)) "
        f"THEN try_cast({field} AS DECIMAL(38,2)) END"
    )


def _moment(field: str) -> str:
    """UTC timestamp of a text: local part minus its offset, within years 1 to 9999."""
    zulu = f"right({field}, 1) = 'Z'"
    local = f"CASE WHEN {zulu} THEN left({field}, length({field}) - 1) ELSE left({field}, length({field}) - 6) END"
    offset = (
        f"CASE WHEN {zulu} THEN 0 ELSE (CASE WHEN substr({field}, length({field}) - 5, 1) = '-' "
        f"THEN -1 ELSE 1 END) * (try_cast(substr({field}, length({field}) - 4, 2) AS INT) * 60 "
        f"+ try_cast(right({field}, 2) AS INT)) END"
    )
    utc = f"(try_cast({local} AS TIMESTAMP) - to_minutes(CAST({offset} AS INT)))"
    return (
        f"CASE WHEN regexp_full_match({field}, '{_WHEN}') AND substr({field}, 18, 2) < '60' "
        f"AND {utc} BETWEEN TIMESTAMP '0001-01-01 00:00:00' "
        f"AND TIMESTAMP '9999-12-31 23:59:59.999999' THEN {utc} END"
    )


part(
    "measured",
    ["raw", "active_stores", "products"],
    f"""
    SELECT raw.*, s.store_id IS NOT NULL AS store_known, p.product_id IS NOT NULL AS product_known,
           {_number("revision", 2147483647)} AS revision_n, {_number("quantity", 1000000)} AS quantity_n,
           {_amount("unit_price_brl", "999999999.99")} AS price_n,
           {_amount("line_discount_brl", "9999999999999999.99")} AS discount_n,
           CASE WHEN CAST(timezone('America/Sao_Paulo', timezone('UTC', {_moment("sold_at")})) AS DATE)
                >= DATE '0001-01-01' THEN {_moment("sold_at")} END AS sold_n,
           {_moment("source_updated_at")} AS updated_n
    FROM raw LEFT JOIN active_stores s ON raw.store_id = s.store_id
    LEFT JOIN products p ON raw.product_id = p.product_id
    """,
)
_RULES = [
    ("ROW_WIDTH_MISMATCH", "NOT width_ok"),
    ("SCHEMA_MISMATCH", "NOT header_ok"),
    *(
        (f"INVALID_{name.upper()}", f"NOT regexp_full_match({name}, '{_ID}')")
        for name in ("source_system", "store_id", "sale_id", "line_id", "product_id")
    ),
    ("SOURCE_MISMATCH", "source_system <> declared_source"),
    ("FILE_STORE_MISMATCH", "store_id <> declared_store"),
    ("UNKNOWN_STORE", "NOT store_known"),
    ("UNKNOWN_PRODUCT", "NOT product_known"),
    ("INVALID_REVISION", "revision_n IS NULL"),
    ("INVALID_QUANTITY", "quantity_n IS NULL"),
    ("INVALID_OPERATION", "operation NOT IN ('UPSERT', 'CANCEL')"),
    ("INVALID_UNIT_PRICE_BRL", "price_n IS NULL"),
    ("INVALID_LINE_DISCOUNT_BRL", "discount_n IS NULL"),
    ("DISCOUNT_EXCEEDS_GROSS", "discount_n > price_n * CAST(quantity_n AS DECIMAL(10,0))"),
    ("INVALID_SOLD_AT", "sold_n IS NULL"),
    ("INVALID_SOURCE_UPDATED_AT", "updated_n IS NULL"),
]
_CODES = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {broken} THEN '{code}' END" for code, broken in _RULES
) + ")"
part("coded", ["measured"], f"SELECT *, {_CODES} AS codes FROM measured")


def _rule_query(name: str, codes: list[str], rules) -> None:
    chosen = [(code, broken) for code, broken in _RULES if code in codes]
    text = "concat_ws('|', " + ", ".join(
        f"CASE WHEN {broken} THEN '{code}' END" for code, broken in chosen
    ) + ")"
    sql = f"SELECT batch_id, row_id, codes FROM (SELECT *, {text} AS codes FROM measured) WHERE codes <> ''"
    sql = sql.replace("SELECT *, concat_ws", "SELECT batch_id, row_id, concat_ws")

    @query(name, ["measured"], sql)
    def run(spark, folder):
        failing = RC.failing_rows(checked(spark, folder), rules())
        return failing.select("batch_id", "row_id", F.concat_ws("|", "errors").alias("codes"))


_IDS = [f"INVALID_{n.upper()}" for n in ("source_system", "store_id", "sale_id", "line_id", "product_id")]
_rule_query("check_identifier", _IDS, RC.identifier_rules)
_rule_query("check_source", ["SOURCE_MISMATCH"], RC.source_rules)
_rule_query("check_file_store", ["FILE_STORE_MISMATCH"], RC.file_store_rules)
_rule_query("check_known_store", ["UNKNOWN_STORE"], RC.known_store_rules)
_rule_query("check_known_product", ["UNKNOWN_PRODUCT"], RC.known_product_rules)
_rule_query("check_revision", ["INVALID_REVISION"], RC.revision_rules)
_rule_query("check_quantity", ["INVALID_QUANTITY"], RC.quantity_rules)
_rule_query("check_operation", ["INVALID_OPERATION"], RC.operation_rules)
_rule_query("check_money", ["INVALID_UNIT_PRICE_BRL", "INVALID_LINE_DISCOUNT_BRL"], RC.money_rules)
_rule_query("check_discount", ["DISCOUNT_EXCEEDS_GROSS"], RC.discount_rules)
_rule_query("check_timestamp", ["INVALID_SOLD_AT", "INVALID_SOURCE_UPDATED_AT"], RC.timestamp_rules)
_rule_query("check_header", ["SCHEMA_MISMATCH"], RC.header_rules)
_rule_query("check_row_width", ["ROW_WIDTH_MISMATCH"], RC.width_rules)


@query(
    "collect_errors",
    ["coded"],
    "SELECT batch_id, row_id, codes FROM coded WHERE codes <> ''",
)
def collect_errors(spark, folder):
    failing = RC.failing_rows(checked(spark, folder), RC.all_rules())
    return failing.select("batch_id", "row_id", F.concat_ws("|", "errors").alias("codes"))


def _canonical_time(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


_CANONICAL = {
    "revision": "coalesce(CAST(revision_n AS VARCHAR), revision)",
    "quantity": "coalesce(CAST(quantity_n AS VARCHAR), quantity)",
    "unit_price_brl": "coalesce(CAST(price_n AS VARCHAR), unit_price_brl)",
    "line_discount_brl": "coalesce(CAST(discount_n AS VARCHAR), line_discount_brl)",
    "sold_at": f"coalesce({_canonical_time('sold_n')}, sold_at)",
    "source_updated_at": f"coalesce({_canonical_time('updated_n')}, source_updated_at)",
}
_JSON = " || ',' || ".join(
    f"'\"{name}\":' || CAST(to_json({_CANONICAL.get(name, name)}) AS VARCHAR)"
    for name in sorted(BUSINESS_FIELDS)
)
_HASH = f"sha256('{{' || {_JSON} || '}}')"


@query(
    "canonical_payload_hash",
    ["measured"],
    f"SELECT batch_id, row_id, {_HASH} AS payload_hash FROM measured",
)
def canonical_payload_hash(spark, folder):
    return RC.payload_hashes(raw(spark, folder)).select("batch_id", "row_id", "payload_hash")


part(
    "valid_rows",
    ["coded"],
    f"""
    SELECT batch_id, source_file, source_line, store_id, sale_id, line_id,
           CAST(revision_n AS INT) AS revision, CAST(quantity_n AS INT) AS quantity, operation,
           CAST(price_n AS DECIMAL(18,2)) AS unit_price_brl,
           CAST(discount_n AS DECIMAL(18,2)) AS line_discount_brl,
           CAST(timezone('America/Sao_Paulo', timezone('UTC', sold_n)) AS DATE) AS business_date,
           CAST(quantity_n * price_n - discount_n AS DECIMAL(24,2)) AS line_net_brl
    FROM coded WHERE codes = ''
    """,
)


@query(
    "type_events",
    ["valid_rows"],
    "SELECT * FROM valid_rows",
)
def type_events(spark, folder):
    return RC.type_events(bronze(spark, folder)).select(
        "batch_id", "source_file", "source_line", "store_id", "sale_id", "line_id", "revision",
        "quantity", "operation", "unit_price_brl", "line_discount_brl", "business_date",
        "line_net_brl",
    )


_SPLIT_CODES = "SELECT batch_id, source_file, source_line, unnest(string_split(codes, '|')) AS code FROM coded WHERE codes <> ''"


@query(
    "issue_rollup",
    ["coded"],
    f"""
    SELECT batch_id, code, 'ERROR' AS severity, count(*) AS count,
           min((source_file, source_line))[1] AS file, min((source_file, source_line))[2] AS line
    FROM ({_SPLIT_CODES}) GROUP BY batch_id, code
    """,
)
def issue_rollup(spark, folder):
    return D.issue_rollup(bronze(spark, folder)).drop("store_id")


@query(
    "delivery_stats",
    ["coded"],
    """
    SELECT batch_id, count(*) AS received, count(*) FILTER (codes = '') AS valid,
           count(*) FILTER (codes <> '') AS rejected,
           CAST(sum(CASE WHEN codes = '' THEN 0 ELSE len(string_split(codes, '|')) END) AS BIGINT)
               AS violations
    FROM coded GROUP BY batch_id
    """,
)
def delivery_stats(spark, folder):
    return D.delivery_stats(bronze(spark, folder))


@query(
    "received_operations",
    ["valid_rows"],
    """
    SELECT batch_id, count(*) FILTER (operation = 'CANCEL') AS valid_cancel_events,
           count(*) FILTER (revision > 1) AS valid_revision_gt1_events
    FROM valid_rows GROUP BY batch_id
    """,
)
def received_operations(spark, folder):
    return R.received_operations(bronze(spark, folder))
