"""Report figures and explanations over the gold rows and the current state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import report as R
from tillclose.operators import serving as S
from tillclose.operators import delivery as D
from workload import q_delivery
from workload.base import part, query
from workload.feed import feed, half_up, money, product_day, state, store_day, table

NET = f"{money('net_cents')} AS net_revenue_brl"

part(
    "store_totals",
    ["store_cents"],
    "SELECT store_id, CAST(sum(net_cents) AS HUGEINT) AS cents FROM store_cents GROUP BY store_id",
)
part(
    "product_totals",
    ["product_cents"],
    "SELECT product_id, CAST(sum(net_cents) AS HUGEINT) AS cents, "
    "CAST(sum(units) AS HUGEINT) AS units FROM product_cents GROUP BY product_id",
)


def percent(part_sql: str, whole: str) -> str:
    hundredths = half_up(f"({part_sql}) * 10000", whole)
    return f"CAST(CAST({hundredths} AS DECIMAL(20,0)) * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(7,2))"


@query(
    "store_revenue_share",
    ["store_totals"],
    f"""
    SELECT row_number() OVER (ORDER BY cents DESC, store_id) AS rank, store_id,
           {money("cents")} AS net_revenue_brl,
           {percent("cents", "(SELECT sum(cents) FROM store_totals)")} AS share_percent,
           (SELECT count(*) FROM store_totals) AS ranked_of
    FROM store_totals ORDER BY cents DESC, store_id LIMIT 6
    """,
)
def store_revenue_share(spark, folder):
    return R.store_revenue_share(store_day(spark, folder))


def with_holes(rows):
    """Gold rows with some figures missing and some store names blank."""
    day = F.dayofyear("business_date")
    return rows.withColumn(
        "net_revenue_brl",
        F.when(~((F.col("store_id") == "S02") & (day == 100)), F.col("net_revenue_brl")),
    ).withColumn("store_id", F.when(F.col("store_id") != "S08", F.col("store_id")).otherwise(" "))


@query(
    "store_revenue_share_incomplete",
    ["store_totals"],
    f"""
    , kept AS (SELECT * FROM store_totals WHERE store_id NOT IN ('S02', 'S08'))
    SELECT row_number() OVER (ORDER BY cents DESC, store_id) AS rank, store_id,
           {money("cents")} AS net_revenue_brl,
           {percent("cents", "(SELECT sum(cents) FROM kept)")} AS share_percent,
           (SELECT count(*) FROM kept) AS ranked_of
    FROM kept ORDER BY cents DESC, store_id LIMIT 6
    """,
)
def store_revenue_share_incomplete(spark, folder):
    return R.store_revenue_share(with_holes(store_day(spark, folder)))


@query(
    "product_mix",
    ["product_totals"],
    f"""
    , ranked AS (SELECT *, row_number() OVER (ORDER BY units DESC, product_id) AS rn
                 FROM product_totals),
    mixed AS (SELECT CASE WHEN rn <= 5 THEN product_id ELSE 'others' END AS product_id,
                     sum(units) AS u, count(*) AS n, min(rn) AS rn FROM ranked GROUP BY 1)
    SELECT product_id, CAST(u AS BIGINT) AS units, CASE WHEN rn <= 5 THEN 0 ELSE n END AS grouped_products,
           {percent("CAST(u AS HUGEINT)", "(SELECT sum(units) FROM product_totals)")} AS share_percent
    FROM mixed
    """,
)
def product_mix(spark, folder):
    return R.product_mix(product_day(spark, folder))


def daily_rows(spark, folder):
    """Revenue per day; some days twice, some without a figure."""
    days = (
        store_day(spark, folder)
        .groupBy("business_date")
        .agg(F.sum("net_revenue_brl").cast("decimal(28,2)").alias("net_revenue_brl"))
    )
    number = F.datediff("business_date", F.lit("1990-01-01").cast("date"))
    copies = F.when(number % 50 == 3, 2).otherwise(1)
    return days.withColumn(
        "net_revenue_brl", F.when(number % 40 != 7, F.col("net_revenue_brl"))
    ).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))


part(
    "points",
    ["store_cents"],
    """
    SELECT business_date, sum(net_cents) AS cents FROM store_cents
    WHERE date_diff('day', DATE '1990-01-01', business_date) % 50 <> 3
      AND date_diff('day', DATE '1990-01-01', business_date) % 40 <> 7
    GROUP BY business_date
    """,
)


@query(
    "daily_trend_points",
    ["points"],
    f"""
    SELECT business_date, {money("cents")} AS net_revenue_brl,
           business_date = (SELECT business_date FROM points ORDER BY cents DESC, business_date LIMIT 1)
               AS is_peak, TRUE AS has_gaps
    FROM points
    """,
)
def daily_trend_points(spark, folder):
    return R.daily_trend_points(daily_rows(spark, folder))


part(
    "grid_scope",
    ["store_cents"],
    "SELECT min(business_date) AS a, max(business_date) AS b, "
    "CAST(date_diff('day', min(business_date), max(business_date)) + 1 AS INT) AS days, "
    "count(DISTINCT store_id) AS stores FROM store_cents",
)


@query(
    "matrix_scope",
    ["grid_scope"],
    "SELECT days, stores, a AS first_date, b AS last_date, days <= 366 AND days * stores <= 1200 "
    "AS allowed FROM grid_scope",
)
def matrix_scope(spark, folder):
    return R.matrix_scope(store_day(spark, folder))


@query(
    "store_day_matrix",
    ["store_cents", "grid_scope"],
    f"""
    , s AS (SELECT least(min(net_cents), 0) AS low, max(net_cents) AS high FROM store_cents)
    SELECT store_id, CAST(d AS DATE) AS business_date,
           CASE WHEN net_cents IS NULL THEN 'MISSING' ELSE 'OBSERVED' END AS state, {NET},
           CAST(CASE WHEN net_cents IS NOT NULL
                THEN least(5, greatest(0, (net_cents - low) * 5 // (high - low))) END AS INT) AS level
    FROM (SELECT DISTINCT store_id FROM store_cents),
         (SELECT unnest(range(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1 DAY,
                              INTERVAL 1 DAY)) AS d FROM grid_scope), s
    LEFT JOIN store_cents c USING (store_id)
    """.replace(
        "LEFT JOIN store_cents c USING (store_id)",
        "LEFT JOIN (SELECT store_id AS st, business_date AS bd, net_cents FROM store_cents) "
        "ON st = store_id AND bd = CAST(d AS DATE)",
    ),
)
def store_day_matrix(spark, folder):
    # Limits wide enough for the whole calendar of the feed.
    return R.store_day_matrix(store_day(spark, folder), max_days=20000, max_cells=2000000)


@query(
    "store_day_matrix_refused",
    ["store_cents"],
    "SELECT store_id, business_date FROM store_cents WHERE FALSE",
)
def store_day_matrix_refused(spark, folder):
    return R.store_day_matrix(store_day(spark, folder)).select("store_id", "business_date")


SLICE = "business_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND store_id = 'S03'"


@query(
    "sales_slice",
    ["store_cents"],
    f"""
    SELECT {money("sum(net_cents)")} AS net_revenue_brl,
           CAST(sum(sales_count) AS BIGINT) AS sales_count, CAST(sum(units) AS BIGINT) AS units
    FROM store_cents WHERE {SLICE}
    """,
)
def sales_slice(spark, folder):
    return R.sales_slice(store_day(spark, folder), "1996-01-01", "1997-12-31", "S03")


@query(
    "sales_slice_daily",
    ["store_cents"],
    f"""
    SELECT business_date, CASE WHEN dayofyear(business_date) <> 100 OR count(*) FILTER
               (store_id = 'S02') = 0 THEN {money("sum(net_cents)")} END AS net_revenue_brl
    FROM store_cents GROUP BY business_date
    """,
)
def sales_slice_daily(spark, folder):
    return R.sales_slice_daily(with_holes(store_day(spark, folder)))


@query(
    "recent_period",
    ["store_cents"],
    "SELECT max(business_date) - 6 AS first_date, max(business_date) AS last_date FROM store_cents",
)
def recent_period(spark, folder):
    return R.recent_period(store_day(spark, folder), 7)


# ---- top lists --------------------------------------------------------------------------
@query(
    "limited_rows",
    ["store_cents"],
    "SELECT business_date, store_id, units, row_number() OVER (ORDER BY units DESC, business_date, "
    "store_id) AS position, (SELECT count(*) FROM store_cents) > 50 AS truncated "
    "FROM store_cents ORDER BY position LIMIT 50",
)
def limited_rows(spark, folder):
    rows = store_day(spark, folder).select("business_date", "store_id", "units")
    order = [F.col("units").desc(), F.col("business_date"), F.col("store_id")]
    return R.limited_rows(rows, order, 50)


@query(
    "top_products",
    ["product_totals"],
    f"""
    SELECT product_id, CAST(units AS BIGINT) AS units, {money("cents")} AS net_revenue_brl,
           row_number() OVER (ORDER BY units DESC, cents DESC, product_id) AS position,
           (SELECT count(*) FROM product_totals) > 20 AS truncated
    FROM product_totals ORDER BY position LIMIT 20
    """,
)
def top_products(spark, folder):
    return R.top_products(product_day(spark, folder))


@query(
    "store_day_listing",
    ["store_cents"],
    f"""
    SELECT business_date, store_id, {NET}, units, item_lines, sales_count,
           {money(half_up('net_cents', 'sales_count'))} AS average_ticket_brl,
           row_number() OVER (ORDER BY business_date, store_id) AS position,
           (SELECT count(*) FROM store_cents) > 500 AS truncated
    FROM store_cents ORDER BY position LIMIT 500
    """,
)
def store_day_listing(spark, folder):
    return R.store_day_listing(store_day(spark, folder))


# ---- explanation ------------------------------------------------------------------------
KEY = "source_system, store_id, sale_id, line_id"
EXPLAINED = (
    f"{KEY}, revision, operation, business_date, product_id, CAST(quantity AS INT) AS quantity, "
    f"{money('net_cents', 'DECIMAL(24,2)')} AS line_net_brl, batch_id, run_id, source_file, "
    "source_line, payload_hash"
)
part("chosen", ["active"], "SELECT * FROM active WHERE store_id = 'S05'")


@query(
    "explain_contributions",
    ["chosen"],
    f"""
    SELECT {EXPLAINED}, row_number() OVER (ORDER BY {KEY}) AS position,
           (SELECT count(*) FROM chosen) > 100 AS truncated FROM chosen ORDER BY position LIMIT 100
    """,
)
def explain_contributions(spark, folder):
    return S.explain_contributions(state(spark, folder), store_id="S05", limit=100)


@query(
    "explain_totals",
    ["chosen"],
    f"SELECT {money('sum(net_cents)')} AS net_revenue_brl, CAST(sum(quantity) AS BIGINT) AS units, "
    "count(*) AS item_lines FROM chosen",
)
def explain_totals(spark, folder):
    return S.explain_totals(state(spark, folder), store_id="S05")


@query(
    "explain_totals_empty",
    [],
    "SELECT CAST(0 AS DECIMAL(28,2)) AS net_revenue_brl, 0 AS units, 0 AS item_lines",
)
def explain_totals_empty(spark, folder):
    return S.explain_totals(state(spark, folder), store_id="S05", business_date="2060-01-01")


@query(
    "explain_revisions",
    ["feed", "chosen"],
    f"""
    , sampled AS (SELECT {KEY} FROM chosen ORDER BY {KEY} LIMIT 100),
    found AS (SELECT {EXPLAINED} FROM feed SEMI JOIN sampled USING ({KEY}))
    SELECT *, row_number() OVER (ORDER BY {KEY}, revision) AS position,
           (SELECT count(*) FROM found) > 100 AS truncated FROM found ORDER BY position LIMIT 100
    """,
)
def explain_revisions(spark, folder):
    return S.explain_revisions(
        state(spark, folder), feed(spark, folder), store_id="S05", limit=100
    )


@query(
    "coverage_labels",
    ["coverage"],
    """
    , n AS (SELECT batch_id, count(*) FILTER (expected AND received) AS confirmed,
                   count(*) FILTER (expected) AS expected_stores FROM coverage GROUP BY batch_id)
    SELECT batch_id, store_id, CASE WHEN NOT expected THEN 'NOT_EXPECTED' WHEN NOT received
           THEN 'PENDING' WHEN zero_movement THEN 'ZERO_CONFIRMED' ELSE 'DELIVERED' END AS label,
           confirmed, expected_stores
    FROM coverage JOIN n USING (batch_id)
    """,
)
def coverage_labels(spark, folder):
    return S.coverage_labels(q_delivery.delivery_coverage(spark, folder))


# ---- attempts: one per event, one book for every 97th event -----------------------------
STATES = """
    CASE WHEN event_id % 41 = 11 THEN 'RUNNING' WHEN event_type = 'view' THEN 'VALIDATED'
         WHEN event_type = 'purchase' THEN 'PUBLISHED' WHEN event_type = 'signup' THEN 'NO_CHANGE'
         WHEN event_type = 'click' THEN 'BLOCKED' ELSE 'TECHNICAL_FAILURE' END
"""
HAS_FILE = "event_type = 'click' AND event_id % 3 = 0"


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "event_type", "value").withColumn(
        "k", F.col("event_id")
    )


def attempts(spark, folder):
    """Attempts with the shape of the attempt record, keyed by book."""
    k = F.col("event_id")
    text = k.cast("string")
    moment = F.col("ts").cast("timestamp")
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    started = F.when(k % 2 == 0, F.concat(F.date_format(moment, pattern), F.lit("+00:00"))).otherwise(
        F.concat(F.date_format(moment - F.expr("INTERVAL 3 HOURS"), pattern), F.lit("-03:00"))
    )

    def entry(code, severity, store, file, when):
        return F.when(
            when,
            F.struct(
                F.lit(code).alias("code"),
                F.lit(severity).alias("severity"),
                F.lit(1).cast("bigint").alias("count"),
                F.lit(store).alias("store_id"),
                F.lit(file).alias("file"),
                F.lit(None).cast("int").alias("line"),
            ),
        )

    blocked = F.col("event_type") == "click"
    no_file = blocked & (k % 3 == 0)
    issues = F.array_compact(
        F.array(
            entry("STALE_REVISION", "INFO", None, None, k % 5 == 0),
            entry("ODD_TOTAL", "WARNING", None, None, k % 7 == 0),
            entry("MISSING_STORE", "ERROR", "S01", None, no_file),
            entry("MISSING_FILE", "ERROR", "S01", "S01.csv", no_file),
            entry("MISSING_STORE", "ERROR", "S02", None, no_file),
            entry("HASH_MISMATCH", "ERROR", None, "S03.csv", blocked),
        )
    )
    stats = F.map_from_arrays(
        F.array(*map(F.lit, ["received", "valid", "rejected", "violations", "duplicates",
                             "conflicts", "stale", "revision_checks_executed"])),
        F.array(k % 900, k % 900 - k % 7, k % 7, k % 7 * 2, k % 11, k % 3, k % 5,
                F.when(blocked, 0).otherwise(1).cast("bigint")),
    )
    seconds = F.floor(F.col("value") * 100) / 100
    stages = F.map_from_arrays(
        F.array(*map(F.lit, ["quality", "ingestion", "extra", "complete"])),
        F.array(seconds, seconds + 1, seconds + 2, seconds + 3),
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("K"), (k % 97).cast("string")).alias("book_id"),
        F.concat(F.lit("R"), text).alias("run_id"),
        F.concat(F.lit("B"), text).alias("batch_id"),
        F.expr(STATES).alias("state"),
        started.alias("started_at"),
        F.when(k % 41 != 11, started).alias("finished_at"),
        issues.alias("issues"),
        stats.alias("stats"),
        stages.alias("stages"),
        F.when(
            F.col("event_type") == "purchase", F.concat(F.lit("P"), text)
        ).when(
            F.col("event_type") == "signup", F.concat(F.lit("P"), (k - 194).cast("string"))
        ).alias("publication_id"),
        F.when(F.col("event_type") == "view", "validate").otherwise("publish").alias("job_mode"),
        "event_id",
    )


def pointers(spark, folder):
    """Official publication of each book: that of its last purchase or error; some have none."""
    rows = table(spark, folder, "events").filter(
        "event_type IN ('purchase', 'error') AND event_id % 97 % 10 <> 9"
    )
    return (
        rows.groupBy((F.col("event_id") % 97).alias("n"))
        .agg(F.max("event_id").cast("string").alias("e"))
        .select(
            F.concat(F.lit("K"), F.col("n").cast("string")).alias("book_id"),
            F.concat(F.lit("R"), F.col("e")).alias("run_id"),
            F.concat(F.lit("P"), F.col("e")).alias("publication_id"),
        )
    )


def books(spark, folder):
    return table(spark, folder, "events").select(
        F.concat(F.lit("K"), (F.col("event_id") % 97).cast("string")).alias("book_id")
    ).distinct()


part(
    "attempts",
    [],
    f"""
    SELECT *, 'K' || (event_id % 97) AS book_id, 'R' || event_id AS run_id, {STATES} AS state,
           strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_utc,
           CASE WHEN event_type = 'purchase' THEN 'P' || event_id
                WHEN event_type = 'signup' THEN 'P' || (event_id - 194) END AS publication_id,
           {HAS_FILE} AS has_file
    FROM events
    """,
)
part(
    "pointers",
    [],
    """
    SELECT 'K' || n AS book_id, 'R' || e AS run_id, 'P' || e AS publication_id
    FROM (SELECT event_id % 97 AS n, max(event_id) AS e FROM events
          WHERE event_type IN ('purchase', 'error') AND event_id % 97 % 10 <> 9 GROUP BY 1)
    """,
)
part(
    "corrected",
    ["attempts", "pointers"],
    """
    SELECT a.* EXCLUDE (state, publication_id), coalesce(a.run_id = p.run_id, FALSE) AS is_official,
           coalesce(a.run_id = p.run_id, FALSE) AND state <> 'PUBLISHED' AS audit_incomplete,
           CASE WHEN a.run_id = p.run_id THEN 'PUBLISHED' ELSE state END AS state,
           CASE WHEN a.run_id = p.run_id AND state <> 'PUBLISHED' THEN p.publication_id
                ELSE a.publication_id END AS publication_id
    FROM attempts a LEFT JOIN pointers p ON a.book_id = p.book_id
    """,
)
part(
    "newest",
    ["corrected"],
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts DESC, run_id DESC) "
    "AS rn FROM corrected) WHERE rn = 1",
)
NEWEST = "book_id, run_id, state, publication_id, audit_incomplete, is_official, started_utc"


@query("latest_attempt", ["newest"], f"SELECT {NEWEST} FROM newest")
def latest_attempt(spark, folder):
    return R.latest_attempt(attempts(spark, folder), pointers(spark, folder))


@query(
    "last_failed_attempt",
    ["corrected"],
    f"""
    SELECT {NEWEST} FROM (SELECT *, row_number() OVER (PARTITION BY book_id
        ORDER BY ts DESC, run_id DESC) AS rn FROM corrected
        WHERE state IN ('BLOCKED', 'TECHNICAL_FAILURE')) WHERE rn = 1
    """,
)
def last_failed_attempt(spark, folder):
    return R.last_failed_attempt(attempts(spark, folder), pointers(spark, folder))


@query(
    "close_decision",
    ["newest", "pointers"],
    """
    SELECT n.book_id, n.run_id, p.publication_id AS official_publication,
           CASE WHEN audit_incomplete THEN 'PUBLISHED_AUDIT_INCOMPLETE'
                WHEN state = 'BLOCKED' AND has_file THEN 'BLOCKED_MISSING_FILE'
                WHEN state = 'BLOCKED' THEN 'BLOCKED'
                WHEN state = 'TECHNICAL_FAILURE' THEN 'FAILED_BEFORE_PUBLICATION'
                WHEN state = 'RUNNING' THEN 'RUNNING' WHEN state = 'NO_CHANGE' THEN 'PUBLICATION_KEPT'
                WHEN state = 'VALIDATED' THEN 'VALIDATED_ONLY'
                WHEN p.publication_id IS NOT NULL THEN 'PUBLISHED' ELSE 'NOTHING_PUBLISHED' END
               AS decision
    FROM newest n LEFT JOIN pointers p ON n.book_id = p.book_id
    """,
)
def close_decision(spark, folder):
    return S.close_decision(
        attempts(spark, folder), pointers(spark, folder), books(spark, folder)
    )


@query(
    "rejection_rate",
    ["attempts"],
    """
    , c AS (SELECT run_id, event_id % 900 AS received, event_id % 7 AS rejected, event_id, event_type
            FROM attempts)
    SELECT run_id, received, received - rejected AS valid, rejected, rejected * 2 AS violations,
           CASE WHEN event_type <> 'click' THEN event_id % 11 END AS duplicates,
           CASE WHEN event_type <> 'click' THEN event_id % 3 END AS conflicts,
           CASE WHEN event_type <> 'click' THEN event_id % 5 END AS stale,
           CASE WHEN received > 0 THEN CAST(CAST(
                CASE WHEN 2 * (rejected * 10000 % received) > received
                       OR (2 * (rejected * 10000 % received) = received
                           AND (rejected * 10000 // received) % 2 = 1)
                     THEN rejected * 10000 // received + 1 ELSE rejected * 10000 // received END
                AS DECIMAL(20,0)) * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(12,2)) END
               AS rejected_percent
    FROM c
    """,
)
def rejection_rate(spark, folder):
    return R.rejection_rate(attempts(spark, folder))


@query(
    "stage_durations",
    ["attempts"],
    """
    SELECT run_id, p AS position, s AS stage, floor(value * 100) / 100 + d AS seconds
    FROM attempts, (SELECT unnest([1, 2, 3, 4]) AS p, unnest([1, 0, 3, 2]) AS d,
                           unnest(['ingestion', 'quality', 'complete', 'extra']) AS s)
    """,
)
def stage_durations(spark, folder):
    return R.stage_durations(attempts(spark, folder))


@query(
    "issues_by_severity",
    ["attempts"],
    """
    , listed AS (
      SELECT run_id, unnest([1, 2, 3, 4, 5, 6]) AS pos,
             unnest(['STALE_REVISION', 'ODD_TOTAL', 'MISSING_STORE', 'MISSING_FILE', 'MISSING_STORE',
                     'HASH_MISMATCH']) AS code,
             unnest(['INFO', 'WARNING', 'ERROR', 'ERROR', 'ERROR', 'ERROR']) AS severity,
             unnest([NULL, NULL, 'S01', 'S01', 'S02', NULL]) AS store_id,
             unnest([event_id % 5 = 0, event_id % 7 = 0, has_file, has_file, has_file,
                     event_type = 'click']) AS present FROM attempts)
    SELECT run_id, code, severity, store_id,
           row_number() OVER (PARTITION BY run_id ORDER BY CASE severity WHEN 'ERROR' THEN 1
                              WHEN 'WARNING' THEN 2 ELSE 3 END, pos) AS position,
           coalesce(code = 'MISSING_STORE' AND store_id = 'S01', FALSE) AS folded
    FROM listed WHERE present
    """,
)
def issues_by_severity(spark, folder):
    return R.issues_by_severity(attempts(spark, folder))
