"""Profile of the current state and its comparison with the state after the first batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import comparison as C
from tillclose.operators import profile as P
from tillclose.operators import row_contract as RC
from workload.base import part, query
from workload.feed import GOLD_COLUMNS, money, previous_state, state, stored, table

TOTALS_SQL = f"""
    count(*) AS active_lines, count(DISTINCT (source_system, store_id, sale_id)) AS sales,
    CAST(sum(quantity) AS BIGINT) AS units, {money("sum(net_cents)")} AS net_revenue_brl,
    {money("sum(gross_cents)")} AS gross_revenue_brl, {money("sum(discount_cents)")} AS discount_brl
"""


def active(spark, folder):
    return RC.active_lines(state(spark, folder))


def half_even(numerator: str, denominator: str) -> str:
    """SQL of a whole-number quotient rounded half to even; the numerator may be negative."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return f"""(SELECT CASE WHEN 2 * hr > hd OR (2 * hr = hd AND hq % 2 <> 0) THEN hq + 1 ELSE hq END
        FROM (SELECT hd, (hn - ((hn % hd) + hd) % hd) // hd AS hq, ((hn % hd) + hd) % hd AS hr
              FROM (SELECT {n} AS hn, nullif({d}, 0) AS hd)))"""


def sixth(numerator: str, denominator: str) -> str:
    """A quotient with six decimals."""
    rounded = half_even(f"({numerator}) * 1000000", denominator)
    return f"CAST(CAST({rounded} AS DECIMAL(30,0)) * CAST('0.000001' AS DECIMAL(7,6)) AS DECIMAL(28,6))"


@query("profile_totals", ["active"], f"SELECT {TOTALS_SQL} FROM active")
def profile_totals(spark, folder):
    return P.profile_totals(active(spark, folder))


def _metric_sql(name: str, cents: str) -> str:
    return f"""
    SELECT '{name}' AS metric, {money("a", "DECIMAL(18,2)")} AS min,
           {money("b", "DECIMAL(18,2)")} AS max, {sixth("t", "100 * n")} AS mean
    FROM (SELECT min({cents}) AS a, max({cents}) AS b, sum({cents}) AS t, count(*) AS n FROM active)
    """


@query(
    "profile_distributions",
    ["active"],
    " UNION ALL ".join(
        _metric_sql(name, cents)
        for name, cents in (
            ("quantity", "quantity * 100"),
            ("unit_price_brl", "unit_cents"),
            ("line_discount_brl", "discount_cents"),
        )
    ),
)
def profile_distributions(spark, folder):
    return P.profile_distributions(active(spark, folder)).drop("quantiles")


@query(
    "profile_quantiles",
    ["active"],
    """
    SELECT 'quantity' AS metric, p AS probability,
           CAST(list_extract(q, i) AS DECIMAL(18,2)) AS value
    FROM (SELECT quantile_disc(quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM active),
         (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS p, unnest(range(1, 6)) AS i)
    """,
)
def profile_quantiles(spark, folder):
    rows = P.profile_distributions(active(spark, folder))
    return P.profile_quantiles(rows, P.PROBABILITIES).filter("metric = 'quantity'")


@query("profile_money_quantiles")
def profile_money_quantiles(spark, folder):
    # Approximate by contract over many distinct values, so only the rows can be checked.
    rows = P.profile_distributions(active(spark, folder))
    return P.profile_quantiles(rows, P.PROBABILITIES).filter("metric <> 'quantity'")


def _groups_sql(key: str) -> str:
    return f"""
    , grouped AS (SELECT {key}, {TOTALS_SQL} FROM active GROUP BY {key})
    SELECT {key}, active_lines, sales, units, net_revenue_brl,
           (SELECT count(*) FROM grouped) AS group_count,
           (SELECT count(*) FROM grouped) > 20 AS truncated
    FROM grouped ORDER BY net_revenue_brl DESC, {key} LIMIT 20
    """


@query("profile_groups", ["active"], _groups_sql("product_id"))
def profile_groups(spark, folder):
    return P.profile_groups(active(spark, folder), "product_id")


@query("profile_store_groups", ["active"], _groups_sql("store_id"))
def profile_store_groups(spark, folder):
    return P.profile_groups(active(spark, folder), "store_id")


@query("top_groups_by_revenue", ["active"], _groups_sql("product_id").replace("20", "5"))
def top_groups_by_revenue(spark, folder):
    return P.profile_groups(active(spark, folder), "product_id", limit=5)


@query(
    "date_summary",
    ["state"],
    """
    , days AS (SELECT DISTINCT business_date AS d FROM state)
    SELECT min(d) AS start, max(d) AS "end", count(*) AS date_count, count(*) > 31 AS dates_truncated,
           (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d)
            FROM (SELECT d FROM days ORDER BY d LIMIT 31)) AS dates
    FROM days
    """,
)
def date_summary(spark, folder):
    summary = P.date_summary(state(spark, folder))
    return summary.withColumn("dates", F.expr("array_join(transform(dates, d -> string(d)), ',')"))


# ---- comparison -------------------------------------------------------------------------
part("days_now", ["state"], "SELECT DISTINCT business_date FROM state")
part("days_before", ["previous"], "SELECT DISTINCT business_date FROM previous")


def both(spark, folder):
    return state(spark, folder, ["business_date"]), previous_state(spark, folder, ["business_date"])


def received(now, before):
    return (
        now.filter("store_id <> 'S09'").select("store_id").distinct(),
        before.filter("store_id <> 'S03'").select("store_id").distinct(),
    )


#: What the totals of a comparison need, beside the key.
COMPARED = [*GOLD_COLUMNS, "unit_price_brl", "line_discount_brl"]


def scope_totals(spark, folder, *by):
    """Totals of both states over common days and stores. The states and the two short lists are tables of their
    own, so nothing is computed again and the rows need not move to meet the lists."""
    now, before = (stored(build(spark, folder, COMPARED), "state") for build in (state, previous_state))
    stores = stored(C.store_sides(*received(now, before)).filter("status = 'COMMON'"), "stores")
    days = stored(C.common_dates(now, before), "days")
    return C.equivalent_scope_totals(now, before, stores, *by, days=days)


part("received_now", ["state"], "SELECT DISTINCT store_id FROM state WHERE store_id <> 'S09'")
part(
    "received_before", ["previous"], "SELECT DISTINCT store_id FROM previous WHERE store_id <> 'S03'"
)


@query(
    "common_dates",
    ["days_now", "days_before"],
    "SELECT business_date FROM days_now INTERSECT SELECT business_date FROM days_before",
)
def common_dates(spark, folder):
    return C.common_dates(*both(spark, folder))


@query(
    "date_scope",
    ["days_now", "days_before"],
    """
    SELECT min(business_date) AS start, max(business_date) AS "end", count(*) AS date_count,
           EXISTS (SELECT * FROM days_now ANTI JOIN days_before USING (business_date))
           OR EXISTS (SELECT * FROM days_before ANTI JOIN days_now USING (business_date))
               AS dates_changed
    FROM days_now SEMI JOIN days_before USING (business_date)
    """,
)
def date_scope(spark, folder):
    return C.date_scope(*both(spark, folder))


@query(
    "common_stores",
    ["received_now", "received_before"],
    """
    SELECT store_id, CASE WHEN b.store_id IS NULL THEN 'ADDED' WHEN a.store_id IS NULL
           THEN 'REMOVED' ELSE 'COMMON' END AS status
    FROM received_now a FULL JOIN received_before b USING (store_id)
    """,
)
def common_stores(spark, folder):
    return C.store_sides(*received(*both(spark, folder)))


part(
    "recut",
    ["state", "previous", "days_now", "days_before", "received_now", "received_before"],
    """
    SELECT * FROM (
        SELECT 'current' AS side, * FROM state UNION ALL SELECT 'previous' AS side, * FROM previous)
    SEMI JOIN (SELECT * FROM days_now SEMI JOIN days_before USING (business_date))
        USING (business_date)
    SEMI JOIN (SELECT * FROM received_now SEMI JOIN received_before USING (store_id))
        USING (store_id)
    WHERE operation = 'UPSERT'
    """,
)


@query("equivalent_scope_totals", ["recut"], f"SELECT side, {TOTALS_SQL} FROM recut GROUP BY side")
def equivalent_scope_totals(spark, folder):
    return scope_totals(spark, folder)


part(
    "product_pairs",
    ["recut"],
    """
    SELECT product_id,
           count(*) FILTER (side = 'previous') AS l1, count(*) FILTER (side = 'current') AS l2,
           coalesce(sum(quantity) FILTER (side = 'previous'), 0) AS u1,
           coalesce(sum(quantity) FILTER (side = 'current'), 0) AS u2,
           coalesce(sum(gross_cents) FILTER (side = 'previous'), 0) AS g1,
           coalesce(sum(gross_cents) FILTER (side = 'current'), 0) AS g2
    FROM recut GROUP BY product_id
    """,
)


def _rule_sql(metric: str, n1: str, d1: str, n2: str, d2: str, unit: int) -> str:
    def quotient(n, d):
        return f"CASE WHEN {d} > 0 THEN {sixth(n, f'{unit} * ({d})')} END"

    return f"""
    SELECT product_id, '{metric}' AS metric,
           CASE WHEN l1 = 0 AND l2 = 0 THEN 'EMPTY' WHEN l1 = 0 OR l2 = 0 THEN 'NOT_COMPARABLE'
                WHEN least(l1, l2) < 3 THEN 'INSUFFICIENT_SAMPLE' WHEN {n1} = 0 THEN 'ZERO_BASELINE'
                WHEN 4 * abs({n2} * {d1} - {n1} * {d2}) > {n1} * {d2} THEN 'WARNING'
                ELSE 'STABLE' END AS status,
           {quotient(n1, d1)} AS previous, {quotient(n2, d2)} AS current
    FROM product_pairs
    """


@query(
    "mean_shift_rules",
    ["product_pairs"],
    f"""
    SELECT *, CASE WHEN status = 'WARNING' THEN 'WARNING' ELSE 'INFO' END AS severity,
           CAST(0.25 AS DECIMAL(9,4)) AS threshold
    FROM ({_rule_sql("quantity_mean", "u1", "l1", "u2", "l2", 1)}
          UNION ALL {_rule_sql("unit_price_mean_brl", "g1", "u1", "g2", "u2", 100)})
    """,
)
def mean_shift_rules(spark, folder):
    totals = scope_totals(spark, folder, "product_id")
    return C.mean_shift_rules(totals, "product_id").drop("difference", "relative_change")


@query(
    "mean_shift_totals",
    ["recut"],
    """
    , t AS (SELECT count(*) FILTER (side = 'previous') AS l1,
                   count(*) FILTER (side = 'current') AS l2,
                   sum(quantity) FILTER (side = 'previous') AS u1,
                   sum(quantity) FILTER (side = 'current') AS u2,
                   sum(gross_cents) FILTER (side = 'previous') AS g1,
                   sum(gross_cents) FILTER (side = 'current') AS g2 FROM recut)
    """
    + "\nUNION ALL ".join(
        f"""SELECT '{metric}' AS metric, 'STABLE' AS status,
            {sixth(f"CAST({n2} AS HUGEINT) * {d1} - CAST({n1} AS HUGEINT) * {d2}", f"CAST({d1} AS HUGEINT) * {d2} * {u}")} AS difference,
            {sixth(f"CAST({n2} AS HUGEINT) * {d1} - CAST({n1} AS HUGEINT) * {d2}", f"CAST({n1} AS HUGEINT) * {d2}")} AS relative_change
        FROM t"""
        for metric, n1, d1, n2, d2, u in (
            ("quantity_mean", "u1", "l1", "u2", "l2", 1),
            ("unit_price_mean_brl", "g1", "u1", "g2", "u2", 100),
        )
    ),
)
def mean_shift_totals(spark, folder):
    return C.mean_shift_rules(equivalent_scope_totals(spark, folder)).select(
        "metric", "status", "difference", "relative_change"
    )


# ---- status, coverage and catalogue of many publications -----------------------------------
# One publication per product: the state after both batches against the one after the first.
@query(
    "comparison_status",
    ["product_pairs"],
    """
    SELECT product_id, CASE WHEN right(product_id, 1) = '0' THEN 'NO_BASELINE'
        WHEN right(product_id, 1) = '1' THEN 'BASELINE_PROFILE_UNAVAILABLE'
        WHEN right(product_id, 1) = '2' AND l1 = 0 AND l2 = 0 THEN 'EMPTY'
        WHEN right(product_id, 1) = '2' THEN 'NOT_COMPARABLE'
        WHEN l1 = 0 AND l2 = 0 THEN 'EMPTY' WHEN l1 = 0 OR l2 = 0 THEN 'NOT_COMPARABLE'
        WHEN least(l1, l2) < 3 THEN 'INSUFFICIENT_SAMPLE' ELSE 'COMPARABLE' END AS status
    FROM product_pairs
    """,
)
def comparison_status(spark, folder):
    totals = scope_totals(spark, folder, "product_id")
    lines = totals.groupBy("product_id").agg(
        *(
            F.sum(F.when(F.col("side") == side, F.col("active_lines")).otherwise(0)).alias(
                f"{side}_active_lines"
            )
            for side in ("previous", "current")
        )
    )
    last = F.right("product_id", F.lit(1))
    pairs = lines.select(
        "*",
        F.when(last != "0", F.lit("baseline")).alias("baseline_publication_id"),
        F.when(last == "1", "INVALID").otherwise("AVAILABLE").alias("baseline_profile_status"),
        F.when(last == "2", 0).otherwise(12).alias("common_stores"),
        F.lit(1).alias("common_dates"),
        F.col("previous_active_lines").alias("previous_total_lines"),
        F.col("current_active_lines").alias("current_total_lines"),
    )
    return C.comparison_status(pairs).select("product_id", "status")


def book_coverage(spark, folder):
    """Daily coverage of each product's stores, one book per product, sequence = day number."""
    rows = state(spark, folder).select(
        F.col("product_id").alias("book_id"),
        F.datediff("business_date", F.lit("1990-01-01").cast("date")).alias("sequence"),
        "store_id",
        "operation",
    )
    cancelled = F.col("operation") == "CANCEL"
    return rows.groupBy("book_id", "sequence", "store_id").agg(
        F.max(F.lit(True)).alias("expected"),
        F.max(~cancelled).alias("received"),
        F.min(cancelled).alias("missing"),
        F.max(F.lit(False)).alias("zero_movement"),
    )


@query(
    "cumulative_coverage",
    ["state"],
    """
    , c AS (SELECT product_id AS book_id, date_diff('day', DATE '1990-01-01', business_date) AS seq,
                   store_id, bool_or(operation = 'UPSERT') AS received FROM state GROUP BY ALL),
    p AS (SELECT DISTINCT book_id, seq, seq % 5 <> 0 AS available FROM c),
    n AS (SELECT book_id, max(seq) AS newest FROM p GROUP BY book_id),
    b AS (SELECT book_id, newest, max(seq) FILTER (NOT available AND seq < newest) AS broken
          FROM p JOIN n USING (book_id) GROUP BY ALL)
    SELECT book_id, store_id, TRUE AS expected, bool_or(received) AS received,
           bool_or(NOT received AND seq = newest) AS missing, FALSE AS zero_movement,
           bool_and(broken IS NULL) AS scope_complete
    FROM c JOIN b USING (book_id) WHERE broken IS NULL OR seq > broken GROUP BY ALL
    """,
)
def cumulative_coverage(spark, folder):
    coverage = book_coverage(spark, folder)
    profiles = (
        coverage.select("book_id", "sequence")
        .distinct()
        .withColumn("available", F.col("sequence") % 5 != 0)
    )
    return C.cumulative_coverage(coverage, profiles)


@query(
    "coverage_over_limit",
    ["state"],
    """
    SELECT book_id, count(*) AS expected, count(*) FILTER (received) AS received FROM (
        SELECT product_id AS book_id, store_id, bool_or(operation = 'UPSERT') AS received
        FROM state GROUP BY ALL) GROUP BY book_id HAVING count(*) > 9
    """,
)
def coverage_over_limit(spark, folder):
    coverage = book_coverage(spark, folder)
    profiles = coverage.select("book_id", "sequence").distinct().withColumn("available", F.lit(True))
    covered = C.cumulative_coverage(coverage, profiles)
    return C.coverage_over_limit(covered, limit=9).select("book_id", "expected", "received")


@query(
    "catalog_context",
    [],
    """
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 THEN s_suppkey % 5 = 0
                           WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 2 = 0 END AS catalog_changed,
           CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 THEN 'approved_operator_catalog'
                ELSE 'received_catalog_bytes' END AS catalog_reference_origin,
           (s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0) OR s_suppkey % 4 <> 0
               AS catalog_identity_available
    FROM supplier
    """,
)
def catalog_context(spark, folder):
    key = F.col("s_suppkey")
    name = F.sha2("s_name", 256)
    other = F.lit("0" * 64)
    pairs = table(spark, folder, "supplier").select(
        "s_suppkey",
        F.when(key % 3 != 0, name).alias("previous_approved"),
        F.when(key % 7 != 0, F.when(key % 5 == 0, other).otherwise(name)).alias("current_approved"),
        F.when(key % 4 != 0, name).alias("previous_received"),
        F.when(key % 2 == 0, other).otherwise(name).alias("current_received"),
    )
    return C.catalog_context(pairs).select(
        "s_suppkey", "catalog_changed", "catalog_reference_origin", "catalog_identity_available"
    )


def damaged_totals(spark, folder):
    """Totals per product, some of them made inconsistent."""
    key = F.substring("product_id", 2, 20).cast("bigint")
    rows = P.profile_totals(active(spark, folder), "product_id")
    return rows.withColumns(
        {
            "net_revenue_brl": F.col("net_revenue_brl")
            + F.when(key % 5 == 1, F.lit("0.01").cast("decimal(3,2)")).otherwise(0),
            "sales": F.col("sales") + F.when(key % 7 == 2, 1000).otherwise(0),
            "units": F.when(key % 11 == 3, 0).otherwise(F.col("units")),
            "active_lines": F.when(key % 13 == 4, 0).otherwise(F.col("active_lines")),
        }
    )


@query(
    "profile_consistency",
    ["active"],
    f"""
    , t AS (SELECT product_id, CAST(substr(product_id, 2) AS BIGINT) AS k, {TOTALS_SQL}
            FROM active GROUP BY product_id),
    d AS (SELECT product_id, k,
                 CASE WHEN k % 7 = 2 THEN sales + 1000 ELSE sales END AS sales,
                 CASE WHEN k % 11 = 3 THEN 0 ELSE units END AS units,
                 CASE WHEN k % 13 = 4 THEN 0 ELSE active_lines END AS lines FROM t),
    c AS (SELECT product_id, concat_ws(',', CASE WHEN k % 5 = 1 THEN 'MONEY_BALANCE' END,
            CASE WHEN sales > lines THEN 'SALES_WITHIN_LINES' END,
            CASE WHEN lines > units THEN 'LINES_WITHIN_UNITS' END,
            CASE WHEN lines = 0 THEN 'EMPTY_IS_ZERO' END) AS broken FROM d)
    SELECT product_id, broken FROM c WHERE broken <> ''
    """,
)
def profile_consistency(spark, folder):
    found = P.profile_consistency(damaged_totals(spark, folder), P.totals_checks())
    return found.select("product_id", F.array_join("broken", ",").alias("broken"))


@query(
    "listing_consistency",
    ["active"],
    """
    , g AS (SELECT store_id, count(DISTINCT product_id) AS n FROM active GROUP BY store_id)
    SELECT store_id, 'TRUNCATION_FLAG' AS broken FROM g WHERE (n > 20) = (store_id < 'S07')
    """,
)
def listing_consistency(spark, folder):
    rows = (
        active(spark, folder)
        .groupBy("store_id")
        .agg(F.countDistinct("product_id").alias("group_count"))
        .withColumn("shown", F.least("group_count", F.lit(20)))
        .withColumn(
            "truncated",
            F.when(F.col("store_id") < "S07", F.col("group_count") <= 20).otherwise(
                F.col("group_count") > 20
            ),
        )
    )
    checks = P.listing_checks("group_count", "shown", "truncated")
    found = P.profile_consistency(rows, checks)
    return found.select("store_id", F.array_join("broken", ",").alias("broken"))


def profile_references(spark, folder):
    """One publication per event, most of them with a profile reference."""
    k = F.col("event_id")
    good = F.sha2(F.concat(F.lit("profile-"), k.cast("string")), 256)
    reference = F.struct(
        F.concat(F.lit("profiles/P"), k.cast("string"), F.lit(".json")).alias("path"),
        F.when(k % 11 == 4, F.upper(good)).otherwise(good).alias("sha256"),
        F.when(k % 13 == 5, 2).otherwise(1).alias("contract_version"),
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("P"), k.cast("string")).alias("publication_id"),
        F.concat(F.lit("R"), k.cast("string")).alias("run_id"),
        F.when(k % 7 != 3, reference).alias("profile"),
    )


def stored_profiles(spark, folder):
    k = F.col("event_id")
    good = F.sha2(F.concat(F.lit("profile-"), k.cast("string")), 256)
    return (
        table(spark, folder, "events")
        .filter("event_id % 17 <> 6")
        .select(
            F.concat(F.lit("profiles/P"), k.cast("string"), F.lit(".json")).alias("path"),
            F.when(k % 23 == 8, 2000000).otherwise(5000).alias("bytes"),
            F.when(k % 19 == 7, F.lit("0" * 64)).otherwise(good).alias("sha256"),
            F.concat(F.lit("P"), F.when(k % 29 == 9, k + 1).otherwise(k).cast("string")).alias(
                "publication_id"
            ),
            F.concat(F.lit("R"), k.cast("string")).alias("run_id"),
            (k % 31 != 10).alias("readable"),
        )
    )


@query(
    "profile_availability",
    [],
    """
    SELECT 'P' || event_id AS publication_id, 'R' || event_id AS run_id,
           CASE WHEN event_id % 7 = 3 THEN 'LEGACY'
                WHEN event_id % 11 = 4 AND sha256('profile-' || event_id) <> upper(sha256('profile-' || event_id))
                  THEN 'INVALID'
                WHEN event_id % 13 = 5 THEN 'INVALID' WHEN event_id % 17 = 6 THEN 'MISSING'
                WHEN event_id % 19 = 7 OR event_id % 23 = 8 OR event_id % 29 = 9
                     OR event_id % 31 = 10 THEN 'INVALID' ELSE 'AVAILABLE' END AS profile_status
    FROM events
    """,
)
def profile_availability(spark, folder):
    return P.profile_availability(profile_references(spark, folder), stored_profiles(spark, folder))
