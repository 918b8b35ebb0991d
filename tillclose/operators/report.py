"""Report figures over gold rows and attempts: shares, trends, matrix, slices, top lists.

Totals come as one-row scalar subqueries and top lists as ordered limits, so no window ever
holds more rows than a report shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillclose.functions.contract import instant, instant_text
from tillclose.schemas import (
    DAILY_LIMIT,  # noqa: F401  (part of the report's limits)
    ISSUE_LIMIT,
    LISTING_LIMIT,
    MATRIX_CELLS,
    MATRIX_DAYS,
    MIX_PRODUCTS,
    PRODUCT_LIMIT,
    RANKED_STORES,
    SEVERITY_RANK,
    STAGE_ORDER,
)


def limited_rows(frame: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows with their position and whether more exist.

    One row beyond the limit is fetched; the window sees only those rows.
    """
    head = frame.orderBy(*order).limit(limit + 1)
    return (
        head.withColumn("position", F.row_number().over(Window.orderBy(*order)))
        .withColumn("_fetched", F.count(F.lit(1)).over(Window.partitionBy()))
        .filter(F.col("position") <= limit)
        .withColumn("truncated", F.col("_fetched") > limit)
        .drop("_fetched")
    )


def top_products(product_day: DataFrame, limit: int = PRODUCT_LIMIT) -> DataFrame:
    grouped = product_day.groupBy("product_id").agg(
        F.sum("units").alias("units"),
        F.sum("net_revenue_brl").cast("decimal(28,2)").alias("net_revenue_brl"),
    )
    order = [F.col("units").desc(), F.col("net_revenue_brl").desc(), F.col("product_id")]
    return limited_rows(grouped, order, limit)


def store_day_listing(store_day: DataFrame, limit: int = LISTING_LIMIT) -> DataFrame:
    return limited_rows(store_day, [F.col("business_date"), F.col("store_id")], limit)


def _complete_totals(rows: DataFrame, key: str, metric: str, kind: str) -> DataFrame:
    """Sum per named group; one missing value leaves the whole group without a figure."""
    total = F.when(F.count_if(F.col(metric).isNull()) == 0, F.sum(metric).cast(kind))
    return (
        rows.filter(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "")
        .groupBy(key)
        .agg(total.alias("amount"))
    )


def _percent(amount: Column, total: Column) -> Column:
    share = amount.cast("decimal(28,2)") * 100 / F.nullif(total.cast("decimal(28,2)"), F.lit(0))
    return F.round(share, 2).cast("decimal(7,2)")


def store_revenue_share(rows: DataFrame, limit: int = RANKED_STORES) -> DataFrame:
    """Stores with most revenue and their share of all complete stores.

    No share is given when a store is negative or the total is not positive.
    """
    complete = _complete_totals(rows, "store_id", "net_revenue_brl", "decimal(28,2)").filter(
        "amount IS NOT NULL"
    )
    totals = complete.agg(
        F.struct(
            F.sum("amount").cast("decimal(28,2)").alias("total"),
            F.min("amount").alias("lowest"),
            F.count(F.lit(1)).alias("stores"),
        )
    ).scalar()
    order = [F.col("amount").desc(), F.col("store_id")]
    top = limited_rows(complete, order, limit).withColumn("t", totals)
    sharing = (F.col("t.lowest") >= 0) & (F.col("t.total") > 0)
    return top.select(
        F.col("position").alias("rank"),
        "store_id",
        F.col("amount").alias("net_revenue_brl"),
        F.when(sharing, _percent(F.col("amount"), F.col("t.total"))).alias("share_percent"),
        F.col("t.stores").alias("ranked_of"),
    )


def product_mix(rows: DataFrame, limit: int = MIX_PRODUCTS) -> DataFrame:
    """Units of the leading products and of all others together, with shares of the total."""
    totals = _complete_totals(rows, "product_id", "units", "bigint")
    whole = totals.agg(
        F.sum("amount").alias("total"),
        F.min("amount").alias("lowest"),
        F.count("amount").alias("known"),
        F.count(F.lit(1)).alias("products"),
    )
    order = [F.col("amount").desc_nulls_last(), F.col("product_id")]
    leading = totals.orderBy(*order).limit(limit)
    shown = leading.agg(
        F.struct(
            F.coalesce(F.sum("amount"), F.lit(0)).alias("units"),
            F.count("amount").alias("known"),
            F.count(F.lit(1)).alias("products"),
        )
    ).scalar()
    others = (
        whole.withColumn("s", shown)
        .filter("products > s.products")
        .select(
            F.lit("others").alias("product_id"),
            F.when(F.col("known") > F.col("s.known"), F.col("total") - F.col("s.units")).alias(
                "amount"
            ),
            (F.col("products") - F.col("s.products")).alias("grouped_products"),
        )
    )
    rows_out = leading.withColumn("grouped_products", F.lit(0).cast("bigint")).unionByName(others)
    base = whole.select(F.struct("total", "lowest")).scalar()
    sharing = (F.col("t.total") > 0) & (F.col("t.lowest") >= 0)
    return rows_out.withColumn("t", base).select(
        "product_id",
        F.col("amount").alias("units"),
        "grouped_products",
        F.when(sharing, _percent(F.col("amount"), F.col("t.total"))).alias("share_percent"),
    )


def daily_trend_points(rows: DataFrame) -> DataFrame:
    """One point per day that has exactly one row with a value; the peak is flagged, and so is
    a calendar with days that have no point."""
    days = (
        rows.filter("business_date IS NOT NULL")
        .groupBy("business_date")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("net_revenue_brl").alias("net_revenue_brl"),
        )
    )
    usable = (F.col("rows") == 1) & F.col("net_revenue_brl").isNotNull()
    facts = days.agg(
        F.struct(
            # Highest value first, then the earliest day.
            F.max_by(
                F.when(usable, F.col("business_date")),
                F.when(
                    usable,
                    F.struct("net_revenue_brl", (-F.unix_date("business_date")).alias("d")),
                ),
            ).alias("peak"),
            (F.datediff(F.max("business_date"), F.min("business_date")) + 1).alias("span"),
            F.count_if(usable).alias("points"),
        )
    ).scalar()
    return (
        days.filter(usable)
        .withColumn("f", facts)
        .select(
            "business_date",
            "net_revenue_brl",
            (F.col("business_date") == F.col("f.peak")).alias("is_peak"),
            (F.col("f.span") > F.col("f.points")).alias("has_gaps"),
        )
    )


def matrix_scope(rows: DataFrame, max_days: int = MATRIX_DAYS, max_cells: int = MATRIX_CELLS) -> DataFrame:
    """Size of the store by calendar day grid, and whether it is small enough to draw."""
    span = (F.datediff(F.max("business_date"), F.min("business_date")) + 1).alias("days")
    scope = rows.agg(
        span,
        F.countDistinct("store_id").alias("stores"),
        F.min("business_date").alias("first_date"),
        F.max("business_date").alias("last_date"),
    )
    return scope.withColumn(
        "allowed",
        (F.col("days") <= max_days) & (F.col("days") * F.col("stores") <= max_cells),
    )


def store_day_matrix(
    rows: DataFrame, max_days: int = MATRIX_DAYS, max_cells: int = MATRIX_CELLS
) -> DataFrame:
    """Dense grid of stores and calendar days; empty when the scope is refused.

    A cell is observed, missing or duplicated. The level places an observed value on a scale
    from the lowest (at most zero) to the highest value, in five steps.
    """
    scope = matrix_scope(rows, max_days, max_cells)
    bounds = scope.select(
        F.when(
            F.col("allowed"), F.struct(F.col("first_date").alias("a"), F.col("last_date").alias("b"))
        )
    ).scalar()
    observed = rows.groupBy("store_id", "business_date").agg(
        F.count(F.lit(1)).alias("records"), F.max("net_revenue_brl").alias("value")
    )
    value = F.when(F.col("records") == 1, F.col("value"))
    scale = observed.agg(
        F.struct(
            F.least(F.min(value), F.lit(0).cast("decimal(28,2)")).alias("low"),
            F.max(value).alias("high"),
        )
    ).scalar()
    grid = (
        rows.select("store_id")
        .distinct()
        .withColumn("_bounds", bounds)
        .filter("_bounds IS NOT NULL")
        .select(
            "store_id",
            F.explode(F.sequence(F.col("_bounds.a"), F.col("_bounds.b"))).alias("business_date"),
        )
    )
    cents = F.expr(
        "cast((value - s.low) * 100 as decimal(30,0)) * 5 "
        "div nullif(cast((s.high - s.low) * 100 as decimal(30,0)), 0)"
    )
    state = (
        F.when(F.col("records").isNull() | F.col("value").isNull(), "MISSING")
        .when(F.col("records") > 1, "DUPLICATE")
        .otherwise("OBSERVED")
    )
    return (
        grid.join(observed, ["store_id", "business_date"], "left")
        .withColumn("s", scale)
        .withColumn("state", state)
        .select(
            "store_id",
            "business_date",
            "state",
            F.when(F.col("state") == "OBSERVED", F.col("value")).alias("net_revenue_brl"),
            F.when(
                F.col("state") == "OBSERVED",
                F.coalesce(F.least(F.greatest(cents, F.lit(0)), F.lit(5)), F.lit(0)).cast("int"),
            ).alias("level"),
        )
    )


def _slice(
    rows: DataFrame, first: str | None, last: str | None, store: str | None
) -> DataFrame:
    if first and last and first > last:
        raise ValueError("the first date must not come after the last")
    if first:
        rows = rows.filter(F.col("business_date") >= F.lit(first).cast("date"))
    if last:
        rows = rows.filter(F.col("business_date") <= F.lit(last).cast("date"))
    if store:
        rows = rows.filter(F.col("store_id") == store)
    return rows


def _known_sum(column: str, kind: str) -> Column:
    """Sum of a column, null when there is no row or any value is missing."""
    return F.when(F.count_if(F.col(column).isNull()) == 0, F.sum(column).cast(kind))


def sales_slice(
    rows: DataFrame, first: str | None = None, last: str | None = None, store: str | None = None
) -> DataFrame:
    """Revenue, sales and units of a date range and store."""
    return _slice(rows, first, last, store).agg(
        _known_sum("net_revenue_brl", "decimal(28,2)").alias("net_revenue_brl"),
        _known_sum("sales_count", "bigint").alias("sales_count"),
        _known_sum("units", "bigint").alias("units"),
    )


def sales_slice_daily(
    rows: DataFrame, first: str | None = None, last: str | None = None, store: str | None = None
) -> DataFrame:
    return (
        _slice(rows, first, last, store)
        .groupBy("business_date")
        .agg(_known_sum("net_revenue_brl", "decimal(28,2)").alias("net_revenue_brl"))
    )


def recent_period(rows: DataFrame, days: int) -> DataFrame:
    """The last observed day and the day ``days - 1`` before it."""
    return rows.agg(F.max("business_date").alias("last_date")).select(
        F.date_sub("last_date", days - 1).alias("first_date"), "last_date"
    )


# ---- attempts ---------------------------------------------------------------------------
def rejection_rate(attempts: DataFrame) -> DataFrame:
    """Counters of each attempt; revision checks that did not run have no figure."""
    stats = F.col("stats")

    def counter(name: str) -> Column:
        return F.try_element_at(stats, F.lit(name))

    ran = F.coalesce(counter("revision_checks_executed") != 0, F.lit(True))
    rate = F.bround(
        counter("rejected").cast("decimal(20,0)")
        * 100
        / F.nullif(counter("received").cast("decimal(20,0)"), F.lit(0)),
        2,
    )
    return attempts.select(
        "run_id",
        *(counter(name).alias(name) for name in ("received", "valid", "rejected", "violations")),
        *(F.when(ran, counter(n)).alias(n) for n in ("duplicates", "conflicts", "stale")),
        rate.cast("decimal(12,2)").alias("rejected_percent"),
    )


def stage_durations(attempts: DataFrame) -> DataFrame:
    """Seconds per attempt and stage, numbered in pipeline order; unknown stages come last."""
    order = F.create_map(*(F.lit(v) for i, n in enumerate(STAGE_ORDER) for v in (n, i)))
    entries = F.array_sort(
        F.transform(
            F.map_entries("stages"),
            lambda e: F.struct(
                F.coalesce(F.try_element_at(order, e["key"]), F.lit(len(STAGE_ORDER))).alias("at"),
                e["key"].alias("stage"),
                e["value"].alias("seconds"),
            ),
        )
    )
    return attempts.select("run_id", F.posexplode(entries).alias("position", "e")).select(
        "run_id", (F.col("position") + 1).alias("position"), "e.stage", "e.seconds"
    )


def corrected_attempts(attempts: DataFrame, pointers: DataFrame) -> DataFrame:
    """The run of the official publication counts as published, whatever its record says."""
    official = pointers.select(
        "book_id",
        F.col("run_id").alias("_run"),
        F.col("publication_id").alias("_publication"),
    )
    unfinished = F.coalesce(
        (F.col("run_id") == F.col("_run")) & (F.col("state") != "PUBLISHED"), F.lit(False)
    )
    return (
        attempts.join(official, "book_id", "left")
        .withColumn("audit_incomplete", unfinished)
        .withColumn(
            "publication_id",
            F.when(unfinished, F.col("_publication")).otherwise(F.col("publication_id")),
        )
        .withColumn("state", F.when(unfinished, "PUBLISHED").otherwise(F.col("state")))
        .withColumn("is_official", F.coalesce(F.col("run_id") == F.col("_run"), F.lit(False)))
        .drop("_run", "_publication")
    )


def _newest(attempts: DataFrame) -> DataFrame:
    """Newest attempt per book by UTC start, then run id."""
    chosen = ["run_id", "state", "publication_id", "audit_incomplete", "is_official"]
    moment = instant(F.col("started_at"))
    newest = F.max_by(
        F.struct(*chosen, instant_text(moment).alias("started_utc")), F.struct(moment, "run_id")
    )
    return attempts.groupBy("book_id").agg(newest.alias("a")).select("book_id", "a.*")


def latest_attempt(attempts: DataFrame, pointers: DataFrame) -> DataFrame:
    return _newest(corrected_attempts(attempts, pointers))


def last_failed_attempt(attempts: DataFrame, pointers: DataFrame) -> DataFrame:
    failed = F.col("state").isin("BLOCKED", "TECHNICAL_FAILURE")
    return _newest(corrected_attempts(attempts, pointers).filter(failed))


def issues_by_severity(attempts: DataFrame, limit: int = ISSUE_LIMIT) -> DataFrame:
    """First issues of each attempt, loudest first and otherwise in their order.

    A missing store is folded under the missing file of the same store when both are shown.
    """
    ranks = F.create_map(*(F.lit(v) for pair in SEVERITY_RANK.items() for v in pair))
    ordered = F.array_sort(
        F.transform(
            "issues",
            lambda issue, at: F.struct(
                (-F.coalesce(F.try_element_at(ranks, issue["severity"]), F.lit(0))).alias("rank"),
                at.alias("at"),
                issue.alias("issue"),
            ),
        )
    )
    shown = F.slice(ordered, 1, limit)
    missing = F.transform(
        F.filter(F.col("shown"), lambda e: e["issue"]["code"] == "MISSING_FILE"),
        lambda e: e["issue"]["store_id"],
    )
    code, store = F.col("e.issue.code"), F.col("e.issue.store_id")
    return (
        attempts.select("run_id", shown.alias("shown"))
        .select("run_id", missing.alias("missing"), F.posexplode("shown").alias("position", "e"))
        .select(
            "run_id",
            (F.col("position") + 1).alias("position"),
            code.alias("code"),
            F.col("e.issue.severity").alias("severity"),
            store.alias("store_id"),
            F.coalesce(
                (code == "MISSING_STORE") & F.array_contains("missing", store), F.lit(False)
            ).alias("folded"),
        )
    )
