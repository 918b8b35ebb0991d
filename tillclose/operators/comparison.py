"""Like-for-like comparison of two published states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.functions.money import half_even, ratio
from tillclose.operators.profile import profile_totals
from tillclose.operators.row_contract import active_lines

# Default parameters of the comparison.
MIN_LINES = 3
QUANTITY_THRESHOLD = "0.25"
PRICE_THRESHOLD = "0.25"
RULES = {
    "quantity_mean": ("units", "active_lines"),
    "unit_price_mean_brl": ("gross_revenue_brl", "units"),
}


def _two_sided(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both sides in one grouping, with a flag per side."""

    def tag(frame: DataFrame, now: bool) -> DataFrame:
        return frame.select(*keys, F.lit(now).alias("_now"), F.lit(not now).alias("_before"))

    return (
        tag(current, True)
        .unionByName(tag(previous, False))
        .groupBy(*keys)
        .agg(F.max("_now").alias("in_current"), F.max("_before").alias("in_previous"))
    )


def date_sides(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Every business day of either state and the sides it belongs to."""
    return _two_sided(current, previous, ["business_date"])


def common_dates(current: DataFrame, previous: DataFrame) -> DataFrame:
    return (
        date_sides(current, previous)
        .filter("in_current AND in_previous")
        .select("business_date")
    )


def date_scope(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Range and number of the common days, and whether either side has other days."""
    both = F.col("in_current") & F.col("in_previous")
    return date_sides(current, previous).agg(
        F.min(F.when(both, F.col("business_date"))).alias("start"),
        F.max(F.when(both, F.col("business_date"))).alias("end"),
        F.count_if(both).alias("date_count"),
        F.coalesce(F.max(~both), F.lit(False)).alias("dates_changed"),
    )


def store_sides(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Stores received on either side: common, added or removed."""
    status = (
        F.when(F.col("in_current") & F.col("in_previous"), "COMMON")
        .when(F.col("in_current"), "ADDED")
        .otherwise("REMOVED")
    )
    return _two_sided(current, previous, ["store_id"]).select("store_id", status.alias("status"))


def equivalent_scope_totals(
    current: DataFrame, previous: DataFrame, stores: DataFrame, *by: str, days: DataFrame | None = None
) -> DataFrame:
    """Profile totals of both states limited to common days and the given stores. ``days`` are the common days
    where the caller has stored them, so that Spark knows how few they are."""
    if days is None:
        days = common_dates(current, previous)
    rows = active_lines(current).withColumn("side", F.lit("current")).unionByName(
        active_lines(previous).withColumn("side", F.lit("previous"))
    )
    recut = rows.join(days, "business_date", "left_semi").join(
        stores.select("store_id"), "store_id", "left_semi"
    )
    return profile_totals(recut, "side", *by)


def _pair(totals: DataFrame, by: list[str]) -> DataFrame:
    """Totals of both sides in one row; an absent side has zero lines."""
    figures = ["active_lines", "sales", "units", "net_revenue_brl", "gross_revenue_brl"]
    sides = ["previous", "current"]
    return totals.groupBy(*by).agg(
        *(
            F.coalesce(F.max(F.when(F.col("side") == side, F.col(name))), F.lit(0)).alias(
                f"{side}_{name}"
            )
            for side in sides
            for name in figures
        )
    )


def sample_status(previous_lines: Column, current_lines: Column, minimum: int) -> Column:
    """Whether the two samples can be compared at all."""
    return (
        F.when((previous_lines == 0) & (current_lines == 0), "EMPTY")
        .when((previous_lines == 0) | (current_lines == 0), "NOT_COMPARABLE")
        .when(F.least(previous_lines, current_lines) < minimum, "INSUFFICIENT_SAMPLE")
        .otherwise("COMPARABLE")
    )


def mean_shift_rules(
    totals: DataFrame,
    *by: str,
    min_lines: int = MIN_LINES,
    quantity_threshold: str = QUANTITY_THRESHOLD,
    price_threshold: str = PRICE_THRESHOLD,
) -> DataFrame:
    """Mean quantity and mean price of both sides: stable, warning or no baseline.

    ``totals`` has one row per side (and ``by``). The threshold is tested on products of whole
    totals, not on rounded means.
    """
    thresholds = {"quantity_mean": quantity_threshold, "unit_price_mean_brl": price_threshold}
    paired = _pair(totals, list(by)).withColumn(
        "sample",
        sample_status(F.col("previous_active_lines"), F.col("current_active_lines"), min_lines),
    )
    entries = []
    for metric, (numerator, denominator) in RULES.items():
        n1, d1, n2, d2 = (
            F.col(f"{side}_{name}").cast("decimal(28,2)")
            for side in ("previous", "current")
            for name in (numerator, denominator)
        )
        before, after = ratio(n1, d1), ratio(n2, d2)
        threshold = F.lit(thresholds[metric]).cast("decimal(9,4)")
        # |n2/d2 - n1/d1| > t * n1/d1 with positive denominators, multiplied out.
        old, new = (n1 * d2).cast("decimal(38,4)"), (n2 * d1).cast("decimal(38,4)")
        exceeds = F.abs(new - old) > (old * threshold)
        comparable = F.col("sample") == "COMPARABLE"
        status = (
            F.when(~comparable, F.col("sample"))
            .when(before == 0, "ZERO_BASELINE")
            .when(exceeds, "WARNING")
            .otherwise("STABLE")
        )
        change = (after - before) / F.nullif(F.abs(before), F.lit(0))
        entries.append(
            F.struct(
                F.lit(metric).alias("metric"),
                status.alias("status"),
                F.when(status == "WARNING", "WARNING").otherwise("INFO").alias("severity"),
                *(
                    half_even(value, 6).cast("decimal(28,6)").alias(name)
                    for name, value in (
                        ("previous", before),
                        ("current", after),
                        ("difference", after - before),
                        ("relative_change", change),
                    )
                ),
                threshold.alias("threshold"),
            )
        )
    return paired.select(*by, F.inline(F.array(*entries)))


def comparison_status(pairs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Overall status per publication.

    ``pairs``: baseline_publication_id, baseline_profile_status, common_stores, common_dates,
    previous_total_lines, current_total_lines (whole states) and previous_active_lines,
    current_active_lines (equivalent scope).
    """
    no_scope = (F.col("common_stores") == 0) | (F.col("common_dates") == 0)
    both_empty = (F.col("previous_total_lines") == 0) & (F.col("current_total_lines") == 0)
    status = (
        F.when(F.col("baseline_publication_id").isNull(), "NO_BASELINE")
        .when(F.col("baseline_profile_status") != "AVAILABLE", "BASELINE_PROFILE_UNAVAILABLE")
        .when(no_scope & both_empty, "EMPTY")
        .when(no_scope, "NOT_COMPARABLE")
        .otherwise(
            sample_status(
                F.col("previous_active_lines"), F.col("current_active_lines"), min_lines
            )
        )
    )
    return pairs.withColumn("status", status)


def cumulative_coverage(coverage: DataFrame, profiles: DataFrame) -> DataFrame:
    """Stores covered by the newest publication of each book.

    ``coverage``: book_id, sequence, store_id, expected, received, missing, zero_movement.
    ``profiles``: book_id, sequence, available. Expected and received accumulate from the
    publication after the last one whose profile is unavailable; missing and zero movement
    are those of the newest publication. ``scope_complete`` holds when nothing was lost.
    """
    newest = profiles.groupBy("book_id").agg(F.max("sequence").alias("_newest"))
    breaks = (
        profiles.join(newest, "book_id")
        .groupBy("book_id", "_newest")
        .agg(
            F.max(
                F.when(~F.col("available") & (F.col("sequence") < F.col("_newest")), F.col("sequence"))
            ).alias("_break")
        )
    )
    scoped = coverage.join(breaks, "book_id").filter(
        F.col("_break").isNull() | (F.col("sequence") > F.col("_break"))
    )
    latest = F.col("sequence") == F.col("_newest")
    return scoped.groupBy("book_id", "store_id").agg(
        F.max("expected").alias("expected"),
        F.max("received").alias("received"),
        F.max(F.col("missing") & latest).alias("missing"),
        F.max(F.col("zero_movement") & latest).alias("zero_movement"),
        F.max(F.col("_break").isNull()).alias("scope_complete"),
    ).filter("expected OR received OR missing OR zero_movement")


def coverage_over_limit(covered: DataFrame, limit: int = 1000) -> DataFrame:
    """Books whose coverage lists exceed the profile's cardinality limit."""
    names = ["expected", "received", "missing", "zero_movement"]
    return (
        covered.groupBy("book_id")
        .agg(*(F.count_if(F.col(name)).alias(name) for name in names))
        .filter(F.greatest(*names) > limit)
    )


def catalog_context(pairs: DataFrame) -> DataFrame:
    """Did the catalogue change? By the approved hash when both sides have it, else by the
    received one, else unknown. Columns previous_/current_ + approved, received."""
    approved = (
        F.coalesce(F.length("previous_approved") > 0, F.lit(False))
        & F.coalesce(F.length("current_approved") > 0, F.lit(False))
    )
    before = F.when(approved, F.col("previous_approved")).otherwise(F.col("previous_received"))
    after = F.when(approved, F.col("current_approved")).otherwise(F.col("current_received"))
    return pairs.withColumns(
        {
            # Null as soon as one side is unknown.
            "catalog_changed": before != after,
            "catalog_reference_origin": F.when(approved, "approved_operator_catalog").otherwise(
                "received_catalog_bytes"
            ),
            "catalog_identity_available": before.isNotNull() & after.isNotNull(),
        }
    )
