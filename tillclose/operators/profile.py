"""Profile of a published state, in long form: totals, distributions, groups, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.functions.money import half_even, ratio
from tillclose.schemas import MAX_PROFILE_BYTES, PROFILE_CONTRACT_VERSION, SALE_KEY

# Default profile parameters.
PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 1.0]
QUANTILE_ACCURACY = 10000
GROUP_LIMIT = 20
DATE_LIMIT = 31
METRICS = ["quantity", "unit_price_brl", "line_discount_brl"]
MONEY_TOTALS = ["net_revenue_brl", "gross_revenue_brl", "discount_brl"]


def _money(value: Column) -> Column:
    return F.coalesce(value.cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)"))


def _measures() -> list[Column]:
    gross = F.col("quantity") * F.col("unit_price_brl")
    return [
        F.count(F.lit(1)).alias("active_lines"),
        F.countDistinct(F.struct(*SALE_KEY)).alias("sales"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"),
        _money(F.sum("line_net_brl")).alias("net_revenue_brl"),
        _money(F.sum(gross)).alias("gross_revenue_brl"),
        _money(F.sum("line_discount_brl")).alias("discount_brl"),
    ]


def profile_totals(active: DataFrame, *by: str) -> DataFrame:
    """Lines, distinct sales, units and money of the active lines, per ``by`` if given."""
    return active.groupBy(*by).agg(*_measures())


def check_probabilities(probabilities: list[float]) -> None:
    ordered = all(0 <= p <= 1 for p in probabilities) and sorted(set(probabilities)) == list(
        probabilities
    )
    if not 1 <= len(probabilities) <= 9 or not ordered:
        raise ValueError("one to nine distinct ascending probabilities between 0 and 1")


def profile_distributions(
    active: DataFrame,
    probabilities: list[float] = PROBABILITIES,
    accuracy: int = QUANTILE_ACCURACY,
) -> DataFrame:
    """Minimum, maximum, mean and approximate quantiles, one row per metric; one pass."""
    check_probabilities(probabilities)
    aggregates = [F.count(F.lit(1)).cast("decimal(20,0)").alias("lines")]
    for name in METRICS:
        value = F.col(name).cast("decimal(18,2)")
        aggregates += [
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
            F.sum(value).cast("decimal(28,2)").alias(f"{name}_sum"),
            F.percentile_approx(value, list(probabilities), accuracy).alias(f"{name}_q"),
        ]
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(f"{name}_min").alias("min"),
            F.col(f"{name}_max").alias("max"),
            half_even(ratio(F.col(f"{name}_sum"), F.col("lines")), 6)
            .cast("decimal(28,6)")
            .alias("mean"),
            F.col(f"{name}_q").alias("quantiles"),
        )
        for name in METRICS
    ]
    return active.agg(*aggregates).select(F.inline(F.array(*entries)))


def profile_quantiles(distributions: DataFrame, probabilities: list[float]) -> DataFrame:
    """Quantiles in long form: metric, probability, value."""
    paired = F.arrays_zip(
        F.array(*(F.lit(p) for p in probabilities)).alias("probability"),
        F.col("quantiles").alias("value"),
    )
    return distributions.select("metric", F.explode(paired).alias("q")).select(
        "metric", F.col("q.probability").alias("probability"), F.col("q.value").alias("value")
    )


def profile_groups(active: DataFrame, key: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """The groups with most revenue, how many groups there are, and whether any is left out."""
    grouped = active.groupBy(key).agg(*_measures()).drop("gross_revenue_brl", "discount_brl")
    groups = active.agg(F.countDistinct(key).alias("n")).scalar()
    top = grouped.orderBy(F.col("net_revenue_brl").desc(), key).limit(limit)
    return top.withColumn("group_count", groups).withColumn(
        "truncated", F.col("group_count") > limit
    )


def date_summary(dates: DataFrame, limit: int = DATE_LIMIT) -> DataFrame:
    """First, last and number of distinct business days, and the first ``limit`` of them."""
    days = dates.select("business_date").distinct()
    shown = (
        days.orderBy("business_date")
        .limit(limit)
        .agg(F.array_sort(F.collect_list("business_date")).alias("dates"))
    )
    return days.agg(
        F.min("business_date").alias("start"),
        F.max("business_date").alias("end"),
        F.count(F.lit(1)).alias("date_count"),
    ).select(
        "*",
        shown.scalar().alias("dates"),
        (F.col("date_count") > limit).alias("dates_truncated"),
    )


def totals_checks() -> dict[str, Column]:
    """What must hold of any row of profile totals."""
    zero = F.lit(0)
    money = [F.col(name) for name in MONEY_TOTALS]
    figures = [F.col("sales"), F.col("units"), *money]
    all_zero = F.lit(True)
    for figure in figures:
        all_zero = all_zero & (figure == zero)
    non_negative = F.lit(True)
    for figure in [F.col("active_lines"), *figures]:
        non_negative = non_negative & (figure >= zero)
    return {
        "MONEY_BALANCE": F.col("gross_revenue_brl") - F.col("discount_brl")
        == F.col("net_revenue_brl"),
        "SALES_WITHIN_LINES": F.col("sales") <= F.col("active_lines"),
        "LINES_WITHIN_UNITS": F.col("active_lines") <= F.col("units"),
        "EMPTY_IS_ZERO": (F.col("active_lines") != zero) | all_zero,
        "NON_NEGATIVE": non_negative,
    }


def listing_checks(count: str, shown: str, truncated: str) -> dict[str, Column]:
    """What must hold of a truncated list: flagged exactly when something is left out."""
    return {
        "SHOWN_WITHIN_COUNT": F.col(shown) <= F.col(count),
        "TRUNCATION_FLAG": F.col(truncated) == (F.col(count) > F.col(shown)),
    }


def profile_consistency(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with the names of the checks; an unknown outcome breaks it."""
    broken = [
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in checks.items()
    ]
    return rows.withColumn("broken", F.array_compact(F.array(*broken))).filter("size(broken) > 0")


def profile_availability(publications: DataFrame, stored: DataFrame) -> DataFrame:
    """State of the profile each publication refers to.

    ``publications``: publication_id, run_id, profile (struct path, sha256, contract_version).
    ``stored``: path, bytes, sha256 of the file and publication_id, run_id, readable inside it.
    """
    found = stored.select(
        F.col("path").alias("_path"),
        F.col("bytes").alias("_bytes"),
        F.col("sha256").alias("_sha"),
        F.col("publication_id").alias("_publication"),
        F.col("run_id").alias("_run"),
        F.col("readable").alias("_readable"),
    )
    reference = F.col("profile")
    referenced = (
        (reference["contract_version"] == PROFILE_CONTRACT_VERSION)
        & reference["sha256"].rlike(r"\A[0-9a-f]{64}\z")
        & (F.length(reference["path"]) > 0)
    )
    intact = (
        (F.col("_bytes") <= MAX_PROFILE_BYTES)
        & (F.col("_sha") == reference["sha256"])
        & F.col("_readable")
        & (F.col("_publication") == F.col("publication_id"))
        & (F.col("_run") == F.col("run_id"))
    )
    status = (
        F.when(reference.isNull(), "LEGACY")
        .when(~F.coalesce(referenced, F.lit(False)), "INVALID")
        .when(F.col("_path").isNull(), "MISSING")
        .when(F.coalesce(intact, F.lit(False)), "AVAILABLE")
        .otherwise("INVALID")
    )
    return publications.join(found, reference["path"] == F.col("_path"), "left").select(
        "publication_id", "run_id", status.alias("profile_status")
    )

