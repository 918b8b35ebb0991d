"""Explanation of published figures, delivery coverage and the headline decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillclose.operators.report import latest_attempt, limited_rows
from tillclose.operators.row_contract import active_lines
from tillclose.schemas import ITEM_KEY

COLUMNS = [
    *ITEM_KEY, "revision", "operation", "business_date", "product_id", "quantity",
    "line_net_brl", "batch_id", "run_id", "source_file", "source_line", "payload_hash",
]


def _selected(state: DataFrame, store_id: str | None, business_date: str | None) -> DataFrame:
    rows = active_lines(state)
    if store_id is not None:
        rows = rows.filter(F.col("store_id") == store_id)
    if business_date is not None:
        rows = rows.filter(F.col("business_date") == F.lit(business_date).cast("date"))
    return rows


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= 100:
        raise ValueError("a sample has 1 to 100 rows")


def explain_contributions(
    state: DataFrame, store_id: str | None = None, business_date: str | None = None, limit: int = 20
) -> DataFrame:
    """Active rows behind a figure in key order, with provenance, and whether more exist."""
    _check_limit(limit)
    rows = _selected(state, store_id, business_date).select(*COLUMNS)
    return limited_rows(rows, [F.col(name) for name in ITEM_KEY], limit)


def explain_totals(
    state: DataFrame, store_id: str | None = None, business_date: str | None = None
) -> DataFrame:
    """Totals of the whole selection, zero when nothing is selected."""
    empty = F.count(F.lit(1)) == 0
    zero = F.lit(0).cast("decimal(28,2)")
    return _selected(state, store_id, business_date).agg(
        F.when(empty, zero)
        .otherwise(F.sum("line_net_brl").cast("decimal(28,2)"))
        .alias("net_revenue_brl"),
        F.when(empty, F.lit(0).cast("bigint")).otherwise(F.sum("quantity")).alias("units"),
        F.count(F.lit(1)).alias("item_lines"),
    )


def explain_revisions(
    state: DataFrame,
    history: DataFrame,
    store_id: str | None = None,
    business_date: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """Every revision of the sampled keys, in order; at most 100 keys join the history."""
    _check_limit(limit)
    keys = (
        _selected(state, store_id, business_date)
        .select(*ITEM_KEY)
        .orderBy(*ITEM_KEY)
        .limit(limit)
    )
    rows = history.select(*COLUMNS).join(keys, ITEM_KEY, "left_semi")
    order = [F.col(name) for name in [*ITEM_KEY, "revision"]]
    return limited_rows(rows, order, limit)


def coverage_labels(coverage: DataFrame) -> DataFrame:
    """What each store did, with the confirmed and expected numbers of its delivery."""
    label = (
        F.when(~F.col("expected"), "NOT_EXPECTED")
        .when(~F.col("received"), "PENDING")
        .when(F.col("zero_movement"), "ZERO_CONFIRMED")
        .otherwise("DELIVERED")
    )
    numbers = coverage.groupBy("batch_id").agg(
        F.count_if(F.col("expected") & F.col("received")).alias("confirmed"),
        F.count_if("expected").alias("expected_stores"),
    )
    return (
        coverage.select("batch_id", "store_id", label.alias("label"))
        .join(numbers, "batch_id")
        .select("batch_id", "store_id", "label", "confirmed", "expected_stores")
    )


def close_decision(attempts: DataFrame, pointers: DataFrame, books: DataFrame) -> DataFrame:
    """Headline state of every book from its newest attempt and its official publication."""
    newest = latest_attempt(attempts, pointers)
    files = (
        attempts.select("book_id", "run_id", F.explode("issues").alias("issue"))
        .filter("issue.code = 'MISSING_FILE'")
        .groupBy("book_id", "run_id")
        .agg(F.count(F.lit(1)).alias("missing_files"))
    )
    official = pointers.select("book_id", F.col("publication_id").alias("official_publication"))
    state = F.col("state")
    decision = (
        F.when(
            F.col("audit_incomplete") | (F.col("is_official") & (state == "TECHNICAL_FAILURE")),
            "PUBLISHED_AUDIT_INCOMPLETE",
        )
        .when((state == "BLOCKED") & (F.col("missing_files") > 0), "BLOCKED_MISSING_FILE")
        .when(state == "BLOCKED", "BLOCKED")
        .when(state == "TECHNICAL_FAILURE", "FAILED_BEFORE_PUBLICATION")
        .when(state == "RUNNING", "RUNNING")
        .when(state == "NO_CHANGE", "PUBLICATION_KEPT")
        .when(state == "VALIDATED", "VALIDATED_ONLY")
        .when(state.isNotNull() & (state != "PUBLISHED"), "UNKNOWN_STATE")
        .when(F.col("official_publication").isNotNull(), "PUBLISHED")
        .otherwise("NOTHING_PUBLISHED")
    )
    return (
        books.select("book_id")
        .join(newest, "book_id", "left")
        .join(files, ["book_id", "run_id"], "left")
        .join(official, "book_id", "left")
        .select("book_id", "run_id", "official_publication", decision.alias("decision"))
    )
