"""One classifying pass over a delivery, and aggregates advanced by signed changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import gold as G
from tillclose.operators import revisions as R
from workload.base import part, query
from workload.feed import GOLD_COLUMNS, ITEM, batches, half_up, money, published, stored

REVISION = f"{ITEM}, revision"
FLAGS = ["is_conflict", "is_duplicate", "is_stale", "is_new", "max_revision"]

part(
    "payload_rows",
    ["claimed"],
    f"""
    SELECT *, count(*) FILTER (batch_id = 'B2') OVER (PARTITION BY {REVISION}, payload_hash) AS copies,
           count(*) FILTER (batch_id = 'B1') OVER (PARTITION BY {REVISION}, payload_hash) AS stored,
           count(*) FILTER (batch_id = 'B1') OVER (PARTITION BY {REVISION}) AS known,
           min(payload_hash) OVER (PARTITION BY {REVISION}) <> max(payload_hash) OVER (PARTITION BY {REVISION})
               AS is_conflict,
           max(revision) OVER (PARTITION BY {ITEM}) AS max_revision
    FROM claimed
    """,
)


@query(
    "classified_revisions",
    ["payload_rows"],
    f"""
    SELECT {REVISION}, source_line, is_conflict, stored > 0 OR copies > 1 AS is_duplicate,
           revision < max_revision AS is_stale, known = 0 AS is_new, max_revision
    FROM payload_rows WHERE batch_id = 'B2'
    """,
)
def classified_revisions(spark, folder):
    previous, incoming = batches(spark, folder, "claimed")
    rows = R.classified(incoming, R.revision_facts(previous, incoming))
    return rows.select(*ITEM.split(", "), "revision", "source_line", *FLAGS)


@query(
    "revision_counts",
    ["payload_rows"],
    f"""
    , incoming AS (SELECT * FROM payload_rows WHERE batch_id = 'B2'),
    payloads AS (SELECT DISTINCT {REVISION}, payload_hash, copies, stored FROM incoming)
    SELECT count(*) AS received, count(*) FILTER (is_conflict) AS conflicts,
           (SELECT CAST(sum(copies - 1 + stored) AS BIGINT) FROM payloads) AS duplicates,
           count(*) FILTER (revision < max_revision) AS stale, count(*) FILTER (known = 0) AS "new"
    FROM incoming
    """,
)
def revision_counts(spark, folder):
    return R.revision_counts(R.revision_facts(*batches(spark, folder, "claimed")))


def _changes(spark, folder):
    """State before the second batch, and the lines it takes away and brings, each written once."""
    before, added = published(spark, folder, GOLD_COLUMNS)
    return before, stored(R.signed_changes(before, added), "changes")


NET = f"{money('net_cents')} AS net_revenue_brl"


@query(
    "advance_store_day",
    ["store_cents"],
    f"SELECT business_date, store_id, {NET}, units, item_lines, sales_count, "
    f"{money(half_up('net_cents', 'sales_count'))} AS average_ticket_brl FROM store_cents",
)
def advance_store_day(spark, folder):
    before, changes = _changes(spark, folder)
    sales = G.sale_deltas(G.sale_lines(before), changes)
    return G.advance_store_day(G.gold_store_day(before), changes, sales)


@query(
    "advance_product_day",
    ["product_cents"],
    f"SELECT business_date, product_id, {NET}, units, item_lines FROM product_cents",
)
def advance_product_day(spark, folder):
    before, changes = _changes(spark, folder)
    return G.advance_product_day(G.gold_product_day(before), changes)


@query(
    "advance_sale_lines",
    ["active"],
    "SELECT business_date, store_id, source_system, sale_id, count(*) AS lines FROM active GROUP BY ALL",
)
def advance_sale_lines(spark, folder):
    before, changes = _changes(spark, folder)
    lines = G.sale_lines(before)
    return G.advance_sale_lines(lines, G.sale_deltas(lines, changes)).select(
        "business_date", "store_id", "source_system", "sale_id", F.col("lines").cast("bigint").alias("lines")
    )
