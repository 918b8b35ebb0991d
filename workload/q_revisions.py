"""Revision resolution over the two batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import revisions as R
from tillclose.operators import row_contract as RC
from workload.base import part, query
from workload.feed import ARRIVAL, ITEM, batches, feed, money, previous_state, state

REVISION = f"{ITEM}, revision"
ITEM_COLUMNS = ITEM.split(", ")

part(
    "conflicts",
    ["claimed"],
    f"SELECT {REVISION}, count(DISTINCT payload_hash) AS payloads FROM claimed GROUP BY ALL "
    "HAVING count(DISTINCT payload_hash) > 1",
)


@query("conflicting_keys", ["conflicts"], "SELECT * FROM conflicts")
def conflicting_keys(spark, folder):
    return R.conflicting_keys(feed(spark, folder, "claimed"))


@query(
    "revision_conflict_rows",
    ["claimed", "conflicts"],
    f"SELECT {REVISION}, source_line, payload_hash FROM claimed SEMI JOIN conflicts "
    f"USING ({REVISION}) WHERE batch_id = 'B2'",
)
def revision_conflict_rows(spark, folder):
    return R.revision_conflict_rows(*batches(spark, folder, "claimed")).select(
        *ITEM_COLUMNS, "revision", "source_line", "payload_hash"
    )


@query(
    "exact_duplicates",
    ["feed"],
    f"""
    , incoming AS (SELECT {REVISION}, payload_hash, count(*) AS n FROM feed GROUP BY ALL),
    stored AS (SELECT {REVISION}, payload_hash, count(*) AS m FROM feed
               WHERE batch_id = 'B1' GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS received, CAST(sum(n - 1) AS BIGINT) AS repeated_in_delivery,
           CAST(sum(coalesce(m, 0)) AS BIGINT) AS already_in_history,
           CAST(sum(n - 1 + coalesce(m, 0)) AS BIGINT) AS duplicates
    FROM incoming LEFT JOIN stored USING ({REVISION}, payload_hash)
    """,
)
def exact_duplicates(spark, folder):
    # The delivery replays everything published before and adds the new rows.
    return R.exact_duplicates(batches(spark, folder)[0], feed(spark, folder))


@query(
    "stale_revisions",
    ["feed"],
    f"""
    SELECT {REVISION}, source_line, max_revision FROM (
        SELECT *, max(revision) OVER (PARTITION BY {ITEM}) AS max_revision FROM feed)
    WHERE batch_id = 'B2' AND revision < max_revision
    """,
)
def stale_revisions(spark, folder):
    return R.stale_revisions(*batches(spark, folder)).select(
        *ITEM_COLUMNS, "revision", "source_line", "max_revision"
    )


part(
    "eligible",
    ["claimed"],
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {REVISION} ORDER BY {ARRIVAL}) AS rn "
    "FROM claimed) WHERE rn = 1",
)


@query(
    "eligible_history",
    ["eligible"],
    f"SELECT {REVISION}, batch_id, source_file, source_line, quantity, payload_hash FROM eligible",
)
def eligible_history(spark, folder):
    return R.eligible_history(*batches(spark, folder, "claimed")).select(
        *ITEM_COLUMNS, "revision", "batch_id", "source_file", "source_line", "quantity",
        "payload_hash",
    )


STATE_SELECT = (
    f"SELECT {REVISION}, operation, product_id, business_date, CAST(quantity AS INT) AS quantity, "
    f"{money('net_cents', 'DECIMAL(24,2)')} AS line_net_brl, payload_hash FROM "
)
STATE_COLUMNS = [
    *ITEM_COLUMNS, "revision", "operation", "product_id", "business_date", "quantity",
    "line_net_brl", "payload_hash",
]


@query("current_state", ["state"], STATE_SELECT + "state")
def current_state(spark, folder):
    history = R.eligible_history(*batches(spark, folder))
    return R.current_state(history).select(*STATE_COLUMNS)


@query("resolve_state", ["state"], STATE_SELECT + "state")
def resolve_state(spark, folder):
    return R.resolve_state(*batches(spark, folder)).select(*STATE_COLUMNS)


@query("active_lines", ["active"], STATE_SELECT + "active")
def active_lines(spark, folder):
    return RC.active_lines(state(spark, folder)).select(*STATE_COLUMNS)


@query(
    "cancelled_keys",
    ["state"],
    "SELECT count(*) AS cancelled_keys FROM state WHERE operation = 'CANCEL'",
)
def cancelled_keys(spark, folder):
    return RC.cancelled_keys(state(spark, folder))


part(
    "split",
    ["active"],
    "SELECT source_system, store_id, sale_id, count(DISTINCT business_date) AS business_dates "
    "FROM active GROUP BY ALL HAVING count(DISTINCT business_date) > 1",
)


@query("split_sales", ["split"], "SELECT * FROM split")
def split_sales(spark, folder):
    return R.split_sales(state(spark, folder))


@query(
    "split_sale_rows",
    ["feed", "split"],
    f"SELECT {REVISION}, source_line, business_date FROM feed "
    "SEMI JOIN split USING (source_system, store_id, sale_id) WHERE batch_id = 'B2'",
)
def split_sale_rows(spark, folder):
    incoming = batches(spark, folder)[1]
    return R.split_sale_rows(incoming, state(spark, folder)).select(
        *ITEM_COLUMNS, "revision", "source_line", "business_date"
    )


part(
    "replacement",
    ["feed"],
    f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ITEM}
        ORDER BY revision DESC, {ARRIVAL}) AS rn FROM feed WHERE batch_id = 'B2') WHERE rn = 1
    """,
)


def _replacement(spark, folder):
    return R.resolve_state(None, batches(spark, folder)[1])


@query(
    "merge_state",
    ["previous", "replacement"],
    f"""
    SELECT {ITEM}, r.revision, r.operation, r.payload_hash,
           CASE WHEN p.payload_hash IS NULL THEN 'INSERT'
                WHEN p.payload_hash = r.payload_hash AND p.revision = r.revision
                     AND p.batch_id = r.batch_id AND p.source_line = r.source_line
                THEN 'UNCHANGED' ELSE 'UPDATE' END AS action
    FROM replacement r LEFT JOIN previous p USING ({ITEM})
    """,
)
def merge_state(spark, folder):
    return R.merge_state(_replacement(spark, folder), previous_state(spark, folder)).select(
        *ITEM_COLUMNS, "revision", "operation", "payload_hash", "action"
    )


@query(
    "merge_actions",
    ["previous", "replacement"],
    f"""
    SELECT CASE WHEN p.payload_hash IS NULL THEN 'INSERT' WHEN r.payload_hash IS NULL THEN 'DELETE'
                WHEN p.payload_hash = r.payload_hash AND p.batch_id = r.batch_id
                     AND p.source_line = r.source_line THEN 'UNCHANGED' ELSE 'UPDATE' END AS action,
           count(*) AS item_keys
    FROM replacement r FULL JOIN previous p USING ({ITEM}) GROUP BY 1
    """,
)
def merge_actions(spark, folder):
    actions = R.merge_actions(_replacement(spark, folder), previous_state(spark, folder))
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("item_keys"))


@query(
    "state_equivalence",
    ["previous", "state"],
    f"""
    , a AS (SELECT {ITEM}, revision, payload_hash FROM state),
    b AS (SELECT {ITEM}, revision, payload_hash FROM previous)
    SELECT 'missing' AS side, count(*) AS rows FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL
    SELECT 'unexpected', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    """,
)
def state_equivalence(spark, folder):
    columns = [*ITEM_COLUMNS, "revision", "payload_hash"]
    now, before = (rows(spark, folder, ["payload_hash"]) for rows in (state, previous_state))
    return R.state_differences(now.select(*columns), before.select(*columns))


@query(
    "state_changes",
    ["previous", "state"],
    f"""
    SELECT 'compared_silver_versions' AS origin,
           count(*) FILTER (p.revision IS NULL) AS new_keys,
           count(*) FILTER (s.revision > p.revision) AS revised_keys,
           count(*) FILTER (s.operation = 'CANCEL' AND p.operation = 'UPSERT') AS cancelled_keys,
           count(*) FILTER (s.operation = 'UPSERT' AND p.operation = 'CANCEL') AS reactivated_keys,
           count(*) FILTER (p.revision IS NULL OR s.payload_hash <> p.payload_hash)
               AS effective_changes
    FROM state s LEFT JOIN previous p USING ({ITEM})
    """,
)
def state_changes(spark, folder):
    return R.state_changes(state(spark, folder), previous_state(spark, folder))
