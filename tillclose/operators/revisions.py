"""Revision resolution: conflicts, duplicates, stale rows, history and current state.

An item key may be hot. Nothing here gathers one key's rows in a task: counts and maxima are
combined before the shuffle, the leading row of a key is a minimum that keeps one row per key and
map task before the shuffle, and joins put one row per key on the side that is matched against, so that
adaptive execution can split the hot side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.functions.digest import packed, unpacked
from tillclose.operators.row_contract import active_lines
from tillclose.schemas import ITEM_KEY, REVISION_KEY, SALE_KEY
from tillclose.session import scratch_path, write_table

PAYLOAD_KEY = [*REVISION_KEY, "payload_hash"]
ARRIVAL = ["batch_id", "source_file", "source_line"]


def conflicting_keys(events: DataFrame) -> DataFrame:
    """Revision keys that carry more than one distinct payload."""
    variants = events.select(*PAYLOAD_KEY).distinct()
    return variants.groupBy(*REVISION_KEY).agg(F.count(F.lit(1)).alias("payloads")).filter("payloads > 1")


def revision_conflict_rows(previous: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose revision key conflicts, within the batch or with history.

    History is cut to the keys of the delivery first, so what is grouped follows the delivery.
    """
    variants = incoming.select(*PAYLOAD_KEY)
    if previous is not None:
        delivered = incoming.select(*REVISION_KEY).distinct()
        stored = previous.select(*PAYLOAD_KEY).join(delivered, REVISION_KEY, "left_semi")
        variants = variants.unionByName(stored)
    return incoming.join(conflicting_keys(variants).drop("payloads"), REVISION_KEY, "left_semi")


def relabel_rejects(rows: DataFrame, code: str) -> DataFrame:
    return rows.withColumn("errors", F.array(F.lit(code)))


def exact_duplicates(
    previous: DataFrame | None, incoming: DataFrame, scope: list[str] | None = None
) -> DataFrame:
    """Repeats inside the delivery plus distinct payloads the history already holds.

    Both parts come from one grouping by payload: copies in the delivery, copies in history.
    A payload counts its repeats (copies - 1) and once more per history row it matches.
    ``scope`` names extra grouping columns such as batch_id.
    """
    scope = scope or []
    arrived = incoming.select(*scope, *PAYLOAD_KEY).withColumn("_old", F.lit(0))
    if previous is not None:
        known = previous.select(*PAYLOAD_KEY).withColumn("_old", F.lit(1))
        if scope:
            raise ValueError("a scoped count has no single history; pass previous=None")
        arrived = arrived.unionByName(known)
    per_payload = arrived.groupBy(*scope, *PAYLOAD_KEY).agg(
        F.sum(1 - F.col("_old")).alias("copies"), F.sum("_old").alias("stored")
    )
    grouped = per_payload.filter("copies > 0").groupBy(*scope)
    return grouped.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("received"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated_in_delivery"),
        F.coalesce(F.sum("stored"), F.lit(0)).alias("already_in_history"),
        F.coalesce(F.sum(F.col("copies") - 1 + F.col("stored")), F.lit(0)).alias("duplicates"),
    )


def stale_revisions(previous: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Incoming rows below the highest revision of their item, with that revision."""
    rows = incoming.select(*ITEM_KEY, "revision")
    if previous is not None:
        delivered = incoming.select(*ITEM_KEY).distinct()
        rows = rows.unionByName(previous.select(*rows.columns).join(delivered, ITEM_KEY, "left_semi"))
    newest = rows.groupBy(*ITEM_KEY).agg(F.max("revision").alias("max_revision"))
    return incoming.join(newest, ITEM_KEY).filter("revision < max_revision")


def revision_facts(previous: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """What history and delivery say about each payload delivered, from one scan of the history.

    Per revision key and payload: its ``copies`` in the delivery, how often it is ``stored``, the distinct
    ``payloads`` of its revision, how many history rows the revision has (``known``), and the highest revision of
    its item. History is cut to the delivered items in the scan and reduced to one row per payload; everything
    else is grouped from those rows, which are written once. What leads to them is removed with the write, and
    payload hashes travel as bytes.
    """
    payload = [*REVISION_KEY, packed(F.col("payload_hash")).alias("payload_hash")]
    pool = incoming.select(*payload, F.lit(0).alias("_old"))
    if previous is not None:
        delivered = incoming.select(*ITEM_KEY).distinct()
        stored = previous.select(*payload).join(delivered, ITEM_KEY, "left_semi")
        pool = pool.unionByName(stored.withColumn("_old", F.lit(1)))
    each = pool.groupBy(*PAYLOAD_KEY).agg(
        F.sum(1 - F.col("_old")).alias("copies"), F.sum("_old").alias("stored")
    )
    path = scratch_path(each.sparkSession, "payloads")
    write_table(each, path)
    each = each.sparkSession.read.schema(each.schema).parquet(path)
    revisions = each.groupBy(*REVISION_KEY).agg(
        F.count(F.lit(1)).alias("payloads"), F.sum("stored").alias("known")
    )
    items = each.groupBy(*ITEM_KEY).agg(F.max("revision").alias("max_revision"))
    facts = each.filter("copies > 0").join(revisions, REVISION_KEY).join(items, ITEM_KEY)
    return facts.withColumn("payload_hash", unpacked(F.col("payload_hash")))


def classified(incoming: DataFrame, facts: DataFrame) -> DataFrame:
    """Incoming rows with ``is_conflict``, ``is_duplicate``, ``is_stale``, ``is_new`` and ``max_revision``.

    A duplicate has its payload stored or delivered more than once; new is what brings a revision that the
    history lacks. ``facts`` are those of the same delivery; a repeated row keeps its flags on every copy.
    """
    digest = F.col("payload_hash")
    told = facts.select(
        *REVISION_KEY,
        packed(digest).alias("payload_hash"),
        (F.col("payloads") > 1).alias("is_conflict"),
        ((F.col("stored") > 0) | (F.col("copies") > 1)).alias("is_duplicate"),
        (F.col("revision") < F.col("max_revision")).alias("is_stale"),
        (F.col("known") == 0).alias("is_new"),
        "max_revision",
    )
    rows = incoming.withColumn("payload_hash", packed(digest)).join(told, PAYLOAD_KEY)
    return rows.withColumn("payload_hash", unpacked(digest))


def revision_counts(facts: DataFrame) -> DataFrame:
    """Rows of the delivery in conflict, repeated or stored before, and stale: one row from the facts alone."""
    rows = F.coalesce(F.sum("copies"), F.lit(0))

    def where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("copies"))), F.lit(0))

    return facts.agg(
        rows.alias("received"),
        where(F.col("payloads") > 1).alias("conflicts"),
        F.coalesce(F.sum(F.col("copies") - 1 + F.col("stored")), F.lit(0)).alias("duplicates"),
        where(F.col("revision") < F.col("max_revision")).alias("stale"),
        where(F.col("known") == 0).alias("new"),
    )


def _leading(rows: DataFrame, key: list[str], *rank: Column) -> DataFrame:
    """The row of each key with the smallest rank: a minimum, combined before the shuffle."""
    rest = F.struct(*(name for name in rows.columns if name not in key))
    led = rows.groupBy(*key).agg(F.min_by(rest, F.struct(*rank)).alias("_led"))
    return led.select(*key, "_led.*").select(*rows.columns)


def _pool(previous: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Stored and arriving rows together; ``_arrives`` sorts the stored ones first."""
    rows = incoming.withColumn("_arrives", F.lit(True))
    return rows if previous is None else rows.unionByName(previous.withColumn("_arrives", F.lit(False)))


def eligible_history(previous: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """One row per revision key: history first, then batch, file and line."""
    rank = [F.col(name) for name in ("_arrives", *ARRIVAL)]
    return _leading(_pool(previous, incoming), REVISION_KEY, *rank).drop("_arrives")


def current_state(history: DataFrame) -> DataFrame:
    """Highest revision of each item; a cancelled item keeps its row."""
    return _leading(history, ITEM_KEY, -F.col("revision"))


def resolve_state(
    previous: DataFrame | None, incoming: DataFrame, where: dict[str, Column] | None = None
) -> DataFrame:
    """``current_state(eligible_history(...))`` with one shuffle instead of two.

    ``where`` names columns, each told by the item key, that the result is dealt and sorted by and carries: what
    comes next by them moves no row again. The arriving rows of an item are one row before they are dealt.
    """
    rank = [-F.col("revision"), *(F.col(name) for name in ("_arrives", *ARRIVAL))]
    if where is None:
        return _leading(_pool(previous, incoming), ITEM_KEY, *rank).drop("_arrives")
    rows = _pool(previous, resolve_state(None, incoming)).withColumns(where)
    has_digest = "payload_hash" in rows.columns
    if has_digest:
        rows = rows.withColumn("payload_hash", packed(F.col("payload_hash")))
    rows = rows.repartition(*where)
    if previous is not None:
        rows = _leading(rows, [*where, *ITEM_KEY], *rank)
    if has_digest:
        rows = rows.withColumn("payload_hash", unpacked(F.col("payload_hash")))
    return rows.drop("_arrives")


def new_history_rows(previous: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """What a batch adds to the history. History rows never change, so the eligible history is
    the previous one and these rows: nothing stored has to be written again.

    A stored revision leads its key, so one grouping tells both; the history brings nothing but its keys."""
    if previous is None:
        return eligible_history(None, incoming)
    known = previous.select(*REVISION_KEY).withColumn("_arrives", F.lit(False))
    rows = incoming.withColumn("_arrives", F.lit(True)).unionByName(known, allowMissingColumns=True)
    rank = [F.col(name) for name in ("_arrives", *ARRIVAL)]
    return _leading(rows, REVISION_KEY, *rank).filter("_arrives").drop("_arrives")


def advance_state(previous_state: DataFrame | None, added: DataFrame) -> DataFrame:
    """Current state after ``added`` joined the history, from the previous state alone: the
    highest revision of an item is either the one it had or one that was added."""
    if previous_state is None:
        return current_state(added)
    return current_state(previous_state.unionByName(added))


def signed_changes(previous_state: DataFrame | None, added: DataFrame) -> DataFrame:
    """The active lines that a batch takes away (``sign`` -1) and brings (+1); lines it leaves alone are not read
    beyond the scan that finds the delivered items."""
    if previous_state is None:
        return active_lines(current_state(added)).withColumn("sign", F.lit(1))
    keys = added.select(*ITEM_KEY).distinct()
    before = previous_state.join(keys, ITEM_KEY, "left_semi")
    now = advance_state(before, added)
    return (
        active_lines(before).withColumn("sign", F.lit(-1)).unionByName(active_lines(now).withColumn("sign", F.lit(1)))
    )


def touched_dates(previous_state: DataFrame | None, state: DataFrame, added: DataFrame) -> DataFrame:
    """Business days whose figures may differ: those of the items the batch added to, before
    and after."""
    keys = added.select(*ITEM_KEY).distinct()
    now = state.join(keys, ITEM_KEY, "left_semi").select("business_date")
    if previous_state is not None:
        before = previous_state.join(keys, ITEM_KEY, "left_semi").select("business_date")
        now = now.unionByName(before)
    return now.distinct()


def split_sales(state: DataFrame) -> DataFrame:
    """Sales whose active items fall on more than one business day."""
    return (
        active_lines(state)
        .groupBy(*SALE_KEY)
        .agg(F.countDistinct("business_date").alias("business_dates"))
        .filter("business_dates > 1")
    )


def split_sale_rows(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Incoming rows of those sales; rows already in history are not rejected again."""
    return incoming.join(split_sales(state).select(*SALE_KEY), SALE_KEY, "left_semi")


def _row_digest(frame: DataFrame) -> DataFrame:
    payload = [name for name in frame.columns if name not in ITEM_KEY]
    return frame.select(*ITEM_KEY, F.struct(*sorted(payload)).alias("_row"))


def merge_actions(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """What it takes to make the stored state equal the expected one, per item key.

    Update and delete replace the stored row, insert and update bring the expected row.
    """
    source = _row_digest(expected).withColumnRenamed("_row", "_source")
    target = _row_digest(stored).withColumnRenamed("_row", "_target")
    action = (
        F.when(F.col("_target").isNull(), "INSERT")
        .when(F.col("_source").isNull(), "DELETE")
        .when(F.col("_source") == F.col("_target"), "UNCHANGED")
        .otherwise("UPDATE")
    )
    return source.join(target, ITEM_KEY, "full_outer").withColumn("action", action)


def merge_state(expected: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The merged state: matched keys updated, new keys inserted, absent keys deleted."""
    if stored is None:
        return expected.withColumn("action", F.lit("INSERT"))
    return (
        merge_actions(expected, stored)
        .filter("action <> 'DELETE'")
        .select(*ITEM_KEY, "_source.*", "action")
    )


def state_differences(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Multiset difference in both directions, counted; both zero means equal.

    One grouping of the rows of both, +1 and -1 each, tells either direction."""
    columns = expected.columns
    sides = expected.withColumn("_sign", F.lit(1)).unionByName(stored.select(*columns).withColumn("_sign", F.lit(-1)))
    rows = sides.groupBy(*columns).agg(F.sum("_sign").alias("_more"))

    def total(count: Column) -> Column:
        return F.coalesce(F.sum(F.greatest(count, F.lit(0))), F.lit(0))

    totals = rows.agg(total(F.col("_more")).alias("missing"), total(-F.col("_more")).alias("unexpected"))
    named = [F.struct(F.lit(side).alias("side"), F.col(side).alias("rows")) for side in ("missing", "unexpected")]
    return totals.select(F.inline(F.array(*named)))


def state_changes(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """New, revised, cancelled, reactivated and effectively changed keys."""
    names = ["new_keys", "revised_keys", "cancelled_keys", "reactivated_keys", "effective_changes"]
    if previous is None:
        total = F.count(F.lit(1))
        values = dict.fromkeys(names, F.lit(0).cast("bigint"))
        values.update(new_keys=total, effective_changes=total)
        return current.agg(*(values[name].alias(name) for name in names)).select(
            F.lit("initial_silver_state").alias("origin"), *names
        )
    before = previous.select(
        *ITEM_KEY,
        F.col("revision").alias("_revision"),
        F.col("operation").alias("_operation"),
        F.col("payload_hash").alias("_hash"),
    )
    now = current.select(*ITEM_KEY, "revision", "operation", "payload_hash")
    is_new = F.col("_revision").isNull()
    conditions = {
        "new_keys": is_new,
        "revised_keys": F.col("revision") > F.col("_revision"),
        "cancelled_keys": (F.col("operation") == "CANCEL") & (F.col("_operation") == "UPSERT"),
        "reactivated_keys": (F.col("operation") == "UPSERT") & (F.col("_operation") == "CANCEL"),
        "effective_changes": is_new | (F.col("payload_hash") != F.col("_hash")),
    }
    return (
        now.join(before, ITEM_KEY, "left")
        .agg(*(F.count_if(conditions[name]).alias(name) for name in names))
        .select(F.lit("compared_silver_versions").alias("origin"), *names)
    )


def received_operations(bronze: DataFrame) -> DataFrame:
    """Valid cancellations and later revisions a batch brought, duplicates and stale included."""
    valid = bronze.filter(F.size("errors") == 0)
    return valid.groupBy("batch_id").agg(
        F.count_if(F.col("operation") == "CANCEL").alias("valid_cancel_events"),
        F.count_if(F.col("revision").cast("bigint") > 1).alias("valid_revision_gt1_events"),
    )
