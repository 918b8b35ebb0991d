"""Copy-on-write of tables kept by buckets: a version writes the buckets its delivery touches, and no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillclose.functions.digest import digest_slice, row_text, text_digest
from tillclose.functions.positions import position_filter
from tillclose.operators.audit import table_fingerprint
from tillclose.schemas import ITEM_KEY
from tillclose.session import local_rows, shuffles_removed, write_table
from tillclose.sinks.tables import next_version, register_version
from tillclose.sources.buckets import (
    BUCKET_MAP,
    COLUMNS_ONLY,
    Layout,
    bucket_of,
    read_buckets,
    read_map,
    touched,
)

#: A bucket of so many rows is a few hundred megabytes; twice as many on average double the buckets.
ROWS_PER_BUCKET = 4_000_000
#: Bounds of the number of buckets, and so of the map that the driver reads.
LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 16
#: So many tasks write a bucket that is hot, where the rows are dealt by ``placement``.
SLOTS = 8


def _count_for(rows: int, least: int, rows_per_bucket: int) -> int:
    count = least
    while count < MOST_BUCKETS and rows > count * rows_per_bucket:
        count *= 2
    return count


def placement(count: int) -> dict[str, Column]:
    """Where a row goes: its bucket, and one of several parts of it that its item is told by."""
    return {"bucket": bucket_of(count), "_slot": F.pmod(F.xxhash64(*ITEM_KEY), F.lit(SLOTS)).cast("int")}


def _whole_print(columns: list[str]) -> list[Column]:
    """The figures of ``table_fingerprint`` over a whole table, as sums that are taken on the way to its files."""
    text = text_digest(row_text(columns))
    digests = (F.coalesce(F.sum(digest_slice(text, start)), F.lit(0)) for start in (1, 16))
    return [F.count(F.lit(1)).alias("rows"), *(x.cast("decimal(38,0)").alias(f"digest_{i}") for i, x in enumerate(digests, 1))]


def advance_buckets(
    spark: SparkSession,
    root: str,
    name: str,
    run_id: str,
    layout: Layout | None,
    delivered: DataFrame,
    advance: Callable[..., DataFrame],
    least_buckets: int = LEAST_BUCKETS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    numbers: set[int] | None = None,
    placed: bool = False,
) -> Layout:
    """A new version of a table after a delivery.

    ``advance`` gets the rows of the buckets that ``delivered`` touches (None for the first version) and returns
    what they become; a row may not leave its sale. When the buckets hold twice ``rows_per_bucket`` on average
    their number doubles and this version writes them all. What was written is read back and must have the
    digests of what was meant, taken while it is written, with every row in its bucket. A hot bucket is written by several tasks. ``numbers`` are
    the touched buckets where the caller knows them already. With ``placed``, ``advance`` also gets the columns of
    ``placement`` and returns rows that carry them and are dealt by them, as ``resolve_state`` does: they are not
    shuffled again on the way to their files.
    """
    with shuffles_removed(spark):
        return _advance(
            spark, root, name, run_id, layout, delivered, advance, least_buckets, rows_per_bucket, numbers, placed
        )


def _advance(
    spark, root, name, run_id, layout, delivered, advance, least_buckets, rows_per_bucket, numbers, placed
) -> Layout:
    if least_buckets & (least_buckets - 1):
        raise ValueError("the number of buckets is a power of two")
    version, path = next_version(spark, root, name), f"{root}/tables/{name}"
    register_version(spark, root, name, path, version, run_id)
    if layout is None:
        count, whole, before = _count_for(delivered.count(), least_buckets, rows_per_bucket), True, None
    else:
        count = max(layout.count, _count_for(layout.rows, layout.count, 2 * rows_per_bucket))
        whole = count != layout.count
        if numbers is None and not whole:
            numbers = touched(layout, delivered)
        before = read_buckets(spark, layout, None if whole else numbers)
    if placed:
        where = placement(count)
        after = advance(before, where)
        columns = sorted(x for x in after.columns if x not in where)
        marked = after.select(*columns, "bucket")
    else:
        after = advance(before)
        columns = sorted(after.columns)
        marked = after.select(*columns, bucket_of(count).alias("bucket")).hint("rebalance", "bucket")
    data = f"{path}/data/version={version}"
    meant = Observation()
    write_table(marked.observe(meant, *_whole_print(columns)), data, "bucket")
    found = spark.read.schema(marked.schema).parquet(data)
    prints = {row["bucket"]: row.asDict() for row in table_fingerprint(found, "bucket").collect()}
    told = {key: sum(entry[key] for entry in prints.values()) for key in ("rows", "digest_1", "digest_2")}
    if told != meant.get or not found.filter(F.col("bucket") != bucket_of(count)).isEmpty():
        raise ValueError(f"the stored buckets of {name} differ from what was to be stored")
    entries = {n: {**entry, "buckets": count, "held": version} for n, entry in prints.items()}
    if whole:
        # Written beside the others, so that a table without rows still has columns.
        found.drop("bucket").limit(0).write.mode("errorifexists").parquet(f"{data}/bucket={COLUMNS_ONLY}")
        nothing = dict.fromkeys(("rows", "digest_1", "digest_2"), 0)
        entries[COLUMNS_ONLY] = {"bucket": COLUMNS_ONLY, "buckets": count, "held": version, **nothing}
    else:
        entries = layout.entries | entries
    # Digests stay texts on the way: they have more digits than a JSON number is read with.
    rows = [{key: str(value) for key, value in entry.items()} for entry in entries.values()]
    kinds = [entry.split() for entry in BUCKET_MAP.split(", ")]
    lines = local_rows(spark, ", ".join(f"{key} string" for key, _ in kinds), rows)
    lines = lines.select(*(F.col(key).cast(kind) for key, kind in kinds))
    lines.coalesce(1).write.mode("errorifexists").parquet(f"{path}/map/version={version}")
    return Layout(path, version, entries)


def map_fingerprint(lines: DataFrame) -> DataFrame:
    """``table_fingerprint`` of a whole version from its map: digests are sums, so no row is read."""
    return lines.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *(F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)").alias(x) for x in ("digest_1", "digest_2")),
    )


def differing_buckets(spark: SparkSession, one: Layout, two: Layout) -> set[int]:
    """Buckets whose digests differ between two versions with the same number of buckets."""
    figures = ["bucket", "rows", "digest_1", "digest_2"]
    sides = [read_map(spark, x.path, x.version).select(*figures) for x in (one, two)]
    odd = sides[0].exceptAll(sides[1]).unionByName(sides[1].exceptAll(sides[0]))
    return {row["bucket"] for row in odd.select("bucket").distinct().collect()}


def version_differences(spark: SparkSession, expected: Layout, stored: Layout) -> DataFrame:
    """Rows that only one of two versions has, with ``side`` (missing, unexpected), copies included.

    Only buckets whose digests differ are read; all of them if the number of buckets differs. Of those, what
    travels is a hash of each row; rows are compared whole only where the hashes do not cancel out.
    """
    numbers = differing_buckets(spark, expected, stored) if expected.count == stored.count else None
    one, two = (read_buckets(spark, x, numbers) for x in (expected, stored))
    columns = sorted(one.columns)
    one, two = one.select(*columns), two.select(*columns)
    one, two = _without_common(one, two)
    return (
        one.exceptAll(two)
        .withColumn("side", F.lit("missing"))
        .unionByName(two.exceptAll(one).withColumn("side", F.lit("unexpected")))
    )


def _without_common(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without most of what they share: every row that one has more often than the other stays, on both sides.

    Rows with the same hash cancel out if they are as many on either side and a second hash agrees. The positions of
    the others make a filter of 2 MB; rows that meet a position by chance stay too.
    """
    # Nulls leave a hash as it was, so which columns are null is hashed as well.
    content = [F.col(name) for name in one.columns] + [F.col(name).isNull() for name in one.columns]
    first, second = F.xxhash64(*content), F.xxhash64(F.lit("second"), *content)
    sides = (rows.select(first.alias("h"), second.alias("g"), F.lit(sign).alias("n")) for rows, sign in ((one, 1), (two, -1)))
    with shuffles_removed(one.sparkSession):
        odd = DataFrame.unionByName(*sides).groupBy("h").agg(F.sum("n").alias("n"), F.bit_xor("g").alias("g"))
        may_differ = position_filter(odd.filter("n <> 0 OR g <> 0").select("h"))(first)
    return one.filter(may_differ), two.filter(may_differ)
