"""Shared pieces of the operators: identifiers, sizes, cut lineage and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.session import cut, scratch_path

#: A null ``doc_id`` takes part under this value and is returned as null.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (never null) and ``text``: the only columns that may travel to a task."""
    return docs.select(F.coalesce(docs["doc_id"], F.lit(NO_ID)).cast("long").alias("doc_id"), "text", *more)


def with_null_ids(frame: DataFrame) -> DataFrame:
    """Turn the stand-in of ``keyed`` back into null."""
    return frame.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as Parquet in the shared folder, read again: survives lost executors."""
    spark = frame.sparkSession
    path = scratch_path(spark, f"{label}-{uuid.uuid4().hex[:8]}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Bits of the filter of ``may_hold``: 2 MB of bitmaps, whatever the number of keys.
FILTER_BITS = 1 << 24


def may_hold(frame: DataFrame, key: Column, keys: DataFrame, name: str = "may") -> DataFrame:
    """The frame with a flag ``name``: false only where no row of ``keys`` (one long column) equals ``key``.

    What is false can skip a join, so rows are shuffled in proportion to the keys and not to the frame. The
    bitmaps, at most ``FILTER_BITS / 32768`` rows of 4 KB, are broadcast: their size has a bound. With more
    keys than bits everything may hold and only the exact join remains.
    """
    bit = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(FILTER_BITS)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits")
    )
    own = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    at = F.bitmap_bit_position(own)
    octet = F.conv(F.hex(F.substring(bits["_bits"], F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = F.call_function("shiftright", octet, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    joined = frame.join(F.broadcast(bits), F.bitmap_bucket_number(own) == bits["_bucket"], "left")
    return joined.select(*(frame[x] for x in frame.columns), F.coalesce(held, F.lit(False)).alias(name))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes the number of hash buckets."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(docs: DataFrame, per_bucket: int, least: int) -> int:
    """A power of two, so that a bucket holds the hashes of about ``per_bucket`` bytes of text."""
    wanted = max(least, -(-text_bytes(docs) // per_bucket))
    return 1 << (wanted - 1).bit_length()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of edges ``(a, b)``.

    Alternating large-star and small-star rounds: every node points at the smallest neighbour it
    knows, so paths halve and hubs cost one row per edge. Each round is cut from its lineage, and only
    a count reaches the driver.
    """
    edges = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").distinct())
        # Small star: a node and its smaller neighbours all point at the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")
        ).first()
        # Every node points once, at its root, and nothing moves any more.
        if now == before or now[0] == 0:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
