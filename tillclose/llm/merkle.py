"""Merkle manifest of a dataset: every row a leaf, a tree per group, one tree over the groups' roots.

1. One scan hashes every row to its leaf; only keys and digests travel from there.
2. Rank: leaves are range-partitioned by group, key, leaf and row; positions in the sorted partitions plus the
   sums of the partitions before give the index in the group. A group of any size is spread over tasks.
3. Up: each level is one table ``(tree, idx, size, digest)``. It is joined with itself on the computed index
   of the sibling (``idx XOR 1`` in a binary tree, ``slot + offset`` modulo the arity otherwise), which gives
   every node what stands before and after it in its run. The rows of slot zero then emit the parents.
   ``size``, the nodes of the tree on this level, says when a tree is done: no level is counted.
4. Down: a node's path is its own siblings and then its parent's path, so the leaves get whole proofs with one
   join a level, on ever larger tables, and a path is stored once per node and not once per leaf and level.

Work follows the number of rows; rounds follow the logarithm of the largest group. Each level is written,
so a lost executor costs one level.

Nulls and edge cases: a null column is ``-`` in the leaf; a null group is a tree of its own, the first one;
null keys come first; rows of one key are ordered by their leaf; repeated rows are leaves of their own. A
lone leaf is its tree's root. An empty table has an empty manifest. Other columns are never read. Groups
are ordered bytewise by UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillclose.llm.frames import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
_PATH = "array<struct<before: string, after: string>>"


def framed(value: Column) -> Column:
    """A value with its number of bytes, so that neighbours can not run into each other; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Digest of a row: SHA-256 of its framed values."""
    return F.sha2(F.concat(*map(framed, values)), 256)


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, own, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _ranked(frame: DataFrame, order: list[str]) -> DataFrame:
    """The frame with ``idx``, the place of a row in its tree, and ``size``, the rows of that tree.

    ``order`` must tell all rows apart, or equal rows would all have to meet in one task.
    """
    ordered = frame.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = written(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("part", F.shiftright("at", 33))
    runs = at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    # One row per tree and partition that it reaches into.
    tree = Window.partitionBy("tree")
    so_far = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = runs.select(
        "tree",
        "part",
        "first",
        (F.sum("rows").over(so_far) - F.col("rows")).alias("before"),
        F.sum("rows").over(tree).alias("size"),
    )
    placed = at.join(starts, ["tree", "part"])
    return placed.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _beside(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the digests ``before`` and ``after`` them in their run: one self-join per offset."""
    slot = F.col("idx") % arity
    out = nodes
    for shift in range(1, arity):
        other = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + shift) % arity
        side = nodes.select("tree", F.col("idx").alias("near"), F.col("digest").alias(f"at_{shift}"))
        out = out.withColumn("near", other).join(side, ["tree", "near"], "left").drop("near")
    found = F.array(*(F.coalesce(f"at_{shift}", F.lit("")) for shift in range(1, arity)))

    def run(wanted) -> Column:
        parts = (F.when(wanted(j), F.get(found, F.pmod(j - slot, F.lit(arity)) - 1)).otherwise("") for j in range(arity))
        return F.concat(*parts)

    return out.select(
        *nodes.columns,
        run(lambda j: F.lit(j) < slot).alias("before"),
        run(lambda j: F.lit(j) > slot).alias("after"),
    )


def _levels(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """All levels of all trees, leaves first: ``tree, idx, size, digest, before, after``."""
    levels = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most:
        levels.append(written(_beside(nodes, arity), "level"))
        # A run's first node speaks for the run; a tree of one node is done.
        first = levels[-1].filter((F.col("size") > 1) & (F.col("idx") % arity == 0))
        nodes = first.select(
            "tree",
            F.floor(F.col("idx") / arity).alias("idx"),
            F.ceil(F.col("size") / arity).alias("size"),
            F.sha2(F.concat("before", "digest", "after"), 256).alias("digest"),
        )
        most = 0 if most == 1 else -(-most // arity)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``tree``, the digest of its root and the level it is on."""
    out = None
    for level, nodes in enumerate(levels):
        top = nodes.filter("size = 1").select("tree", "digest", F.lit(level).alias("level"))
        out = top if out is None else out.unionByName(top)
    return out


def _paths(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """``tree, idx``, ``path`` and the columns of ``above`` for all nodes of the lowest level.

    ``above`` has one row per tree: its ``level``, and the ``path`` that goes on over its root.
    """
    own = F.when(F.col("size") > 1, F.array(F.struct("before", "after"))).otherwise(F.array().cast(_PATH))
    kept = [x for x in above.columns if x not in ("tree", "level", "path")]
    up = None
    for level in reversed(range(len(levels))):
        ends = above.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("parent"), "path", *kept)
        if up is not None:
            ends = ends.unionByName(up.withColumnRenamed("idx", "parent"))
        nodes = levels[level].select("tree", "idx", own.alias("own"), F.floor(F.col("idx") / arity).alias("parent"))
        joined = nodes.join(ends, ["tree", "parent"])
        up = written(joined.select("tree", "idx", F.concat("own", "path").alias("path"), *kept), "paths")
    return up


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    key: str = "doc_id",
    arity: int = ARITY,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``key, group, idx, leaf, path, subroot, root`` of every row, and the columns to ``carry`` along.

    ``path`` has, per level from the leaf to the root, the sibling digests ``before`` and ``after`` the node.
    ``carry`` maps names to expressions over ``docs``, evaluated in the scan that makes the leaves.
    """
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit(""))
    leaves = written(
        docs.select(
            tree.alias("tree"),
            docs[key].alias("key"),
            leaf([docs[x] for x in fields]).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
            *(value.alias(f"carry_{i}") for i, value in enumerate(carry.values())),
        ),
        "leaves",
    )
    leaves = written(_ranked(leaves, ["key", "digest", "row"]), "ranked")
    levels = _levels(leaves.select("tree", "idx", "size", "digest"), arity)
    names = [f"carry_{i}" for i in range(len(carry))]
    if not levels:
        nothing = F.lit(None).cast("string")
        ends = leaves.withColumns({"path": F.array().cast(_PATH), "subroot": nothing, "root": nothing})
    else:
        tops = written(_tops(levels), "tops")
        forest = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        forest = written(_ranked(forest, ["name"]), "forest")
        upper = _levels(forest.select("tree", "idx", "size", "digest"), arity)
        root = _tops(upper).select("tree", "level", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
        over = forest.join(_paths(upper, root, arity), ["tree", "idx"]).select(F.col("name").alias("tree"), "path", "root")
        above = written(tops.join(over, "tree").withColumnRenamed("digest", "subroot"), "above")
        ends = leaves.join(_paths(levels, above, arity), ["tree", "idx"])
    return ends.select(
        F.col("key").alias(key),
        F.when(F.col("tree") != "", F.substring("tree", 2, (1 << 31) - 1)).alias(group),
        "idx",
        F.col("digest").alias("leaf"),
        "path",
        "subroot",
        "root",
        *(F.col(x).alias(y) for x, y in zip(names, carry, strict=True)),
    )


def verified(proofs: DataFrame, claimed: str = "leaf") -> DataFrame:
    """``folded_root`` of the digest in ``claimed`` over each row's path, and whether it is the root."""
    out = proofs.withColumn("folded_root", folded(F.col(claimed), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
