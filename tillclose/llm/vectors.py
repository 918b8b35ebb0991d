"""Near duplicates among embeddings: navigable small-world graphs per shard, verified by cosine.

1. Equal vectors of a label are one class with its number of copies.
2. Shards: classes of a label are dealt by hash to shards of about ``SHARD``. A shard covers its classes with
   balls: a class within half the linking angle of a centre joins that ball, any other becomes a centre. Two
   of one ball always link, so a family of near copies costs one row a shard, however large it is.
3. Every shard builds a hierarchical navigable small-world graph over its centres: levels fall off by powers
   of the degree, neighbours are chosen for diversity, and batches are inserted by searching what is there.
4. Every centre queries every shard of its label. The range it asks for is the linking angle plus both radii,
   so no link between members of two balls can be beyond it. A search audits itself: probes at the edge of the
   linking angle around members of the shard are searched too, and the beam doubles until it finds
   ``RECALL`` of what brute force finds for them, and for real queries; a beam as wide as the shard is exact.
5. Verification in double precision: two balls so near that all of their members must link (triangle inequality
   of angles, with a margin for rounding) count as a whole; of all others every pair of members is compared.
6. Connected components of the balls that link are those of the vectors.

No pair of members is ever sent: rows that travel are balls, pairs of balls, and counts per ball or class.
A centre is sent once per shard of its label, as querying every shard asks for.

Nulls and edge cases: a vector that is null, empty or zero, or has null or non-finite components, links with
nothing, and so does one with a null label. Vectors of different lengths are never compared. Rows are told
by label and vector, so null and repeated ids cost nothing; a null id counts as larger than any other in
``component_id``, which is null only if all of its rows have none. Repeated rows link with each other. An
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillclose.llm.frames import components, written
from tillclose.llm.text import mix

LEAST, SHARD, RECALL = 0.93, 4096, 0.99
DEGREE, BUILD_BEAM, FIRST_BEAM = 12, 32, 24
_PROBES, _BATCH = 64, 512
#: Angles closer to a bound than this are compared component by component.
_MARGIN = 1e-6


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, searched for many queries at once."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors, self.levels = vectors, levels
        top = int(levels.max(initial=0))
        self.near = [np.full((len(vectors), DEGREE * 2 if k == 0 else DEGREE), -1, np.int32) for k in range(top + 1)]
        self.entry = -1

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, levels=self.levels, entry=self.entry, **{f"near{i}": x for i, x in enumerate(self.near)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Graph:
        held = np.load(io.BytesIO(data))
        graph = cls(held["vectors"], held["levels"])
        graph.entry = int(held["entry"])
        graph.near = [held[f"near{i}"] for i in range(len(graph.near))]
        return graph

    @classmethod
    def built(cls, vectors: np.ndarray, keys: np.ndarray) -> Graph:
        """Insert all vectors in order; ``keys`` decide their levels."""
        share = (mix(keys.view(np.uint64) ^ np.uint64(0xA5A5)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        levels = np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(DEGREE)).astype(np.int64)
        graph = cls(vectors, np.minimum(levels, 12))
        done = 0
        while done < len(vectors):
            size = min(max(done, 16), _BATCH, len(vectors) - done)
            graph._insert(np.arange(done, done + size))
            done += size
        return graph

    def _insert(self, new: np.ndarray) -> None:
        """Link a batch with what it finds in the graph and with each other."""
        own = self.vectors[new]
        within = own @ own.T
        np.fill_diagonal(within, -2.0)
        start = None
        top = int(self.levels[self.entry]) if self.entry >= 0 else -1
        for level in reversed(range(len(self.near))):
            here = self.levels[new] >= level
            found = np.full((len(new), 0), -1, np.int32)
            if level <= top:
                found, _ = self._layer(own, level, BUILD_BEAM, start)
                start = found[:, :1]
            if not here.any():
                continue
            others = np.where(here[None, :], within, -2.0)[here]
            count = min(BUILD_BEAM, len(new))
            mates = np.argpartition(-others, count - 1, axis=1)[:, :count]
            mates = np.where(np.take_along_axis(others, mates, 1) > -2.0, new[mates], -1)
            chosen = self._diverse(new[here], np.hstack([found[here], mates]), DEGREE)
            self.near[level][new[here], :DEGREE] = chosen
            self._back(level, np.repeat(new[here], DEGREE), chosen.ravel())
        best = new[np.argmax(self.levels[new])]
        if self.entry < 0 or self.levels[best] > self.levels[self.entry]:
            self.entry = int(best)

    def _back(self, level: int, source: np.ndarray, target: np.ndarray) -> None:
        """The same edges from the other end; a full list is chosen anew."""
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(nodes), count.max()), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        width = self.near[level].shape[1]
        for low in range(0, len(nodes), _BATCH):
            part = slice(low, low + _BATCH)
            both = np.hstack([self.near[level][nodes[part]], more[part]])
            self.near[level][nodes[part]] = self._diverse(nodes[part], both, width)

    def _diverse(self, nodes: np.ndarray, offered: np.ndarray, count: int) -> np.ndarray:
        """Up to ``count`` of the offered neighbours, nearest first: first those that are nearer to the node
        than to any neighbour chosen before, then the nearest of the others."""
        offered = np.sort(offered, axis=1)
        offered[:, 1:][offered[:, 1:] == offered[:, :-1]] = -1
        offered[offered == nodes[:, None]] = -1
        near = np.einsum("nd,ncd->nc", self.vectors[nodes], self.vectors[offered])
        near[offered < 0] = -2.0
        order = np.argsort(-near, axis=1, kind="stable")[:, : count * 3]
        offered, near = np.take_along_axis(offered, order, 1), np.take_along_axis(near, order, 1)
        own = self.vectors[offered]
        between = np.einsum("ncd,ned->nce", own, own)
        chosen = np.zeros(offered.shape, bool)
        for at in range(offered.shape[1]):
            hidden = (chosen & (between[:, at, :] > near[:, at, None])).any(axis=1)
            chosen[:, at] = (near[:, at] > -2.0) & ~hidden & (chosen.sum(axis=1) < count)
        rank = np.where(near > -2.0, np.where(chosen, 0, 1), 2)
        order = np.argsort(rank, axis=1, kind="stable")[:, :count]
        out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(offered, order, 1), -1)
        if out.shape[1] < count:
            out = np.hstack([out, np.full((len(out), count - out.shape[1]), -1)])
        return out.astype(np.int32)

    def _layer(self, queries: np.ndarray, level: int, beam: int, start: np.ndarray | None):
        """Best-first search of one level: the ``beam`` nearest found of every query, nearest first."""
        size, near = len(queries), self.near[level]
        rows = np.arange(size)[:, None]
        ids = np.full((size, beam), -1, np.int32)
        sims = np.full((size, beam), -3.0)
        open_ = np.zeros((size, beam), bool)
        seen = np.zeros((size, len(self.vectors) + 1), bool)
        first = np.full((size, 1), self.entry, np.int32) if start is None else start
        ids[:, :1], open_[:, :1] = first, True
        sims[:, :1] = np.einsum("nd,ncd->nc", queries, self.vectors[first])
        seen[rows, first] = True
        step = 2
        while True:
            score = np.where(open_, sims, -4.0)
            take = np.argpartition(-score, min(step, beam) - 1, axis=1)[:, : min(step, beam)]
            live = np.take_along_axis(open_, take, 1)
            busy = np.flatnonzero(live.any(axis=1))
            if not len(busy):
                return ids, sims
            np.put_along_axis(open_, take, False, 1)
            nodes = np.where(live[busy], ids[busy[:, None], take[busy]], -1)
            offered = np.where(nodes[..., None] >= 0, near[nodes], -1).reshape(len(busy), -1)
            offered = np.sort(offered, axis=1)
            fresh = (offered >= 0) & ~seen[busy[:, None], offered]
            fresh[:, 1:] &= offered[:, 1:] != offered[:, :-1]
            seen[busy[:, None], np.where(fresh, offered, len(self.vectors))] = True
            sim = np.full(offered.shape, -3.0)
            at = np.nonzero(fresh)
            sim[at] = np.einsum("nd,nd->n", queries[busy[at[0]]], self.vectors[offered[at]])
            every = np.hstack([sims[busy], sim])
            order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            sims[busy] = np.take_along_axis(every, order, 1)
            ids[busy] = np.take_along_axis(np.hstack([ids[busy], np.where(fresh, offered, -1)]), order, 1)
            open_[busy] = np.take_along_axis(np.hstack([open_[busy], fresh]), order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the nodes each query finds, nearest first, ``-1`` where there are fewer."""
        start = None
        for level in reversed(range(1, int(self.levels[self.entry]) + 1)):
            found, _ = self._layer(queries, level, 4, start)
            start = found[:, :1]
        return self._layer(queries, 0, beam, start)

    def within(self, queries: np.ndarray, least: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with a cosine of at least ``least``. A beam that is full of such nodes says
        that there may be more: those queries go on with twice the beam."""
        out, left = [], np.arange(len(queries))
        while len(left):
            beam, more = min(beam, len(self.vectors)), []
            for low in range(0, len(left), _BATCH):
                part = left[low : low + _BATCH]
                ids, sims = self.search(queries[part], beam)
                hit = (ids >= 0) & (sims >= least[part, None])
                full = hit.all(axis=1) & (beam < len(self.vectors))
                at = np.nonzero(hit & ~full[:, None])
                out.append((part[at[0]], ids[at]))
                more.append(part[full])
            left, beam = np.concatenate(more), beam * 2
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))


def audited(graph: Graph, queries: np.ndarray, least: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """``within`` at the first beam whose audit passes, and that beam.

    The audit compares with brute force: probes at an angle of ``limit`` from vectors of the graph, which are
    the hardest links, and an even share of the queries. A beam as wide as the graph compares with everything.
    """
    size, wide = graph.vectors.shape
    rng = np.random.default_rng(size)
    at = np.unique(np.linspace(0, size - 1, _PROBES).astype(np.int64))
    aside = rng.standard_normal((len(at), wide))
    base = graph.vectors[at]
    aside -= (aside * base).sum(1, keepdims=True) * base
    lengths = np.linalg.norm(aside, axis=1, keepdims=True)
    # In one dimension nothing lies aside.
    aside = np.divide(aside, lengths, out=np.zeros_like(aside), where=lengths > 1e-9)
    probes = np.cos(limit) * base + np.sin(limit) * aside
    some = np.unique(np.linspace(0, len(queries) - 1, _PROBES).astype(np.int64)) if len(queries) else np.zeros(0, np.int64)
    tests = np.vstack([probes, queries[some]])
    bound = np.r_[np.full(len(probes), np.cos(limit) - 1e-9), least[some]]
    wanted = tests @ graph.vectors.T >= bound[:, None]
    beam = FIRST_BEAM
    while True:
        beam = min(beam, size)
        who, what = graph.within(tests, bound, beam)
        if beam == size or wanted[who, what].sum() >= RECALL * wanted.sum():
            break
        beam *= 2
    if beam < size:
        return *graph.within(queries, least, beam), beam
    return *np.nonzero(queries @ graph.vectors.T >= least[:, None]), beam


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vector`` at length one, null where it has no direction, and its length ``dim``."""
    for batch in batches:
        given = batch.column("embedding")
        sizes = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.fill_null(given.flatten(), np.nan).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(sizes)
        largest, length = np.zeros(len(sizes)), np.ones(len(sizes))
        with np.errstate(all="ignore"):
            if len(some):
                first = (np.cumsum(sizes) - sizes)[some]
                largest[some] = np.maximum.reduceat(np.abs(values), first)
                # Scaled by the largest component first, so that no square overflows or vanishes.
                values = values / np.repeat(largest, sizes)
                length[some] = np.sqrt(np.add.reduceat(values * values, first))
            good = np.isfinite(largest) & (largest > 0)
            values = (values / np.repeat(length, sizes))[np.repeat(good, sizes)]
        offsets = np.r_[0, np.cumsum(np.where(good, sizes, 0))].astype(np.int32)
        vector = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~good))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), vector],
            names=["vec_id", "label", "dim", "vector"],
        )


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1]).cast(pa.list_(pa.float64()))


def covered(vectors: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The centre of every vector, and the angle to it: the first one within ``radius``, or itself."""
    centre, off = np.full(len(vectors), -1), np.zeros(len(vectors))
    least = np.cos(radius)
    for at in range(len(vectors)):
        if centre[at] >= 0:
            continue
        rest = np.flatnonzero(centre[at:] < 0) + at
        sims = vectors[rest] @ vectors[at]
        rest, sims = rest[sims >= least], sims[sims >= least]
        centre[rest], off[rest] = at, angle(sims)
        centre[at], off[at] = at, 0.0
    return centre, off


_BALL = (
    "dim int, shard long, ball long, radius double, weight long, centre array<double>, "
    "members array<long>, copies array<long>, vectors array<double>"
)


def _keys(table: pa.Table, rows: int) -> list[pa.Array]:
    """The label and dimension of a group, once per row of its result."""
    return [pa.array([table.column(x)[0].as_py()] * rows, table.column(x).type) for x in ("label", "dim", "shard")]


def _shard_balls(limit: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        order = np.argsort(ids)
        ids, copies, vectors = ids[order], copies[order], _matrix(table.column("vector"))[order]
        centre, off = covered(vectors, limit / 2 - _MARGIN)
        order = np.argsort(centre, kind="stable")
        heads, first = np.unique(centre[order], return_index=True)
        cuts = np.r_[first, len(order)].astype(np.int32)
        wide = vectors.shape[1]
        return pa.table(
            [
                *_keys(table, len(heads)),
                pa.array(ids[heads]),
                pa.array(np.maximum.reduceat(off[order], first)),
                pa.array(np.add.reduceat(copies[order], first)),
                _lists(vectors[heads]),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids[order])),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(copies[order])),
                pa.ListArray.from_arrays(pa.array(cuts * wide), pa.array(vectors[order].ravel())),
            ],
            names=["label", "dim", "shard", "ball", "radius", "weight", "centre", "members", "copies", "vectors"],
        )

    return run


def _shard_graph(table: pa.Table) -> pa.Table:
    """The graph over the centres of a shard, with their ids and radii."""
    balls = table.column("ball").to_numpy()
    order = np.argsort(balls)
    balls, radii = balls[order], table.column("radius").to_numpy()[order]
    graph = Graph.built(_matrix(table.column("centre"))[order], balls).packed()
    return pa.table(
        [*_keys(table, 1), pa.array([balls.tobytes()]), pa.array([radii.tobytes()]), pa.array([graph])],
        names=["label", "dim", "shard", "balls", "radii", "graph"],
    )


def _near_balls(least: float) -> Callable:
    """Balls of a shard that may hold a link with the balls of one block of queries, and whether all of their
    members must link: then no angle between them can exceed the limit."""
    limit = float(np.arccos(least))

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["a", "b", "whole"]
        if not shard.num_rows or not queries.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.bool_())], names=names)
        balls, radii = (np.frombuffer(shard.column(x)[0].as_py(), y) for x, y in (("balls", np.int64), ("radii", np.float64)))
        graph = Graph.unpacked(shard.column("graph")[0].as_py())
        asked, own, centres = queries.column("ball").to_numpy(), queries.column("radius").to_numpy(), _matrix(queries.column("centre"))
        reach = limit + own + radii.max() + _MARGIN
        who, what, _ = audited(graph, centres, np.cos(np.minimum(reach, np.pi)), limit)
        one, two = asked[who], balls[what]
        apart = angle(np.einsum("nd,nd->n", centres[who], graph.vectors[what]))
        reach = own[who] + radii[what]
        keep = (one != two) & (apart <= limit + reach + _MARGIN)
        pairs = np.column_stack([np.minimum(one, two), np.maximum(one, two), apart + reach <= limit - _MARGIN])
        pairs = np.unique(pairs[keep], axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)], names=names)

    return run


_COUNTS = "a long, b long, members array<long>, links array<long>"


def _verified(least: float) -> Callable:
    """Pairs of balls with a link: the members that have one, with the number of their links."""

    def run(batches):
        for batch in batches:
            out = []
            columns = {x: batch.column(x) for x in batch.schema.names}
            for row in range(batch.num_rows):
                (a, b), copies, flat = (
                    [columns[f"{s}_{x}"][row].values.to_numpy() for s in "ab"] for x in ("members", "copies", "vectors")
                )
                left, right = flat[0].reshape(len(a), -1), flat[1].reshape(len(b), -1)
                one, two = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                for low in range(0, len(left), _BATCH):
                    ok = left[low : low + _BATCH] @ right.T >= least
                    one[low : low + _BATCH] = ok @ copies[1]
                    two += copies[0][low : low + _BATCH] @ ok
                if one.any():
                    who, links = np.r_[a, b], np.r_[one, two]
                    pair = columns["a"][row].as_py(), columns["b"][row].as_py()
                    out.append((*pair, who[links > 0].tolist(), links[links > 0].tolist()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)],
                names=["a", "b", "members", "links"],
            )

    return run


def linked(vectors: DataFrame, least: float = LEAST, shard: int = SHARD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``."""
    label = f"label {vectors.schema['label'].dataType.simpleString()}"
    given = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), "label", vectors["embedding"].cast("array<double>").alias("embedding")
    )
    rows = given.mapInArrow(units, f"vec_id long, {label}, dim int, vector array<double>")
    good = F.col("label").isNotNull() & F.col("vector").isNotNull()
    one, two = (F.when(good, F.xxhash64("label", "vector", F.lit(i))) for i in (0, 1))
    rows = written(rows.select("vec_id", "label", "dim", "vector", one.alias("one"), two.alias("two")), "vectors")
    group, same = ["label", "dim"], ["label", "dim", "one", "two"]
    classes = rows.filter("one IS NOT NULL").groupBy(*same).agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"), F.first("vector").alias("vector")
    )
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    shards = written(classes.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards")), "shards")
    dealt = classes.join(shards, group).withColumn("shard", F.pmod(F.xxhash64("class"), "shards"))
    balls = dealt.select(*group, "shard", "class", "copies", "vector").groupBy(*group, "shard")
    balls = written(balls.applyInArrow(_shard_balls(float(np.arccos(least))), f"{label}, {_BALL}"), "balls")
    kind = f"{label}, dim int, shard long, balls binary, radii binary, graph binary"
    graphs = balls.select(*group, "shard", "ball", "radius", "centre").groupBy(*group, "shard")
    graphs = written(graphs.applyInArrow(_shard_graph, kind), "graphs")
    # Blocks of queries are the shards again: every block meets every shard of its label.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    asked = balls.join(shards, group).select(*group, F.col("shard").alias("block"), every.alias("shard"), "ball", "radius", "centre")
    held = graphs.join(shards, group).select(*group, every.alias("block"), "shard", "balls", "radii", "graph")
    meet = [*group, "shard", "block"]
    pairs = held.groupBy(*meet).cogroup(asked.groupBy(*meet)).applyInArrow(_near_balls(least), "a long, b long, whole boolean")
    pairs = written(pairs.groupBy("a", "b").agg(F.max("whole").alias("whole")), "pairs")
    doubtful = pairs.filter("NOT whole").select("a", "b")
    for side in "ab":
        columns = (F.col(x).alias(f"{side}_{x}") for x in ("members", "copies", "vectors"))
        doubtful = doubtful.join(balls.select(F.col("ball").alias(side), *columns), side)
    found = written(doubtful.mapInArrow(_verified(least), _COUNTS), "found")
    wholes = pairs.filter("whole").select("a", "b")
    parts = components(found.select("a", "b").unionByName(wholes))
    of_ball = balls.select("ball", "weight", F.explode("members").alias("class"))
    # Links of all members of a ball: with the others of the ball, and with balls that link as a whole.
    weights = balls.select("ball", "weight")
    each = wholes.select(F.col("a").alias("ball"), F.col("b").alias("other"))
    each = each.unionByName(each.select(F.col("other").alias("ball"), F.col("ball").alias("other")))
    more = each.join(weights.withColumnRenamed("ball", "other"), "other").groupBy("ball").agg(F.sum("weight").alias("more"))
    single = found.select(F.explode(F.arrays_zip("members", "links")).alias("m"))
    single = single.groupBy(F.col("m.members").alias("class")).agg(F.sum("m.links").alias("extra"))
    named = of_ball.join(more, "ball", "left").join(parts.withColumnRenamed("node", "ball"), "ball", "left")
    named = named.join(single, "class", "left").join(classes.select("class", *same, "low"), "class")
    named = written(
        named.select(
            *same,
            "low",
            F.coalesce("component", "ball").alias("component"),
            (F.col("weight") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n_links"),
        ),
        "named",
    )
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").drop("component", "low")
    out = rows.drop("vector").join(named, same, "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
