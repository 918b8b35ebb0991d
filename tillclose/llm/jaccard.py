"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection of sorted arrays.

Two documents link when ``100 * |A n B| >= 75 * |A u B|`` for their sets of word shingles.

1. Every document becomes a set of 64-bit shingle hashes; equal sets are one class, represented by
   the smallest ``doc_id``.
2. Document frequencies: shingles travel as 6-byte hashes, packed by bucket. Shingles of more than one
   class come back to their documents, so each class knows its rarest shingles.
3. Linked sets of sizes ``m <= n`` share one of the rarest ``n - ceil(0.75 n) + 1`` shingles of both,
   and their size bands (powers of 4/3) are equal or next to each other. A class posts those
   shingles; a tile is one shingle in one band and the band below.
   Of shingles that the same classes post, only the one that comes first in their order stays: it has
   the same tiles and the widest bound.
4. Leader rounds: in a tile everyone of another component meets one leader. The first leader is the class
   with the fewest rarer shingles, which is the nearest to the middle of a family; later ones are drawn in each
   tile anew, so a class of many tiles meets as many leaders. Pairs whose parity bitmaps differ in more bits
   than two linked sets can differ in elements are dropped; of the rest one per class is verified in a round,
   by intersecting sorted arrays. Connected components follow, until a round finds no link.
5. Last round: all pairs of *different* components of a tile that are left; position and bitmap bounds
   drop most in the tile, the rest are verified. A family of thousands of near copies is one component
   by then and costs nothing, while no link between components can be missed.

Tiles over ``TILE`` rows are cut into blocks, and every pair of blocks is one task's work.
Nothing is dropped: bounds are exact, and hashes decide only who meets whom. Hash equality stands for
shingle equality at 64 bits.

Nulls and edge cases: a document without words has an empty set, links with nothing and is its own
component; one with fewer words than a shingle has its whole sequence as its only shingle. A document is
an id with a text: rows of a null id or of a repeated id with other texts take part each with its own
text, under a 63-bit hash of both instead of the id. A null ``doc_id`` is the smallest and comes back
null. Repeated rows are equal sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.llm import text as tx
from tillclose.llm.frames import bucket_count, components, may_hold, written

WIDTH, NUM, DEN = 5, 3, 4
TILE = 4096
_BUCKET_BYTES, _LEAST_BUCKETS = 16 << 20, 64
_HASH_BITS = 48
_LEAST_SIGN, _MOST_SIGN = 16, 1024
_LEADER_ROUNDS = 3


def row_sets(chunk: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a chunk."""
    return [own for step in tx.chunks([chunk], limit=tx.STEP_BYTES) for own in _step_sets(step, width)]


def _step_sets(chunk: pa.RecordBatch, width: int) -> list[np.ndarray]:
    words = tx.Words(*tx.buffers(chunk.column("text")), lower=True)
    hashes, at = words.windows(width)
    row = words.doc[at]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])][: len(row)]
    hashes, row = hashes[fresh], row[fresh]
    cut = np.searchsorted(row, np.arange(chunk.num_rows + 1))
    sets = [hashes[low:high] for low, high in zip(cut[:-1], cut[1:], strict=True)]
    short = np.diff(words.first)
    for i in np.flatnonzero((short > 0) & (short < width)):
        sets[i] = np.array([words.row_hash(int(i))], np.uint64)
    return sets


def signature(own: np.ndarray) -> bytes:
    """Parity bitmap of a set: at least four bits per element up to 2048, a power of two of bytes."""
    size = min(max(_LEAST_SIGN, 1 << int(len(own) // 2).bit_length()), _MOST_SIGN)
    bits = np.bincount((own >> np.uint64(20)).astype(np.int64) & (size * 8 - 1), minlength=size * 8) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of signatures (rows of 64-bit words), at the coarser of the two widths."""
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def fold(signs: list[bytes], size: int) -> np.ndarray:
    """Signatures folded to ``size`` bytes: parity bitmaps fold by exclusive or."""
    out = np.zeros((len(signs), size // 8), np.uint64)
    for i, sign in enumerate(signs):
        own = np.frombuffer(sign, np.uint64)
        out[i] = np.bitwise_xor.reduce(own.reshape(-1, size // 8), axis=0)
    return out


def near_enough(apart: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Linked sets differ in at most a seventh of their summed sizes; bits differ at most as often."""
    return apart * (DEN + NUM) <= total * (DEN - NUM)


def row_prints(docs: DataFrame) -> list[Column]:
    """128 bits that tell a row of ``docs`` by its id and text."""
    own = docs["doc_id"].cast("long")
    return [F.xxhash64(own, docs["text"]), F.xxhash64(F.lit(1), own, docs["text"])]


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` (one for each id and text), ``own_id`` as it came, ``text`` and the row's prints.

    The id stands for itself where it has one text, as small numbers pack best.
    """
    one, two = row_prints(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text", one.alias("one"), two.alias("two"))
    texts = rows.filter("own_id IS NOT NULL").groupBy("own_id").agg(F.min("one").alias("a"), F.max("one").alias("b"))
    several = written(texts.filter("a <> b").select(F.col("own_id").alias("several")), "several")
    rows = rows.join(several, F.col("own_id") == F.col("several"), "left")
    alone = F.col("own_id").isNotNull() & F.col("several").isNull()
    hashed = F.col("one").bitwiseOR(F.lit(-(1 << 63)))
    return rows.select(F.when(alone, F.col("own_id")).otherwise(hashed).alias("doc_id"), "own_id", "one", "two", "text")


def _profile(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            sets = row_sets(chunk, width)
            with np.errstate(over="ignore"):
                low = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in sets]
                high = [int(np.bitwise_xor.reduce(tx.mix(x)).view(np.int64)) if len(x) else 0 for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(chunk.column(x) for x in ("doc_id", "own_id", "one", "two")),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(high, pa.int64()),
                ],
                names=["doc_id", "own_id", "one", "two", "n", "low", "high"],
            )

    return run


def _send(width: int, buckets: int) -> Callable:
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            ids = chunk.column("doc_id").to_numpy().astype(np.int64)
            sets = row_sets(chunk, width)
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            if not len(row):
                continue
            hashes = np.concatenate(sets)
            bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            hashes, row, bucket = hashes[order], row[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            rows = [
                (
                    int(bucket[low]),
                    tx.pack(ids[row[low:high]].view(np.uint64)),
                    # The bits of the bucket are known there.
                    tx.pack_raw(hashes[low:high] << np.uint64(bits) >> np.uint64(64 - _HASH_BITS), 6),
                )
                for low, high in zip(cut[:-1], cut[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in rows], pa.int32()),
                    pa.array([x[1] for x in rows], pa.binary()),
                    pa.array([x[2] for x in rows], pa.binary()),
                ],
                names=["bucket", "docs", "hashes"],
            )

    return run


def _frequent(buckets: int) -> Callable:
    bits = buckets.bit_length() - 1

    def run(table: pa.Table) -> pa.Table:
        top = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(64 - bits)
        docs = np.concatenate([tx.unpack(x).view(np.int64) for x in table.column("docs").to_pylist()])
        raw = b"".join(table.column("hashes").to_pylist())
        # In place: a bucket is the most a worker holds here.
        hashes = tx.unpack_raw(raw, 6)
        hashes <<= np.uint64(64 - _HASH_BITS)
        hashes >>= np.uint64(bits)
        hashes |= top
        del raw
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        del ordered
        order = order[np.r_[False, same] | np.r_[same, False]]
        docs, hashes = docs[order], hashes[order]
        order = np.lexsort((docs, hashes))
        docs, hashes = docs[order], hashes[order]
        # A document counts once, also if it came twice or if two of its shingles share a hash.
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])][: len(docs)]
        docs, hashes = docs[fresh], hashes[fresh]
        _, group, count = np.unique(hashes, return_inverse=True, return_counts=True)
        count = count[group]
        keep = count > 1
        docs, hashes, count = docs[keep], hashes[keep], count[keep]
        part = _part(docs, buckets)
        order = np.lexsort((docs, part))
        docs, hashes, count, part = docs[order], hashes[order], count[order], part[order]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
        rows = [
            (
                int(part[low]),
                tx.pack(docs[low:high].view(np.uint64)),
                tx.pack_raw(hashes[low:high], 8),
                tx.pack(count[low:high]),
            )
            for low, high in zip(cut[:-1], cut[1:], strict=True)
        ]
        return pa.table(
            [pa.array([x[0] for x in rows], pa.int32())]
            + [pa.array([x[i] for x in rows], pa.binary()) for i in (1, 2, 3)],
            names=["part", "docs", "hashes", "counts"],
        )

    return run


def _part(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part of each document; ``_part_of`` says the same to Spark."""
    return (docs ^ (docs >> 17) ^ (docs >> 34)) & (parts - 1)


def _part_of(doc: Column, parts: int) -> Column:
    spread = doc.bitwiseXOR(F.shiftright(doc, 17)).bitwiseXOR(F.shiftright(doc, 34))
    return spread.bitwiseAND(F.lit(parts - 1).cast("long")).cast("int")


def _post(shared: pa.Table, classes: pa.Table) -> pa.Table:
    """The rarest shingles of each class, with the rank they have in it."""
    names = ["shingle", "doc_id", "n", "rank", "band"]
    empty = pa.table([pa.array([], pa.int64())] * 5, names=names)
    if not shared.num_rows or not classes.num_rows:
        return empty
    docs = np.concatenate([tx.unpack(x).view(np.int64) for x in shared.column("docs").to_pylist()])
    hashes = tx.unpack_raw(b"".join(shared.column("hashes").to_pylist()), 8).view(np.int64)
    counts = np.concatenate([tx.unpack(x).view(np.int64) for x in shared.column("counts").to_pylist()])
    reps, sizes, copies = (classes.column(x).to_numpy() for x in ("doc_id", "n", "copies"))
    turn = np.argsort(reps)
    reps, sizes, copies = reps[turn], sizes[turn], copies[turn]
    at = np.minimum(np.searchsorted(reps, docs), len(reps) - 1)
    # Only representatives post, and only shingles that not just copies of their class hold; those come first.
    keep = (reps[at] == docs) & (counts > copies[at])
    docs, hashes, counts, at = docs[keep], hashes[keep], counts[keep], at[keep]
    order = np.lexsort((hashes, counts, docs))
    docs, hashes, at = docs[order], hashes[order], at[order]
    if not len(docs):
        return empty
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    held = np.diff(np.r_[first, len(docs)])
    nth = np.arange(len(docs)) - np.repeat(first, held)
    n = sizes[at]
    alone = n - np.repeat(held, held)
    keep = nth < n - -(-n * NUM // DEN) + 1 - alone
    columns = [hashes[keep], docs[keep], n[keep], (alone + nth)[keep], band(n[keep].astype(np.float64))]
    return pa.table([pa.array(x) for x in columns], names=names)


def band(size: np.ndarray) -> np.ndarray:
    """Size band: sets of a link are in the same band or in neighbouring ones."""
    return np.floor(np.log(size) / np.log(DEN / NUM) + 1e-9).astype(np.int64)


def _bitmap_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow a link."""
    for batch in batches:
        left, right = batch.column("a_sign").to_pylist(), batch.column("b_sign").to_pylist()
        width = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)])
        total = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
        keep = np.zeros(len(left), bool)
        for size in np.unique(width):
            at = np.flatnonzero(width == size)
            one, two = (fold([x[i] for i in at], int(size)) for x in (left, right))
            keep[at] = near_enough(bits_apart(one, two), total[at])
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def _block_pairs(table: pa.Table) -> pa.Table:
    """Pairs of different components in one block, or between two blocks, of a tile.

    Rows of the tile's own band are compared with each other and with the band below.
    """
    doc, n, rank, part, block, home = (
        table.column(x).to_numpy() for x in ("doc_id", "n", "rank", "component", "block", "home")
    )
    signs = table.column("sign").to_pylist()
    first, second = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    size = min(map(len, signs))
    folded = fold(signs, size)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    out = []
    for i in left:
        others = right if first != second else right[right > i]
        low, high = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
        ok = (part[others] != part[i]) & (home[i] | home[others]) & (low * DEN >= high * NUM)
        # Shingles of higher rank that both can still share, this one included.
        rest = np.minimum(n[i] - rank[i], n[others] - rank[others])
        ok &= rest * (DEN + NUM) >= (n[i] + n[others]) * NUM
        others = others[ok]
        others = others[near_enough(bits_apart(folded[i], folded[others]), n[i] + n[others])]
        out += [(min(doc[i], doc[j]), max(doc[i], doc[j])) for j in others]
    out = sorted(set(out))
    return pa.table(
        [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"]
    )


def _pack_sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            sets = row_sets(chunk, width)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([signature(x) for x in sets], pa.binary()),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                names=["doc_id", "n", "sign", "shingles"],
            )

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, two in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True):
            left, right = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            small, large = (left, right) if len(left) <= len(right) else (right, left)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[at] == small).sum())
            keep.append(common * DEN >= NUM * (len(left) + len(right) - common))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that link, by intersecting the exact sets.

    Only sets that a pair names travel: that of ``b`` once per pair, that of ``a`` once.
    """
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set"))
    left = left.join(pairs.select("a").distinct(), "a", "left_semi")
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "a_set", "b_set")
    return joined.mapInArrow(_verify, "a long, b long")


def _met(postings: DataFrame) -> DataFrame:
    """Postings of shingles with several classes, one shingle for each set of classes."""
    groups = postings.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("one"),
        F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("two"),
        # All classes of the group rank its shingles alike, so one of them tells the first.
        F.min(F.struct("doc_id", "rank"))["rank"].alias("rank"),
    )
    kept = groups.filter("size > 1").groupBy("size", "one", "two").agg(F.min(F.struct("rank", "shingle")).alias("f"))
    return postings.join(kept.select(F.col("f.shingle").alias("shingle")), "shingle")


def _tiles(postings: DataFrame) -> DataFrame:
    """Each posting in the tile of its band, and as a guest in the tile of the band above."""
    tiles = F.array(
        F.struct(F.col("band").alias("tile"), F.lit(True).alias("home")),
        F.struct((F.col("band") + 1).alias("tile"), F.lit(False).alias("home")),
    )
    return postings.withColumn("at", F.explode(tiles)).select("*", "at.tile", "at.home").drop("at", "band")


def _known(postings: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Postings with the component of their class so far."""
    if parts is None:
        return postings.withColumn("component", F.col("doc_id"))
    named = postings.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.withColumn("component", F.coalesce("component", "doc_id"))


def _leader_pairs(known: DataFrame, turn: int) -> DataFrame:
    """Everyone (``b``) of a tile with one leader (``a``) of the tile's band and another component.

    A leader drawn alike in all tiles would be the same in all tiles of a family: most would meet but one.
    """
    first = F.lit(0) if turn else F.col("rank")
    order = F.struct(first.alias("first"), F.xxhash64("doc_id", "shingle", F.lit(turn)), "doc_id", "n", "component")
    leaders = known.groupBy("shingle", F.col("band").alias("tile")).agg(F.min(order).alias("leader"))
    met = _tiles(known).join(leaders, ["shingle", "tile"]).filter("component <> leader.component")
    met = met.filter("4 * least(n, leader.n) >= 3 * greatest(n, leader.n)")
    return met.select(F.col("leader.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _one_each(pairs: DataFrame, turn: int) -> DataFrame:
    """One leader for every ``b``, which is enough to join it to its component; others wait for later rounds."""
    first = F.min(F.struct(F.xxhash64("a", F.lit(turn)), "a")).alias("first")
    return pairs.groupBy("b").agg(first).select("first.a", "b")


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Pairs that were not verified before, in either order."""
    if tried is None:
        return pairs
    both = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow a link."""
    for side in ("a", "b"):
        own = sets.select(
            F.col("doc_id").alias(side), F.col("n").alias(f"{side}_n"), F.col("sign").alias(f"{side}_sign")
        )
        pairs = pairs.join(own, side)
    return pairs.select("a", "b", "a_n", "b_n", "a_sign", "b_sign").mapInArrow(_bitmap_pairs, "a long, b long")


def _last_pairs(known: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """All pairs of different components that meet in a tile and that the bounds allow."""
    rows = _tiles(known)
    sizes = rows.groupBy("shingle", "tile").agg(
        F.count(F.lit(1)).alias("size"),
        F.max("home").alias("any_home"),
        (F.min("component") != F.max("component")).alias("open"),
    )
    sizes = sizes.filter("open AND any_home").select(
        "shingle", "tile", F.ceil(F.col("size") / tile).cast("int").alias("blocks")
    )
    rows = rows.join(sizes, ["shingle", "tile"]).join(sets.select("doc_id", "sign"), "doc_id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    return rows.groupBy("shingle", "tile", "one", "two").applyInArrow(_block_pairs, "a long, b long").distinct()


def members(docs: DataFrame, width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """``doc_id, n``, the prints ``one`` and ``two`` of every row, and ``lead``: id and prints of the
    component's row with the smallest id (null without words)."""
    docs = _documents(docs)
    schema = "doc_id long, own_id long, one long, two long, n long, low long, high long"
    profile = written(docs.mapInArrow(_profile(width), schema), "sets")
    filled = profile.filter("n > 0")
    # A document counts once, as in the document frequencies, also if its row is repeated.
    lead = F.min(F.struct(F.col("own_id").alias("doc_id"), "one", "two")).alias("lead")
    once = filled.groupBy("n", "low", "high", "doc_id").agg(lead)
    classes = once.groupBy("n", "low", "high").agg(
        F.min("doc_id").alias("doc_id"),
        F.count(F.lit(1)).alias("copies"),
        F.min("lead").alias("lead"),
    )
    classes = written(classes, "classes")
    buckets = bucket_count(docs, _BUCKET_BYTES, _LEAST_BUCKETS)
    shared = (
        docs.mapInArrow(_send(width, buckets), "bucket int, docs binary, hashes binary")
        .groupBy("bucket")
        .applyInArrow(_frequent(buckets), "part int, docs binary, hashes binary, counts binary")
    )
    reps = classes.select(_part_of(F.col("doc_id"), buckets).alias("part"), "doc_id", "n", "copies")
    postings = shared.groupBy("part").cogroup(reps.groupBy("part")).applyInArrow(
        _post, "shingle long, doc_id long, n long, rank long, band long"
    )
    postings = written(_met(written(postings, "postings")), "tiles")
    wanted = written(postings.select("doc_id").distinct(), "wanted")
    # Texts are not shuffled: those that may be wanted are cut to sets first. A repeated row has its set
    # once, and from here on sets are read where they were written.
    schema = "doc_id long, n long, sign binary, shingles binary"
    near = may_hold(docs.select("doc_id", "text"), docs["doc_id"], wanted).filter("may").select("doc_id", "text")
    sets = near.mapInArrow(_pack_sets(width), schema).join(wanted, "doc_id", "left_semi")
    sets = written(sets.dropDuplicates(["doc_id"]), "shingles")
    tried = links = parts = None
    for turn in range(_LEADER_ROUNDS):
        pairs = _untried(_leader_pairs(_known(postings, parts), turn), tried)
        pairs = written(_one_each(_possible(pairs, sets), turn), "pairs")
        found = written(_linked(pairs, sets), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if parts is not None and found.isEmpty():
            break
        parts = written(components(links), "parts")
    pairs = written(_untried(_last_pairs(_known(postings, parts), sets, tile), tried), "pairs")
    links = links.unionByName(written(_linked(pairs, sets), "links"))
    parts = written(components(links), "parts").select(F.col("node").alias("rep"), F.col("component").alias("root"))
    own = classes.select("n", "low", "high", F.col("doc_id").alias("rep"), "lead")
    first = parts.join(own, "rep").groupBy("root").agg(F.min("lead").alias("first"))
    named = own.join(parts.join(first, "root"), "rep", "left")
    named = named.select("n", "low", "high", F.coalesce("first", "lead").alias("lead"))
    out = profile.join(named, ["n", "low", "high"], "left")
    return out.select(F.col("own_id").alias("doc_id"), "n", "one", "two", "lead")


def near_duplicates(docs: DataFrame, width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    component = F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    return members(docs, width, tile).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")
    )
