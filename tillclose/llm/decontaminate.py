"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a window of words and ignores the others, so a substituted word at an
ignored position does not change the hash. Windows of benchmark items and of documents are hashed under
every mask and joined on the hash; each hit puts an item on a diagonal of a document, and the words of
the item are compared with the document's along it. Substitutions cost less than they gain to bridge,
so the best-scoring segment tells a changed copy from chance.

- Documents are scanned once. A bitmap of fixed size, filled from the benchmark in Spark, lets pass
  windows that may hit; only those rows are written and joined. A larger benchmark fills the bitmap and
  lets more rows pass to the join, but nothing is lost and nothing grows on the driver.
- Documents with hits travel once, as word hashes; candidates get the slice under the item only.

Words are runs of letters and digits of the lower-cased text (ASCII punctuation and blanks separate).
An item and a document overlap when at least ``SHARE`` percent of the whole item's words match along the
diagonal, or the segment has at least ``LEAST_MATCHES`` matching words. Up to 19 words, and wherever at
most two words in ten are changed, the masks find every such copy: items under ``LONG`` words have a mask
for each place left free, and any two places of ten words are free in one of ``PAIRS``. Items under
``LEAST_ITEM`` words are no evidence and never match.

Nulls and edge cases: null or empty texts and items match nothing; a null ``doc_id`` is reported as
null; repeated rows are one row of the result; items with equal text are each reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillclose.llm import text as tx
from tillclose.llm.frames import keyed, with_null_ids, written

#: Kept positions of the masks; windows of 11 words with 7 kept, after spaced seeds for similarity search.
MASKS = ((0, 1, 2, 4, 7, 8, 10), (0, 2, 3, 5, 6, 9, 10), (0, 1, 4, 5, 7, 9, 10))
#: For every two places of ten words, one of these fits in without them; the last is for three of fifteen.
PAIRS = (
    (0, 1, 3, 4, 5, 6),
    (0, 1, 2, 3, 6, 7),
    (0, 1, 4, 5, 7, 8),
    (0, 2, 4, 5, 6, 7),
    (0, 1, 2, 4, 6, 8),
    (0, 1, 2, 3, 4, 5),
)
SPAN, LONG = 11, 10
LEAST_ITEM, LEAST_MATCHES, SHARE = 5, 12, 80
MATCH, MISS = 1, -2
FILTER_BITS = 24
_STEPS = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(SPAN)], np.uint64)


def _words(column: pa.Array) -> tx.Words:
    return tx.Words(*tx.buffers(pc.utf8_lower(column.cast(pa.large_string()))), separators=tx.PUNCTUATION)


def _seeds(words: tx.Words, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the kept words of every window, and the windows' first words."""
    span = mask[-1] + 1
    total = len(words.hashes) - span + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:total] == words.doc[span - 1 :])
    with np.errstate(over="ignore"):
        out = np.full(len(at), salt, np.uint64)
        for j, place in enumerate(mask):
            out += words.hashes[at + place] * _STEPS[j]
    return tx.mix(out), at


def masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """The masks of items from ``LONG`` words on, as length 0, and masks with one free place for each
    length of shorter items. A free end is left off, so that a cut item is found as well."""
    own = [(n, tuple(x for x in range(n) if x != free)) for n in short for free in range(1, n)]
    return [*((0, mask) for mask in (*MASKS, *PAIRS)), *own]


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - FILTER_BITS)
    return (hashes >> top).astype(np.int64), (hashes << np.uint64(FILTER_BITS) >> top).astype(np.int64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tx.chunks(batches):
        words = _words(chunk.column("text"))
        values = pa.array(words.hashes.view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), values)
        yield pa.RecordBatch.from_arrays([chunk.column("item_id"), lists], names=["item_id", "words"])


def _item_seeds(short: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            words, ids = _words(chunk.column("text")), np.arange(chunk.num_rows)
            lengths = np.diff(words.first)
            for number, (length, mask) in enumerate(masks(short)):
                hashes, at = _seeds(words, mask, number)
                row = words.doc[at]
                own = lengths[row] == length if length else lengths[row] >= LONG
                hashes, at, row = hashes[own], at[own], row[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.column("item_id").take(pa.array(ids[row])),
                        pa.array(hashes.view(np.int64)),
                        pa.array((at - words.first[row]).astype(np.int32)),
                    ],
                    names=["item_id", "seed", "item_at"],
                )

    return run


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The filter: at most ``2**FILTER_BITS / 64`` rows reach the driver, however many items there are."""
    top = 64 - FILTER_BITS
    first = F.shiftrightunsigned("seed", top)
    second = F.shiftrightunsigned(F.shiftleft("seed", FILTER_BITS), top)
    bits = seeds.select(F.explode(F.array(first, second)).alias("bit")).distinct()
    place = F.shiftrightunsigned("bit", 3).cast("int").alias("place")
    one = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (F.col("bit") % 8).cast("int") + 1)
    rows = bits.select(place, one.alias("one")).groupBy("place").agg(F.sum("one").cast("int").alias("byte"))
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    found = rows.toArrow()
    table[found.column("place").to_numpy()] = found.column("byte").to_numpy()
    return table


def _scan(bitmap: np.ndarray, short: list[int]) -> Callable:
    raw = bitmap.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(raw, np.uint8)

        def passes(places: np.ndarray) -> np.ndarray:
            return (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)

        for chunk in tx.chunks(batches, limit=tx.STEP_BYTES):
            words = _words(chunk.column("text"))
            found, places = [], []
            for number, (_, mask) in enumerate(masks(short)):
                hashes, at = _seeds(words, mask, number)
                one, two = _probes(hashes)
                keep = np.flatnonzero(passes(one))
                keep = keep[passes(two[keep])]
                found.append(hashes[keep])
                places.append(at[keep])
            found, places = np.concatenate(found), np.concatenate(places)
            order = np.argsort(places, kind="stable")
            found, places = found[order], places[order]
            row = words.doc[places]
            rows = np.unique(row)
            if not len(rows):
                continue
            ends = np.r_[0, np.searchsorted(row, rows, "right")].astype(np.int32)
            own = [words.hashes[words.first[r] : words.first[r + 1]] for r in rows]
            sizes = np.cumsum([0, *map(len, own)]).astype(np.int32)
            near = (places - words.first[row]).astype(np.int32)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id").take(take),
                    chunk.column("print").take(take),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(own).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(near)),
                ],
                names=["doc_id", "print", "words", "seeds", "places"],
            )

    return run


def segment(same: np.ndarray) -> tuple[int, int, int]:
    """Best-scoring run of an aligned comparison: start, end and matches."""
    gains = np.r_[0, np.cumsum(np.where(same, MATCH, MISS))]
    low = np.minimum.accumulate(gains)
    end = int(np.argmax(gains - low))
    start = int(np.flatnonzero(gains[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def aligned(same: np.ndarray, size: int) -> tuple[int, int, int] | None:
    """Start, end and matches of an item of ``size`` words along a diagonal, or None if that is chance."""
    whole = int(same.sum())
    if whole * 100 >= size * SHARE:
        places = np.flatnonzero(same)
        return int(places[0]), int(places[-1]) + 1, whole
    start, end, matches = segment(same)
    return (start, end, matches) if matches >= LEAST_MATCHES else None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            item, part = np.array(row["item"], np.int64), np.array(row["part"], np.int64)
            skip = max(0, -row["shift"])
            item_part = item[skip : skip + len(part)]
            found = aligned(item_part == part[: len(item_part)], len(item))
            if found is None:
                continue
            start, end, matches = found
            begin = max(0, row["shift"]) + start
            out.append((row["doc_id"], row["print"], row["item_id"], begin, skip + start, end - start, matches))
        names = ["doc_id", "print", "item_id", "doc_at", "item_at", "n_words", "n_matched"]
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)


def _overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    items = items.select("item_id", "text").filter("text IS NOT NULL")
    words = written(items.mapInArrow(_item_words, "item_id long, words array<long>"), "items")
    sizes = words.groupBy(F.size("words").alias("n")).count().filter((F.col("n") >= LEAST_ITEM) & (F.col("n") < LONG))
    # At most LONG - LEAST_ITEM lengths.
    short = sorted(r.n for r in sizes.collect())
    seeds = written(items.mapInArrow(_item_seeds(short), "item_id long, seed long, item_at int"), "seeds")
    print_ = F.xxhash64("text").alias("print")
    own = keyed(docs).withColumn("print", print_)
    schema = "doc_id long, print long, words array<long>, seeds array<long>, places array<int>"
    hits = written(own.mapInArrow(_scan(_bitmap(seeds), short), schema), "hits")
    hits = hits.dropDuplicates(["doc_id", "print"])
    each = hits.select("doc_id", "print", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    met = each.select("doc_id", "print", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    placed = met.join(seeds, "seed").select(
        "doc_id", "print", "item_id", (F.col("place") - F.col("item_at")).alias("shift")
    )
    placed = placed.distinct().join(words.withColumnRenamed("words", "item"), "item_id")
    joined = placed.join(hits.select("doc_id", "print", "words"), ["doc_id", "print"])
    part = F.slice("words", F.greatest("shift", F.lit(0)) + 1, F.size("item") + F.least("shift", F.lit(0)))
    checked = joined.select("doc_id", "print", "item_id", "shift", "item", part.alias("part")).mapInArrow(
        _verify,
        "doc_id long, print long, item_id long, doc_at long, item_at long, n_words long, n_matched long",
    )
    best = F.max(F.struct("n_matched", (-F.col("n_words")).alias("less"), (-F.col("doc_at")).alias("early"), "item_at"))
    return checked.groupBy("doc_id", "print", "item_id").agg(best.alias("b")).select(
        "doc_id",
        "print",
        "item_id",
        (-F.col("b.early")).alias("doc_at"),
        F.col("b.item_at").alias("item_at"),
        (-F.col("b.less")).alias("n_words"),
        F.col("b.n_matched").alias("n_matched"),
    )


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best overlap of every document and item that have one, in word positions."""
    return with_null_ids(_overlaps(docs, items).drop("print").distinct())


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns."""
    bad = _overlaps(docs, items).select(F.col("doc_id").alias("_c_id"), F.col("print").alias("_c_print")).distinct()
    bad = written(bad, "overlaps")
    doc_id = F.coalesce(docs["doc_id"], F.lit(-(1 << 63)))
    return docs.join(bad, (doc_id == bad["_c_id"]) & (F.xxhash64(docs["text"]) == bad["_c_print"]), "left_anti")
