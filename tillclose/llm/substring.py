"""Substring dedup: words covered by a window of words that also starts earlier are removed.

Rabin-Karp hashes of all windows of ``width`` words are computed in numpy, chunk by chunk, and counted
in Spark: every chunk sends the first occurrence of each hash to the hash's bucket, where all but the
earliest one are marked. What repeats inside a chunk is marked there. Marks return to their document
and merge into maximal removal intervals.

- The shuffle carries 7 bytes of hash and about 1.5 of position for each distinct window of a chunk;
  a window that holds a third of all rows arrives once per chunk, so no bucket is unbounded.
- Buckets are a power of two that follows the size of the texts.
- Texts are hashed into the key only where an id repeats, so a table of unique ids carries no more.
- Equality is that of 64-bit hashes: among ``n`` windows, about ``n**2 / 2**65`` pairs collide.

Nulls and edge cases: a null or empty text has no words; a text of fewer than ``width`` words keeps all;
a null ``doc_id`` orders first. A document is told by its id and its text: rows with the same (or no) id and
different texts are documents of their own, ordered among each other by a hash of the text, and a mark of
one never removes words of another. Rows equal in both are one document seen several times and return alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillclose.llm import text as tx
from tillclose.llm.frames import bucket_count, keyed, may_hold, with_null_ids, written

WIDTH = 20
_BUCKET_BYTES, _LEAST_BUCKETS = 4 << 20, 256
_SENT = "bucket int, docs binary, prints binary, counts binary, at binary, hashes binary"
_MARKS = "part int, docs binary, prints binary, starts binary, ends binary"


def _told(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``print``, which is 0 for ids of one row and tells the texts of all others.

    Decided by the bitmap alone: an id it takes for a repeated one gets a print in all of its rows, which
    changes no result.
    """
    docs = keyed(docs)
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = written(counts.filter("rows > 1").select("doc_id"), "repeated")
    many = may_hold(docs, F.col("doc_id"), repeated)
    text = F.coalesce("text", F.lit(""))
    return many.select("doc_id", "text", F.when(F.col("may"), F.xxhash64(text)).otherwise(0).alias("print"))


def _merge(docs: np.ndarray, prints: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Union of intervals per document, as sorted arrays."""
    order = np.lexsort((starts, prints, docs))
    docs, prints, starts, ends = docs[order], prints[order], starts[order], ends[order]
    if not len(docs):
        return docs, prints, starts, ends
    # Shift every document behind the previous one, so one running maximum serves all.
    nth = np.cumsum(_changes(docs, prints)) - 1
    shift = nth.astype(np.int64) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + shift)
    new = np.r_[True, (starts + shift)[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(docs) - 1]
    return docs[new], prints[new], starts[new], (reach - shift)[last]


def _changes(docs: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Where a new document begins in sorted arrays that are not empty."""
    return np.r_[True, (docs[1:] != docs[:-1]) | (prints[1:] != prints[:-1])]


def _mark_rows(docs: np.ndarray, prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, parts: int):
    """Rows of marks, by the part of their document."""
    key = docs.view(np.uint64) ^ tx.mix(prints.view(np.uint64))
    part = (tx.mix(key) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    docs, prints, starts, ends, part = docs[order], prints[order], starts[order], ends[order], part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    for low, high in zip(cut[:-1], cut[1:], strict=True):
        columns = (docs, prints, starts, ends)
        yield (int(part[low]), *(tx.pack(x[low:high].view(np.uint64)) for x in columns))


def _send(width: int, buckets: int) -> Callable:
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            ids = chunk.column("doc_id").to_numpy().astype(np.int64)
            prints = chunk.column("print").to_numpy().astype(np.int64)
            words = tx.Words(*tx.buffers(chunk.column("text")))
            hashes, at = words.windows(width)
            if not len(hashes):
                continue
            row = words.doc[at]
            # Sorted by hash, then document, then position: the first of each hash leads.
            order = np.lexsort((at - words.first[row], prints[row], ids[row], hashes))
            same = np.r_[False, hashes[order][1:] == hashes[order][:-1]]
            again = order[same]
            lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))][same]
            # Two rows of one document hold the same occurrence.
            place = at - words.first[row]
            one, two = row[again], row[lead]
            late = (ids[one] != ids[two]) | (prints[one] != prints[two]) | (place[again] != place[lead])
            again = again[late]
            rows = []
            marks = _merge(ids[row[again]], prints[row[again]], place[again], place[again] + width)
            for part, *packed in _mark_rows(*marks, buckets):
                rows.append((-1 - part, *packed, b""))
            first = np.sort(order[~same])
            bucket = (hashes[first] >> np.uint64(64 - bits)).astype(np.int64)
            turn = np.argsort(bucket, kind="stable")
            first, bucket = first[turn], bucket[turn]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                own = first[low:high]
                here, counts = np.unique(row[own], return_counts=True)
                rows.append(
                    (
                        int(bucket[low]),
                        tx.pack(ids[here].view(np.uint64)),
                        tx.pack(prints[here].view(np.uint64)),
                        tx.pack(counts),
                        tx.pack(place[own]),
                        tx.pack_raw(hashes[own], 7),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW_SENT, strict=True)],
                names=["bucket", "docs", "prints", "counts", "at", "hashes"],
            )

    return run


_ARROW_SENT = [pa.int32(), *[pa.binary()] * 5]


def _count(width: int, buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            # Marks made inside a chunk only pass.
            out = pa.table(
                [
                    pa.array([-1 - bucket] * table.num_rows, pa.int32()),
                    *(table.column(x).combine_chunks() for x in ("docs", "prints", "counts", "at")),
                ],
                names=["part", "docs", "prints", "starts", "ends"],
            )
            return out
        docs, prints, at, hashes = [], [], [], []
        for row in table.to_pylist():
            counts = tx.unpack(row["counts"]).astype(np.int64)
            docs.append(np.repeat(tx.unpack(row["docs"]).view(np.int64), counts))
            prints.append(np.repeat(tx.unpack(row["prints"]).view(np.int64), counts))
            at.append(tx.unpack(row["at"]).view(np.int64))
            hashes.append(tx.unpack_raw(row["hashes"], 7))
        docs, prints, at, hashes = map(np.concatenate, (docs, prints, at, hashes))
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        docs, prints, at, hashes = docs[order], prints[order], at[order], hashes[order]
        order = np.lexsort((at, prints, docs, hashes))
        docs, prints, at, hashes = docs[order], prints[order], at[order], hashes[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        late = (docs != docs[lead]) | (prints != prints[lead]) | (at != at[lead])
        docs, prints, at = docs[late], prints[late], at[late]
        rows = list(_mark_rows(docs, prints, at, at + width, buckets))
        return pa.table(
            [
                pa.array([x[0] for x in rows], pa.int32()),
                *(pa.array([x[i] for x in rows], pa.binary()) for i in (1, 2, 3, 4)),
            ],
            names=["part", "docs", "prints", "starts", "ends"],
        )

    return run


def _gather(table: pa.Table) -> pa.Table:
    columns = [
        np.concatenate([tx.unpack(x).view(np.int64) for x in table.column(name).to_pylist()])
        for name in ("docs", "prints", "starts", "ends")
    ]
    docs, prints, starts, ends = _merge(*columns)
    low = np.flatnonzero(_changes(docs, prints)) if len(docs) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[low, len(docs)].astype(np.int32))
    spans = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (starts, ends)]
    keys = [pa.array(docs[low]), pa.array(prints[low])]
    return pa.table([*keys, *spans], names=["doc_id", "print", "starts", "ends"])


def _spans(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    sent = docs.mapInArrow(_send(width, buckets), _SENT)
    marks = sent.groupBy("bucket").applyInArrow(_count(width, buckets), _MARKS)
    return marks.groupBy("part").applyInArrow(
        _gather, "doc_id long, print long, starts array<int>, ends array<int>"
    )


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``print``, ``starts``, ``ends``: the maximal word intervals to remove, for documents with
    any; ``print`` is 0, or tells the texts of a repeated id."""
    return _spans(_told(docs), width, bucket_count(docs, _BUCKET_BYTES, _LEAST_BUCKETS))


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tx.chunks(batches):
        totals, removed, kept = [], [], []
        for text, starts, ends in zip(
            *(chunk.column(x).to_pylist() for x in ("text", "starts", "ends")), strict=True
        ):
            words = (text or "").encode().split()
            totals.append(len(words))
            if starts:
                left, at = [], 0
                for low, high in zip(starts, ends, strict=True):
                    left += words[at:low]
                    at = high
                words = left + words[at:]
            removed.append(totals[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                pa.array(totals, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: every document without its repeated windows."""
    told = _told(docs)
    spans = _spans(told, width, bucket_count(docs, _BUCKET_BYTES, _LEAST_BUCKETS))
    joined = told.join(spans, ["doc_id", "print"], "left")
    out = joined.mapInArrow(_cut_words, "doc_id long, n_words long, n_removed long, kept string")
    return with_null_ids(out)
