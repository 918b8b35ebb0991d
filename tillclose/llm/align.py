"""Alignment of two tokenizers' ids on the same bytes, and which ids stand for each other in the corpus.

0. Neither side joins a space to what stands before it (checked for the model), so a text is split there, and
   each distinct unit is encoded and aligned once; groups and links of a text are those of its units.
1. A unit is encoded by both; the cumulative ends of the tokens go into a dictionary from end to index
   per side. The intersection of the two key sets, sorted, cuts both id lists into groups that cover the
   same bytes; nothing inside a group ends together.
2. Links are the pairs of tokens whose bytes overlap, expanded slice by slice: between two cuts each place
   where either side ends closes one overlap, so a slice of ``m`` and ``n`` tokens has ``m + n - 1`` links.
3. Tasks reduce a chunk of texts to its distinct id pairs with the number of its documents that hold each,
   and keep the links of its documents as places in that list. Spark sums the pairs over all chunks, takes
   the highest count of every first id, and sends each chunk the counts of its own pairs: a pair that every
   document holds travels once per chunk.

Side A is a byte-level BPE ``tokenizer.json``; it encodes a space and the text. Side B is a sentencepiece
model, which puts the space itself. Strings of special tokens are plain text on both sides.

Nulls and edge cases: a text that is null or empty, or that either side changes (its token bytes do not join
to the space and the text), has no tokens, groups or links. Rows are documents: null and repeated ids come
back as they are, and repeated rows count each. An empty table gives an empty result. Other columns are never
read. A single text must fit in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillclose.llm import text as tx
from tillclose.llm.frames import written
from tillclose.llm.token_counts import BYTE_LEVEL, counts


# The longest stretches that begin with a space after something that is no blank on either side.
_UNIT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
_WHOLE = re.compile(r"(?s).+")
# Units that are encoded as one string.
_BLOCK = 128


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Per offset at which both sides end, in order: how many tokens of each end there or before."""
    a_at, b_at = (dict(zip(x.tolist(), range(1, len(x) + 1), strict=True)) for x in (a_ends, b_ends))
    common = sorted(a_at.keys() & b_at.keys())
    return np.array([list(map(x.__getitem__, common)) for x in (a_at, b_at)], np.int64).reshape(2, -1).T


class Aligned:
    """Units with the ids of both sides: ``cuts`` are the tokens of each side up to the end of every group,
    ``ends`` the groups up to the end of every unit, and ``good`` says which units neither side changes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, sizes: np.ndarray):
        self.a, self.b, self.a_ends, self.b_ends = a, b, a_ends, b_ends
        self.cuts = common_ends(a_ends, b_ends)
        self.good = sizes > 0
        offsets = np.r_[0, a_ends][self.cuts[:, 0]]
        self.ends = np.searchsorted(offsets, np.cumsum(sizes), "right")

    def tokens(self) -> np.ndarray:
        """Tokens of both sides, groups and links of every unit."""
        at = np.vstack([np.zeros((1, 2), np.int64), self.cuts])[np.r_[0, self.ends]]
        both = np.diff(at, axis=0)
        groups = np.diff(np.r_[0, self.ends])
        # A slice of m and n tokens has m + n - 1 overlaps.
        return np.column_stack([both, groups, both.sum(1) - groups])

    def links(self) -> np.ndarray:
        """The id pairs of all overlaps, slice by slice, as one number each.

        In a slice every place where either side ends closes one overlap.
        """
        closed = np.union1d(self.a_ends, self.b_ends)
        left, right = self.a[np.searchsorted(self.a_ends, closed)], self.b[np.searchsorted(self.b_ends, closed)]
        return left << 32 | right

    def groups(self) -> list[tuple[list[int], list[int]]]:
        """The ids of each group."""
        a, b, out, i, j = self.a.tolist(), self.b.tolist(), [], 0, 0
        for up, to in zip(*self.cuts.T.tolist(), strict=True):
            out.append((a[i:up], b[j:to]))
            i, j = up, to
        return out

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every unit: its groups with their ids in order."""
        # Few ids make up most tokens: each is written once.
        a, b = (np.array(list(map(str, ids.tolist())), object)[at].tolist() for ids, at in (np.unique(x, return_inverse=True) for x in (self.a, self.b)))
        each, i, j = [], 0, 0
        for up, to in zip(*self.cuts.T.tolist(), strict=True):
            each.append(f"{','.join(a[i:up])}|{','.join(b[j:to])}" if up - i + to - j > 2 else f"{a[i]}|{b[j]}")
            i, j = up, to
        return [";".join(each[low:high]) for low, high in pairwise([0, *self.ends.tolist()])]


class Pair:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        self.a_bytes = dict(counts(a_path).tokens)
        ranks = {token: rank for rank, token in self.a_bytes.items()}
        self._a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = {i: self._piece(i) for i in range(self._b.get_piece_size())}
        self._sizes = []
        for kind in (self.a_bytes, self.b_bytes):
            sizes = np.zeros(max(kind) + 1, np.int64)
            sizes[list(kind)] = [len(x) for x in kind.values()]
            self._sizes.append(sizes)
        # Units are exact only if no token of B goes on over a space into the next unit.
        self._space = self._b.piece_to_id("▁")
        apart = self._space != self._b.unk_id() and not any(b" " in x.lstrip(b" ") for x in self.b_bytes.values())
        self._split = (_UNIT if apart else _WHOLE).findall

    def _piece(self, at: int) -> bytes:
        piece = self._b.id_to_piece(at)
        return bytes([int(piece[3:-1], 16)]) if self._b.is_byte(at) else piece.replace("▁", " ").encode()

    def split(self, text: str | None) -> list[str]:
        """The units of a space and the text; none of an empty one."""
        return self._split(" " + text) if text else []

    def _encoded(self, blocks: list[list[str]]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """Ids of both sides, and the bytes of every unit; a unit that a side changes has no ids and none."""
        wholes = ["".join(x) for x in blocks]
        # The model puts the first space itself, but leaves a lone one out.
        right = self._b.encode([x[1:] for x in wholes], num_threads=1)
        for units, whole, b in zip(blocks, wholes, right, strict=True):
            a, b, data = self._a.encode_ordinary(whole), [self._space] if whole == " " else b, whole.encode()
            sides = (self.a_bytes, a), (self.b_bytes, b)
            if all(b"".join(map(kind.__getitem__, ids)) == data for kind, ids in sides):
                yield a, b, [len(x.encode()) for x in units]
            elif len(units) == 1:
                yield [], [], [0]
            else:
                half = len(units) // 2
                yield from self._encoded([units[:half], units[half:]])

    def align(self, units: list[str]) -> Aligned:
        """Tokens and groups of units. Those that end in a blank would run into the next one, so they, the
        last ones of their texts, are encoded each on its own."""
        blocks = [[]]
        for unit in units:
            if unit[-1].isspace():
                blocks += [[unit], []]
                continue
            if len(blocks[-1]) >= _BLOCK:
                blocks.append([])
            blocks[-1].append(unit)
        parts = list(self._encoded([x for x in blocks if x]))
        a, b, sizes = (np.fromiter(chain.from_iterable(x[i] for x in parts), np.int64) for i in range(3))
        return Aligned(a, b, np.cumsum(self._sizes[0][a]), np.cumsum(self._sizes[1][b]), sizes)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """The two tokenizers, made once per worker."""
    key = (a_path, b_path)
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id`` and its ``groups``: ids of both sides that cover the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for chunk in tx.chunks(batches):
            found = []
            for text in chunk.column("text").to_pylist():
                whole = own.align(own.split(text))
                found.append([{"a": a, "b": b} for a, b in whole.groups()] if whole.good.all() else [])
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(found, kind)], names=["doc_id", "groups"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>"
    )


_CHUNK = (
    "chunk long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, "
    "groups_sha256: string, pairs: long>>, places binary, times binary, pairs array<long>, held array<long>"
)


def _reduced(a_path: str, b_path: str):
    """A chunk's documents, its distinct id pairs with their documents, and who holds which."""
    kind = pa.struct(
        [(x, pa.int64()) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string()), ("pairs", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        for chunk in tx.chunks(batches):
            split = [own.split(x) for x in chunk.column("text").to_pylist()]
            place = {x: i for i, x in enumerate(set().union(*split))}
            units = own.align(list(place))
            sizes, texts = units.tokens(), units.texts()
            at = np.fromiter((place[x] for one in split for x in one), np.int64)
            ends = np.r_[0, np.cumsum([len(x) for x in split])]
            # A text with a unit that a side changes has no tokens at all.
            good = np.diff(np.r_[0, np.cumsum(~units.good[at])][ends]) == 0
            totals = np.diff(np.vstack([np.zeros((1, 4), np.int64), np.cumsum(sizes[at], 0)])[ends], axis=0) * good[:, None]
            digests = [
                sha256(";".join([texts[place[x]] for x in one]).encode()).hexdigest() if one and ok else ""
                for one, ok in zip(split, good, strict=True)
            ]
            # The links of every unit, then of every text, as places among the chunk's id pairs.
            pairs, of_unit = np.unique(units.links(), return_inverse=True)
            doc = np.repeat(np.arange(len(split)), np.diff(ends))
            at, doc = at[good[doc]], doc[good[doc]]
            each = sizes[at, 3]
            first = np.r_[0, np.cumsum(sizes[:, 3])][at]
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            link = of_unit[np.repeat(first, each) + inside]
            key, times = np.unique(np.repeat(doc, each) * max(len(pairs), 1) + link, return_counts=True)
            doc, link = np.divmod(key, max(len(pairs), 1))
            held = np.bincount(link, minlength=len(pairs))
            # Pairs that only texts without tokens would have had go.
            pairs, link, held = pairs[held > 0], (np.cumsum(held > 0) - 1)[link], held[held > 0]
            columns = [chunk.column("doc_id").to_pylist(), *totals.T, digests, np.bincount(doc, minlength=len(split))]
            fields = [pa.array(x, kind.field(i).type) for i, x in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays([0, len(split)], pa.StructArray.from_arrays(fields, fields=list(kind))),
                    pa.array([tx.pack(link)], pa.binary()),
                    pa.array([tx.pack(times)], pa.binary()),
                    pa.array([pairs], pa.list_(pa.int64())),
                    pa.array([held], pa.list_(pa.int64())),
                ],
                names=["chunk", "docs", "places", "times", "pairs", "held"],
            )
            number += 1

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk with the counts of their links."""
    for batch in batches:
        for row in range(batch.num_rows):
            docs = batch.column("docs")[row].values
            table = batch.column("table")[row].values
            key, count, best = (table.field(x).to_numpy(zero_copy_only=False) for x in ("pair", "n_docs", "best"))
            order = np.argsort(key)
            count, best = count[order], best[order]
            place = tx.unpack(batch.column("places")[row].as_py()).astype(np.int64)
            time = tx.unpack(batch.column("times")[row].as_py()).astype(np.int64)
            # Sums over the links of each document: differences of running sums at its end.
            ends = np.r_[0, np.cumsum(docs.field("pairs").to_numpy())]
            sums = [
                np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (time * best[place], time * count[place])
            ]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.RecordBatch.from_arrays(
                [*(docs.field(x) for x in names), *map(pa.array, sums), docs.field("groups_sha256")],
                names=[*names, "n_best", "count_sum", "groups_sha256"],
            )


def _pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair``, ``n_docs`` and whether no other pair of its first id has more."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
    pairs = written(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("n_docs")), "pairs")
    first = F.shiftright("pair", 32).alias("a_id")
    # At most one row per entry of the first vocabulary.
    most = pairs.groupBy(first).agg(F.max("n_docs").alias("most"))
    return pairs.withColumn("a_id", first).join(most, "a_id").select(
        "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")
    )


def id_pairs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a_id, b_id, n_docs, best`` of all linked id pairs: a translation table of the vocabularies."""
    chunks = written(docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(_reduced(a_path, b_path), _CHUNK), "chunks")
    low = F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id")
    return _pair_counts(chunks).select(F.shiftright("pair", 32).cast("int").alias("a_id"), low, "n_docs", "best")


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document its tokens, groups and links, with the corpus-wide counts of its links' id pairs."""
    chunks = docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(_reduced(a_path, b_path), _CHUNK)
    chunks = written(chunks, "chunks")
    needed = chunks.select("chunk", F.explode("pairs").alias("pair")).join(_pair_counts(chunks), "pair")
    tables = needed.groupBy("chunk").agg(F.collect_list(F.struct("pair", "n_docs", "best")).alias("table"))
    none = F.array().cast("array<struct<pair: long, n_docs: long, best: boolean>>")
    whole = chunks.select("chunk", "docs", "places", "times").join(tables, "chunk", "left")
    whole = whole.withColumn("table", F.coalesce("table", none)).drop("chunk")
    numbers = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
    return whole.mapInArrow(_counted, f"doc_id long, {numbers}, groups_sha256 string")
