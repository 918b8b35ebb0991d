"""Byte-level BPE encoding and decoding by monoid tree reduction.

Every text is encoded by halves, down to leaves of ``LEAF_CHARS`` characters; a join re-encodes a window
around the cut, grown until the tokens outside it cannot change, and concatenates:

- *Between pieces of the pattern.* No match of the pattern spans a change from a non-space character
  to a blank, or from a letter (digit) to anything but a letter (digit). The cut moves from the middle
  to the nearest such place: what lies on either side is split, and therefore encoded, as in the whole
  text, so the window at this cut is empty. A stretch without such a place is one leaf.
- *Inside a piece,* which is halved in turn, down to vocabulary entries or ``LEAF_BYTES`` bytes. A token
  sequence is the encoding of its bytes exactly if every pair of neighbours is the encoding of the
  pair's bytes. The window grows by tokens, doubling, until the pairs at its two edges hold; all other
  pairs come from encodings of parts.

Leaves and windows are merged here by rank, lowest first, leftmost among equals; no tokenizer library
takes part. Pieces repeat: a chunk of texts gives its new pieces to numpy, which merges the leaves of all
of them at once, one merge of each a round, and a worker remembers the tokens of up to ``_REMEMBERED``.

Tokens of pieces and bytes of tokens lie in one array each; the ids of a chunk are gathered from those at once, and
decoding gathers the bytes of ``LEAF_TOKENS`` tokens at a time and concatenates them. The vocabulary is a parameter: a
file of ranks in tiktoken's format and the pattern that splits text. Texts are independent, so Spark
spreads the rows; each task holds one bounded chunk of them.

Nulls and edge cases: a null text is empty, an empty text has no tokens; ids and rows are kept as they
are, so null and repeated ``doc_id`` return as they came.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tillclose.llm import text as tx

LEAF_CHARS, LEAF_BYTES, LEAF_TOKENS = 128, 16, 1 << 16
_REMEMBERED, _FEW, _NEAR, _NONE = 1 << 18, 128, 32, 1 << 40
_BLANKS = " \n\t\r"
_LETTER, _DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._split = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        # Where the tokens of a remembered piece begin and how many they are, in one array for all pieces.
        self._pieces: dict[str, int] = {}
        self._forget()
        # Every way in which two entries make a third, as a sorted key and what they make.
        size = self._size = max(self.bytes_of) + 1
        made = [
            (left * size + right, rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None
        ]
        self._joins, self._made = np.array(sorted(made) or [(-1, _NONE)], np.int64).T
        self._byte = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        # The bytes of all tokens, one after the other.
        tokens = [self.bytes_of.get(x, b"") for x in range(size)]
        self._text = np.frombuffer(b"".join(tokens), np.uint8)
        self._sizes = np.array([len(x) for x in tokens])
        self._starts = np.cumsum(self._sizes) - self._sizes

    def _forget(self) -> None:
        self._pieces.clear()
        self._held, self._values, self._ends = 0, np.zeros(1 << 10, np.int32), np.zeros(1, np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of tokens make, or ``_NONE``."""
        key = left * self._size + right
        at = np.minimum(np.searchsorted(self._joins, key), len(self._joins) - 1)
        return np.where(self._joins[at] == key, self._made[at], _NONE)

    def _merged_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merged`` of many short pieces that are not in the vocabulary: all tokens, and how many each has."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.array([len(x) for x in pieces])
        own = np.repeat(np.arange(len(pieces)), sizes)
        tokens = self._byte[np.frombuffer(b"".join(pieces), np.uint8)]
        makes = np.full(len(tokens), _NONE)
        inner = np.flatnonzero(own[1:] == own[:-1])
        makes[inner] = self._joined(tokens[inner], tokens[inner + 1])
        done = []
        while len(tokens):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            lowest = np.repeat(np.minimum.reduceat(makes, starts), np.diff(np.r_[starts, len(own)]))
            ready = lowest == _NONE
            done.append((own[ready], tokens[ready]))
            own, tokens, makes, lowest = own[~ready], tokens[~ready], makes[~ready], lowest[~ready]
            if not len(tokens):
                break
            # The leftmost of the lowest pairs of each piece becomes one token.
            at = np.flatnonzero(makes == lowest)
            at = at[np.r_[True, own[at][1:] != own[at][:-1]]]
            tokens[at] = makes[at]
            stay = np.ones(len(tokens), bool)
            stay[at + 1] = False
            own, tokens, makes = own[stay], tokens[stay], makes[stay]
            at -= np.arange(len(at))
            changed = np.r_[at, at[at > 0] - 1]
            makes[changed] = _NONE
            changed = changed[changed + 1 < len(own)]
            changed = changed[own[changed] == own[changed + 1]]
            makes[changed] = self._joined(tokens[changed], tokens[changed + 1])
        own, tokens = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(own, kind="stable")
        return tokens[order].astype(np.int32), np.bincount(own, minlength=len(pieces))

    def merged(self, data: bytes) -> list[int]:
        """Tokens of bytes inside one piece, by merging neighbours; a vocabulary entry stands for itself."""
        known = self.ranks.get(data)
        if known is not None:
            return [known]
        return self._merged_few(data) if len(data) <= _FEW else self._merged_many(data)

    def _merged_few(self, data: bytes) -> list[int]:
        """By rescanning all pairs for the lowest rank."""
        rank, none = self.ranks.get, len(self.bytes_of)
        parts = [data[x : x + 1] for x in range(len(data))]
        pairs = [rank(data[x : x + 2], none) for x in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
        return [self.ranks[x] for x in parts]

    def _merged_many(self, data: bytes) -> list[int]:
        """By a queue of pairs, in proportion to the length up to a logarithm."""
        ranks, end = self.ranks, len(data)
        # Each part is known by its first byte: where it ends and where the part before it begins.
        stop, back = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(ranks[pair], at, at + 2) for at in range(end - 1) if (pair := data[at : at + 2]) in ranks]
        heapq.heapify(queue)
        while queue:
            _, at, to = heapq.heappop(queue)
            middle = stop[at]
            # Outdated if either part has been merged since: it is gone, or the pair ends elsewhere.
            if not at < middle < end or stop[middle] != to:
                continue
            stop[at], stop[middle] = to, 0
            if to < end:
                back[to] = at
                rank = ranks.get(data[at : stop[to]])
                if rank is not None:
                    heapq.heappush(queue, (rank, at, stop[to]))
            before = back[at]
            if before >= 0:
                rank = ranks.get(data[before:to])
                if rank is not None:
                    heapq.heappush(queue, (rank, before, to))
        out, at = [], 0
        while at < end:
            out.append(ranks[data[at : stop[at]]])
            at = stop[at]
        return out

    def holds(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are next to each other inside a piece."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > _REMEMBERED:
                self._pairs.clear()
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._pairs[left, right] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one match of the pattern, or of a part of it."""
        known = self.ranks.get(data)
        if known is not None:
            return [known]
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        # Cut at a power of two, so that runs of one character are cut where their tokens end.
        half = 1 << (len(data) - 1).bit_length() - 1
        left, right, size = self.piece(data[:half]), self.piece(data[half:]), 1
        while True:
            low, high = max(len(left) - size, 0), min(size, len(right))
            window = self.merged(b"".join(self.bytes_of[x] for x in (*left[low:], *right[:high])))
            if (not low or self.holds(left[low - 1], window[0])) and (
                high == len(right) or self.holds(window[-1], right[high])
            ):
                return left[:low] + window + right[high:]
            size *= 2

    def learn(self, pieces: set[str]) -> None:
        """Remember the tokens of pieces; what was remembered may go first."""
        if len(self._pieces) > _REMEMBERED:
            self._forget()
        short, short_data, other, other_tokens = [], [], [], []
        for piece in pieces:
            raw = piece.encode()
            if len(raw) <= LEAF_BYTES and raw not in self.ranks:
                short.append(piece)
                short_data.append(raw)
            else:
                other.append(piece)
                other_tokens.append(self.piece(raw))
        values, sizes = self._merged_all(short_data)
        values = np.concatenate([values, np.fromiter(chain.from_iterable(other_tokens), np.int32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, other_tokens), np.int64, len(other))])
        self._pieces.update(zip(chain(short, other), range(len(self._pieces), len(self._pieces) + len(sizes))))
        end = self._held + len(values)
        if end > len(self._values):
            self._values = np.concatenate([self._values[: self._held], np.zeros(2 * end - self._held, np.int32)])
        self._values[self._held : end] = values
        self._ends = np.concatenate([self._ends, self._held + np.cumsum(sizes)])
        self._held = end

    @staticmethod
    def stable(text: str, at: int) -> bool:
        """Whether no match of the pattern can span this place."""
        before, after = text[at - 1], text[at]
        if after in _BLANKS:
            return not before.isspace()
        for kind in (_LETTER, _DIGIT):
            if kind.match(before):
                return not kind.match(after)
        return False

    def _cut(self, text: str, low: int, high: int) -> int | None:
        """A stable place inside the range near its middle, or the nearest, if there is any."""
        middle = (low + high) // 2
        # Most cuts are at a blank close by.
        at = text.find(" ", max(middle, low + 1), min(middle + _NEAR, high))
        if at > 0 and self.stable(text, at):
            return at
        for step in range(middle - low + 1):
            if middle - step > low and self.stable(text, middle - step):
                return middle - step
            if middle + step < high and middle + step > low and self.stable(text, middle + step):
                return middle + step
        return None

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one text after the other, and where each begins, with the end of the last."""
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            self._reduce(text, 0, len(text), pieces)
            ends.append(len(pieces))
        kept = len(self._pieces) <= _REMEMBERED
        new = set(pieces)
        self.learn(new.difference(self._pieces) if kept else new)
        own = np.fromiter(map(self._pieces.__getitem__, pieces), np.int64, len(pieces))
        starts, sizes = self._ends[own], self._ends[own + 1] - self._ends[own]
        return gathered(self._values, starts, sizes), np.r_[0, np.cumsum(sizes)][ends]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.encode_all([text])[0].tolist()

    def _reduce(self, text: str, low: int, high: int, out: list[str]) -> None:
        """The pieces of a range, by halves and from left to right."""
        cut = self._cut(text, low, high) if high - low > LEAF_CHARS else None
        if cut is None:
            out += self._split.findall(text[low:high])
            return
        self._reduce(text, low, cut, out)
        self._reduce(text, cut, high, out)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of token sequences that begin and end at ``ends``, and where those of each begin and end."""
        sizes = self._sizes[ids]
        # By leaves, so that the places to gather from stay few.
        cuts = range(LEAF_TOKENS, len(ids), LEAF_TOKENS)
        leaves = zip(np.split(self._starts[ids], cuts), np.split(sizes, cuts), strict=True)
        data = np.concatenate([gathered(self._text, *leaf) for leaf in leaves])
        return data, np.r_[0, np.cumsum(sizes)][ends]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a token sequence."""
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, made once per worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def _with(chunk: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [(x, chunk.column(x)) for x in chunk.schema.names if x not in columns and x != "text"]
    names, arrays = zip(*kept, *columns.items(), strict=True)
    return pa.RecordBatch.from_arrays(list(arrays), names=list(names))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for chunk in tx.chunks(batches, limit=tx.STEP_BYTES):
        values, ends = own.encode_all([x or "" for x in chunk.column("text").to_pylist()])
        yield _with(chunk, ids=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)))


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in batches:
        ids = batch.column("ids")
        ends = np.asarray(ids.offsets)
        data, ends = own.decode_all(np.asarray(ids.values)[ends[0] : ends[-1]], ends - ends[0])
        buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
        yield _with(batch, decoded=pa.Array.from_buffers(pa.binary(), batch.num_rows, buffers))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column("ids"), batch.column("decoded")
        values, ends = np.asarray(ids.values), np.asarray(ids.offsets)
        spans = list(zip(ends[:-1], ends[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array([hashlib.sha256(values[a:b].astype("<u4").tobytes()).hexdigest() for a, b in spans]),
                pa.array([hashlib.sha256(x).hexdigest() for x in column.to_pylist()]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of every text."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _encoded(batches, path, pattern), "doc_id long, ids array<int>"
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``decoded``, the bytes that ``ids`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decoded(batches, path, pattern):
            yield batch.select(["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digested(_decoded(_encoded(batches, path, pattern), path, pattern))

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
