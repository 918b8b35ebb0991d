"""Token counts by prefix dynamic programming.

The encoding of a prefix of a piece ends in the one vocabulary token ``t`` that holds next to the last
token of the prefix before it, so ``count[i] = count[i - len(t)] + 1``: one pass gives the exact count
of every prefix of a piece. Counts of pieces add up along the text, and the sums at the ends of pieces,
with the table of the piece that a place falls into, answer how many tokens any prefix has and where a
budget ends, without encoding again.

The vocabulary is a byte-level BPE ``tokenizer.json`` of the tokenizers library; strings of its special
tokens inside a text are one token each, as the library's default has it.

Nulls and edge cases: a null text is empty and has no tokens; rows are independent, so null or repeated
``doc_id`` come back as they are. Tables of frequent pieces are kept per worker up to a fixed number.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from os.path import commonprefix

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tillclose.llm import text as tx

_KEPT = 1 << 19
# Fixed value: the split of byte-level BPE files that ask for the built-in pattern.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# The same split for texts below U+0250, where letters and digits are few enough to be listed: the
# standard library's engine takes half the time.
_LETTERS, _DIGITS, _SPACES = (
    r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f",
    r"0-9\xb2\xb3\xb9\xbc-\xbe",
    r"\t-\r \x85\xa0",
)
_NARROW = re.compile(
    rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_WIDE = re.compile("[^\x00-\u024f]")
_ANY = regex.compile(BYTE_LEVEL)


def find(text: str) -> list[str]:
    """The pieces of a text."""
    return (_ANY if _WIDE.search(text) else _NARROW).findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in such files: printable Latin-1 bytes for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


class PieceCounts(dict):
    """Tokens of each piece, found on demand; two generations, so that frequent pieces stay."""

    def __init__(self, owner: Counts):
        super().__init__()
        self.owner, self.older = owner, {}

    def turn(self) -> None:
        """Begin a new generation when the current one is full."""
        if len(self) >= _KEPT:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> int:
        count = self.older.get(piece)
        if count is None:
            count = self.owner.table(piece.encode())[-1]
        self[piece] = count
        return count


class Counts:
    """Exact prefix counts for one vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], specials: list[str]):
        # Every suffix of a token: its rank if it is a token itself, else -1.
        self.suffixes = {token[i:]: -1 for token in vocabulary for i in range(1, len(token))} | vocabulary
        self.tokens = {rank: token for token, rank in vocabulary.items()}
        library = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=vocabulary, special_tokens={})
        self._piece = library._encode_single_piece
        self._pairs: dict[int, bool] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pieces = PieceCounts(self)

    def holds(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= 2 * _KEPT:
                self._pairs.clear()
            known = self._pairs[key] = self._piece(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def table(self, piece: bytes) -> list[int]:
        """Count of every byte prefix of a piece, the empty one first."""
        counts, last = [0], [-1]
        self._extend(piece, counts, last)
        return counts

    def _extend(self, piece: bytes, counts: list[int], last: list[int]) -> None:
        """Continue the tables of a prefix of the piece to its end."""
        known, pairs = self.suffixes.get, self._pairs.get
        for end in range(len(counts), len(piece) + 1):
            start = end - 1
            while True:
                token = known(piece[start:end])
                if token >= 0:
                    if not start:
                        break
                    holds = pairs(last[start] << 32 | token)
                    if holds or holds is None and self.holds(last[start], token):
                        break
                start -= 1
            counts.append(counts[start] + 1)
            last.append(token)

    def learn(self, pieces: Iterable[str]) -> None:
        """Count new pieces in order, each from the table of the prefix it shares with the one before."""
        counts, last, before = [0], [-1], b""
        for data, piece in sorted((x.encode(), x) for x in pieces):
            shared = len(commonprefix((before, data)))
            del counts[shared + 1 :], last[shared + 1 :]
            self._extend(data, counts, last)
            self.pieces[piece] = counts[-1]
            before = data

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those strings."""
        at = 0
        if self.special is not None:
            for match in self.special.finditer(text):
                yield text[at : match.start()], False
                yield match[0], True
                at = match.end()
        yield text[at:], False

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split, extra = [], []
        for text in texts:
            if self.special is None or not self.special.search(text):
                split.append(find(text))
                extra.append(0)
                continue
            parts = list(self.parts(text))
            split.append([x for part, special in parts if not special for x in find(part)])
            extra.append(sum(special for _, special in parts))
        count = self.pieces
        count.turn()
        # Not a set difference: that walks through all known pieces for every call.
        self.learn(x for x in set().union(*split) if x not in count and x not in count.older)
        count = count.__getitem__
        return [more + sum(map(count, pieces)) for pieces, more in zip(split, extra, strict=True)]

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def prefixes(self, text: str) -> Prefixes:
        return Prefixes(self, text)


class Prefixes:
    """Counts at the end of every piece of a text, and inside pieces on demand."""

    def __init__(self, counts: Counts, text: str):
        self.counts, self.text = counts, text
        self.pieces = [
            (piece, special)
            for part, special in counts.parts(text)
            for piece in ([part] if special else find(part))
        ]
        self.ends = [0, *accumulate(len(x) for x, _ in self.pieces)]
        self.sums = [0, *accumulate(1 if s else counts.pieces[x] for x, s in self.pieces)]

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters, as their own encoding would have."""
        at = bisect_right(self.ends, chars) - 1
        if self.ends[at] == chars and not self._blank(at):
            return self.sums[at]
        # A cut piece, or blanks that bind differently at the end, are split again from the last
        # place that no piece spans.
        while at and (self._blank(at) or not self._apart(at)):
            at -= 1
        rest = self.text[self.ends[at] : chars]
        return self.sums[at] + sum(self.counts.pieces[x] for x in find(rest))

    def _blank(self, at: int) -> bool:
        return at > 0 and self.pieces[at - 1][0][-1].isspace()

    def _apart(self, at: int) -> bool:
        """Whether a shorter text is split here too."""
        piece, special = self.pieces[at - 1]
        return special or not piece.isspace()

    def cut(self, budget: int) -> int:
        """The most characters of a whole-piece prefix with at most ``budget`` tokens."""
        at = bisect_right(self.sums, budget) - 1
        while at > 0 and self.count(self.ends[at]) > budget:
            at -= 1
        return self.ends[at]


_COUNTS: dict[str, Counts] = {}


def counts(path: str) -> Counts:
    """The counter of a ``tokenizer.json``, made once per worker."""
    if path not in _COUNTS:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        byte = _byte_letters()
        specials = [x["content"] for x in whole["added_tokens"]]
        vocabulary = {
            bytes(byte[c] for c in token): rank
            for token, rank in whole["model"]["vocab"].items()
            if token not in specials
        }
        _COUNTS[path] = Counts(vocabulary, specials)
    return _COUNTS[path]


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(path)
        for chunk in tx.chunks(batches):
            texts = [x or "" for x in chunk.column("text").to_pylist()]
            totals = own.totals(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array([x > limit for x in totals], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``doc_id`` and ``text`` cut to the last piece that fits a budget of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(path)
        for chunk in tx.chunks(batches):
            texts = [x or "" for x in chunk.column("text").to_pylist()]
            cut = [x[: own.prefixes(x).cut(budget)] for x in texts]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(cut, pa.string())], names=["doc_id", "text"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
