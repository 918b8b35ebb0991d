"""Words, word hashes and window hashes of whole Arrow batches, and packed integer columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. Everything here works on one bounded
chunk of a batch, so memory follows the chunk and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
#: What arrays of words and pieces are made of at once: they take many times its bytes, and a worker keeps its peak.
STEP_BYTES = 1 << 20
_SEGMENT = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits separates words here.
PUNCTUATION = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Odd multipliers of the polynomial hashes over bytes and over words, and their inverses mod 2**64.
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _byte_codes() -> np.ndarray:
    codes = np.arange(1, 257, dtype=np.uint64)
    codes = mix(codes * np.uint64(0xBF58476D1CE4E5B9))
    codes[_SEPARATOR] = 0
    return codes


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(30))
        values = values * np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(27)
        values = values * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse, extended on demand."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            size = 1 << (size - 1).bit_length()
            self.up = self._run(self.base, size)
            self.down = self._run(pow(self.base, -1, 1 << 64), size)
        return self.up, self.down

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


_CODES = _byte_codes()
_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return whole[first:last], offsets - first


def chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        begin = 0
        while begin < len(ends):
            used = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, used + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """The words of a chunk: byte ``starts`` and ``ends``, row ``doc``, 64-bit ``hashes``; ``first``
    has the index of each row's first word, and one past the last."""

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _SEPARATOR
    ):
        size, rows = len(data), len(offsets) - 1
        word = ~separators[data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        codes = np.where(separators, 0, _CODES).astype(np.uint64)
        self.hashes = self._hash(_LOWER[data] if lower else data, codes)

    def _hash(self, data: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        begin = 0
        with np.errstate(over="ignore"):
            while begin < len(out):
                low = self.starts[begin]
                end = max(begin + 1, int(np.searchsorted(self.ends, low + _SEGMENT, "right")))
                high = self.ends[end - 1]
                up, down = _BYTES.get(int(high - low))
                at = self.starts[begin:end] - low
                out[begin:end] = (
                    np.add.reduceat(codes[data[low:high]] * up[: high - low], at) * down[at]
                )
                begin = end
        return mix(out)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of every ``width`` consecutive words of one row: hashes and first words."""
        total = len(self.hashes)
        if total < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = _WORDS.get(total)
        with np.errstate(over="ignore"):
            sums = np.zeros(total + 1, np.uint64)
            np.cumsum(self.hashes * up[:total], out=sums[1:])
            spans = (sums[width:] - sums[:-width]) * down[: total - width + 1]
        at = np.flatnonzero(self.doc[: total - width + 1] == self.doc[width - 1 :])
        return mix(spans[at] ^ np.uint64(width)), at

    def row_hash(self, row: int) -> np.uint64:
        """Hash of the whole word sequence of a row, as a window of that width would have."""
        begin, end = self.first[row], self.first[row + 1]
        up, _ = _WORDS.get(int(end - begin))
        with np.errstate(over="ignore"):
            total = np.add.reduce(self.hashes[begin:end] * up[: end - begin])
        return mix(np.array([total ^ np.uint64(end - begin)], np.uint64))[0]


def pack(values: np.ndarray) -> bytes:
    """Differences of 64-bit integers, byte plane by byte plane, compressed."""
    values = values.astype(np.uint64, copy=False)
    with np.errstate(over="ignore"):
        steps = np.diff(values, prepend=np.uint64(0))
    # Zigzag, so that small steps down stay small.
    steps = (steps << np.uint64(1)) ^ (np.uint64(0) - (steps >> np.uint64(63)))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _codec().compress(planes.tobytes(), asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    """The integers given to ``pack``."""
    size = int.from_bytes(packed[:8], "little")
    raw = _codec().decompress(packed[8:], size * 8, asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).view(np.uint64).ravel()
    with np.errstate(over="ignore"):
        steps = (steps >> np.uint64(1)) ^ (np.uint64(0) - (steps & np.uint64(1)))
        return np.cumsum(steps, dtype=np.uint64)


def pack_raw(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of random 64-bit values, which no coding makes shorter."""
    raw = values.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8)
    return raw[:, :width].tobytes()


def unpack_raw(packed: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).ravel()


_CODEC: list[pa.Codec] = []


def _codec() -> pa.Codec:
    if not _CODEC:
        _CODEC.append(pa.Codec("zstd", compression_level=1))
    return _CODEC[0]
