"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Only documents have labels. A document is a bag of passages of ``PASSAGE`` words; every passage is
encoded, a gated attention learned from the documents' labels weighs the passages, and the weighted
representation is scored:

    h = tanh(E x),  a = softmax(w . (tanh(V h) * sigmoid(U h))),  score = sigmoid(c . sum(a h) + b)

The model is fitted with Adam on a bounded sample of labelled documents (``SAMPLE`` rows, the smallest
hashes of ``doc_id``); it is a few kilobytes and the same on every run. Scoring reads every passage of
every whole text. Inputs are the text alone: never labels, language, source or ``doc_id``.

Nulls and edge cases: a null or empty text is one passage without words and gets that passage's score;
documents without a label are scored too; null labels are not learned from; rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.llm import text as tx
from tillclose.llm.frames import written

PASSAGE, SAMPLE, FOLDS, THRESHOLD = 64, 4000, 5, 0.3
HASHED, HIDDEN, GATE, ROUNDS, RATE, DECAY = 16, 16, 8, 200, 0.02, 1e-3
# Byte classes of which a passage has shares.
_CLASSES = (b"#*$%&|<>", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"=@\"'()[]{}_/\\")
WIDTH = len(_CLASSES) + 7 + HASHED


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a chunk, and the offsets of the rows' passages."""
    data, offsets = tx.buffers(column)
    words = tx.Words(data, offsets)
    per_row = np.maximum(-(-np.diff(words.first) // PASSAGE), 1)
    first = np.r_[0, np.cumsum(per_row)]
    out = np.zeros((first[-1], WIDTH), np.float32)
    if not len(words.starts):
        return out, first
    place = np.arange(len(words.starts)) - words.first[words.doc]
    at = first[words.doc] + place // PASSAGE
    total = first[-1]

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(at, values, total)

    n = np.maximum(summed(np.ones(len(at))), 1)
    size = (words.ends - words.starts).astype(np.float64)
    chars = np.maximum(summed(size), 1)
    starts = words.starts
    for j, own in enumerate(_CLASSES):
        table = np.zeros(256, bool)
        table[list(own)] = True
        out[:, j] = summed(np.add.reduceat(table[data].astype(np.int32), starts)) / chars
    j = len(_CLASSES)
    out[:, j] = np.log1p(chars / n)
    out[:, j + 1] = np.sqrt(np.maximum(summed(size**2) / n - (chars / n) ** 2, 0)) / 4
    out[:, j + 2] = summed(size <= 3) / n
    out[:, j + 3] = summed(size >= 20) / n
    out[:, j + 4] = n / PASSAGE
    order = np.lexsort((words.hashes, at))
    again = np.r_[False, (words.hashes[order][1:] == words.hashes[order][:-1]) & (at[order][1:] == at[order][:-1])]
    out[:, j + 5] = np.bincount(at[order], again, total) / n
    same = np.r_[False, (words.hashes[1:] == words.hashes[:-1]) & (at[1:] == at[:-1])]
    out[:, j + 6] = summed(same) / n
    sign = 1.0 - 2.0 * (words.hashes & np.uint64(1)).astype(np.float64)
    slot = ((words.hashes >> np.uint64(8)) % np.uint64(HASHED)).astype(np.int64)
    hashed = np.bincount(at * HASHED + slot, sign, total * HASHED).reshape(total, HASHED)
    out[:, j + 7 :] = hashed / np.sqrt(n)[:, None]
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Gated-attention network over bags of passages."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {
            "E": rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)),
            "V": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "w": rng.normal(0, 1 / np.sqrt(GATE), GATE),
            "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[row])
        a = e / np.add.reduceat(e, first[:-1])[row]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "row": row, "s": _sigmoid(z @ p["c"] + p["b"])}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        p, row, a, h = self.p, f["row"], f["a"], f["h"]
        d = (f["s"] - label) / len(label)
        dz = d[:, None] * p["c"]
        da = (h * dz[row]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first[:-1])[row])
        dt, dg = de[:, None] * p["w"] * f["g"], de[:, None] * p["w"] * f["t"]
        dv, du = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = a[:, None] * dz[row] + dv @ p["V"].T + du @ p["U"].T
        out = {
            "E": f["x"].T @ (dh * (1 - h**2)),
            "V": h.T @ dv,
            "U": h.T @ du,
            "w": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ d,
            "b": d.sum(keepdims=True),
        }
        return {k: v + DECAY * p[k] * (k != "b") for k, v in out.items()}

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, ROUNDS + 1):
            grad = self.gradients(self.forward(x, first), first, label)
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                self.p[k] = self.p[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["s"]


def held_out() -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tx.chunks(batches):
        x, first = passages(chunk.column("text"))
        ends = pa.array((first * WIDTH).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([chunk.column("quality"), lists], names=["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality``, from at most ``sample`` labelled documents of the learning folds."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality"))
    known = known.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    found = rows.select("quality", "text").mapInArrow(_featured, "quality double, x array<float>").toArrow()
    if not found.num_rows:
        return Model(np.zeros(WIDTH), np.ones(WIDTH))
    bags = [np.asarray(v.values, np.float64).reshape(-1, WIDTH) for v in found.column("x")]
    label = found.column("quality").to_numpy()
    order = np.lexsort((np.array([b.sum() for b in bags]), label))
    bags, label = [bags[i] for i in order], label[order]
    x, first = np.concatenate(bags), np.r_[0, np.cumsum([len(b) for b in bags])]
    return Model(x.mean(0), x.std(0) + 1e-2).fit(x, first, label)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            scores = model.score(*passages(chunk.column("text")))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(scores)], names=["doc_id", "score"]
            )

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
