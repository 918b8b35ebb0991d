"""Near duplicates of embeddings against brute force."""

import numpy as np
import pytest

from tillclose.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, ball long, one long, class long"


def brute(rows):
    """Links of every row, and the smallest id of its component."""
    own = []
    for _, e, label, *_ in rows:
        bad = label is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e)
        own.append(None if bad else np.array(np.array(e, np.float32), float))
    links = [set() for _ in rows]
    for i, x in enumerate(own):
        for j, y in enumerate(own[:i]):
            if x is None or y is None or rows[i][2] != rows[j][2] or len(x) != len(y):
                continue
            x_, y_ = x / np.abs(x).max(), y / np.abs(y).max()
            if x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        low = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((row[0], len(links[i]), low, row[0] == low))
    return out


def table():
    rng = np.random.default_rng(4)
    rows = []

    def add(vector, label, doc=True):
        rows.append((len(rows) * 7 % 1009 if doc is True else doc, None if vector is None else [None if x is None else float(x) for x in vector], label, 1, 2, 3))

    for label in (0, 1, 2):
        base = rng.standard_normal((60, 12))
        for x in base:
            add(x, label)
        # Near the bound, exact copies, scaled copies, a large tight family, and a chain of links.
        for x in base[:25]:
            add(x + rng.standard_normal(12) * rng.uniform(0.2, 0.6), label)
        for x in base[25:30]:
            add(x, label)
            add(x * 3, label)
        for _ in range(60):
            add(base[40] + rng.standard_normal(12) * 0.05, label)
        start, to = base[50], base[51]
        for k in range(30):
            add(start * np.cos(k / 8) + to * np.sin(k / 8), label)
    for x in (None, [], [0.0] * 12, [1.0, None], [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e-30] * 12, [1e30] * 12, [2e30] * 12):
        add(x, 1)
    add(rows[0][1], None)
    add(rows[0][1], 7)
    add(rows[0][1][:5], 0)
    add(rows[0][1], 0, None)
    add(rows[1][1], 0, 5)
    add(rows[2][1], 0, 5)
    add([1.0] * 3, 9, None)
    return rows


@pytest.mark.parametrize("shard", [40, 4096])
def test_links_and_components(spark, shard):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in vectors.linked(docs, shard=shard).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute(rows)))


def test_empty_and_unlinked(spark):
    docs = spark.createDataFrame([(1, None, 0, 1, 1, 1), (None, [1.0], None, 1, 1, 1)], SCHEMA)
    assert sorted(map(repr, map(tuple, vectors.linked(docs).collect()))) == sorted(map(repr, [(1, 0, 1, True), (None, 0, None, True)]))
    assert vectors.linked(docs.limit(0)).collect() == []


def test_recall_of_the_graph():
    rng = np.random.default_rng(2)
    own = rng.standard_normal((3000, 32))
    own[1500:] = own[:1500] + rng.standard_normal((1500, 32)) * rng.uniform(0, 0.4, (1500, 1))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    graph = vectors.Graph.unpacked(vectors.Graph.built(own, np.arange(3000)).packed())
    who, what, beam = vectors.audited(graph, own, np.full(3000, 0.93), float(np.arccos(0.93)))
    wanted = own @ own.T >= 0.93
    found = np.zeros_like(wanted)
    found[who, what] = True
    assert not (found & ~wanted).any() and beam < 3000
    assert (found | found.T).sum() >= 0.99 * wanted.sum()
    # What a narrow beam can not answer goes on with wider ones.
    who, what = graph.within(own[:50], np.full(50, -0.5), 4)
    truth = own[:50] @ own.T >= -0.5
    assert len(who) >= 0.95 * truth.sum()
