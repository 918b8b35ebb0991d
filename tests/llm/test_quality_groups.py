"""Fences of small groups: no size at which verdicts of a whole source turn over."""

import random

import pytest

from tests.llm.test_operators import VOCABULARY
from tillclose.llm import quality_rules

SIZES = (1, 20, 99, 100, 101)


@pytest.fixture(scope="module")
def verdicts(spark):
    rng = random.Random(9)
    plain = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(60, 140))) for _ in range(900)]
    rows = [(i, t, "en", "web", "x") for i, t in enumerate(plain)]
    for size in SIZES:
        for i in range(size):
            cells = " ".join(rng.choice(VOCABULARY) + (" |" if rng.random() < 0.25 else "") for _ in range(90))
            rows.append((10_000 * size + i, cells, f"l{size}", f"tables{size}", "x"))
    # Clashing names of other columns, and junk among ordinary texts.
    rows += [(-1 - i, " ".join(rng.choice(VOCABULARY) + "***" for _ in range(80)), "en", "web", "x") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns
    return docs, {r.doc_id for r in kept.collect()}


def test_no_cliff(verdicts):
    _, kept = verdicts
    shares = [sum(10_000 * size + i in kept for i in range(size)) / size for size in SIZES]
    assert shares[2] > 0.95 and max(shares[2:]) - min(shares[2:]) < 0.05
    assert shares[1] <= shares[2] + 0.05
    assert not kept & {-1, -2, -3, -4, -5}
    assert sum(i in kept for i in range(900)) >= 890


def test_fences_move_by_little_with_one_more_document(spark, verdicts):
    docs, _ = verdicts
    counts = quality_rules.measured(docs).cache()
    limits = {r.source: r.most_symbols for r in quality_rules.fences(counts).collect()}
    assert abs(limits["tables99"] - limits["tables101"]) < 0.15 * limits["tables101"]
    assert limits["web"] < limits["tables20"]
