"""The Merkle manifest against trees built in plain Python."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tillclose.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, path string, tree string, level int"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return digest(*map(framed, row[:5]))


def levels_of(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path_of(levels, at, arity):
    path = []
    for nodes in levels[:-1]:
        run, slot = nodes[at - at % arity :][:arity], at % arity
        path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at //= arity
    return path


def brute(rows, arity):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0, leaf(row)), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: levels_of([leaf(r) for _, r in sorted(trees[lang])], arity) for lang in langs}
    top = levels_of([built[lang][-1][0] for lang in langs], arity)
    out = []
    for i, lang in enumerate(langs):
        for at, (_, row) in enumerate(sorted(trees[lang])):
            path = path_of(built[lang], at, arity) + path_of(top, i, arity)
            out.append((row[0], lang, at, leaf(row), path, built[lang][-1][0], top[-1][0]))
    return out


def rows(count):
    kinds = ["en", "", None, "é", "z", "=", "en"]
    out = [(i * 7 % 31, "s" if i % 3 else None, kinds[i % 7], i if i % 5 else None, f"tëxt {i}" if i % 4 else None) for i in range(count)]
    out += [(None, "s", "en", 1, "x"), (None, "s", "en", 1, "y"), (3, None, "lone", None, "")] + [(2, "s", "en", 2, "same")] * 3
    return [(*x, 1, "p", "t", 2) for x in out]


@pytest.mark.parametrize(("arity", "count"), [(2, 60), (3, 40), (5, 13)])
def test_paths_and_roots(spark, arity, count):
    table = rows(count)
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    found = merkle.manifest(docs, arity=arity).collect()
    mine = [
        (r.doc_id, r.lang, r.idx, r.leaf, [(s.before, s.after) for s in r.path], r.subroot, r.root) for r in found
    ]
    assert sorted(map(repr, mine)) == sorted(map(repr, brute(table, arity)))


def test_a_changed_row_is_noticed(spark):
    table = rows(20)
    docs = spark.createDataFrame(table, SCHEMA)
    claim = merkle.leaf([docs[x] if x != "n_chars" else docs[x] + 1 for x in merkle.FIELDS])
    found = merkle.verified(merkle.manifest(docs, carry={"claim": claim}), "claim").collect()
    assert len(found) == len(table)
    assert all(r.verified == (r.claim == r.leaf) == (r.folded_root == r.root) for r in found)
    nulls = sum(row[3] is None for row in table)
    assert sum(r.verified for r in found) == nulls > 0
    whole = merkle.verified(merkle.manifest(docs))
    assert whole.filter("verified").count() == len(table)


def test_neighbouring_values_do_not_mix(spark):
    frame = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("-", None), (None, "-"), ("", "x")], "a string, b string")
    leaves = [r.x for r in frame.select(merkle.leaf([F.col("a"), F.col("b")]).alias("x")).collect()]
    assert len(set(leaves)) == 5


def test_one_row_and_none(spark):
    one = spark.createDataFrame(rows(0)[2:3], SCHEMA)
    row = merkle.manifest(one).first()
    assert (row.leaf, row.path) == (row.root, []) and row.subroot == row.root
    assert merkle.manifest(one.limit(0)).collect() == []
