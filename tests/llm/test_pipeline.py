"""The pipeline against a brute-force version of its stages, and the SQL of the operators."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tillclose.llm import decontaminate, pii
from workload.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_same_rows_as_sql(spark, name):
    good, note = compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name])
    assert good, note


def test_pipeline(spark):
    from tests.llm.test_operators import brute_components
    from tillclose.llm import quality_rules

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rules = {r.doc_id for r in quality_rules.quality(docs).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in rules]
    groups = brute_components(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.overlaps(own, items).collect()}
    expected = {d: pii.mask(t, pii.spans(t)[1]) for d, t in rows if d not in bad}
    found = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    from hashlib import sha256

    assert found == {d: sha256(t.encode()).hexdigest() for d, t in expected.items()}


def test_stages_accept_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert out.count() == 0


def test_null_and_repeated_ids_cost_no_other_text(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (None, text("c"))]
    rows += [(1, text("a")), (1, text("d")), (1, text("e")), (2, text("d") + " more"), (3, text("f")), (3, text("f"))]
    rows += [(None, ""), (None, None), (4, ""), (5, text("g")), (5, text("h")), (6, text("h"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates_stage(spark, docs, FOLDER).collect()]
    one_b = [x for x in left if x[1] in (text("b"), text("b") + " more")]
    assert len(one_b) == 1 and one_b[0][0] is None
    expected = [(None, text("a")), (None, text("c")), (1, text("d")), (1, text("e")), (3, text("f"))]
    expected += [(None, ""), (None, None), (4, ""), (5, text("g")), (5, text("h"))]
    assert sorted(map(repr, left)) == sorted(map(repr, [*expected, *one_b]))


def test_links_of_each_text_of_a_null_or_repeated_id(spark):
    from tillclose.llm import jaccard

    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (3, text("b") + " x"), (None, text("c")), (None, text("d"))]
    rows += [(4, text("d") + " x"), (5, text("e")), (7, text("c")), (6, text("e") + " x")]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(1, 1), (1, 1), (2, 1), (3, 1), (None, None), (None, None), (4, None), (5, 5), (7, None), (6, 5)]
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in found))) == sorted(map(repr, expected))


def test_texts_go_to_tasks_by_bytes(spark):
    import pyarrow as pa

    docs = spark.range(0, 24, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 200000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    found = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 24_000_000 and max(found) < 10_000_000


def test_a_batch_of_texts_is_no_longer_than_a_chunk(spark):
    import pyarrow as pa

    from tillclose.llm import text as tx

    docs = spark.range(0, 24, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 100000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    found = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 12_000_000 and max(found) < tx.CHUNK_BYTES + 1_000_000
