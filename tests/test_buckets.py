"""A state by buckets: what is rewritten, what is read, growth, empty tables and retention."""

import os

import pytest

from tests.test_increments import COLUMNS, row
from tillclose.operators import audit
from tillclose.operators import revisions as R
from tillclose.sinks import buckets as B
from tillclose.sinks import tables as W
from tillclose.sources import buckets as S
from tillclose.sources import tables as TB


def deliver(spark, root, layout, rows, **sizes):
    frame = spark.createDataFrame(rows, COLUMNS)
    return B.advance_buckets(
        spark, root, "silver", "run", layout, frame, lambda before: R.resolve_state(before, frame), **sizes
    )


def content(frame):
    return sorted(map(repr, frame.select(*sorted(frame.columns)).collect()))


def many(first, last, revision=1):
    return [row(f"s{n}", "1", revision) for n in range(first, last)]


def size(path):
    return sum(os.path.getsize(os.path.join(where, x)) for where, _, names in os.walk(path) for x in names if x.endswith(".parquet"))


def test_only_touched_buckets_are_written(spark, folder):
    one = deliver(spark, folder, None, many(0, 400))
    two = deliver(spark, folder, one, many(7, 8, 2))
    number = next(iter(S.touched(one, spark.createDataFrame(many(7, 8), COLUMNS))))
    assert {n for n, held in two.held.items() if held == 1} == {number}
    assert {x for x in os.listdir(f"{two.path}/data/version=1") if x.startswith("bucket")} == {f"bucket={number}"}
    assert 8 * size(f"{two.path}/data/version=1") < size(f"{one.path}/data/version=0")
    whole = R.resolve_state(None, spark.createDataFrame(many(0, 400) + many(7, 8, 2), COLUMNS))
    assert content(S.read_buckets(spark, two)) == content(whole)
    # The version before stays as it was.
    assert content(S.read_buckets(spark, one)) == content(spark.createDataFrame(many(0, 400), COLUMNS))
    assert B.differing_buckets(spark, one, two) == {number}
    found = B.version_differences(spark, one, two).collect()
    assert sorted((x.side, x.revision) for x in found) == [("missing", 1), ("unexpected", 2)]
    files = S.read_buckets(spark, two, {number}).inputFiles()
    assert files and all(f"bucket={number}/" in x or "bucket=-1/" in x for x in files)


def test_fingerprint_of_a_version_from_its_map(spark, folder):
    layout = deliver(spark, folder, None, many(0, 50))
    layout = deliver(spark, folder, layout, many(40, 60, 2))
    state = S.read_buckets(spark, layout)
    whole = audit.table_fingerprint(state.select(*sorted(state.columns))).first()
    assert B.map_fingerprint(S.read_map(spark, layout.path, layout.version)).first() == whole


def test_buckets_double(spark, folder):
    layout = deliver(spark, folder, None, many(0, 10), least_buckets=2, rows_per_bucket=5)
    assert layout.count == 2
    for low in (10, 20, 30):
        layout = deliver(spark, folder, layout, many(low, low + 10), least_buckets=2, rows_per_bucket=5)
    # 20 rows in two buckets are twice what is meant only once there are more of them.
    assert (layout.count, layout.rows) == (4, 40)
    assert content(S.read_buckets(spark, layout)) == content(spark.createDataFrame(many(0, 40), COLUMNS))
    other = deliver(spark, f"{folder}/other", None, many(0, 39), least_buckets=2)
    assert [x.sale_id for x in B.version_differences(spark, layout, other).collect()] == ["s39"]


def test_empty_tables_and_deliveries(spark, folder):
    empty = deliver(spark, folder, None, [])
    assert (empty.rows, S.read_buckets(spark, empty).count()) == (0, 0)
    assert set(S.read_buckets(spark, empty).columns) == set(spark.createDataFrame([], COLUMNS).columns)
    some = deliver(spark, folder, empty, many(0, 3))
    again = deliver(spark, folder, some, [])
    assert content(S.read_buckets(spark, again)) == content(spark.createDataFrame(many(0, 3), COLUMNS))
    assert again.held == some.held


def test_a_bucket_other_than_meant_is_refused(spark, folder, monkeypatch):
    layout = deliver(spark, folder, None, many(0, 5))
    real = B.table_fingerprint
    monkeypatch.setattr(B, "table_fingerprint", lambda frame, *by: real(frame.withColumn("x", B.F.rand()), *by))
    with pytest.raises(ValueError):
        deliver(spark, folder, layout, many(0, 2, 2))


def test_number_of_buckets(spark, folder):
    with pytest.raises(ValueError):
        deliver(spark, folder, None, [], least_buckets=12)


def test_held_versions_are_kept(spark, folder):
    layout = deliver(spark, folder, None, many(0, 100))
    for revision in (2, 3):
        layout = deliver(spark, folder, layout, many(7, 8, revision))
    held = spark.createDataFrame([("p", "table:silver", layout.path, 2)], "publication_id string, kind string, path string, version long")
    named = audit.bucket_references(held, S.read_maps(spark, layout.path))
    assert [(x.kind, x.version) for x in named.collect()] == [("table:silver:bucket", 0)]
    loose = audit.unreferenced_versions(TB.read_registry(spark, folder), held.unionByName(named))
    assert [x.version for x in loose.collect()] == [1]
    assert W.next_version(spark, folder, "silver") == 3


def test_a_version_is_computed_once(spark, folder):
    # The digests are taken on the way to the files, so what is written is evaluated once.
    seen = spark.sparkContext.accumulator(0)

    def counted(before, rows):
        def pass_on(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        whole = R.resolve_state(before, rows)
        return whole.mapInArrow(pass_on, whole.schema)

    rows = spark.createDataFrame(many(0, 20), COLUMNS)
    layout = B.advance_buckets(spark, folder, "silver", "run-0", None, rows, lambda before: counted(before, rows))
    assert seen.value == layout.rows
