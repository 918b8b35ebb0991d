"""What stays on disk: shuffles end with the write they led to, rows move narrow and once, tables are compressed."""

import os
import time

import pytest

from tests.test_buckets import content, deliver, many
from tests.test_increments import COLUMNS, row
from tillclose import session
from tillclose.functions import positions
from tillclose.functions.digest import packed, unpacked
from tillclose.operators import revisions as R
from tillclose.sinks import buckets as B
from tillclose.sources import buckets as S

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    """Files with shuffled rows; an index of nothing may stay."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in found.split("\n") if "/shuffle_" in name and name.endswith(".data")}


def left_behind(spark, before):
    """Shuffle files that were not there before; they are removed a moment after the query."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return set()
        time.sleep(0.2)
    return shuffle_files(spark) - before


def place(spark, root, layout, rows):
    frame = spark.createDataFrame(rows, COLUMNS)
    return B.advance_buckets(
        spark, root, "silver", "run", layout, frame, lambda before, where: R.resolve_state(before, frame, where), placed=True
    )


def test_a_digest_travels_as_bytes_and_any_text_comes_back(spark):
    texts = ["0f" * 32, "0F" * 32, "x" * 32, "", "é", "ab", "\x01" * 33, None]
    rows = spark.createDataFrame([(x,) for x in texts], "d string").select("d", packed(B.F.col("d")).alias("p"))
    found = {x.d: (x.back, x.bytes) for x in rows.selectExpr("d", "octet_length(p) AS bytes", "p").withColumn("back", unpacked(B.F.col("p"))).collect()}
    assert {d: back for d, (back, _) in found.items()} == dict(zip(texts, texts))
    assert found["0f" * 32][1] == 33


def test_a_state_dealt_by_buckets_is_the_same_state(spark, folder):
    first = many(0, 60) + [row("s1", "1", 3, payload="ab" * 32), row("s1", "2", 1)]
    second = many(50, 70, 2) + many(1, 2, 2)
    plain = deliver(spark, f"{folder}/a", deliver(spark, f"{folder}/a", None, first), second)
    dealt = place(spark, f"{folder}/b", place(spark, f"{folder}/b", None, first), second)
    assert content(S.read_buckets(spark, dealt)) == content(S.read_buckets(spark, plain))
    figures = ("rows", "digest_1", "digest_2", "held")
    assert {n: [e[x] for x in figures] for n, e in dealt.entries.items()} == {n: [e[x] for x in figures] for n, e in plain.entries.items()}


def test_a_state_dealt_by_buckets_moves_once(spark):
    before, rows = (spark.createDataFrame(many(0, n), COLUMNS).localCheckpoint() for n in (9, 5))
    state = plan(R.resolve_state(before, rows, B.placement(16)))
    # The arriving rows by their item, then all by their bucket.
    assert state.count("Exchange hashpartitioning") == 2 and state.count("Exchange hashpartitioning(bucket") == 1


def test_shuffles_end_with_the_version_they_led_to(spark, folder):
    before = shuffle_files(spark)
    place(spark, folder, place(spark, folder, None, many(0, 30)), many(5, 8, 2))
    assert left_behind(spark, before) == set()


def test_tables_are_written_with_zstd(spark, folder):
    session.write_table(spark.range(3), f"{folder}/t")
    assert all(x.endswith(".zstd.parquet") for x in os.listdir(f"{folder}/t") if x.startswith("part"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


@pytest.mark.parametrize("bits", [8, 1 << 24])
def test_only_rows_that_may_differ_are_compared(spark, monkeypatch, bits):
    monkeypatch.setattr(positions, "FILTER_BITS", bits)
    kinds = "k int, v string, w string"
    common = [(n, "c", None) for n in range(40)]
    one = spark.createDataFrame([*common, (1, "a", None), (1, "a", None), (2, None, "x"), (7, "z", "z"), (7, "z", "z")], kinds)
    two = spark.createDataFrame([*common, (1, "a", None), (2, "x", None), (7, "z", "z"), (7, "z", "z"), (9, "n", "n")], kinds)
    left, right = B._without_common(one, two)
    for mine, other, whole in ((left, right, one.exceptAll(two)), (right, left, two.exceptAll(one))):
        assert content(mine.exceptAll(other)) == content(whole)
    if bits > 8:
        assert left.count() == 3 and right.count() == 3
    nothing, neither = B._without_common(one, one)
    assert nothing.count() == neither.count() == 0


def test_a_delivery_is_classified_by_packed_payloads(spark):
    old, new = many(0, 20) + [row("a", "1", 1, payload="ab" * 32)], [row("a", "1", 1, payload=x * 32) for x in ("ab", "cd", "cd")]
    previous, incoming = (spark.createDataFrame(x, COLUMNS) for x in (old, new))
    before = shuffle_files(spark)
    facts = R.revision_facts(previous, incoming)
    assert left_behind(spark, before) == set()
    rows = R.classified(incoming, facts)
    assert "[0-9a-f]{64}" in plan(rows)
    found = sorted((x.payload_hash[:2], x.is_conflict, x.is_duplicate, x.is_new) for x in rows.collect())
    assert found == [("ab", True, True, False), ("cd", True, True, False), ("cd", True, True, False)]


@needs_tables
def test_rows_travel_to_their_products_as_numbers(spark):
    from workload import q_rows

    rows = plan(q_rows.checked(spark, FOLDER))
    below = rows.split("LeftOuter")[1] if "LeftOuter" in rows else rows
    assert "unit_price_brl" not in below and "source_updated_at" not in below


@needs_tables
def test_numbers_of_delivered_rows_are_stored(spark):
    from workload import q_files

    before = shuffle_files(spark)
    q_files.delivered(spark, FOLDER)
    assert left_behind(spark, before) == set()


def test_bronze_is_compressed_and_its_shuffles_end(spark, folder):
    from tillclose.sinks import tables as T

    before = shuffle_files(spark)
    path = T.write_bronze(spark.range(50).groupBy("id").count().repartition(3, "id"), folder)
    assert left_behind(spark, before) == set()
    assert any(x.endswith(".zstd.parquet") for x in os.listdir(path))


def test_events_are_exported_whole_in_part_or_not_at_all(spark, folder):
    from tillclose.sinks import tables as T

    names = "run_id string, kind string, state string, event_time string"
    events = spark.createDataFrame([(f"r{n}", kind, f"s{n}", "t") for n in range(40) for kind in ("start", "terminal")], names)
    before = shuffle_files(spark)
    parts = ["kind = 'start' AND run_id < 'r2'", "kind = 'start'", "kind = 'start' OR run_id = 'r7'", "true", "true"]
    for part in parts:
        T.write_lineage_events(events.filter(part), folder)
        found = T.read_exported_events(spark, folder)
        assert content(found.select("run_id", "kind")) == content(events.filter(part).select("run_id", "kind"))
    with pytest.raises(ValueError):
        T.write_lineage_events(events.withColumn("state", B.F.lit("other")), folder)
    assert left_behind(spark, before) == set()
