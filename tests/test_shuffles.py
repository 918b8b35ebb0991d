"""What is shuffled for a query: plans on the smallest tables, read before adaptive execution changes them."""

import os

import pytest

from tillclose.operators import revisions as R
from workload import feed as W

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(frame):
    return plan(frame).count("Exchange hashpartitioning")


def test_rows_dealt_by_sale_are_not_shuffled_again(spark):
    # The two tables of each batch alone, at most: neither history nor state moves its wide rows.
    previous, incoming = W.batches(spark, FOLDER)
    history = R.eligible_history(previous, incoming)
    assert exchanges(R.current_state(history)) <= 4
    assert exchanges(W.state(spark, FOLDER)) <= 2


def test_new_history_rows_join_nothing_with_the_history(spark):
    previous, incoming = (rows.localCheckpoint() for rows in W.batches(spark, FOLDER))
    assert "Join" not in plan(R.new_history_rows(previous, incoming))


def test_published_rows_are_read_from_where_they_were_written(spark):
    for rows in W.published(spark, FOLDER, W.GOLD_COLUMNS):
        assert exchanges(rows) == 0
        assert set(rows.columns) == {*W.REVISION_KEY, *W.GOLD_COLUMNS}


def test_references_are_tables_of_known_size(spark):
    from workload import q_rows

    files = q_rows.checked(spark, FOLDER).inputFiles()
    for name in ("files", "stores", "products"):
        assert any(f"/{name}-" in file for file in files)


def test_compared_rows_do_not_move_to_meet_days_and_stores(spark):
    from workload import q_profile

    rows = plan(q_profile.scope_totals(spark, FOLDER))
    assert "hashpartitioning(business_date" not in rows and "hashpartitioning(store_id#" not in rows


def test_long_generated_methods_are_left_to_the_expressions(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_exported_events_are_stored_compressed_and_once(spark, folder):
    from tillclose.sinks import tables as T

    events = spark.sql("SELECT 'r' AS run_id, kind, 'x' AS state, '' AS event_time FROM VALUES ('start'), ('terminal') AS t(kind)")
    T.write_lineage_events(events.filter("kind = 'start'"), folder)
    T.write_lineage_events(events, folder)
    assert T.read_exported_events(spark, folder).count() == 2
    assert any(name.endswith(".json.gz") for name in os.listdir(f"{folder}/lineage"))


def test_states_are_compared_once_with_the_columns_told(spark):
    from workload import q_revisions

    rows = plan(q_revisions.state_equivalence(spark, FOLDER))
    assert rows.count("lineitem.parquet") <= 2 and rows.count("Exchange hashpartitioning") <= 4
    assert "unit_price_brl" not in rows


def test_state_differences_count_rows_of_a_multiset(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), (None, 1), ("d", 2)], "v string, k int")
    found = {r.side: r.rows for r in R.state_differences(left, right).collect()}
    assert found == {"missing": 2, "unexpected": 2}
    assert {r.rows for r in R.state_differences(left.limit(0), right.limit(0)).collect()} == {0}
