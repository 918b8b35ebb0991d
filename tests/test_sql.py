"""A few queries of each family against SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from workload.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "gold_store_day", "eligible_history", "collect_errors", "check_manifest", "delivery_coverage",
    "mean_shift_rules", "product_mix", "reconcile_attempts", "read_delivery_csv", "advance_gold",
]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    good, note = compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name])
    assert good, note


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
