"""Signed changes against full builds, and the one scan that classifies a delivery."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tillclose.operators import gold as G
from tillclose.operators import revisions as R

COLUMNS = (
    "source_system string, store_id string, sale_id string, line_id string, revision int, operation string, "
    "product_id string, business_date date, quantity int, line_net_brl decimal(24,2), payload_hash string, "
    "batch_id string, source_file string, source_line int"
)
DAY = dt.date(2026, 1, 1)


def row(sale, line, revision, operation="UPSERT", day=0, net="10.00", batch="B1", at=0, payload=None):
    own = payload or f"{sale}{line}{revision}{operation}{day}{net}"
    date = DAY + dt.timedelta(day)
    return ("pos", "S1", sale, line, revision, operation, f"P{line}", date, 2, Decimal(net), own, batch, "f", at)


def advanced(spark, old, new):
    """State, both tables and sale lines after ``new``, advanced from those after ``old``."""
    before = R.current_state(R.eligible_history(None, spark.createDataFrame(old, COLUMNS)))
    added = R.new_history_rows(before, spark.createDataFrame(new, COLUMNS))
    changes = R.signed_changes(before, added)
    lines = G.sale_lines(before)
    sales = G.sale_deltas(lines, changes)
    whole = R.advance_state(before, added)
    pairs = [
        (G.advance_store_day(G.gold_store_day(before), changes, sales), G.gold_store_day(whole)),
        (G.advance_product_day(G.gold_product_day(before), changes), G.gold_product_day(whole)),
        (G.advance_sale_lines(lines, sales), G.sale_lines(whole)),
    ]
    for mine, full in pairs:
        assert sorted(map(repr, mine.select(*full.columns).collect())) == sorted(map(repr, full.collect()))
    return pairs[0][0].orderBy("business_date").collect()


def test_sales_that_come_and_go(spark):
    old = [row("a", "1", 1), row("a", "2", 1), row("b", "1", 1), row("c", "1", 1, "CANCEL"), row("d", "1", 1)]
    # One of two lines cancelled; an only line cancelled; one revived; one moved to another day; a new sale.
    new = [row("a", "2", 2, "CANCEL"), row("b", "1", 2, "CANCEL"), row("c", "1", 2), row("d", "1", 2, day=1), row("e", "1", 1)]
    found = advanced(spark, old, [(*x[:11], "B2", *x[12:]) for x in new])
    assert [(r.item_lines, r.sales_count) for r in found] == [(3, 3), (1, 1)]


def test_the_last_line_of_a_day_leaves_no_row(spark):
    assert advanced(spark, [row("a", "1", 1)], [row("a", "1", 2, "CANCEL", batch="B2")]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rng = random.Random(seed)

    def some(count, batch):
        return [
            row(rng.choice("abcdef"), rng.choice("123"), rng.randint(1, 6), rng.choice(["UPSERT", "UPSERT", "CANCEL"]),
                rng.randint(0, 2), f"{rng.randint(1, 9999)}.{rng.randint(10, 99)}", batch, i)
            for i in range(count)
        ]

    advanced(spark, some(40, "B1"), some(15, "B2"))


def test_first_batch(spark):
    added = R.eligible_history(None, spark.createDataFrame([row("a", "1", 1), row("a", "2", 1)], COLUMNS))
    changes = R.signed_changes(None, added)
    found = G.advance_store_day(None, changes, G.sale_deltas(None, changes)).collect()
    assert [(r.item_lines, r.sales_count, r.average_ticket_brl) for r in found] == [(2, 1, Decimal("20.00"))]


def test_classified_like_the_single_checks(spark):
    old = [row("a", "1", 1, payload="x"), row("a", "1", 3, payload="y"), row("b", "1", 1, payload="z")]
    new = [
        row("a", "1", 1, payload="x", at=1), row("a", "1", 2, payload="n", at=2), row("a", "1", 3, payload="other", at=3),
        row("b", "1", 1, payload="z", at=4), row("b", "1", 1, payload="z", at=5), row("c", "1", 1, payload="q", at=6),
        row("c", "1", 1, payload="q", at=7), row("d", "1", 1, payload="1", at=8), row("d", "1", 1, payload="2", at=9),
    ]
    previous, incoming = spark.createDataFrame(old, COLUMNS), spark.createDataFrame(new, COLUMNS)
    facts = R.revision_facts(previous, incoming)
    rows = R.classified(incoming, facts).collect()
    assert len(rows) == len(new)

    def places(name):
        return sorted(r.source_line for r in rows if r[name])

    assert places("is_conflict") == sorted(r.source_line for r in R.revision_conflict_rows(previous, incoming).collect()) == [3, 8, 9]
    assert places("is_stale") == sorted(r.source_line for r in R.stale_revisions(previous, incoming).collect()) == [1, 2]
    assert places("is_duplicate") == [1, 4, 5, 6, 7]
    assert places("is_new") == [2, 6, 7, 8, 9]
    counts = R.revision_counts(facts).first()
    assert (counts.received, counts.conflicts, counts.stale, counts.new) == (9, 3, 2, 5)
    assert counts.duplicates == R.exact_duplicates(previous, incoming).first().duplicates
    alone = R.revision_counts(R.revision_facts(None, incoming.limit(0))).first()
    assert (alone.received, alone.duplicates) == (0, 0)


def test_the_history_is_read_once(spark, folder):
    spark.createDataFrame([row("a", "1", 1)], COLUMNS).write.parquet(f"{folder}/history")
    incoming = spark.createDataFrame([row("a", "1", 2)], COLUMNS)
    history = spark.read.parquet(f"{folder}/history")
    facts = R.revision_facts(history, incoming)
    for frame in (R.classified(incoming, facts), R.revision_counts(facts)):
        plan = frame._jdf.queryExecution().toString()
        # The facts are written: what reads them never goes back to the history.
        assert "history" not in plan
