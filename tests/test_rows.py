"""Boundaries of the row contract, and revision rules on small frames."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests import fixture as X
from tillclose.operators import documents as DOC
from tillclose.operators import gold as G
from tillclose.operators import lineage as L
from tillclose.operators import report as R
from tillclose.operators import revisions as V
from tillclose.operators import row_contract as RC
from tillclose.schemas import BUSINESS_FIELDS

# Fixed boundary values: field, text, expected codes.
BOUNDARIES = [
    ("quantity", "１", "INVALID_QUANTITY"),
    ("quantity", "1e3", "INVALID_QUANTITY"),
    ("quantity", "0", "INVALID_QUANTITY"),
    ("quantity", "1000000", ""),
    ("quantity", "1000001", "INVALID_QUANTITY"),
    ("quantity", "5\n", "INVALID_QUANTITY"),
    ("revision", "02", ""),
    ("revision", "2147483647", ""),
    ("revision", "2147483648", "INVALID_REVISION"),
    ("revision", "0000000000001", "INVALID_REVISION"),
    ("unit_price_brl", " 1.00", "INVALID_UNIT_PRICE_BRL"),
    ("unit_price_brl", "1.001", "INVALID_UNIT_PRICE_BRL"),
    ("unit_price_brl", "NaN", "INVALID_UNIT_PRICE_BRL"),
    ("unit_price_brl", "999999999.99", ""),
    ("unit_price_brl", "1000000000.00", "INVALID_UNIT_PRICE_BRL"),
    ("line_discount_brl", "20.01", "DISCOUNT_EXCEEDS_GROSS"),
    ("line_discount_brl", "20", ""),
    ("line_discount_brl", "-0.01", "INVALID_LINE_DISCOUNT_BRL"),
    ("operation", "upsert", "INVALID_OPERATION"),
    ("product_id", "P99", "UNKNOWN_PRODUCT"),
    ("product_id", "", "INVALID_PRODUCT_ID|UNKNOWN_PRODUCT"),
    ("sale_id", "a" * 65, "INVALID_SALE_ID"),
    ("sale_id", "a" * 64, ""),
    ("store_id", "S02", "FILE_STORE_MISMATCH"),
    ("store_id", "S9", "FILE_STORE_MISMATCH|UNKNOWN_STORE"),
    ("source_system", "other", "SOURCE_MISMATCH"),
    ("sold_at", "2026-02-30T12:00:00Z", "INVALID_SOLD_AT"),
    ("sold_at", "2026-01-01T12:00:00", "INVALID_SOLD_AT"),
    ("sold_at", "2026-01-01T12:00:00+24:00", "INVALID_SOLD_AT"),
    ("sold_at", "2026-01-01T12:00:00+23:59", ""),
    ("sold_at", "2026-01-01T12:00:60Z", "INVALID_SOLD_AT"),
    ("sold_at", "2026-01-01T12:00:00.1234567Z", "INVALID_SOLD_AT"),
    ("sold_at", "0001-01-01T00:00:00Z", "INVALID_SOLD_AT"),
    ("sold_at", "0001-01-02T00:00:00Z", ""),
    ("sold_at", "9999-12-31T23:59:59-23:59", "INVALID_SOLD_AT"),
    ("source_updated_at", "0001-01-01T00:00:00Z", ""),
    ("source_updated_at", "0001-01-01T00:00:00+00:01", "INVALID_SOURCE_UPDATED_AT"),
    ("source_updated_at", "0000-12-31T23:59:59-23:59", "INVALID_SOURCE_UPDATED_AT"),
]


def raw(spark, rows):
    """Rows as read from the file of store S01."""
    order = [*BUSINESS_FIELDS, "source_line"]
    values = [[*(row[n] for n in BUSINESS_FIELDS), i + 2] for i, row in enumerate(rows)]
    schema = ", ".join(f"{n} {'int' if n == 'source_line' else 'string'}" for n in order)
    return spark.createDataFrame(values, schema).select(
        "*",
        F.lit("b1").alias("batch_id"),
        F.lit("r1").alias("run_id"),
        F.concat("store_id", F.lit(".csv")).alias("source_file"),
        F.lit("{}").alias("raw_payload"),
        F.lit(True).alias("width_ok"),
        F.lit(True).alias("header_ok"),
    )


def bronze(spark, rows, file=None):
    found = raw(spark, rows)
    if file:
        found = found.withColumn("source_file", F.lit(file))
    files = spark.createDataFrame(
        [("b1", f"{s}.csv", "synthetic-pos", s) for s in ("S01", "S02")],
        "batch_id string, path string, source_system string, store_id string",
    )
    stores = spark.createDataFrame([("S01",), ("S02",), ("S03",)], "store_id string")
    products = spark.createDataFrame([("P01",), ("P02",), ("P03",)], "product_id string")
    return RC.bronze_rows(RC.with_references(found, files, stores, products))


def events(spark, rows):
    return RC.type_events(bronze(spark, rows))


def test_boundaries(spark):
    base = X.base_rows()[0]
    rows = [{**base, field: text} for field, text, _ in BOUNDARIES]
    found = bronze(spark, rows, "S01.csv").orderBy("source_line").collect()
    got = ["|".join(row["errors"]) for row in found]
    assert got == [codes for _, _, codes in BOUNDARIES]


def test_equal_content_has_equal_hash(spark):
    base = X.base_rows()[0]
    same = {
        **base, "revision": "01", "quantity": "02", "unit_price_brl": "10", "line_discount_brl": "1.0",
        "sold_at": "2026-01-01T15:00:00Z", "source_updated_at": "2026-01-02T11:00:00.000+00:00",
    }
    assert bronze(spark, [base, same]).select("payload_hash").distinct().count() == 1


def test_gold_of_the_hand_fixture(spark):
    state = V.resolve_state(None, events(spark, X.base_rows()))
    gold = sorted(map(tuple, G.gold_store_day(state).drop("business_date").collect()))
    assert gold == [
        ("S01", Decimal("44.00"), 6, 3, 2, Decimal("22.00")),
        ("S02", Decimal("20.00"), 1, 1, 1, Decimal("20.00")),
    ]


def test_two_sources_share_a_sale_id(spark):
    rows = [X.line("S01", "A1", "1", "P01", "1", "1.00")]
    other = [{**rows[0], "source_system": "other-pos"}]
    both = events(spark, rows).unionByName(
        events(spark, rows).withColumn("source_system", F.lit("other-pos"))
    )
    assert other and G.gold_store_day(V.resolve_state(None, both)).first()["sales_count"] == 2


def test_revisions(spark):
    first = events(spark, X.base_rows())
    assert V.exact_duplicates(first, first).first()["duplicates"] == 4
    assert V.exact_duplicates(first, first.unionByName(first)).first()["duplicates"] == 8
    changed = events(spark, [{**X.base_rows()[0], "quantity": "9"}])
    assert V.revision_conflict_rows(first, changed).count() == 1
    later = events(spark, [{**X.base_rows()[0], "revision": "2", "quantity": "3"}])
    assert V.stale_revisions(first.unionByName(later), first).count() == 1
    added = V.new_history_rows(first, later.unionByName(first))
    assert added.count() == 1
    state = V.advance_state(V.current_state(first), added)
    assert state.filter("revision = 2").count() == 1 and state.count() == 4
    alone = events(
        spark, [{**X.base_rows()[0], "revision": "9", "sold_at": "2026-01-02T12:00:00-03:00"}]
    )
    split = V.resolve_state(first, alone)
    assert V.split_sales(split).count() == 1
    assert V.split_sale_rows(alone, split).count() == 1


def test_order_of_arrival_does_not_matter(spark):
    rows = events(spark, X.base_rows() * 3)
    expected = sorted(map(str, V.eligible_history(None, rows).collect()))
    shuffled = rows.repartition(5, F.rand(7))
    assert sorted(map(str, V.eligible_history(None, shuffled).collect())) == expected


@pytest.mark.parametrize(
    "path, safe",
    [
        ("S01.csv", True), ("a/b.csv", True), ("../a.csv", False), ("/a.csv", False),
        ("a//b.csv", False), ("./a.csv", False), ("a\\b.csv", False), ("c:a.csv", False),
        (".csv", False), ("a.CSV", False), ("", False),
    ],
)
def test_safe_paths(spark, path, safe):
    assert spark.range(1).select(DOC.safe_path(F.lit(path))).first()[0] is safe


def test_slice_of_missing_and_empty(spark):
    schema = "business_date date, store_id string, net_revenue_brl decimal(28,2), sales_count bigint, units bigint"
    rows = spark.sql(
        "SELECT DATE '2026-01-08' AS business_date, 'S01' AS store_id, "
        "CAST('9007199254740993.01' AS DECIMAL(28,2)) AS net_revenue_brl, 1L AS sales_count, 1L AS units"
    )
    assert R.sales_slice(rows).first()["net_revenue_brl"] == Decimal("9007199254740993.01")
    assert R.sales_slice(rows, store="S9").first()["net_revenue_brl"] is None
    missing = rows.unionByName(rows.withColumn("net_revenue_brl", F.lit(None).cast("decimal(28,2)")))
    assert R.sales_slice(missing).first()["net_revenue_brl"] is None
    period = R.recent_period(rows, 7).first()
    assert str(period["first_date"]) == "2026-01-02" and schema
    with pytest.raises(ValueError):
        R.sales_slice(rows, "2026-01-02", "2026-01-01")


def test_ancestry(spark):
    links = [("k", f"p{i}", f"p{i - 1}" if i else None) for i in range(9)]
    links += [("c", "x", "y"), ("c", "y", "x"), ("b", "m", "lost")]
    schema = "book_id string, publication_id string, previous_publication_id string"
    pointers = [("k", "p7"), ("c", "x"), ("b", "m")]
    found = L.publication_ancestry(
        spark.createDataFrame(links, schema),
        spark.createDataFrame(pointers, "book_id string, publication_id string"),
    ).collect()
    chains = {row["book_id"]: row["chain"] for row in found}
    assert chains == {"k": "OK", "c": "CYCLE", "b": "BROKEN_LINK"}
    assert {r["publication_id"]: r["generation"] for r in found if r["book_id"] == "k"} == {
        f"p{i}": 7 - i for i in range(8)
    }
