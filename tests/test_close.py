"""End-to-end runs against hand-calculated results."""

import json
from decimal import Decimal

import pytest

from tests import fixture as X
from tillclose.plans import close as P
from tillclose.sources import tables as TB


class Shop:
    """A state and its deliveries."""

    def __init__(self, spark, folder, stores=("S01", "S02", "S03")):
        self.spark, self.folder, self.stores, self.count = spark, folder, stores, 0
        self.root = f"{folder}/root"
        P.configure_references(
            spark, self.root, json.dumps(X.catalog(stores)), json.dumps(X.schedule(stores))
        )

    def close(self, rows, batch_id=None, validate_only=False, **options):
        self.count += 1
        batch_id = batch_id or f"b{self.count}"
        path = X.deliver(
            f"{self.folder}/in{self.count}", rows, batch_id, stores=self.stores, **options
        )
        return P.close_batch(self.spark, self.root, path, validate_only)

    def revenue(self):
        return P.report(self.spark, self.root)["summary"].first()["net_revenue_brl"]

    def gold(self, name="gold_store_day"):
        _, frames = TB.read_published_snapshot(self.spark, self.root, [name])
        return sorted(map(tuple, frames[name].collect()))


@pytest.fixture
def shop(spark, folder):
    return Shop(spark, folder)


def change(rows, index, **values):
    return [{**row, **(values if i == index else {})} for i, row in enumerate(rows)]


def test_life_of_a_close(shop):
    first = shop.close(X.base_rows(), "b1")
    assert (first.state, first.issues) == ("PUBLISHED", [])
    assert first.stats["received"] == 4 and first.coverage["zero_movement"] == ["S03"]
    day = [str(r[0]) for r in shop.gold()]
    assert day == ["2026-01-01"] * 2
    assert [r[1:] for r in shop.gold()] == [
        ("S01", Decimal("44.00"), 6, 3, 2, Decimal("22.00")),
        ("S02", Decimal("20.00"), 1, 1, 1, Decimal("20.00")),
    ]
    assert [r[1:4] for r in shop.gold("gold_product_day")] == [
        ("P01", Decimal("39.00"), 3),
        ("P02", Decimal("5.00"), 1),
        ("P03", Decimal("20.00"), 3),
    ]

    replay = shop.close(X.base_rows(), "b1")
    assert (replay.state, replay.stats["duplicates"]) == ("NO_CHANGE", 4)
    assert replay.publication_id == first.publication_id

    revised = change(X.base_rows()[:1], 0, revision="2", quantity="3", unit_price_brl="11.00")
    assert shop.close(revised, "b3", zero=("S02", "S03")).state == "PUBLISHED"
    assert shop.revenue() == Decimal("77.00")

    moved = [
        {**row, "revision": "3", "sold_at": "2026-01-02T12:00:00-03:00"}
        for row in [{**revised[0]}, X.base_rows()[1]]
    ]
    assert shop.close(moved, "b5", zero=("S02", "S03")).state == "PUBLISHED"
    assert [(str(r[0]), r[1], r[2]) for r in shop.gold()] == [
        ("2026-01-01", "S01", Decimal("20.00")),
        ("2026-01-01", "S02", Decimal("20.00")),
        ("2026-01-02", "S01", Decimal("37.00")),
    ]

    cancel = change(X.base_rows()[3:], 0, revision="2", operation="CANCEL")
    assert shop.close(cancel, "b6", zero=("S01", "S03")).state == "PUBLISHED"
    assert shop.revenue() == Decimal("57.00")
    _, frames = TB.read_published_snapshot(shop.spark, shop.root, ["history"])
    assert frames["history"].filter("sale_id = 'B1'").count() == 2
    found = {k: f.collect() for k, f in P.explain(shop.spark, shop.root, "S01").items()}
    assert found["totals"][0]["net_revenue_brl"] == Decimal("57.00")
    assert len(found["contributions"]) == 3 and len(found["revisions"]) == 6
    decision = P.report(shop.spark, shop.root)["decision"].first()
    assert decision["decision"] == "PUBLISHED"

    events = P.export_lineage(shop.spark, shop.root)
    assert events.filter("kind = 'terminal' AND event_type = 'COMPLETE'").count() == 5
    before = P.W.read_exported_events(shop.spark, shop.root).count()
    P.export_lineage(shop.spark, shop.root)
    assert P.W.read_exported_events(shop.spark, shop.root).count() == before == 10


@pytest.mark.slow
def test_blocked_deliveries(shop):
    shop.close(X.base_rows(), "b1")
    conflict = change(X.base_rows(), 0, quantity="9")
    blocked = shop.close(conflict, "b2")
    assert (blocked.state, blocked.stats["conflicts"]) == ("BLOCKED", 1)
    assert blocked.codes() == ["REVISION_CONFLICT"] and blocked.stats["rejected"] == 1

    inside = X.base_rows()[:1] + change(X.base_rows()[:1], 0, quantity="9")
    twice = [{**row, "revision": "5"} for row in inside]
    assert shop.close(twice, "b3", zero=("S02", "S03")).stats["conflicts"] == 2

    alone = change(
        X.base_rows()[:2], 0, revision="99", sold_at="2026-01-02T12:00:00-03:00"
    )
    split = shop.close(alone, "b4", zero=("S02", "S03"))
    assert split.state == "BLOCKED" and split.stats["rejected"] == 2
    assert [i["count"] for i in split.issues if i["code"] == "SALE_DATE_CONFLICT"] == [1]

    bad = X.base_rows() + [
        X.line("S01", "A9", "1", "P01", "0", "-1", sold_at="yesterday", product_id="??")
    ]
    invalid = shop.close(bad, "b5")
    stats = invalid.stats
    assert (stats["received"], stats["valid"], stats["rejected"]) == (5, 4, 1)
    assert stats["violations"] >= 4 and stats["revision_checks_executed"] == 0

    other = shop.close(X.base_rows()[:3] + X.base_rows()[3:], "b1", change=lambda m, t: m.update(correction_of="b0"))
    assert "BATCH_ID_CONFLICT" in other.codes()
    assert shop.revenue() == Decimal("64.00")


@pytest.mark.slow
def test_delivery_issues(shop):
    def missing(manifest, texts):
        texts.pop("S02.csv")
        texts["X.csv"] = "a\n"
        manifest["files"][0]["sha256"] = "0" * 64
        manifest["covered_stores"] = ["S01", "S01", "S02", "S03"]

    def mislabelled(manifest, texts):
        manifest["files"][0]["row_count"] = 9
        manifest["zero_movement"].append("S01")
        manifest.update(schema_version=True, extra=1, correction_of="../x")
        manifest["files"].append(dict(manifest["files"][0]))

    def elsewhere(manifest, texts):
        manifest["window_id"] = "W9"

    for edit, codes in (
        (
            missing,
            {"MISSING_FILE", "MISSING_STORE", "UNEXPECTED_FILE", "HASH_MISMATCH", "COVERAGE_MISMATCH"},
        ),
        (
            mislabelled,
            {
                "ROW_COUNT_MISMATCH", "INVALID_ZERO_CONFIRMATION", "UNSUPPORTED_SCHEMA_VERSION",
                "UNKNOWN_MANIFEST_FIELDS", "INVALID_MANIFEST_FIELD", "DUPLICATE_MANIFEST_FILE",
            },
        ),
        (
            elsewhere,
            {"UNKNOWN_OR_DUPLICATE_WINDOW", "UNEXPECTED_STORE", "INVALID_ZERO_CONFIRMATION"},
        ),
    ):
        attempt = shop.close(X.base_rows(), change=edit)
        assert attempt.state == "BLOCKED"
        assert set(attempt.codes()) == codes


@pytest.mark.slow
def test_validate_only_and_time_zone(shop):
    rows = change(X.base_rows(), 1, sold_at="2026-01-02T03:00:00Z")
    rows = change(rows, 0, sold_at="2026-01-02T02:59:59Z", sale_id="A0")
    checked = shop.close(rows, "b1", validate_only=True)
    assert checked.state == "VALIDATED"
    assert TB.load_publication(shop.spark, shop.root) is None
    assert shop.close(rows, "b1").state == "PUBLISHED"
    assert [(str(r[0]), r[1], r[2]) for r in shop.gold() if r[1] == "S01"] == [
        ("2026-01-01", "S01", Decimal("39.00")),
        ("2026-01-02", "S01", Decimal("5.00")),
    ]


@pytest.mark.slow
def test_extremes_and_empty(shop):
    rows = [
        X.line("S01", "A1", "1", "P01", "1000000", "999999999.99", "0", sold_at="0001-01-02T12:00:00Z"),
        X.line("S01", "A2", "1", "P02", "1", "1.00", sold_at="1800-06-01T12:00:00Z"),
        X.line("S02", "B1", "1", "P03", "7", "0.00", sold_at="9999-12-31T12:00:00Z"),
    ]
    assert shop.close(rows, "b1").state == "PUBLISHED"
    gold = shop.gold()
    assert [str(r[0]) for r in gold] == ["0001-01-02", "1800-06-01", "9999-12-31"]
    assert gold[0][2] == Decimal("999999999990000.00") and gold[2][6] == Decimal("0.00")

    gone = [{**row, "revision": "2", "operation": "CANCEL"} for row in rows]
    assert shop.close(gone, "b2").state == "PUBLISHED"
    summary = P.report(shop.spark, shop.root)["summary"].first()
    assert summary["net_revenue_brl"] == 0 and summary["average_ticket_brl"] is None
    _, frames = TB.read_published_snapshot(shop.spark, shop.root, ["silver"])
    assert frames["silver"].count() == 3


@pytest.mark.slow
def test_profile_after_correction(shop):
    shop.close(X.base_rows(), "b1")
    rows = [
        {**X.base_rows()[0], "revision": "2", "quantity": "3"},
        {**X.base_rows()[3], "revision": "2", "operation": "CANCEL"},
        *X.base_rows()[:2],
        X.base_rows()[2],
    ]
    second = shop.close(rows, "b2")
    assert second.state == "PUBLISHED" and second.stats["duplicates"] == 3
    read = lambda name: P.profile_section(shop.spark, shop.root, second.publication_id, name)
    changes = read("state_changes")[0]
    assert (changes["revised_keys"], changes["cancelled_keys"], changes["effective_changes"]) == (2, 1, 2)
    received = read("received_operations")[0]
    assert (received["valid_cancel_events"], received["valid_revision_gt1_events"]) == (1, 2)
    sides = {t["side"]: t for t in read("equivalent_totals")}
    assert float(sides["previous"]["net_revenue_brl"]) == 64.0
    assert float(sides["current"]["net_revenue_brl"]) == 54.0


def test_references_are_fixed(shop):
    shop_catalog = json.dumps(X.catalog(("S01",)))
    with pytest.raises(ValueError):
        P.configure_references(shop.spark, shop.root, shop_catalog, json.dumps(X.schedule(("S01",))))
    P.configure_references(
        shop.spark, shop.root, json.dumps(X.catalog(), indent=2), json.dumps(X.schedule())
    )


def test_no_references(spark, folder):
    path = X.deliver(f"{folder}/in", X.base_rows(), "b1")
    attempt = P.close_batch(spark, f"{folder}/root", path)
    assert attempt.codes() == ["OPERATOR_REFERENCES_MISSING"]
    assert P.report(spark, f"{folder}/root")["decision"].first()["decision"] == "BLOCKED"
