"""The four-row hand delivery and a writer for delivery folders."""

import csv
import hashlib
import io
import json
import os

from tillclose.schemas import BUSINESS_FIELDS

SOLD, UPDATED = "2026-01-01T12:00:00-03:00", "2026-01-02T08:00:00-03:00"


def line(store, sale, number, product, quantity, price, discount="0.00", **changes):
    row = dict(
        source_system="synthetic-pos", store_id=store, sale_id=sale, line_id=number, revision="1",
        operation="UPSERT", product_id=product, sold_at=SOLD, quantity=quantity,
        unit_price_brl=price, line_discount_brl=discount, source_updated_at=UPDATED,
    )
    return {**row, **changes}


def base_rows():
    return [
        line("S01", "A1", "1", "P01", "2", "10.00", "1.00"),
        line("S01", "A1", "2", "P02", "1", "5.00"),
        line("S01", "A2", "1", "P03", "3", "7.50", "2.50"),
        line("S02", "B1", "1", "P01", "1", "20.00"),
    ]


def catalog(stores=("S01", "S02", "S03")):
    return {
        "schema_version": 1,
        "stores": [
            {"store_id": s, "name": s, "state": "SP", "timezone": "America/Sao_Paulo", "active": True}
            for s in stores
        ],
        "products": [
            {"product_id": p, "name": p, "category": "any"} for p in ("P01", "P02", "P03")
        ],
    }


def schedule(stores=("S01", "S02", "S03"), sources=("synthetic-pos",)):
    return {
        "schema_version": 1,
        "windows": [
            {
                "window_id": "W1", "source_system": source, "stores": list(stores),
                "starts_at": "2026-01-01T00:00:00-03:00", "ends_at": "2026-01-02T00:00:00-03:00",
            }
            for source in sources
        ],
    }


def csv_text(rows, header=BUSINESS_FIELDS):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    for row in rows:
        writer.writerow([row[name] for name in BUSINESS_FIELDS])
    return out.getvalue()


def deliver(folder, rows, batch_id, zero=("S03",), change=None, files=None, stores=("S01", "S02", "S03"), source="synthetic-pos"):
    """Write a delivery folder; ``change`` may edit the manifest, ``files`` the file texts."""
    os.makedirs(folder)
    texts = {}
    for store in sorted({row["store_id"] for row in rows} - set(zero)):
        texts[f"{store}.csv"] = csv_text([row for row in rows if row["store_id"] == store])
    manifest = {
        "schema_version": 1,
        "batch_id": batch_id,
        "source_system": source,
        "window_id": "W1",
        "files": [],
        "zero_movement": list(zero),
    }
    for name, text in texts.items():
        shown = (files or {}).get(name, text)
        manifest["files"].append(
            {
                "path": name,
                "sha256": hashlib.sha256(shown.encode()).hexdigest(),
                "row_count": len(list(csv.reader(io.StringIO(shown)))) - 1,
                "store_id": name.removesuffix(".csv"),
            }
        )
        texts[name] = shown
    if change:
        change(manifest, texts)
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w", newline="") as handle:
            handle.write(text)
    for name, document in (
        ("manifest.json", manifest),
        ("catalog.json", catalog(stores)),
        ("schedule.json", schedule(stores)),
    ):
        with open(f"{folder}/{name}", "w") as handle:
            json.dump(document, handle)
    return folder
