"""Row contract: every rule is a Column, every code is collected in contract order.

Raw rows carry the twelve business fields as text plus ``batch_id``, ``run_id``,
``source_file``, ``source_line``, ``width_ok`` and ``header_ok``. ``with_references`` adds what
the rules compare against; Spark picks the join for each side by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.functions import contract as C
from tillclose.functions.digest import canonical_json, text_digest
from tillclose.schemas import (
    BUSINESS_FIELDS,
    ITEM_KEY,
    MAX_LINE_DISCOUNT,
    MAX_QUANTITY,
    MAX_REVISION,
    MAX_UNIT_PRICE,
    OPERATIONS,
    TYPED_FIELDS,
)

Rules = list[tuple[str, Column]]


def with_references(
    raw: DataFrame, files: DataFrame, stores: DataFrame, products: DataFrame
) -> DataFrame:
    """Add the manifest's source and store of the file, and catalogue membership.

    ``files``: batch_id, path, source_system, store_id, one row per declared file.
    ``stores`` / ``products``: active store ids and product ids, any repeats are removed.
    """
    declared = files.select(
        "batch_id",
        F.col("path").alias("source_file"),
        F.col("source_system").alias("declared_source"),
        F.col("store_id").alias("declared_store"),
    )
    known_stores = stores.select("store_id").distinct().withColumn("store_known", F.lit(True))
    known_products = (
        products.select("product_id").distinct().withColumn("product_known", F.lit(True))
    )
    return (
        raw.join(declared, ["batch_id", "source_file"], "left")
        .join(known_stores, "store_id", "left")
        .join(known_products, "product_id", "left")
        .withColumn("store_known", F.coalesce("store_known", F.lit(False)))
        .withColumn("product_known", F.coalesce("product_known", F.lit(False)))
    )


MEASURES = ["_revision", "_quantity", "_price", "_discount", "_sold", "_updated"]


def measured(rows: DataFrame) -> DataFrame:
    """Canonical value of every number, amount and instant, null where the text is invalid.

    Each is computed once, in steps, because rules, canonical texts and hashes all use them.
    """
    stamps = {"_sold": "sold_at", "_updated": "source_updated_at"}
    return (
        rows.withColumns(
            {
                "_revision": C.bounded_integer(F.col("revision"), MAX_REVISION),
                "_quantity": C.bounded_integer(F.col("quantity"), MAX_QUANTITY),
                "_price": C.bounded_money(F.col("unit_price_brl"), MAX_UNIT_PRICE),
                "_discount": C.bounded_money(F.col("line_discount_brl"), MAX_LINE_DISCOUNT),
                **{name: C.offset_micros(F.col(field)) for name, field in stamps.items()},
            }
        )
        .withColumns(
            {
                name: F.when(
                    C.usable_instant(F.col(field), F.col(name)), F.timestamp_micros(F.col(name))
                )
                for name, field in stamps.items()
            }
        )
        .withColumn("_sold", F.when(C.within_calendar(F.col("_sold")), F.col("_sold")))
    )


def identifier_rules() -> Rules:
    return [
        (f"INVALID_{name.upper()}", ~C.valid_identifier(F.col(name)))
        for name in [*ITEM_KEY, "product_id"]
    ]


def _differs(field: str, declared: str) -> Column:
    return ~F.coalesce(F.col(field), F.lit("")).eqNullSafe(F.col(declared))


def source_rules() -> Rules:
    return [("SOURCE_MISMATCH", _differs("source_system", "declared_source"))]


def file_store_rules() -> Rules:
    return [("FILE_STORE_MISMATCH", _differs("store_id", "declared_store"))]


def known_store_rules() -> Rules:
    return [("UNKNOWN_STORE", ~F.col("store_known"))]


def known_product_rules() -> Rules:
    return [("UNKNOWN_PRODUCT", ~F.col("product_known"))]


def revision_rules() -> Rules:
    return [("INVALID_REVISION", F.col("_revision").isNull())]


def quantity_rules() -> Rules:
    return [("INVALID_QUANTITY", F.col("_quantity").isNull())]


def operation_rules() -> Rules:
    return [("INVALID_OPERATION", ~F.coalesce(F.col("operation").isin(OPERATIONS), F.lit(False)))]


def money_rules() -> Rules:
    return [
        ("INVALID_UNIT_PRICE_BRL", F.col("_price").isNull()),
        ("INVALID_LINE_DISCOUNT_BRL", F.col("_discount").isNull()),
    ]


def discount_rules() -> Rules:
    gross = F.col("_price").cast("decimal(18,2)") * F.col("_quantity").cast("decimal(10,0)")
    # Null on any invalid input, and then the rule stays silent.
    exceeds = F.col("_discount").cast("decimal(18,2)") > gross
    return [("DISCOUNT_EXCEEDS_GROSS", F.coalesce(exceeds, F.lit(False)))]


def timestamp_rules() -> Rules:
    return [
        ("INVALID_SOLD_AT", F.col("_sold").isNull()),
        ("INVALID_SOURCE_UPDATED_AT", F.col("_updated").isNull()),
    ]


def width_rules() -> Rules:
    return [("ROW_WIDTH_MISMATCH", ~F.coalesce("width_ok", F.lit(False)))]


def header_rules() -> Rules:
    return [("SCHEMA_MISMATCH", ~F.coalesce("header_ok", F.lit(False)))]


def all_rules() -> Rules:
    """Order of the codes on a row: width, header, then the fields."""
    return [
        *width_rules(),
        *header_rules(),
        *identifier_rules(),
        *source_rules(),
        *file_store_rules(),
        *known_store_rules(),
        *known_product_rules(),
        *revision_rules(),
        *quantity_rules(),
        *operation_rules(),
        *money_rules(),
        *discount_rules(),
        *timestamp_rules(),
    ]


def error_codes(rules: Rules) -> Column:
    # Not array_compact: a lambda would have all rules interpreted row by row. No code is listed twice.
    codes = F.array(*(F.when(broken, F.lit(code)) for code, broken in rules))
    return F.array_except(codes, F.array(F.lit(None).cast("string")))


def coded(rows: DataFrame, rules: Rules, name: str = "errors") -> DataFrame:
    """Measured rows with the codes they break, as the one element of a generator: a filter on the codes is not
    pushed below it, where every measure and rule would be computed anew for each of its uses."""
    return measured(rows).select("*", F.explode(F.array(error_codes(rules))).alias(name))


def failing_rows(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break at least one of the rules, with the codes they break."""
    return coded(rows, rules).drop(*MEASURES).filter(F.size("errors") > 0)


def canonical_fields() -> dict[str, Column]:
    """Canonical text of each field of measured rows; an invalid value stays as it came."""
    fields = {name: F.coalesce(F.col(name), F.lit("")) for name in BUSINESS_FIELDS}
    replacements = {
        "revision": F.col("_revision").cast("string"),
        "quantity": F.col("_quantity").cast("string"),
        "unit_price_brl": F.col("_price").cast("string"),
        "line_discount_brl": F.col("_discount").cast("string"),
        "sold_at": C.instant_text(F.col("_sold")),
        "source_updated_at": C.instant_text(F.col("_updated")),
    }
    return {name: F.coalesce(replacements.get(name, fields[name]), fields[name]) for name in fields}


def payload_hashes(rows: DataFrame) -> DataFrame:
    """SHA-256 of the canonical JSON of the twelve fields."""
    hashed = text_digest(canonical_json(canonical_fields()))
    return measured(rows).withColumn("payload_hash", hashed).drop(*MEASURES)


def bronze_rows(rows: DataFrame) -> DataFrame:
    """All received rows: canonical values, provenance, payload hash and ordered codes."""
    canonical = canonical_fields()
    names = [f"_text_{name}" for name in BUSINESS_FIELDS]
    texts = coded(rows, all_rules(), "_errors").withColumns({f"_text_{name}": canonical[name] for name in BUSINESS_FIELDS})
    fields = dict(zip(BUSINESS_FIELDS, map(F.col, names), strict=True))
    return texts.select(
        *(fields[name].alias(name) for name in BUSINESS_FIELDS),
        "batch_id",
        "run_id",
        "source_file",
        "source_line",
        text_digest(canonical_json(fields)).alias("payload_hash"),
        "raw_payload",
        F.col("_errors").alias("errors"),
    )


def quarantine(bronze: DataFrame) -> DataFrame:
    return bronze.filter(F.size("errors") > 0)


def with_measures(events: DataFrame) -> DataFrame:
    """Business day and exact net amount of typed rows."""
    net = F.col("quantity") * F.col("unit_price_brl") - F.col("line_discount_brl")
    return events.withColumns(
        {
            "business_date": C.business_day(F.col("sold_at")),
            "line_net_brl": net.cast("decimal(24,2)"),
        }
    )


def type_events(bronze: DataFrame) -> DataFrame:
    """Typed rows of the error-free part of bronze."""
    valid = bronze.filter(F.size("errors") == 0)
    typed = valid.withColumns(
        {name: F.col(name).try_cast(kind) for name, kind in TYPED_FIELDS.items()}
    )
    return with_measures(typed)


def active_lines(state: DataFrame) -> DataFrame:
    return state.filter(F.col("operation") == "UPSERT")


def cancelled_keys(state: DataFrame) -> DataFrame:
    return state.filter(F.col("operation") == "CANCEL").agg(
        F.count(F.lit(1)).alias("cancelled_keys")
    )
