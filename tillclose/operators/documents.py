"""Contracts of the JSON documents of a delivery: catalogue, schedule, manifest.

Documents come as text and are parsed as VARIANT, which refuses repeated keys and keeps the
JSON type of every value, so ``1`` and ``"1"`` and ``true`` stay different. Each document is
one row; its records are exploded, so any number of documents is checked in one job.
Catalogues and schedules are keyed by ``reference_id``, manifests by ``delivery_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.functions import contract as C
from tillclose.schemas import BUSINESS_ZONE, DOCUMENT_VERSION

# Fixed field lists of the manifest.
MANIFEST_FIELDS = [
    "schema_version",
    "batch_id",
    "source_system",
    "window_id",
    "files",
    "zero_movement",
    "covered_stores",
    "correction_of",
]
FILE_FIELDS = ["path", "row_count", "sha256", "store_id"]


def parsed(documents: DataFrame) -> DataFrame:
    """Adds ``doc``: the root object, null when the text is not one JSON object."""
    value = F.try_parse_json("document")
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return documents.withColumn("doc", F.when(is_object, value))


def _part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _kind(value: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_part(value, path)), F.lit("ABSENT"))


def _text(value: Column, path: str) -> Column:
    """The string at a path, null when absent or of another type."""
    return F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def _integer(value: Column, path: str) -> Column:
    return F.when(_kind(value, path) == "BIGINT", F.try_variant_get(value, path, "bigint"))


def _items(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _identifiers(value: Column, path: str) -> Column:
    """Items of a list as valid identifiers; an item that is none becomes null."""

    def item(entry: Column) -> Column:
        text = F.when(
            F.schema_of_variant(entry) == "STRING", F.try_variant_get(entry, "$", "string")
        )
        return F.when(C.valid_identifier(text), text)

    return F.transform(_items(value, path), item)


def _right_version(doc: Column) -> Column:
    return F.coalesce(_integer(doc, "$.schema_version") == DOCUMENT_VERSION, F.lit(False))


def _clean_list(items: Column) -> Column:
    """A list without repeats whose items are all valid identifiers."""
    return (
        items.isNotNull()
        & ~F.exists(items, lambda item: item.isNull())
        & (F.size(F.array_distinct(items)) == F.size(items))
    )


Finding = tuple[Column, str, "str | Column | None", "Column | None"]


def _findings(frame: DataFrame, key: str, rules: list[Finding]) -> DataFrame:
    """Every broken rule of every row, in one pass: key, code, field, value, count.

    A rule is (broken, code, field, value); an unknown outcome counts as not broken.
    """

    def finding(broken: Column, code: str, field, value) -> Column:
        field = field if isinstance(field, Column) else F.lit(field)
        value = F.lit(None) if value is None else value
        return F.when(
            broken,
            F.struct(
                F.lit(code).alias("code"),
                field.cast("string").alias("field"),
                value.cast("string").alias("value"),
            ),
        )

    listed = F.array_compact(F.array(*(finding(*rule) for rule in rules)))
    return (
        frame.select(key, F.explode(listed).alias("finding"))
        .groupBy(key, "finding.code", "finding.field", "finding.value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _repeats(frame: DataFrame, keys: list[str], code: str, field: str, value: str) -> DataFrame:
    """Ids that occur again: one finding per repeat."""
    return (
        frame.groupBy(*keys)
        .agg((F.count(F.lit(1)) - 1).alias("count"))
        .filter("count > 0")
        .select(
            keys[0], F.lit(code).alias("code"), F.lit(field).alias("field"),
            F.col(value).alias("value"), "count",
        )
    )


def _all(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


# ---- catalogue --------------------------------------------------------------------------
_COLLECTIONS = {"stores": "store_id", "products": "product_id"}


def catalog_records(catalogs: DataFrame, collection: str) -> DataFrame:
    """Records of one collection: their id (null when invalid) and raw value."""
    identifier = _text(F.col("record"), f"$.{_COLLECTIONS[collection]}")
    return (
        parsed(catalogs)
        .select("reference_id", F.explode(_items(F.col("doc"), f"$.{collection}")).alias("record"))
        .withColumn("id", F.when(C.valid_identifier(identifier), identifier))
    )


def active_stores(catalogs: DataFrame) -> DataFrame:
    active = F.try_variant_get("record", "$.active", "boolean") & (
        _kind(F.col("record"), "$.active") == "BOOLEAN"
    )
    return (
        catalog_records(catalogs, "stores")
        .filter(F.col("id").isNotNull() & active)
        .select("reference_id", F.col("id").alias("store_id"))
        .distinct()
    )


def catalog_products(catalogs: DataFrame) -> DataFrame:
    return (
        catalog_records(catalogs, "products")
        .filter("id IS NOT NULL")
        .select("reference_id", F.col("id").alias("product_id"))
        .distinct()
    )


def check_catalog(catalogs: DataFrame) -> DataFrame:
    """Issues of the catalogues: reference_id, code, field, value, count."""
    key, doc, record, name = "reference_id", F.col("doc"), F.col("record"), F.col("id")
    empty = {
        collection: F.coalesce(F.size(_items(doc, f"$.{collection}")) == 0, F.lit(True))
        for collection in _COLLECTIONS
    }
    found = [
        _findings(
            parsed(catalogs),
            key,
            [
                (doc.isNull(), "INVALID_CATALOG", "document", None),
                (~_right_version(doc), "CATALOG_SCHEMA_VERSION", None, None),
                *((empty[part], "INVALID_CATALOG", part, None) for part in _COLLECTIONS),
            ],
        )
    ]
    metadata = (
        (_kind(record, "$.active") == "BOOLEAN")
        & F.coalesce(_text(record, "$.timezone") == BUSINESS_ZONE, F.lit(False))
        & _text(record, "$.state").isNotNull()
    )
    no_category = F.coalesce(_text(record, "$.category"), F.lit("")) == ""
    specific = {"stores": (~metadata, "store_metadata"), "products": (no_category, "category")}
    for collection, identifier in _COLLECTIONS.items():
        records = catalog_records(catalogs, collection)
        named = name.isNotNull()
        blank_name = F.coalesce(_text(record, "$.name"), F.lit("")) == ""
        broken, field = specific[collection]
        found += [
            _findings(
                records,
                key,
                [
                    (~named, "INVALID_CATALOG", collection, None),
                    (named & blank_name, "INVALID_CATALOG", "name", name),
                    (named & broken, "INVALID_CATALOG", field, name),
                ],
            ),
            _repeats(records.filter(named), [key, "id"], "DUPLICATE_REFERENCE", identifier, "id"),
        ]
    return _all(*found)


# ---- schedule ---------------------------------------------------------------------------
def schedule_windows(schedules: DataFrame) -> DataFrame:
    """Delivery windows with their raw record; ids are null unless they are texts."""
    record = F.col("record")
    return (
        parsed(schedules)
        .select("reference_id", F.explode(_items(F.col("doc"), "$.windows")).alias("record"))
        .select(
            "reference_id",
            "record",
            _text(record, "$.window_id").alias("window_id"),
            _text(record, "$.source_system").alias("source_system"),
            _identifiers(record, "$.stores").alias("stores"),
        )
    )


def check_schedule(schedules: DataFrame, active: DataFrame) -> DataFrame:
    """Issues of the schedules; ``active``: reference_id, store_id of the catalogue."""
    key, doc, record = "reference_id", F.col("doc"), F.col("record")
    windows = schedule_windows(schedules)
    usable = C.valid_identifier(F.col("window_id")) & C.valid_identifier(F.col("source_system"))
    clean = F.coalesce(_clean_list(F.col("stores")) & (F.size("stores") > 0), F.lit(False))
    starts, ends = (C.instant(_text(record, f"$.{n}")) for n in ("starts_at", "ends_at"))
    ordered = F.coalesce(starts < ends, F.lit(False))
    window = F.col("window_id")
    not_a_list = (_kind(doc, "$.windows") != "ABSENT") & _items(doc, "$.windows").isNull()
    # Windows naming a store that is not active, found by one anti join over their stores.
    strangers = (
        windows.filter(usable & clean)
        .select(key, "window_id", "source_system", F.explode("stores").alias("store_id"))
        .join(active.select(key, "store_id"), [key, "store_id"], "left_anti")
        .select(key, "window_id", "source_system")
        .distinct()
    )
    return _all(
        _findings(
            parsed(schedules),
            key,
            [
                (doc.isNull(), "INVALID_SCHEDULE", "document", None),
                (~_right_version(doc), "SCHEDULE_SCHEMA_VERSION", None, None),
                (not_a_list, "INVALID_SCHEDULE", "windows", None),
            ],
        ),
        _findings(
            windows,
            key,
            [
                (~usable, "INVALID_SCHEDULE_WINDOW", None, None),
                (usable & ~clean, "INVALID_SCHEDULE_STORES", "window_id", window),
                (usable & ~ordered, "INVALID_DELIVERY_INTERVAL", "window_id", window),
            ],
        ),
        _repeats(
            windows.filter(usable),
            [key, "source_system", "window_id"],
            "DUPLICATE_SCHEDULE_WINDOW",
            "window_id",
            "window_id",
        ),
        _findings(strangers, key, [(F.lit(True), "INVALID_SCHEDULE_STORES", "window_id", window)]),
    )


def matched_windows(manifests: DataFrame, schedules: DataFrame) -> DataFrame:
    """Per delivery: how many windows match, and the stores of the match.

    ``manifests``: batch_id, reference_id, window_id, source_system.
    """
    windows = schedule_windows(schedules).groupBy(
        "reference_id", "window_id", "source_system"
    ).agg(F.count(F.lit(1)).alias("windows"), F.first("stores").alias("stores"))
    return manifests.join(windows, ["reference_id", "window_id", "source_system"], "left")


def expected_stores(manifests: DataFrame, schedules: DataFrame) -> DataFrame:
    """Stores of the one window a delivery belongs to."""
    usable = ~F.exists("stores", lambda item: item.isNull())
    return (
        matched_windows(manifests, schedules)
        .filter((F.col("windows") == 1) & usable)
        .select("batch_id", F.explode(F.array_distinct("stores")).alias("store_id"))
    )


def window_issues(manifests: DataFrame, schedules: DataFrame) -> DataFrame:
    return (
        matched_windows(manifests, schedules)
        .filter("coalesce(windows, 0) <> 1")
        .select("batch_id", F.lit("UNKNOWN_OR_DUPLICATE_WINDOW").alias("code"))
    )


# ---- manifest ---------------------------------------------------------------------------
def safe_path(path: Column) -> Column:
    """Relative, normalised POSIX path of a ``.csv`` file."""
    parts = F.split(path, "/")
    clean = ~F.exists(parts, lambda part: part.isin("", ".", ".."))
    return F.coalesce(
        clean
        & ~path.rlike(r"[\\:\x00-\x1f]")
        & (F.length(F.element_at(parts, -1)) > 4)
        & path.endswith(".csv"),
        F.lit(False),
    )


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """One row per distinct path of a manifest: its first entry, how often it is named.

    Entries that are no objects or have an unsafe path keep one row each (``state`` says so).
    """
    entry = F.col("entry")
    exploded = parsed(manifests).select(
        "delivery_id", F.posexplode(_items(F.col("doc"), "$.files")).alias("position", "entry")
    )
    path = _text(entry, "$.path")
    state = (
        F.when(~F.coalesce(F.schema_of_variant(entry).startswith("OBJECT"), F.lit(False)), "INVALID")
        .when(~safe_path(path), "UNSAFE")
        .otherwise("NAMED")
    )
    keys = F.array_sort(F.json_object_keys(F.to_json(entry)))
    right = (
        keys.eqNullSafe(F.array(*map(F.lit, FILE_FIELDS)))
        & C.matches(_text(entry, "$.sha256"), C.SHA256)
        & F.coalesce(_integer(entry, "$.row_count") >= 0, F.lit(False))
        & C.valid_identifier(_text(entry, "$.store_id"))
    )
    described = exploded.select(
        "delivery_id",
        "position",
        state.alias("state"),
        path.alias("path"),
        F.struct(
            _text(entry, "$.sha256").alias("sha256"),
            _integer(entry, "$.row_count").alias("row_count"),
            _text(entry, "$.store_id").alias("store_id"),
            right.alias("valid"),
        ).alias("fields"),
    )
    return described.groupBy(
        "delivery_id",
        "state",
        "path",
        F.when(F.col("state") != "NAMED", F.col("position")).alias("_single"),
    ).agg(
        F.count(F.lit(1)).alias("times"),
        F.min("position").alias("position"),
        F.min_by("fields", "position").alias("fields"),
    ).drop("_single")


def manifest_files(manifests: DataFrame) -> DataFrame:
    """Valid entries: the first per path, well formed."""
    return (
        manifest_entries(manifests)
        .filter("state = 'NAMED' AND fields.valid")
        .select("delivery_id", "path", "fields.sha256", "fields.row_count", "fields.store_id", "position")
    )


def manifest_zeros(manifests: DataFrame) -> DataFrame:
    """Stores confirming zero movement; an invalid list confirms nothing."""
    zeros = _identifiers(F.col("doc"), "$.zero_movement")
    return (
        parsed(manifests)
        .filter(F.coalesce(_clean_list(zeros), F.lit(False)))
        .select("delivery_id", F.explode(zeros).alias("store_id"))
    )


def manifest_headers(manifests: DataFrame) -> DataFrame:
    """The scalar fields and the declared coverage of each manifest."""
    doc = F.col("doc")
    covered = _identifiers(doc, "$.covered_stores")
    return parsed(manifests).select(
        "delivery_id",
        *(
            _text(doc, f"$.{name}").alias(name)
            for name in ("batch_id", "source_system", "window_id", "correction_of")
        ),
        # A declared but unusable list still is a declaration, of nothing that can match.
        F.when(
            _kind(doc, "$.covered_stores") != "ABSENT",
            F.coalesce(covered, F.array(F.lit(None).cast("string"))),
        ).alias("covered_stores"),
    )


def check_manifest(manifests: DataFrame) -> DataFrame:
    """Issues of the manifests: delivery_id, code, field, value, count."""
    key, doc = "delivery_id", F.col("doc")
    unknown = F.array_except(
        F.json_object_keys(F.to_json(doc)), F.array(*map(F.lit, MANIFEST_FIELDS))
    )
    zeros = _identifiers(doc, "$.zero_movement")
    wrong_correction = (_kind(doc, "$.correction_of") != "ABSENT") & ~C.valid_identifier(
        _text(doc, "$.correction_of")
    )
    documents = _findings(
        parsed(manifests),
        key,
        [
            (doc.isNull(), "INVALID_MANIFEST", None, None),
            (~_right_version(doc), "UNSUPPORTED_SCHEMA_VERSION", None, None),
            *(
                (~C.valid_identifier(_text(doc, f"$.{n}")), "INVALID_MANIFEST_FIELD", n, None)
                for n in ("batch_id", "source_system", "window_id")
            ),
            (wrong_correction, "INVALID_MANIFEST_FIELD", "correction_of", None),
            (
                F.size(unknown) > 0,
                "UNKNOWN_MANIFEST_FIELDS",
                F.array_join(F.array_sort(unknown), ","),
                None,
            ),
            (_items(doc, "$.files").isNull(), "INVALID_MANIFEST_FILES", None, None),
            (
                ~F.coalesce(_clean_list(zeros), F.lit(False)),
                "INVALID_ZERO_CONFIRMATION",
                None,
                None,
            ),
        ],
    )
    state, path = F.col("state"), F.col("path")
    named = state == "NAMED"
    entries = manifest_entries(manifests)
    rules = [
        (state == "INVALID", "INVALID_MANIFEST_FILE", None, None),
        (state == "UNSAFE", "UNSAFE_PATH", "file", path),
        (named & ~F.col("fields.valid"), "INVALID_MANIFEST_FILE", "file", path),
    ]
    # A path named n times is one entry with n - 1 repeats.
    again = F.array_repeat(F.lit(1), (F.col("times") - 1).cast("int"))
    repeated = entries.filter(named & (F.col("times") > 1)).withColumn("_again", F.explode(again))
    return _all(
        documents,
        _findings(entries, key, rules),
        _findings(repeated, key, [(F.lit(True), "DUPLICATE_MANIFEST_FILE", "file", path)]),
    )


def canonical_manifest(doc: Column) -> Column:
    """Compact JSON with ordered keys; the three lists are ordered too, so the order in which
    files or stores are listed does not change the identity."""
    fields = F.try_variant_get(doc, "$", "map<string,variant>")
    listed = ["files", "zero_movement", "covered_stores"]

    def one(name: Column) -> Column:
        value = F.element_at(fields, name)
        items = F.try_variant_get(value, "$", "array<variant>")
        ordered = F.array_join(F.array_sort(F.transform(items, lambda i: F.to_json(i))), ",")
        text = F.when(
            name.isin(listed) & items.isNotNull(), F.concat(F.lit("["), ordered, F.lit("]"))
        ).otherwise(F.to_json(value))
        return F.concat(F.lit('"'), name, F.lit('":'), text)

    body = F.array_join(F.transform(F.array_sort(F.map_keys(fields)), one), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))


def manifest_identity(manifests: DataFrame) -> DataFrame:
    """SHA-256 of the canonical manifest; an unreadable one counts as the empty object."""
    text = F.coalesce(canonical_manifest(F.col("doc")), F.lit("{}"))
    return parsed(manifests).select("delivery_id", F.sha2(text, 256).alias("manifest_hash"))
