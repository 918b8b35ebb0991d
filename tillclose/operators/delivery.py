"""Delivery-level checks: what was declared, what arrived, what was expected.

Every frame is keyed by ``batch_id``, so one job checks any number of deliveries.

- ``files``: batch_id, path, sha256, row_count, store_id (valid manifest entries)
- ``inventory``: batch_id, path, bytes, sha256 (delivered files)
- ``counts``: batch_id, path, received_rows
- ``zeros``: batch_id, store_id (confirmed zero movement)
- ``expected``: batch_id, store_id (stores of the delivery window)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.schemas import (
    LIMIT_FILE_BYTES,
    LIMIT_FILES,
    LIMIT_JSON_BYTES,
    LIMIT_TOTAL_BYTES,
)

DOCUMENTS = ["manifest.json", "catalog.json", "schedule.json"]
ISSUE_COLUMNS = ["batch_id", "code", "severity", "store_id", "file", "line", "count"]


def issue(frame: DataFrame, code: str | Column, **context: Column) -> DataFrame:
    """Rows of ``frame`` as issues of one shape."""
    kinds = {"store_id": "string", "file": "string", "line": "int", "count": "bigint"}
    return frame.select(
        "batch_id",
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        F.lit("ERROR").alias("severity"),
        *(context.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()),
    )


def union_issues(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def observed_counts(files: DataFrame, bronze: DataFrame) -> DataFrame:
    """Rows received per delivered file, combined before the shuffle."""
    counted = bronze.groupBy("batch_id", F.col("source_file").alias("path")).agg(
        F.count(F.lit(1)).alias("received_rows")
    )
    return (
        files.select("batch_id", "path")
        .join(counted, ["batch_id", "path"], "left")
        .select("batch_id", "path", F.coalesce("received_rows", F.lit(0)).alias("received_rows"))
    )


def delivered(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Declared files that arrived."""
    return files.join(inventory.select("batch_id", "path"), ["batch_id", "path"], "left_semi")


def missing_files(files: DataFrame, inventory: DataFrame) -> DataFrame:
    absent = files.join(inventory.select("batch_id", "path"), ["batch_id", "path"], "left_anti")
    return issue(absent, "MISSING_FILE", file=F.col("path"), store_id=F.col("store_id"))


def unexpected_files(files: DataFrame, inventory: DataFrame) -> DataFrame:
    extra = inventory.filter(~F.col("path").isin(DOCUMENTS)).join(
        files.select("batch_id", "path"), ["batch_id", "path"], "left_anti"
    )
    return issue(extra, "UNEXPECTED_FILE", file=F.col("path"))


def hash_mismatch(files: DataFrame, inventory: DataFrame) -> DataFrame:
    actual = inventory.select("batch_id", "path", F.col("sha256").alias("_actual"))
    differing = files.join(actual, ["batch_id", "path"]).filter("_actual <> sha256")
    return issue(differing, "HASH_MISMATCH", file=F.col("path"))


def row_count_mismatch(files: DataFrame, inventory: DataFrame, counts: DataFrame) -> DataFrame:
    """Declared against received rows of the files that arrived."""
    return (
        delivered(files, inventory)
        .join(counts, ["batch_id", "path"], "left")
        .withColumn("received_rows", F.coalesce("received_rows", F.lit(0)))
        .filter("received_rows <> row_count")
        .select(
            "batch_id",
            F.lit("ROW_COUNT_MISMATCH").alias("code"),
            F.col("path").alias("file"),
            F.col("row_count").cast("bigint").alias("expected"),
            F.col("received_rows").cast("bigint").alias("received"),
        )
    )


def empty_files(
    files: DataFrame, inventory: DataFrame, counts: DataFrame, zeros: DataFrame
) -> DataFrame:
    """Zero-byte files, and files without rows whose store did not confirm zero movement."""
    arrived = files.join(inventory.select("batch_id", "path", "bytes"), ["batch_id", "path"])
    zero_bytes = issue(arrived.filter("bytes = 0"), "EMPTY_FILE", file=F.col("path"))
    without_rows = (
        arrived.join(counts, ["batch_id", "path"], "left")
        .filter("coalesce(received_rows, 0) = 0")
        .join(zeros.select("batch_id", "store_id"), ["batch_id", "store_id"], "left_anti")
    )
    return zero_bytes.unionByName(
        issue(without_rows, "EMPTY_WITHOUT_ZERO_CONFIRMATION", store_id=F.col("store_id"))
    )


def unexpected_store(files: DataFrame, expected: DataFrame, active: DataFrame) -> DataFrame:
    """Files of a store that is inactive or outside the window."""
    allowed = expected.join(active.select("store_id"), "store_id", "left_semi")
    outside = files.join(
        allowed.select("batch_id", "store_id"), ["batch_id", "store_id"], "left_anti"
    )
    return issue(outside, "UNEXPECTED_STORE", store_id=F.col("store_id"))


def _store_rows(files: DataFrame, counts: DataFrame) -> DataFrame:
    return (
        files.join(counts, ["batch_id", "path"])
        .groupBy("batch_id", "store_id")
        .agg(F.sum("received_rows").alias("store_rows"))
    )


def invalid_zero_confirmation(
    zeros: DataFrame, expected: DataFrame, files: DataFrame, counts: DataFrame
) -> DataFrame:
    """Zero confirmed by a store that is not expected, or that delivered rows."""
    known = expected.select("batch_id", "store_id").withColumn("_expected", F.lit(True))
    wrong = (
        zeros.select("batch_id", "store_id")
        .join(known, ["batch_id", "store_id"], "left")
        .join(_store_rows(files, counts), ["batch_id", "store_id"], "left")
        .filter("_expected IS NULL OR coalesce(store_rows, 0) <> 0")
    )
    return issue(wrong, "INVALID_ZERO_CONFIRMATION", store_id=F.col("store_id"))


def delivery_coverage(
    expected: DataFrame, files: DataFrame, inventory: DataFrame, zeros: DataFrame
) -> DataFrame:
    """Per store: expected, received (a file or an expected confirmed zero), missing, zero.

    The four sets are tagged and grouped once instead of joined pairwise.
    """

    def tag(frame: DataFrame, **flags: bool) -> DataFrame:
        return frame.select(
            "batch_id",
            "store_id",
            *(F.lit(flags.get(name, False)).alias(name) for name in ("e", "f", "z")),
        )

    tagged = (
        tag(expected, e=True)
        .unionByName(tag(delivered(files, inventory), f=True))
        .unionByName(tag(zeros, z=True))
    )
    grouped = tagged.groupBy("batch_id", "store_id").agg(
        F.max("e").alias("expected"), F.max("f").alias("_file"), F.max("z").alias("zero_movement")
    )
    received = F.col("_file") | (F.col("zero_movement") & F.col("expected"))
    return grouped.select(
        "batch_id",
        "store_id",
        "expected",
        received.alias("received"),
        (F.col("expected") & ~received).alias("missing"),
        "zero_movement",
    )


def missing_stores(coverage: DataFrame) -> DataFrame:
    return issue(coverage.filter("missing"), "MISSING_STORE", store_id=F.col("store_id"))


def coverage_mismatch(manifests: DataFrame, files: DataFrame, zeros: DataFrame) -> DataFrame:
    """Declared ``covered_stores`` that repeat a store or differ from files and zeros.

    Both sides become rows: a store declared twice, or on one side only, is a mismatch.
    """
    declaring = manifests.filter("covered_stores IS NOT NULL").select("batch_id", "covered_stores")
    listed = declaring.select("batch_id", F.explode("covered_stores").alias("store_id"))
    present = (
        files.select("batch_id", "store_id")
        .unionByName(zeros.select("batch_id", "store_id"))
        .join(declaring.select("batch_id"), "batch_id", "left_semi")
    )
    sides = listed.withColumn("_times", F.lit(1)).withColumn("_there", F.lit(0)).unionByName(
        present.withColumn("_times", F.lit(0)).withColumn("_there", F.lit(1))
    )
    wrong = (
        sides.groupBy("batch_id", "store_id")
        .agg(F.sum("_times").alias("_times"), F.max("_there").alias("_there"))
        .filter("_times <> 1 OR _there <> 1")
        .select("batch_id")
        .distinct()
    )
    return issue(wrong, "COVERAGE_MISMATCH")


def batch_identity_conflict(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """A known batch id with another manifest, or with other reference documents."""
    known = registry.select(
        "batch_id",
        F.col("manifest_hash").alias("_manifest"),
        F.col("reference_hash").alias("_reference"),
    )
    compared = incoming.join(known, "batch_id")
    return union_issues(
        issue(
            compared.filter(~F.col("manifest_hash").eqNullSafe(F.col("_manifest"))),
            "BATCH_ID_CONFLICT",
        ),
        issue(
            compared.filter(~F.col("reference_hash").eqNullSafe(F.col("_reference"))),
            "BATCH_REFERENCE_CONFLICT",
        ),
    )


def new_batches(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Identities to append to the registry: the first seen stays."""
    return incoming.join(registry.select("batch_id"), "batch_id", "left_anti")


def reference_identity_guard(proposed: DataFrame, stored: DataFrame) -> DataFrame:
    """Approved references never change within a state: accept, keep or refuse."""
    known = stored.select("state_id", F.col("digest").alias("_digest"))
    verdict = (
        F.when(F.col("_digest").isNull(), "ACCEPTED")
        .when(F.col("_digest") == F.col("digest"), "UNCHANGED")
        .otherwise("REFUSED")
    )
    return proposed.join(known, "state_id", "left").withColumn("verdict", verdict).drop("_digest")


def input_budget(
    inventory: DataFrame,
    max_files: int = LIMIT_FILES,
    max_file_bytes: int = LIMIT_FILE_BYTES,
    max_json_bytes: int = LIMIT_JSON_BYTES,
    max_total_bytes: int = LIMIT_TOTAL_BYTES,
) -> DataFrame:
    """Deliveries over budget: single files, and the delivery as a whole."""
    is_json = F.lower("path").endswith(".json")
    json_over = is_json & (F.col("bytes") > max_json_bytes) & F.lit(max_json_bytes < max_file_bytes)
    code = F.when(json_over, "INPUT_JSON_BYTES_LIMIT").when(
        F.col("bytes") > max_file_bytes, "INPUT_FILE_BYTES_LIMIT"
    )
    single = issue(
        inventory.withColumn("_code", code).filter("_code IS NOT NULL"),
        F.col("_code"),
        file=F.col("path"),
        count=F.col("bytes"),
    )
    whole = inventory.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )
    return union_issues(
        single,
        issue(whole.filter(F.col("files") > max_files), "INPUT_FILE_COUNT_LIMIT", count=F.col("files")),
        issue(
            whole.filter(F.col("bytes") > max_total_bytes),
            "INPUT_TOTAL_BYTES_LIMIT",
            count=F.col("bytes"),
        ),
    )


def issue_rollup(bronze: DataFrame) -> DataFrame:
    """One issue per batch and code, with its count and the first place it occurs."""
    place = F.struct("source_file", "source_line")
    rolled = (
        bronze.select("batch_id", "source_file", "source_line", F.explode("errors").alias("code"))
        .groupBy("batch_id", "code")
        .agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("_first"))
    )
    return issue(
        rolled,
        F.col("code"),
        file=F.col("_first.source_file"),
        line=F.col("_first.source_line"),
        count=F.col("count"),
    )


def delivery_stats(bronze: DataFrame) -> DataFrame:
    broken = F.size("errors") > 0
    return bronze.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(~broken).alias("valid"),
        F.count_if(broken).alias("rejected"),
        F.sum(F.size("errors")).cast("bigint").alias("violations"),
    )


def accepted_before(batches: DataFrame, publications: DataFrame) -> DataFrame:
    """Batches some publication already accepted, with that publication: replays."""
    accepted = publications.select(
        F.explode("accepted_batches").alias("batch_id"), "publication_id", "sequence"
    )
    latest = accepted.groupBy("batch_id").agg(
        F.max_by("publication_id", "sequence").alias("publication_id")
    )
    return batches.join(latest, "batch_id").withColumn("state", F.lit("NO_CHANGE"))


def attempt_state(attempts: DataFrame, issues: DataFrame, accepted: DataFrame) -> DataFrame:
    """Final state per batch: an ERROR blocks, validation stops, a replay changes nothing.

    ``attempts``: batch_id, validate_only. ``accepted``: batch_id, publication_id.
    """
    blocked = (
        issues.filter("severity = 'ERROR'")
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("error_issues"))
    )
    state = (
        F.when(F.col("error_issues") > 0, "BLOCKED")
        .when(F.col("validate_only"), "VALIDATED")
        .when(F.col("_official").isNotNull(), "NO_CHANGE")
        .otherwise("PUBLISHED")
    )
    official = accepted.select("batch_id", F.col("publication_id").alias("_official"))
    return (
        attempts.join(blocked, "batch_id", "left")
        .join(official, "batch_id", "left")
        .withColumn("state", state)
        .withColumn("error_issues", F.coalesce("error_issues", F.lit(0)))
        .withColumn("publication_id", F.when(F.col("state") == "NO_CHANGE", F.col("_official")))
        .drop("_official")
    )
