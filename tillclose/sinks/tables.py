"""Writers of immutable table versions, manifests, profiles, registries and events.

Nothing is overwritten: every write goes to a path of its own or appends records, and a
publication becomes visible with one appended manifest. A job that dies in between leaves
files no manifest names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tillclose.functions.positions import position_filter
from tillclose.operators import lineage as L
from tillclose.operators.audit import latest_table_version
from tillclose.operators.delivery import new_batches
from tillclose.operators.revisions import relabel_rejects
from tillclose.operators.row_contract import quarantine
from tillclose.session import local_rows, scratch_path, shuffles_removed, write_table
from tillclose.sources.tables import REGISTRY, _read_json, read_registry

IDENTITY = "batch_id string, manifest_hash string, reference_hash string"
EXPORTED = "run_id string, kind string, digest string"
PROFILE = "publication_id string, run_id string, section string, document string"


def write_bronze(bronze: DataFrame, run_path: str) -> str:
    """All received rows with provenance and errors, one table per attempt."""
    path = f"{run_path}/bronze"
    write_table(bronze, path)
    return path


def write_quarantine(bronze: DataFrame, run_path: str) -> str:
    path = f"{run_path}/quarantine"
    quarantine(bronze).write.mode("errorifexists").parquet(path)
    return path


def write_rejects(rows: DataFrame, code: str, run_path: str) -> str:
    """Rejected rows under a single code, one folder per code."""
    path = f"{run_path}/rejects/code={code}"
    relabel_rejects(rows, code).write.mode("errorifexists").parquet(path)
    return path


def next_version(spark: SparkSession, root: str, name: str) -> int:
    newest = latest_table_version(read_registry(spark, root).filter(F.col("table_name") == name))
    row = newest.first()
    return 0 if row is None else row["version"] + 1


def register_version(
    spark: SparkSession, root: str, name: str, path: str, version: int, run_id: str
) -> None:
    record = local_rows(
        spark,
        REGISTRY,
        [{"table_name": name, "path": path, "version": version, "run_id": run_id}],
    )
    record.write.mode("append").json(f"{root}/versions")


def write_version(
    frame: DataFrame, root: str, name: str, run_id: str, partition_by: str | None = None
) -> Row:
    """A new immutable version of a table; its number is registered before the write, so a
    failed write never frees it."""
    spark = frame.sparkSession
    version = next_version(spark, root, name)
    path = f"{root}/tables/{name}"
    register_version(spark, root, name, path, version, run_id)
    writer = frame.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/version={version}")
    return Row(path=path, version=version)


def write_history(added: DataFrame, root: str, run_id: str) -> Row:
    """What this run adds to the history, in the partition of the run."""
    spark = added.sparkSession
    version = next_version(spark, root, "history")
    path = f"{root}/tables/history"
    register_version(spark, root, "history", path, version, run_id)
    added.drop("run_id").write.mode("errorifexists").parquet(f"{path}/run_id={run_id}")
    return Row(path=path, version=version)


def write_gold(store_day: DataFrame, product_day: DataFrame, root: str, run_id: str) -> dict:
    """Both gold tables, in two writes; neither counts before the publication."""
    return {
        "gold_store_day": write_version(store_day, root, "gold_store_day", run_id),
        "gold_product_day": write_version(product_day, root, "gold_product_day", run_id),
    }


def write_publication(manifest: DataFrame, root: str) -> None:
    """Append one manifest; from then on it is the official one."""
    manifest.coalesce(1).write.mode("append").json(f"{root}/publications")


def profile_digest(profile: DataFrame) -> DataFrame:
    """Digest of the sections of a profile, whatever order they come in."""
    text = F.concat_ws("\u0001", "section", "document")
    return profile.groupBy("publication_id", "run_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\u0002"), 256).alias("sha256"),
        F.sum(F.length("document")).alias("bytes"),
    )


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    return _read_json(spark, f"{root}/profiles", PROFILE)


def write_evidence(frame: DataFrame, run_path: str, name: str) -> DataFrame:
    """An intermediate result of a run, written once and read from there by later stages."""
    path = f"{run_path}/evidence/{name}"
    frame.write.mode("errorifexists").parquet(path)
    return frame.sparkSession.read.parquet(path)


def write_profile(profile: DataFrame, root: str) -> str:
    """Store a profile once. Writing the same content again changes nothing, other content
    under a stored id is refused. ``profile``: one JSON document per section, a dozen rows."""
    spark = profile.sparkSession
    stored = profile_digest(read_profiles(spark, root)).withColumnRenamed("sha256", "_stored")
    fresh = profile_digest(profile)
    row = fresh.join(
        stored.select("publication_id", "_stored"), "publication_id", "left"
    ).first()
    if row["_stored"] is None:
        profile.coalesce(1).write.mode("append").json(f"{root}/profiles")
    elif row["_stored"] != row["sha256"]:
        raise ValueError("a stored profile cannot be replaced by other content")
    return row["sha256"]


def read_batch_registry(spark: SparkSession, root: str) -> DataFrame:
    return _read_json(spark, f"{root}/batches", IDENTITY)


def write_batch_registry(incoming: DataFrame, root: str) -> None:
    """Record the identity of batches seen for the first time."""
    known = read_batch_registry(incoming.sparkSession, root)
    rows = new_batches(incoming, known).select("batch_id", "manifest_hash", "reference_hash")
    rows.write.mode("append").json(f"{root}/batches")


def write_quality_summary(
    issues: DataFrame, stats: DataFrame, coverage: DataFrame, run_path: str
) -> None:
    """Issues, counters and coverage of an attempt, as JSON."""
    for name, frame in (("issues", issues), ("stats", stats), ("coverage", coverage)):
        frame.write.mode("errorifexists").json(f"{run_path}/quality/{name}")


def read_exported_events(spark: SparkSession, root: str) -> DataFrame:
    return _read_json(spark, f"{root}/lineage", EXPORTED)


def write_lineage_events(events: DataFrame, root: str) -> None:
    """Append the events not exported yet; one that contradicts an exported one is refused.

    Events are wide, so they stay where they were written: keys and digests alone tell which kinds (there are two) are
    exported as a whole, in part or not at all. Of those exported in part, only events that may be missing move.
    """
    spark = events.sparkSession
    exported = read_exported_events(spark, root)
    path = scratch_path(spark, "events")
    write_table(L.event_digest(events), path)
    digested = spark.read.schema(L.event_digest(events).schema).parquet(path)
    with shuffles_removed(spark):
        kinds = L.export_status(digested, exported).collect()
        if any(kind["diverging"] for kind in kinds):
            raise ValueError("an exported event contradicts the reconstructed one")
        missing = [digested.filter(F.col("kind").eqNullSafe(x["kind"])) for x in kinds if not x["exported"]]
        for kind in (x["kind"] for x in kinds if x["exported"] and x["missing"]):
            rows, known = (x.filter(F.col("kind").eqNullSafe(kind)) for x in (digested, exported))
            keys = L.missing_lineage_events(rows.select("run_id", "kind"), known)
            at = F.xxhash64("run_id")
            may_be_missing = position_filter(keys.select(at.alias("h")))(at)
            missing.append(L.missing_lineage_events(rows.filter(may_be_missing), known).select(*digested.columns))
        if missing:
            lines = reduce(DataFrame.unionByName, missing)
            lines.write.mode("append").option("compression", "gzip").json(f"{root}/lineage")
