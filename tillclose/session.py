"""Session settings every operator relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SETTINGS = {
    # Instants are UTC; the business day is derived explicitly.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Split hot partitions of a join even where that costs one more shuffle downstream.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot compiles no method above 8000 bytes of bytecode; a generated one beyond runs interpreted, so such a
    # stage is better evaluated by its expressions, whose code is split.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Texts go to Python tasks by bytes, not by ten thousand rows of any length: both sides of the pipe hold a batch.
    # It is as long as a chunk of ``llm.text``: more would only wait there.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Run ids and versions in paths stay texts.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Years 1 to 9999 are legal business dates.
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
    "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
}


def build_session(name: str = "tillclose", **settings: str) -> SparkSession:
    """A session with the settings above, and without the capture of Python call sites, which
    costs more than the planning of small stages."""
    builder = SparkSession.builder.appName(name).config(
        "spark.python.sql.dataFrameDebugging.enabled", "false"
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; partition counts and memory stay with the cluster."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, as the cluster names it.

    Only a local session (tests) may fall back to a fresh folder of its own.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    current = spark.conf.get("tillclose.local.folder", None)
    if current is None:
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("tillclose.local.folder", current)
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside removes its shuffle files when it ends, and not when the driver happens to collect
    garbage. For frames that are executed once: a second execution would have to compute them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_table(frame: DataFrame, path: str, *by: str) -> None:
    """A table written once to a path of its own. Its digests are hexadecimal texts, which zstd halves and snappy
    leaves as long as they are; the shuffles that led to it end with the write."""
    with shuffles_removed(frame.sparkSession):
        writer = frame.write.mode("errorifexists").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a frame outside its lineage, so a lost executor does not replay it all."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)


def local_rows(spark: SparkSession, schema: str, rows: list[dict]) -> DataFrame:
    """A few records as a plan literal: no Python worker, folded by the optimizer."""
    kind = f"array<{T.StructType.fromDDL(schema).simpleString()}>"
    return spark.sql(
        "SELECT inline(from_json(:rows, :kind))", args={"rows": json.dumps(rows), "kind": kind}
    )
