"""Writer of deliveries: CSV files per delivery and store, and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillclose.schemas import BUSINESS_FIELDS, DOCUMENT_VERSION
from tillclose.session import shuffles_removed
from tillclose.sources.delivery import file_inventory, read_delivery_csv

# Keeps a file well below the 64 MiB a delivery file may have.
ROWS_PER_FILE = 200000


def write_delivery(rows: DataFrame, folder: str, store: str = "store_id") -> None:
    """Files below ``delivery=<batch>/store=<store>/``.

    Rows are brought together per delivery and store; a hot store is split over several tasks
    and files, which the manifest lists one by one. ``store`` names the column that holds the
    store a file is delivered for.
    """
    named = rows.select(
        *BUSINESS_FIELDS, F.col("batch_id").alias("delivery"), F.col(store).alias("store")
    )
    with shuffles_removed(rows.sparkSession):
        (
            named.hint("rebalance", "delivery", "store")
            .write.mode("errorifexists")
            .partitionBy("delivery", "store")
            .option("header", "true")
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false")
            .option("maxRecordsPerFile", ROWS_PER_FILE)
            .csv(folder)
        )


def delivered_files(spark, folder: str) -> DataFrame:
    """What was written: delivery, store, path, digest and row count of every file."""
    inventory = file_inventory(spark, folder, "*.csv")
    counted = (
        read_delivery_csv(spark, folder, inventory)
        .groupBy(F.col("source_file").alias("path"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    return (
        inventory.join(counted, "path", "left")
        .select(
            F.regexp_extract("path", r"delivery=([^/]*)", 1).alias("delivery_id"),
            F.regexp_extract("path", r"store=([^/]*)", 1).alias("store_id"),
            "path",
            "sha256",
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
        )
    )


def manifest_documents(files: DataFrame, source_system: str, window_id: str) -> DataFrame:
    """One manifest per delivery; its list is as long as the delivery has files."""
    entry = F.struct("path", "row_count", "sha256", "store_id")
    return files.groupBy("delivery_id").agg(F.array_sort(F.collect_list(entry)).alias("files")).select(
        "delivery_id",
        F.to_json(
            F.struct(
                F.lit(DOCUMENT_VERSION).alias("schema_version"),
                F.col("delivery_id").alias("batch_id"),
                F.lit(source_system).alias("source_system"),
                F.lit(window_id).alias("window_id"),
                "files",
                F.array().cast("array<string>").alias("zero_movement"),
            )
        ).alias("document"),
    )
