"""Scans of delivered files and documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillclose.functions.contract import instant
from tillclose.schemas import ATTEMPT, BRONZE, BUSINESS_FIELDS

_CELLS = [f"c{i}" for i in range(1, len(BUSINESS_FIELDS) + 1)]
_CORRUPT = "_corrupt"


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _relative(path: Column, folder: str) -> Column:
    """Path below the folder, whatever scheme the file system adds in front."""
    base = re.sub(_SCHEME, "", folder).rstrip("/") + "/"
    if not base.startswith("/"):
        return F.substring_index(path, base, -1)
    plain = F.regexp_replace(path, _SCHEME, "")
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(plain)


def _decoded(path: Column) -> Column:
    """A path as it is named; the metadata column has it as a URL."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _record_cells(record: Column) -> Column:
    """Cells of one CSV record, quotes removed."""
    ended = F.concat(F.regexp_replace(record, r"\r?\n?\z", ""), F.lit(","))
    cells = F.regexp_extract_all(ended, F.lit('("(?:[^"]++|"")*+"|[^,]*+),'), F.lit(1))
    return F.transform(
        cells,
        lambda c: F.when(
            F.startswith(c, F.lit('"')), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )


def _strict(content: Column) -> Column:
    """Whether every cell that begins with a quote ends with one, right before a comma or line end."""
    rest = F.regexp_replace(content, r'(\A|[,\n])"(?:[^"]++|"")*+"(?=[,\r\n]|\z)', "$1")
    return ~F.rlike(rest, F.lit(r'(\A|[,\n])"'))


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder: relative path, bytes, SHA-256, header cells, and whether the
    text is valid UTF-8 with well-formed quotes. Hidden files of the file system are left out."""
    content = F.col("content").cast("string")
    first = F.element_at(F.split(content, r"\r?\n", 2), 1)
    readable = F.coalesce(F.is_valid_utf8(content) & _strict(content), F.lit(False))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(
            _relative(F.col("path"), folder).alias("path"),
            F.col("length").alias("bytes"),
            F.sha2("content", 256).alias("sha256"),
            readable.alias("readable"),
            _record_cells(first).alias("header"),
        )
    )


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Relative path and bytes only; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(_relative(F.col("path"), folder).alias("path"), F.col("length").alias("bytes"))
    )


def file_headers(inventory: DataFrame) -> DataFrame:
    """Header cells of the CSV files, and whether they are the twelve fields in order."""
    wanted = F.array(*map(F.lit, BUSINESS_FIELDS))
    return inventory.filter("path LIKE '%.csv'").select(
        "path", "header", (F.col("header") == wanted).alias("header_ok")
    )


def _breaks(text: Column) -> Column:
    return F.coalesce(
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)
    )


def read_delivery_csv(
    spark: SparkSession, folder: str, inventory: DataFrame | None = None
) -> DataFrame:
    """Rows of all CSV files below a folder, cells as text, with file and physical line.

    Quoted cells may hold line breaks, so a file is read by one task; the contract limits a
    file to 64 MiB. The line is counted within the file from the record order and the breaks
    inside earlier records. A record of another width than the contract's fills the corrupt
    column, from which its cells are split, so each record is held against its own header:
    under a wrong header all cells are matched by name (the last of equal names counts), an
    absent field is empty, and the width is right if there are as many cells as header cells.
    Pass a stored ``inventory`` of the folder where there is one, so files are read once.
    """
    if inventory is None:
        inventory = file_inventory(spark, folder, "*.csv")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*_CELLS, _CORRUPT]])
    scanned = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("multiLine", "true")
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
        .select("*", F.col("_metadata.file_path").alias("_file"))
        .withColumn("_order", F.monotonically_increasing_id())
        .withColumn("source_file", _relative(_decoded(F.col("_file")), folder))
    )
    inside = F.lit(0)
    for name in _CELLS:
        inside = inside + _breaks(F.col(name))
    broken_inside = _breaks(F.regexp_replace(F.col(_CORRUPT), r"\r?\n\z", ""))
    earlier = Window.partitionBy("source_file").orderBy("_order").rowsBetween(
        Window.unboundedPreceding, -1
    )
    lines = F.when(F.col(_CORRUPT).isNull(), inside).otherwise(broken_inside) + 1
    headers = file_headers(inventory).withColumnRenamed("path", "source_file")
    given = F.transform(F.array(*_CELLS), lambda c: F.coalesce(c, F.lit("")))
    cells = F.when(F.col(_CORRUPT).isNull(), given).otherwise(_record_cells(F.col(_CORRUPT)))

    def cell(position: int, name: str) -> Column:
        last = F.size("header") + 1 - F.nullif(F.array_position(F.reverse("header"), name), F.lit(0))
        at = F.when(F.col("header_ok"), F.lit(position + 1)).otherwise(last.cast("int"))
        # An empty or absent cell is the empty text.
        return F.coalesce(F.try_element_at("_cells", at), F.lit(""))

    return (
        scanned.withColumn("_lines", lines)
        .withColumn(
            "source_line", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) + 2).cast("int")
        )
        .withColumn("_cells", cells)
        .join(headers, "source_file", "left")
        .select(
            *(cell(i, name).alias(name) for i, name in enumerate(BUSINESS_FIELDS)),
            "source_file",
            "source_line",
            F.coalesce(F.size("_cells") == F.size("header"), F.lit(False)).alias("width_ok"),
            F.coalesce(F.col("header_ok"), F.lit(False)).alias("header_ok"),
            F.to_json(F.struct("header", F.col("_cells").alias("values"))).alias("raw_payload"),
        )
    )


def read_documents(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Whole JSON documents of one name below a folder: relative path and text."""
    return (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name)
        .text(folder)
        .select(
            _relative(_decoded(F.col("_metadata.file_path")), folder).alias("path"),
            F.col("value").alias("document"),
        )
    )


def read_bronze_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON rows with the declared schema."""
    return spark.read.schema(BRONZE).json(path)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """All attempt records; the UTC start is derived, null when the record is unusable."""
    return (
        spark.read.schema(f"book_id string, {ATTEMPT}")
        .json(path)
        .withColumn("started_utc", instant(F.col("started_at")))
    )
