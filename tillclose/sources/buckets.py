"""Tables kept by buckets of their sale keys: which version holds each bucket, and reading some of them.

A version of such a table is a map, ``{path}/map/version=N``, with one row per bucket that names the version
whose files hold it, ``{path}/data/version=M/bucket=B``. What a version leaves alone it names as it is.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillclose.schemas import SALE_KEY

#: ``held``: version whose files hold the bucket. Digests are those of ``audit.table_fingerprint``.
BUCKET_MAP = (
    "bucket int, buckets int, held bigint, rows bigint, digest_1 decimal(38,0), digest_2 decimal(38,0)"
)
#: A bucket without rows that keeps the columns of a table that may be empty.
COLUMNS_ONLY = -1


@dataclass(frozen=True)
class Layout:
    """A map on the driver: at most ``sinks.buckets.MOST_BUCKETS`` entries, whatever the rows."""

    path: str
    version: int
    entries: dict[int, dict]

    @property
    def count(self) -> int:
        return next(iter(self.entries.values()))["buckets"]

    @property
    def rows(self) -> int:
        return sum(entry["rows"] for entry in self.entries.values())

    @property
    def held(self) -> dict[int, int]:
        return {bucket: entry["held"] for bucket, entry in self.entries.items()}


def bucket_of(count: int) -> Column:
    """The bucket of a row: all lines and revisions of a sale share one. From the first 32 bits of an MD5, so any
    engine can tell it; ``count`` is a power of two, so doubling it splits every bucket in two."""
    digest = F.md5(F.concat_ws("\u0001", *SALE_KEY))
    return (F.conv(digest.substr(1, 8), 16, 10).cast("bigint") % count).cast("int")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(BUCKET_MAP).parquet(f"{path}/map/version={version}")


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """The maps of all versions: ``path``, ``version`` and the columns of a map."""
    maps = spark.read.schema(f"{BUCKET_MAP}, version bigint").parquet(f"{path}/map")
    return maps.select(F.lit(path).alias("path"), "version", *(x for x in maps.columns if x != "version"))


def load_layout(spark: SparkSession, path: str, version: int) -> Layout:
    entries = read_map(spark, path, version).collect()
    return Layout(path, version, {entry["bucket"]: entry.asDict() for entry in entries})


def touched(layout: Layout, rows: DataFrame) -> set[int]:
    """Buckets the sales of ``rows`` belong to."""
    numbers = rows.select(bucket_of(layout.count).alias("bucket")).distinct().collect()
    return {row["bucket"] for row in numbers}


def read_buckets(spark: SparkSession, layout: Layout, numbers: Iterable[int] | None = None) -> DataFrame:
    """Rows of some buckets, or of all; only their files are listed and read."""
    held = layout.held
    wanted = held if numbers is None else {*numbers, COLUMNS_ONLY} & held.keys()
    return spark.read.parquet(*(f"{layout.path}/data/version={held[n]}/bucket={n}" for n in sorted(wanted)))
