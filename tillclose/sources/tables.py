"""Published tables at the versions a publication manifest names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tillclose.operators.audit import current_publication
from tillclose.schemas import PUBLICATION
from tillclose.session import local_rows
from tillclose.sources.buckets import Layout, load_layout, read_buckets

REGISTRY = "table_name string, path string, version bigint, run_id string"


def _read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON dataset that may not exist yet; an absent one is empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return local_rows(spark, schema, [])


def read_publications(spark: SparkSession, root: str) -> DataFrame:
    return _read_json(spark, f"{root}/publications", PUBLICATION)


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """Every table version ever written, published or not."""
    return _read_json(spark, f"{root}/versions", REGISTRY)


def load_publication(spark: SparkSession, root: str) -> Row | None:
    """The official publication: the newest committed manifest, one row or nothing."""
    return current_publication(read_publications(spark, root)).first()


def read_table_version(spark: SparkSession, publication: Row, name: str) -> DataFrame:
    """A table exactly as the manifest names it.

    The history is stored as what each run added, partitioned by ``run_id``; a version of it is
    the parts of the runs the publication accepted. Parts of failed runs are never read. The
    state is kept by buckets, each in the version that last changed it.
    """
    reference = publication["tables"][name]
    path = reference["path"]
    if name == "silver":
        return read_buckets(spark, state_layout(spark, publication))
    if name == "history":
        runs = [source["run_id"] for source in publication["sources"]]
        return spark.read.parquet(path).filter(F.col("run_id").isin(runs))
    return spark.read.parquet(path if name == "bronze" else f"{path}/version={reference['version']}")


def state_layout(spark: SparkSession, publication: Row) -> Layout:
    """Which version holds each bucket of the published state."""
    reference = publication["tables"]["silver"]
    return load_layout(spark, reference["path"], reference["version"])


def read_published_snapshot(
    spark: SparkSession, root: str, names: list[str]
) -> tuple[Row | None, dict[str, DataFrame]]:
    """Several tables, all from one manifest read once, so publications never mix."""
    publication = load_publication(spark, root)
    if publication is None:
        return None, {}
    return publication, {name: read_table_version(spark, publication, name) for name in names}
