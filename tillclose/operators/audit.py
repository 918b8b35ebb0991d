"""Versions, references and fingerprints of what is published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillclose.functions.digest import digest_slice, row_text, text_digest
from tillclose.schemas import PUBLISHED_TABLES


def latest_table_version(registry: DataFrame) -> DataFrame:
    """Newest version per table."""
    return registry.groupBy("table_name").agg(F.max("version").alias("version"))


def current_publication(publications: DataFrame, *by: str) -> DataFrame:
    """The newest committed publication, per ``by`` if given; no row when there is none."""
    newest = F.max_by(F.struct(*publications.columns), F.struct("sequence", "publication_id"))
    found = publications.groupBy(*by).agg(newest.alias("p"))
    return found.filter("p IS NOT NULL").select("p.*")


def table_fingerprint(frame: DataFrame, *by: str) -> DataFrame:
    """Row count and content digest that do not depend on row order or partitioning.

    Every row is hashed and the hashes are summed, so the work is one partial aggregation.
    """
    columns = [name for name in frame.columns if name not in by]
    hashed = frame.select(*by, text_digest(row_text(columns)).alias("_hash"))
    return hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *(
            F.coalesce(F.sum(digest_slice(F.col("_hash"), start)), F.lit(0))
            .cast("decimal(38,0)")
            .alias(f"digest_{i}")
            for i, start in enumerate((1, 16), 1)
        ),
    )


def revenue_cents(gold: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("net_revenue_brl"), F.lit(0)) * 100
    return gold.agg(total.cast("decimal(30,0)").alias("net_revenue_cents"))


def referenced_versions(publications: DataFrame) -> DataFrame:
    """Everything some publication still refers to: tables, bronze sources and profiles."""
    tables = publications.select(
        "publication_id", F.explode(F.map_entries("tables")).alias("t")
    ).select(
        "publication_id",
        F.concat(F.lit("table:"), F.col("t.key")).alias("kind"),
        F.col("t.value.path").alias("path"),
        F.col("t.value.version").alias("version"),
    )
    sources = publications.select("publication_id", F.explode("sources").alias("s")).select(
        "publication_id",
        F.concat(F.lit("bronze:"), F.col("s.batch_id")).alias("kind"),
        F.col("s.bronze_path").alias("path"),
        F.col("s.bronze_version").alias("version"),
    )
    profiles = publications.filter("profile IS NOT NULL").select(
        "publication_id",
        F.lit("profile").alias("kind"),
        F.col("profile.path").alias("path"),
        F.lit(None).cast("bigint").alias("version"),
    )
    return reduce(DataFrame.unionByName, [tables, sources, profiles])


def bucket_references(references: DataFrame, maps: DataFrame) -> DataFrame:
    """Versions whose buckets a referenced version names: they are held with it. ``maps``: path, version, held."""
    named = maps.select("path", "version", "held").distinct()
    return (
        references.join(named, ["path", "version"])
        .filter("held <> version")
        .select(
            "publication_id",
            F.concat("kind", F.lit(":bucket")).alias("kind"),
            "path",
            F.col("held").alias("version"),
        )
    )


def unreferenced_versions(registry: DataFrame, references: DataFrame) -> DataFrame:
    """Versions no publication refers to. ``registry``: path, version."""
    held = references.filter("version IS NOT NULL").select("path", "version").distinct()
    return registry.join(held, ["path", "version"], "left_anti")


def refused_removals(proposals: DataFrame, references: DataFrame) -> DataFrame:
    """Proposed paths that reach a referenced one: the same, above or below it.

    Both sides become their ancestor paths, which turns containment into equality. A path
    has few ancestors, so this needs no comparison of all pairs.
    """

    def ancestors(frame: DataFrame, name: str) -> DataFrame:
        parts = F.split(F.regexp_replace(F.trim(F.col("path")), r"/+\z", ""), "/")
        chain = F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.concat_ws("/", F.slice(parts, 1, n)),
        )
        return frame.select(F.col("path").alias(name), F.explode(chain).alias("node"))

    held = references.select("path").distinct()
    above = (
        ancestors(held, "held")
        .select(F.col("node").alias("path"))
        .distinct()
    )
    exact = proposals.select("path").withColumn(
        "_path", F.regexp_replace(F.trim(F.col("path")), r"/+\z", "")
    )
    covers = exact.join(above.select(F.col("path").alias("_path")), "_path", "left_semi")
    inside = ancestors(proposals, "proposal").join(
        held.select(F.col("path").alias("node")), "node", "left_semi"
    )
    return (
        covers.select("path").unionByName(inside.select(F.col("proposal").alias("path"))).distinct()
    )


def inventory_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files missing, added or changed between two inventories; no row when they are equal."""
    old = before.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    status = (
        F.when(F.col("sha256").isNull(), "MISSING")
        .when(F.col("_sha").isNull(), "EXTRA")
        .when((F.col("sha256") != F.col("_sha")) | (F.col("bytes") != F.col("_bytes")), "CHANGED")
    )
    return (
        after.select("path", "bytes", "sha256")
        .join(old, "path", "full_outer")
        .select("path", status.alias("status"))
        .filter("status IS NOT NULL")
    )


def publication_defects(publications: DataFrame, pointers: DataFrame) -> DataFrame:
    """Publications that break the retention contract, with the reasons.

    Batches accepted must be those of the sources, all tables must be named, versions must not
    be negative, and the pointer must equal the stored manifest.
    """
    batches = F.array_sort(F.array_distinct("accepted_batches"))
    sources = F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["batch_id"])))
    required = F.array(*map(F.lit, PUBLISHED_TABLES))
    negative = F.exists(F.map_values("tables"), lambda t: F.coalesce(t["version"] < 0, F.lit(True)))
    content = sorted(publications.columns)
    stored = publications.withColumn("_stored", F.sha2(row_text(content), 256))
    official = pointers.select(
        "publication_id", F.sha2(row_text(content), 256).alias("_official")
    )
    reasons = {
        "BATCHES_DIFFER_FROM_SOURCES": ~batches.eqNullSafe(sources)
        | (F.size(F.coalesce(batches, F.array().cast("array<string>"))) == 0),
        "INCOMPLETE_MANIFEST": F.size(F.array_except(required, F.map_keys("tables"))) > 0,
        "INVALID_VERSION": negative,
        "POINTER_DIFFERS": F.col("_official").isNotNull()
        & (F.col("_official") != F.col("_stored")),
    }
    broken = F.array_compact(
        F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in reasons.items()))
    )
    return (
        stored.join(official, "publication_id", "left")
        .select("publication_id", broken.alias("defects"))
        .filter("size(defects) > 0")
    )
