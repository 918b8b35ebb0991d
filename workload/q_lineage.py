"""Lineage and audit over attempts and publications derived from the events.

Every event is also a publication of its book (event number modulo 97), linked to the one
before it. A few links are broken, one book runs in a circle, one starts with legacy records.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import audit as A
from tillclose.operators import lineage as L
from workload.base import part, query
from workload.feed import product_day, state, store_day, stored, table
from workload.q_report import attempts

ABSENT = "event_id % 1009 = 500"
LEGACY = "(event_id % 97 = 9 AND event_id < 970)"


def _name(letter, value):
    return F.concat(F.lit(letter), value.cast("string"))


def publications(spark, folder):
    k = F.col("event_id")
    previous = (
        F.when(F.expr(LEGACY), F.lit(None))
        .when(k == 5, _name("P", F.lit(296)))
        .when(k >= 97, _name("P", k - 97))
    )
    return (
        table(spark, folder, "events")
        .filter(f"NOT ({ABSENT})")
        .select(
            _name("K", k % 97).alias("book_id"),
            _name("P", k).alias("publication_id"),
            _name("R", k).alias("run_id"),
            previous.alias("previous_publication_id"),
            F.expr(LEGACY).alias("is_legacy"),
            k.alias("sequence"),
        )
    )


def official(spark, folder):
    newest = table(spark, folder, "events").filter(f"NOT ({ABSENT})")
    return (
        newest.groupBy((F.col("event_id") % 97).alias("n"))
        .agg(F.max("event_id").alias("e"))
        .select(_name("K", F.col("n")).alias("book_id"), _name("P", F.col("e")).alias("publication_id"))
    )


part(
    "publications",
    [],
    f"""
    SELECT 'K' || (event_id % 97) AS book_id, 'P' || event_id AS publication_id,
           'R' || event_id AS run_id, event_id AS sequence, {LEGACY} AS is_legacy,
           CASE WHEN {LEGACY} THEN NULL WHEN event_id = 5 THEN 'P296'
                WHEN event_id >= 97 THEN 'P' || (event_id - 97) END AS previous_publication_id
    FROM events WHERE NOT ({ABSENT})
    """,
)
part(
    "reach",
    ["publications"],
    """
    SELECT book_id, 'P' || max(sequence) AS publication_id FROM publications GROUP BY book_id
    UNION
    SELECT r.book_id, p.previous_publication_id FROM reach r JOIN publications p
        ON p.publication_id = r.publication_id WHERE p.previous_publication_id IS NOT NULL
    """,
)
part(
    "chains",
    ["reach", "publications"],
    """
    SELECT book_id, CASE WHEN count(*) FILTER (found IS NULL) > 0 THEN 'BROKEN_LINK'
           WHEN count(*) FILTER (found IS NOT NULL AND previous IS NULL) = 0
           THEN 'CYCLE' ELSE 'OK' END AS chain
    FROM (SELECT r.book_id, p.publication_id AS found, p.previous_publication_id AS previous
          FROM reach r LEFT JOIN publications p ON p.publication_id = r.publication_id)
    GROUP BY book_id
    """,
)
part(
    "committed",
    ["reach", "chains", "publications", "attempts"],
    """
    SELECT * FROM publications WHERE publication_id IN
        (SELECT publication_id FROM reach JOIN chains USING (book_id) WHERE chain = 'OK')
    UNION
    SELECT p.* FROM publications p JOIN attempts a ON a.run_id = p.run_id
        AND a.publication_id = p.publication_id AND a.state = 'PUBLISHED'
    WHERE p.book_id IN (SELECT book_id FROM publications JOIN reach USING (book_id, publication_id)
                        JOIN chains USING (book_id) WHERE is_legacy AND chain = 'OK')
    """,
)


@query(
    "publication_ancestry",
    ["reach", "chains", "publications"],
    "SELECT book_id, publication_id, chain FROM reach JOIN chains USING (book_id) "
    "SEMI JOIN publications USING (publication_id)",
    recursive=True,
)
def publication_ancestry(spark, folder):
    found = L.publication_ancestry(publications(spark, folder), official(spark, folder))
    return found.drop("generation")


@query(
    "committed_publications",
    ["committed"],
    "SELECT book_id, publication_id, run_id FROM committed",
    recursive=True,
)
def committed_publications(spark, folder):
    return L.committed_publications(
        publications(spark, folder), official(spark, folder), attempts(spark, folder)
    ).select("book_id", "publication_id", "run_id")


def recorded(spark, folder):
    """Attempt records that were saved; some are lost."""
    rows = attempts(spark, folder).filter("event_id % 50 <> 7")
    return rows.withColumn("error_codes", L.error_codes(F.col("issues")))


@query(
    "reconcile_attempts",
    ["committed", "attempts"],
    """
    , saved AS (SELECT * FROM attempts WHERE event_id % 50 <> 7)
    SELECT coalesce(a.book_id, c.book_id) AS book_id, coalesce(a.run_id, c.run_id) AS run_id,
           CASE WHEN c.run_id IS NOT NULL THEN 'PUBLISHED'
                WHEN a.state IN ('RUNNING', 'PUBLISHED') THEN 'TECHNICAL_FAILURE'
                WHEN a.state = 'NO_CHANGE' AND u.publication_id IS NULL THEN 'TECHNICAL_FAILURE'
                ELSE a.state END AS state,
           CASE WHEN c.run_id IS NOT NULL THEN c.publication_id
                WHEN a.state = 'NO_CHANGE' THEN a.publication_id END AS publication_id,
           CASE WHEN c.run_id IS NULL AND a.state IN ('RUNNING', 'PUBLISHED') THEN 'INTERRUPTED_ATTEMPT'
                WHEN c.run_id IS NULL AND a.state = 'NO_CHANGE' AND u.publication_id IS NULL
                  THEN 'PUBLICATION_UNAVAILABLE'
                WHEN a.event_type = 'click' THEN 'HASH_MISMATCH'
                     || CASE WHEN a.has_file THEN ',MISSING_FILE,MISSING_STORE' ELSE '' END
                ELSE '' END AS error_codes
    FROM saved a FULL JOIN committed c ON a.run_id = c.run_id
    LEFT JOIN (SELECT DISTINCT publication_id FROM committed) u ON u.publication_id = a.publication_id
    """,
    recursive=True,
)
def reconcile_attempts(spark, folder):
    rows = L.reconcile_attempts(
        recorded(spark, folder).select(
            "book_id", "run_id", "state", "publication_id", "error_codes"
        ),
        committed_publications(spark, folder),
    )
    return rows.withColumn("error_codes", F.array_join("error_codes", ","))


def documents(spark, folder):
    """Full publication manifests: tables, sources, accepted batches, profile."""
    k = F.col("event_id")
    names = ["history", "silver", "gold_store_day", "gold_product_day", "bronze"]

    def reference(name):
        path = F.lit(f"tables/{name}") if name != "bronze" else F.concat(
            F.lit("runs/R"), k.cast("string"), F.lit("/bronze")
        )
        version = F.lit(0).cast("bigint") if name == "bronze" else F.expr("event_id div 97")
        return F.struct(
            path.alias("path"),
            (F.when(k % 83 == 6, -1).otherwise(version) if name == "silver" else version)
            .cast("bigint")
            .alias("version"),
        )

    tables = F.map_from_arrays(
        F.array(*(F.lit(name) for name in names)), F.array(*map(reference, names))
    )
    tables = F.when(k % 71 == 8, F.map_filter(tables, lambda key, _: key != "history")).otherwise(
        tables
    )

    def source(number):
        text = number.cast("string")
        return F.struct(
            F.concat(F.lit("B"), text).alias("batch_id"),
            F.concat(F.lit("R"), text).alias("run_id"),
            F.concat(F.lit("runs/R"), text, F.lit("/bronze")).alias("bronze_path"),
            F.lit(0).cast("bigint").alias("bronze_version"),
            F.create_map(F.lit("catalog.json"), F.sha2(text, 256)).alias("reference_hashes"),
            F.sha2(F.lit("approved"), 256).alias("operator_reference_hash"),
            F.sha2(text, 256).alias("manifest_hash"),
        )

    profile = F.struct(
        F.concat(F.lit("profiles/P"), k.cast("string"), F.lit(".json")).alias("path"),
        F.sha2(k.cast("string"), 256).alias("sha256"),
        F.lit(1).alias("contract_version"),
    )
    has_two = k >= 97
    return table(spark, folder, "events").select(
        _name("P", k).alias("publication_id"),
        _name("R", k).alias("run_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias(
            "published_at"
        ),
        k.alias("sequence"),
        F.when(has_two, F.array(_name("B", k - 97), _name("B", F.when(k % 61 == 9, k + 1).otherwise(k))))
        .otherwise(F.array(_name("B", k)))
        .alias("accepted_batches"),
        tables.alias("tables"),
        F.when(has_two, F.array(source(k), source(k - 97))).otherwise(F.array(source(k))).alias(
            "sources"
        ),
        F.when(k % 5 != 3, profile).alias("profile"),
    )


@query(
    "lineage_events",
    ["attempts"],
    """
    , known AS (
      SELECT *, CASE WHEN state = 'PUBLISHED' THEN event_id
                     WHEN state = 'NO_CHANGE' AND event_id >= 194 THEN event_id - 194 END AS pub
      FROM attempts WHERE state <> 'NO_CHANGE' OR event_id >= 0),
    shape AS (SELECT *, pub >= 97 AS two, pub % 71 <> 8 AS has_history FROM known)
    SELECT 'legacy:' || sha256(run_id) AS run_id,
           CASE WHEN event_type = 'view' THEN 'retail.validate' ELSE 'retail.publish' END AS job,
           'start' AS kind, 'START' AS event_type, 'RUNNING' AS state, '' AS reason_codes,
           NULL AS publication_id, 0 AS inputs, 0 AS outputs FROM shape
    UNION ALL
    SELECT 'legacy:' || sha256(run_id),
           CASE WHEN event_type = 'view' THEN 'retail.validate' ELSE 'retail.publish' END,
           'terminal', CASE WHEN state IN ('BLOCKED', 'TECHNICAL_FAILURE') THEN 'FAIL' ELSE 'COMPLETE' END,
           state,
           CASE WHEN event_type = 'click' THEN 'HASH_MISMATCH'
                     || CASE WHEN has_file THEN ',MISSING_FILE,MISSING_STORE' ELSE '' END
                WHEN state = 'TECHNICAL_FAILURE' THEN state ELSE '' END,
           CASE WHEN pub IS NOT NULL THEN 'P' || pub END,
           CASE WHEN pub IS NULL THEN 0 ELSE CASE WHEN two THEN 5 ELSE 3 END
                + CASE WHEN state = 'NO_CHANGE' THEN CASE WHEN has_history THEN 4 ELSE 3 END ELSE 0 END
           END,
           CASE WHEN state = 'PUBLISHED' THEN CASE WHEN has_history THEN 5 ELSE 4 END ELSE 0 END
    FROM shape WHERE state <> 'RUNNING'
    """,
)
def lineage_events(spark, folder):
    return lineage_frame(spark, folder).select(
        "run_id",
        "job",
        "kind",
        "event_type",
        "state",
        F.array_join("reason_codes", ",").alias("reason_codes"),
        "publication_id",
        F.size("inputs").alias("inputs"),
        F.size("outputs").alias("outputs"),
    )


def lineage_frame(spark, folder):
    return L.lineage_events(attempts(spark, folder), documents(spark, folder))


def digests(spark, folder):
    """Key and digest of every event, built once."""
    return stored(L.event_digest(lineage_frame(spark, folder)).select("run_id", "kind", "digest"), "digests")


def exported(events):
    """Events already written: all but some, and a few that say something else."""
    return (
        events.filter(~(F.col("run_id").endswith("7") & (F.col("kind") == "terminal")))
        .withColumn(
            "digest",
            F.when(F.col("run_id").endswith("a"), F.lit("0" * 64)).otherwise(F.col("digest")),
        )
        .select("run_id", "kind", "digest")
    )


part(
    "event_keys",
    ["attempts"],
    """
    SELECT 'legacy:' || sha256(run_id) AS run_id, 'start' AS kind FROM attempts
    UNION ALL SELECT 'legacy:' || sha256(run_id), 'terminal' FROM attempts WHERE state <> 'RUNNING'
    """,
)


@query(
    "missing_lineage_events",
    ["event_keys"],
    "SELECT * FROM event_keys WHERE right(run_id, 1) = '7' AND kind = 'terminal'",
)
def missing_lineage_events(spark, folder):
    events = digests(spark, folder)
    found = L.missing_lineage_events(events, exported(events))
    return found.select("run_id", "kind")


@query(
    "diverging_lineage_events",
    ["event_keys"],
    "SELECT * FROM event_keys WHERE right(run_id, 1) = 'a'",
)
def diverging_lineage_events(spark, folder):
    events = digests(spark, folder)
    found = L.diverging_lineage_events(events, exported(events))
    return found.select("run_id", "kind")


# ---- audit ------------------------------------------------------------------------------
def _digest_sql(text: str) -> str:
    return ", ".join(
        f"CAST(coalesce(sum(CAST('0x' || substr(sha256({text}), {start}, 15) AS BIGINT)), 0) "
        f"AS DECIMAL(38,0)) AS digest_{i}"
        for i, start in ((1, 1), (2, 16))
    )


_ROW = (
    "'{\"business_date\":\"' || business_date || '\",\"product_id\":\"' || product_id || "
    "'\",\"net_revenue_brl\":' || cents || ',\"units\":' || units || ',\"item_lines\":' || item_lines || '}'"
)


@query(
    "table_fingerprint",
    ["product_cents"],
    f"""
    SELECT count(*) AS rows, {_digest_sql(_ROW)}
    FROM (SELECT *, CAST(CAST(CAST(net_cents AS DECIMAL(30,0)) * CAST('0.01' AS DECIMAL(3,2))
                         AS DECIMAL(28,2)) AS VARCHAR) AS cents FROM product_cents)
    """,
)
def table_fingerprint(spark, folder):
    return A.table_fingerprint(product_day(spark, folder))


@query(
    "revenue_cents",
    ["store_cents"],
    "SELECT CAST(sum(net_cents) AS DECIMAL(30,0)) AS net_revenue_cents FROM store_cents",
)
def revenue_cents(spark, folder):
    return A.revenue_cents(store_day(spark, folder))


part(
    "refs",
    [],
    """
    SELECT 'P' || event_id AS publication_id, 'table:' || t AS kind,
           CASE WHEN t = 'bronze' THEN 'runs/R' || event_id || '/bronze' ELSE 'tables/' || t END AS path,
           CASE WHEN t = 'bronze' THEN 0 WHEN t = 'silver' AND event_id % 83 = 6 THEN -1
                ELSE event_id // 97 END AS version
    FROM events, (SELECT unnest(['history', 'silver', 'gold_store_day', 'gold_product_day', 'bronze']) AS t)
    WHERE NOT (t = 'history' AND event_id % 71 = 8)
    UNION ALL SELECT 'P' || event_id, 'bronze:B' || (event_id - d), 'runs/R' || (event_id - d) || '/bronze', 0
    FROM events, (SELECT unnest([0, 97]) AS d) WHERE event_id >= d
    UNION ALL SELECT 'P' || event_id, 'profile', 'profiles/P' || event_id || '.json', NULL
    FROM events WHERE event_id % 5 <> 3
    """,
)


@query("referenced_versions", ["refs"], "SELECT * FROM refs")
def referenced_versions(spark, folder):
    return A.referenced_versions(documents(spark, folder))


def registry(spark, folder):
    """Versions on disk: one per event for the history table and one bronze per event."""
    k = F.col("event_id")
    rows = table(spark, folder, "events")
    return rows.select(
        F.lit("tables/history").alias("path"), (k * 2).alias("version")
    ).unionByName(
        rows.select(
            F.concat(F.lit("runs/R"), (k * 3).cast("string"), F.lit("/bronze")).alias("path"),
            F.lit(0).cast("bigint").alias("version"),
        )
    )


part(
    "disk",
    [],
    "SELECT 'tables/history' AS path, event_id * 2 AS version FROM events "
    "UNION ALL SELECT 'runs/R' || (event_id * 3) || '/bronze', 0 FROM events",
)


@query(
    "unreferenced_versions",
    ["disk", "refs"],
    "SELECT path, version FROM disk WHERE (path, version) NOT IN "
    "(SELECT (path, version) FROM refs WHERE version IS NOT NULL)",
)
def unreferenced_versions(spark, folder):
    return A.unreferenced_versions(registry(spark, folder), referenced_versions(spark, folder))


@query(
    "refused_removals",
    [],
    """
    , x AS (SELECT 1)
    SELECT path FROM (
        SELECT 'runs/R' || (event_id * 2) AS path, event_id * 2 AS n FROM events
        UNION ALL SELECT 'runs/R' || (event_id * 2) || '/bronze/part-0.parquet', event_id * 2 FROM events
        UNION ALL SELECT 'tables/history', 0
        UNION ALL SELECT 'scratch/' || event_id, -1 FROM events)
    WHERE n IN (SELECT event_id FROM events)
    """.replace(", x AS (SELECT 1)", ""),
)
def refused_removals(spark, folder):
    k = F.col("event_id")
    rows = table(spark, folder, "events")
    twice = F.concat(F.lit("runs/R"), (k * 2).cast("string"))
    proposals = (
        rows.select(twice.alias("path"))
        .unionByName(rows.select(F.concat(twice, F.lit("/bronze/part-0.parquet")).alias("path")))
        .unionByName(rows.select(F.lit("tables/history").alias("path")).distinct())
        .unionByName(rows.select(F.concat(F.lit("scratch/"), k.cast("string")).alias("path")))
    )
    return A.refused_removals(proposals, referenced_versions(spark, folder))


@query(
    "inventory_diff",
    ["inventory"],
    """
    SELECT batch_id || '/' || path AS path,
           CASE WHEN bytes % 7 = 1 THEN 'MISSING' WHEN bytes % 7 = 2 THEN 'EXTRA' ELSE 'CHANGED' END AS status
    FROM inventory WHERE bytes % 7 IN (1, 2, 3)
    """,
)
def inventory_diff(spark, folder):
    from workload.q_delivery import inventory

    rows = inventory(spark, folder).select(
        F.concat_ws("/", "batch_id", "path").alias("path"), "bytes", "sha256"
    )
    kind = F.col("bytes") % 7
    before = rows.filter(kind != 2)
    after = rows.filter(kind != 1).withColumn(
        "sha256", F.when(kind == 3, F.reverse("sha256")).otherwise(F.col("sha256"))
    )
    return A.inventory_diff(before, after)


@query(
    "sources_match_batches",
    [],
    """
    SELECT * FROM (SELECT 'P' || event_id AS publication_id, concat_ws(',',
        CASE WHEN event_id % 61 = 9 AND event_id >= 97 THEN 'BATCHES_DIFFER_FROM_SOURCES' END,
        CASE WHEN event_id % 71 = 8 THEN 'INCOMPLETE_MANIFEST' END,
        CASE WHEN event_id % 83 = 6 THEN 'INVALID_VERSION' END,
        CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'POINTER_DIFFERS' END) AS defects
    FROM events) WHERE defects <> ''
    """,
)
def sources_match_batches(spark, folder):
    rows = documents(spark, folder)
    pointers = rows.filter("sequence % 4 = 0").withColumn(
        "published_at",
        F.when(F.col("sequence") % 3 == 0, F.lit("later")).otherwise(F.col("published_at")),
    )
    found = A.publication_defects(rows, pointers)
    return found.withColumn("defects", F.array_join("defects", ","))


@query(
    "latest_table_version",
    ["disk"],
    "SELECT path AS table_name, max(version) AS version FROM disk GROUP BY path",
)
def latest_table_version(spark, folder):
    rows = registry(spark, folder).withColumnRenamed("path", "table_name")
    return A.latest_table_version(rows)


@query(
    "current_publication",
    ["publications"],
    "SELECT book_id, arg_max(publication_id, sequence) AS publication_id, "
    "arg_max(run_id, sequence) AS run_id FROM publications GROUP BY book_id",
)
def current_publication(spark, folder):
    found = A.current_publication(publications(spark, folder), "book_id")
    return found.select("book_id", "publication_id", "run_id")
