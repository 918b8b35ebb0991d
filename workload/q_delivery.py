"""Delivery checks: one delivery per business day, one file per store with sales that day.

What is declared, delivered, expected and confirmed is derived from the feed; a few day/store
pairs, chosen by their numbers, are declared wrong so that every check has something to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import delivery as D
from workload.base import part, query
from workload.feed import feed_cents

# Day number and store number mixed into one value the conditions below look at.
MIX = "(day_no * 31 + store_no * 17)"


def _named(frame):
    """Names of the delivery, the store and its file."""
    return frame.withColumns(
        {
            "batch_id": F.concat(F.lit("D"), F.lpad(F.col("day_no").cast("string"), 6, "0")),
            "store_id": F.concat(F.lit("S"), F.lpad(F.col("store_no").cast("string"), 2, "0")),
        }
    ).withColumn("path", F.concat("store_id", F.lit(".csv")))


def day_stores(spark, folder):
    """Rows sold per day and store."""
    rows = feed_cents(spark, folder).select("day_no", "store_no")
    counted = rows.groupBy("day_no", "store_no").agg(F.count(F.lit(1)).alias("sold_rows"))
    return _named(counted).withColumn("mix", F.expr(MIX))


def all_pairs(spark, folder):
    """Every store on every day that has a delivery."""
    days = feed_cents(spark, folder).select("day_no").distinct()
    pairs = days.withColumn("store_no", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return _named(pairs).withColumn("mix", F.expr(MIX))


def _digest(note: str):
    return F.sha2(F.concat_ws("/", "batch_id", "path", F.lit(note)), 256)


def files(spark, folder):
    return day_stores(spark, folder).select(
        "batch_id",
        "path",
        _digest("declared").alias("sha256"),
        (F.col("sold_rows") + F.when(F.col("mix") % 7 == 0, 1).otherwise(0)).alias("row_count"),
        "store_id",
    )


def inventory(spark, folder):
    rows = day_stores(spark, folder)
    arrived = rows.filter("mix % 13 <> 0").select(
        "batch_id",
        "path",
        F.when(F.col("mix") % 17 == 0, 0).otherwise(F.col("sold_rows") * 120).alias("bytes"),
        F.when(F.col("mix") % 11 == 0, _digest("other")).otherwise(_digest("declared")).alias("sha256"),
    )
    extra = (
        rows.filter("day_no % 29 = 0")
        .select("batch_id")
        .distinct()
        .withColumn("path", F.explode(F.array(F.lit("extra.csv"), F.lit("manifest.json"))))
        .select("batch_id", "path", F.lit(64).cast("bigint").alias("bytes"), _digest("x").alias("sha256"))
    )
    return arrived.unionByName(extra)


def counts(spark, folder):
    lost = (F.col("mix") % 19 == 0) | (F.col("mix") % 17 == 0)
    return day_stores(spark, folder).select(
        "batch_id", "path", F.when(lost, 0).otherwise(F.col("sold_rows")).alias("received_rows")
    )


def expected(spark, folder):
    return all_pairs(spark, folder).filter("mix % 23 <> 0").select("batch_id", "store_id")


def zeros(spark, folder):
    """Silent stores confirm zero on most days; some stores with rows do so wrongly."""
    sold = day_stores(spark, folder).select("batch_id", "store_id", "sold_rows")
    return (
        all_pairs(spark, folder)
        .join(sold, ["batch_id", "store_id"], "left")
        .filter("(sold_rows IS NULL AND mix % 3 <> 0) OR mix % 37 = 0")
        .select("batch_id", "store_id")
    )


def active(spark, folder):
    return all_pairs(spark, folder).filter("store_no <> 4").select("store_id").distinct()


def manifests(spark, folder):
    """Covered stores as declared: right, one store left out, or one store repeated."""
    covered = (
        files(spark, folder)
        .select("batch_id", "store_id")
        .unionByName(zeros(spark, folder))
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_set("store_id")).alias("covered"))
    )
    day = F.substring("batch_id", 2, 6).cast("int")
    return covered.select(
        "batch_id",
        F.when(day % 31 == 0, F.slice("covered", 2, 100))
        .when(day % 37 == 0, F.concat("covered", F.slice("covered", 1, 1)))
        .when(day % 41 != 0, F.col("covered"))
        .alias("covered_stores"),
    )


_NAMES = (
    "'D' || lpad(CAST(day_no AS VARCHAR), 6, '0') AS batch_id, "
    "'S' || lpad(CAST(store_no AS VARCHAR), 2, '0') AS store_id, "
    "'S' || lpad(CAST(store_no AS VARCHAR), 2, '0') || '.csv' AS path, "
    f"{MIX} AS mix"
)
part(
    "day_stores",
    ["cents"],
    f"SELECT *, {_NAMES} FROM (SELECT day_no, store_no, count(*) AS sold_rows FROM cents GROUP BY ALL)",
)
part(
    "all_pairs",
    ["cents"],
    f"SELECT *, {_NAMES} FROM (SELECT DISTINCT day_no FROM cents), "
    "(SELECT unnest(range(1, 13)) AS store_no)",
)
part(
    "files",
    ["day_stores"],
    "SELECT batch_id, path, sha256(concat_ws('/', batch_id, path, 'declared')) AS sha256, "
    "sold_rows + CASE WHEN mix % 7 = 0 THEN 1 ELSE 0 END AS row_count, store_id FROM day_stores",
)
part(
    "inventory",
    ["day_stores"],
    """
    SELECT batch_id, path, CASE WHEN mix % 17 = 0 THEN 0 ELSE sold_rows * 120 END AS bytes,
           sha256(concat_ws('/', batch_id, path,
                            CASE WHEN mix % 11 = 0 THEN 'other' ELSE 'declared' END)) AS sha256
    FROM day_stores WHERE mix % 13 <> 0
    UNION ALL
    SELECT batch_id, p, 64, sha256(concat_ws('/', batch_id, p, 'x'))
    FROM (SELECT DISTINCT batch_id FROM day_stores WHERE day_no % 29 = 0),
         (SELECT unnest(['extra.csv', 'manifest.json']) AS p)
    """,
)
part(
    "counts",
    ["day_stores"],
    "SELECT batch_id, path, CASE WHEN mix % 19 = 0 OR mix % 17 = 0 THEN 0 ELSE sold_rows END "
    "AS received_rows FROM day_stores",
)
part("expected", ["all_pairs"], "SELECT batch_id, store_id FROM all_pairs WHERE mix % 23 <> 0")
part(
    "zeros",
    ["all_pairs", "day_stores"],
    """
    SELECT a.batch_id, a.store_id FROM all_pairs a LEFT JOIN day_stores d
    ON a.batch_id = d.batch_id AND a.store_id = d.store_id
    WHERE (d.sold_rows IS NULL AND a.mix % 3 <> 0) OR a.mix % 37 = 0
    """,
)


@query(
    "missing_files",
    ["files", "inventory"],
    "SELECT batch_id, 'MISSING_FILE' AS code, store_id, path AS file FROM files "
    "ANTI JOIN inventory USING (batch_id, path)",
)
def missing_files(spark, folder):
    found = D.missing_files(files(spark, folder), inventory(spark, folder))
    return found.select("batch_id", "code", "store_id", "file")


@query(
    "unexpected_files",
    ["files", "inventory"],
    "SELECT batch_id, 'UNEXPECTED_FILE' AS code, path AS file FROM inventory "
    "ANTI JOIN files USING (batch_id, path) "
    "WHERE path NOT IN ('manifest.json', 'catalog.json', 'schedule.json')",
)
def unexpected_files(spark, folder):
    found = D.unexpected_files(files(spark, folder), inventory(spark, folder))
    return found.select("batch_id", "code", "file")


@query(
    "hash_mismatch",
    ["files", "inventory"],
    "SELECT f.batch_id, 'HASH_MISMATCH' AS code, f.path AS file FROM files f JOIN inventory i "
    "ON f.batch_id = i.batch_id AND f.path = i.path WHERE f.sha256 <> i.sha256",
)
def hash_mismatch(spark, folder):
    found = D.hash_mismatch(files(spark, folder), inventory(spark, folder))
    return found.select("batch_id", "code", "file")


@query(
    "row_count_mismatch",
    ["files", "inventory", "counts"],
    """
    SELECT batch_id, 'ROW_COUNT_MISMATCH' AS code, path AS file, row_count AS expected,
           received_rows AS received
    FROM files SEMI JOIN inventory USING (batch_id, path) JOIN counts USING (batch_id, path)
    WHERE row_count <> received_rows
    """,
)
def row_count_mismatch(spark, folder):
    return D.row_count_mismatch(
        files(spark, folder), inventory(spark, folder), counts(spark, folder)
    )


@query(
    "empty_files",
    ["files", "inventory", "counts", "zeros"],
    """
    SELECT batch_id, 'EMPTY_FILE' AS code, NULL AS store_id, path AS file
    FROM files SEMI JOIN (SELECT * FROM inventory WHERE bytes = 0) USING (batch_id, path)
    UNION ALL
    SELECT batch_id, 'EMPTY_WITHOUT_ZERO_CONFIRMATION', store_id, NULL
    FROM files SEMI JOIN inventory USING (batch_id, path)
    SEMI JOIN (SELECT * FROM counts WHERE received_rows = 0) USING (batch_id, path)
    ANTI JOIN zeros USING (batch_id, store_id)
    """,
)
def empty_files(spark, folder):
    found = D.empty_files(
        files(spark, folder), inventory(spark, folder), counts(spark, folder), zeros(spark, folder)
    )
    return found.select("batch_id", "code", "store_id", "file")


@query(
    "unexpected_store",
    ["files", "expected"],
    "SELECT batch_id, 'UNEXPECTED_STORE' AS code, store_id FROM files WHERE store_id = 'S04' "
    "OR (batch_id, store_id) NOT IN (SELECT (batch_id, store_id) FROM expected)",
)
def unexpected_store(spark, folder):
    found = D.unexpected_store(
        files(spark, folder), expected(spark, folder), active(spark, folder)
    )
    return found.select("batch_id", "code", "store_id")


@query(
    "invalid_zero_confirmation",
    ["zeros", "expected", "files", "counts"],
    """
    SELECT batch_id, 'INVALID_ZERO_CONFIRMATION' AS code, store_id FROM zeros
    WHERE (batch_id, store_id) NOT IN (SELECT (batch_id, store_id) FROM expected)
       OR (batch_id, store_id) IN (SELECT (batch_id, store_id) FROM files
                                   JOIN counts USING (batch_id, path) WHERE received_rows > 0)
    """,
)
def invalid_zero_confirmation(spark, folder):
    found = D.invalid_zero_confirmation(
        zeros(spark, folder), expected(spark, folder), files(spark, folder), counts(spark, folder)
    )
    return found.select("batch_id", "code", "store_id")


part(
    "coverage",
    ["expected", "files", "inventory", "zeros"],
    """
    SELECT batch_id, store_id, e.batch_id IS NOT NULL AS expected,
           (f.batch_id IS NOT NULL OR (z.batch_id IS NOT NULL AND e.batch_id IS NOT NULL)) AS received,
           z.batch_id IS NOT NULL AS zero_movement
    FROM (SELECT * FROM expected) e
    FULL JOIN (SELECT DISTINCT batch_id, store_id FROM files SEMI JOIN inventory
               USING (batch_id, path)) f USING (batch_id, store_id)
    FULL JOIN zeros z USING (batch_id, store_id)
    """,
)


@query(
    "delivery_coverage",
    ["coverage"],
    "SELECT *, expected AND NOT received AS missing FROM coverage",
)
def delivery_coverage(spark, folder):
    return D.delivery_coverage(
        expected(spark, folder),
        files(spark, folder),
        inventory(spark, folder),
        zeros(spark, folder),
    )


@query(
    "missing_stores",
    ["coverage"],
    "SELECT batch_id, 'MISSING_STORE' AS code, store_id FROM coverage WHERE expected AND NOT received",
)
def missing_stores(spark, folder):
    found = D.missing_stores(delivery_coverage(spark, folder))
    return found.select("batch_id", "code", "store_id")


@query(
    "coverage_mismatch",
    ["files", "zeros"],
    """
    , present AS (SELECT DISTINCT batch_id, CAST(substr(batch_id, 2) AS INT) AS day_no
                  FROM (SELECT batch_id FROM files UNION ALL SELECT batch_id FROM zeros))
    SELECT batch_id, 'COVERAGE_MISMATCH' AS code FROM present
    WHERE day_no % 31 = 0 OR day_no % 37 = 0
    """,
)
def coverage_mismatch(spark, folder):
    found = D.coverage_mismatch(
        manifests(spark, folder), files(spark, folder), zeros(spark, folder)
    )
    return found.select("batch_id", "code")


# ---- identity, budget and state of the deliveries ---------------------------------------
part(
    "identities",
    ["day_stores"],
    """
    SELECT batch_id, min(day_no) AS day_no,
           sha256(concat_ws('/', batch_id, sum(sold_rows))) AS manifest_hash,
           sha256(concat_ws('/', batch_id, count(*))) AS reference_hash
    FROM day_stores GROUP BY batch_id
    """,
)


def identities(spark, folder):
    grouped = (
        day_stores(spark, folder)
        .groupBy("batch_id")
        .agg(
            F.min("day_no").alias("day_no"),
            F.sum("sold_rows").alias("_rows"),
            F.count(F.lit(1)).alias("_stores"),
        )
    )
    return grouped.select(
        "batch_id",
        "day_no",
        F.sha2(F.concat_ws("/", "batch_id", "_rows"), 256).alias("manifest_hash"),
        F.sha2(F.concat_ws("/", "batch_id", "_stores"), 256).alias("reference_hash"),
    )


def registry(spark, folder):
    """First identities on record: most days known, some under another content."""
    other = F.lit("0" * 64)
    return (
        identities(spark, folder)
        .filter("day_no % 5 <> 0")
        .select(
            "batch_id",
            F.when(F.col("day_no") % 7 == 1, other)
            .otherwise(F.col("manifest_hash"))
            .alias("manifest_hash"),
            F.when(F.col("day_no") % 11 != 2, F.col("reference_hash")).alias("reference_hash"),
        )
    )


@query(
    "batch_identity_conflict",
    ["identities"],
    """
    SELECT batch_id, 'BATCH_ID_CONFLICT' AS code FROM identities
    WHERE day_no % 5 <> 0 AND day_no % 7 = 1
    UNION ALL SELECT batch_id, 'BATCH_REFERENCE_CONFLICT' FROM identities
    WHERE day_no % 5 <> 0 AND day_no % 11 = 2
    """,
)
def batch_identity_conflict(spark, folder):
    found = D.batch_identity_conflict(identities(spark, folder), registry(spark, folder))
    return found.select("batch_id", "code")


@query(
    "new_batches",
    ["identities"],
    "SELECT batch_id, manifest_hash, reference_hash FROM identities WHERE day_no % 5 = 0",
)
def new_batches(spark, folder):
    found = D.new_batches(identities(spark, folder), registry(spark, folder))
    return found.select("batch_id", "manifest_hash", "reference_hash")


@query(
    "reference_identity_guard",
    ["identities"],
    """
    SELECT batch_id AS state_id, reference_hash AS digest,
           CASE WHEN day_no % 5 = 0 THEN 'ACCEPTED' WHEN day_no % 11 = 2 THEN 'REFUSED'
                ELSE 'UNCHANGED' END AS verdict
    FROM identities
    """,
)
def reference_identity_guard(spark, folder):
    proposed = identities(spark, folder).select(
        F.col("batch_id").alias("state_id"), F.col("reference_hash").alias("digest")
    )
    stored = registry(spark, folder).select(
        F.col("batch_id").alias("state_id"),
        F.coalesce("reference_hash", F.lit("other")).alias("digest"),
    )
    return D.reference_identity_guard(proposed, stored)


@query(
    "input_budget",
    ["inventory"],
    """
    SELECT batch_id, CASE WHEN path LIKE '%.json' AND bytes > 50 THEN 'INPUT_JSON_BYTES_LIMIT'
                          ELSE 'INPUT_FILE_BYTES_LIMIT' END AS code, path AS file, bytes AS count
    FROM inventory WHERE bytes > 600 OR (path LIKE '%.json' AND bytes > 50)
    UNION ALL SELECT batch_id, 'INPUT_FILE_COUNT_LIMIT', NULL, count(*) FROM inventory
    GROUP BY batch_id HAVING count(*) > 10
    UNION ALL SELECT batch_id, 'INPUT_TOTAL_BYTES_LIMIT', NULL, CAST(sum(bytes) AS BIGINT)
    FROM inventory GROUP BY batch_id HAVING sum(bytes) > 3000
    """,
)
def input_budget(spark, folder):
    found = D.input_budget(
        inventory(spark, folder),
        max_files=10,
        max_file_bytes=600,
        max_json_bytes=50,
        max_total_bytes=3000,
    )
    return found.select("batch_id", "code", "file", "count")


def publications(spark, folder):
    """One publication per month of deliveries, which accepted the known batches."""
    return (
        identities(spark, folder)
        .filter("day_no % 3 = 0")
        .withColumn("sequence", F.expr("day_no div 30"))
        .groupBy("sequence")
        .agg(F.array_sort(F.collect_set("batch_id")).alias("accepted_batches"))
        .withColumn("publication_id", F.concat(F.lit("P"), F.col("sequence").cast("string")))
    )


@query(
    "batch_already_accepted",
    ["identities"],
    "SELECT batch_id, 'P' || CAST(day_no // 30 AS VARCHAR) AS publication_id, 'NO_CHANGE' AS state "
    "FROM identities WHERE day_no % 3 = 0",
)
def batch_already_accepted(spark, folder):
    batches = identities(spark, folder).select("batch_id")
    return D.accepted_before(batches, publications(spark, folder))


@query(
    "attempt_state",
    ["identities", "files", "inventory"],
    """
    , missing AS (SELECT batch_id, count(*) AS n FROM files ANTI JOIN inventory
                  USING (batch_id, path) GROUP BY batch_id)
    SELECT batch_id, day_no % 4 = 0 AS validate_only, coalesce(n, 0) AS error_issues,
           CASE WHEN n > 0 THEN 'BLOCKED' WHEN day_no % 4 = 0 THEN 'VALIDATED'
                WHEN day_no % 3 = 0 THEN 'NO_CHANGE' ELSE 'PUBLISHED' END AS state,
           CASE WHEN n IS NULL AND day_no % 4 <> 0 AND day_no % 3 = 0
                THEN 'P' || CAST(day_no // 30 AS VARCHAR) END AS publication_id
    FROM identities LEFT JOIN missing USING (batch_id)
    """,
)
def attempt_state(spark, folder):
    attempts = identities(spark, folder).select(
        "batch_id", (F.col("day_no") % 4 == 0).alias("validate_only")
    )
    issues = D.missing_files(files(spark, folder), inventory(spark, folder))
    return D.attempt_state(attempts, issues, batch_already_accepted(spark, folder))
