"""Sources and sinks: what the tables yield is written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from tillclose.operators import delivery as D
from tillclose.operators import documents as DOC
from tillclose.operators import gold as G
from tillclose.operators import profile as P
from tillclose.operators import revisions as R
from tillclose.operators import row_contract as RC
from tillclose.schemas import BUSINESS_FIELDS, REVISION_KEY
from tillclose.session import scratch_path
from tillclose.sinks import delivery as OUT
from tillclose.sinks import tables as W
from tillclose.sources import delivery as IN
from tillclose.sources import tables as TB
from workload import q_delivery, q_documents, q_lineage, q_report, q_rows
from workload.base import part, query
from workload.feed import GOLD_COLUMNS, batches, feed, half_up, money, previous_state, published, state, stored, table
from workload.q_revisions import ITEM_COLUMNS, REVISION, STATE_COLUMNS, STATE_SELECT

FIELDS = ", ".join(BUSINESS_FIELDS)


def delivered(spark, folder) -> str:
    path = scratch_path(spark, "delivery")
    # The numbers are stored, so the shuffle that found their stores ends before the texts move to their files.
    rows = q_rows.as_texts(stored(q_rows.numbers(spark, folder), "numbers")).withColumn(
        "file_store", F.regexp_replace("source_file", "[.]csv$", "")
    )
    OUT.write_delivery(rows, path, "file_store")
    return path


@query(
    "read_delivery_csv",
    ["raw"],
    f"SELECT {FIELDS}, batch_id AS delivery, declared_store AS store, TRUE AS width_ok, "
    "TRUE AS header_ok FROM raw",
)
def read_delivery_csv(spark, folder):
    rows = IN.read_delivery_csv(spark, delivered(spark, folder))
    return rows.select(
        *BUSINESS_FIELDS,
        F.regexp_extract("source_file", r"delivery=([^/]*)", 1).alias("delivery"),
        F.regexp_extract("source_file", r"store=([^/]*)", 1).alias("store"),
        "width_ok",
        "header_ok",
    )


@query(
    "write_delivery",
    ["raw"],
    "SELECT batch_id AS delivery_id, declared_store AS store_id, count(*) AS row_count, "
    "TRUE AS listed FROM raw GROUP BY ALL",
)
def write_delivery(spark, folder):
    path = delivered(spark, folder)
    files = OUT.delivered_files(spark, path)
    manifests = OUT.manifest_documents(files, "pos", "W1")
    listed = DOC.manifest_files(manifests).select(
        "delivery_id", "path", F.col("sha256").alias("_sha"), F.col("row_count").alias("_rows")
    )
    same = (F.col("_sha") == F.col("sha256")) & (F.col("_rows") == F.col("row_count"))
    return (
        files.join(listed, ["delivery_id", "path"], "left")
        .groupBy("delivery_id", "store_id")
        .agg(
            F.sum("row_count").alias("row_count"),
            F.min(F.coalesce(same, F.lit(False))).alias("listed"),
        )
    )


BRONZE_KEY = "batch_id, source_file, source_line, sale_id, line_id, product_id"
BRONZE_COLUMNS = [*BRONZE_KEY.split(", "), "codes"]


def _coded(bronze):
    return bronze.withColumn("codes", F.concat_ws("|", "errors")).select(*BRONZE_COLUMNS)


@query("read_bronze_ndjson", ["coded"], f"SELECT {BRONZE_KEY}, codes FROM coded")
def read_bronze_ndjson(spark, folder):
    path = scratch_path(spark, "ndjson")
    # Each row repeats its header and every name; as text it is twenty times the table it comes from.
    q_rows.bronze(spark, folder).write.option("compression", "gzip").json(path)
    return _coded(IN.read_bronze_ndjson(spark, path))


@query("write_bronze", ["coded"], f"SELECT {BRONZE_KEY}, codes FROM coded")
def write_bronze(spark, folder):
    run = scratch_path(spark, "run")
    return _coded(spark.read.parquet(W.write_bronze(q_rows.bronze(spark, folder), run)))


@query("write_quarantine", ["coded"], f"SELECT {BRONZE_KEY}, codes FROM coded WHERE codes <> ''")
def write_quarantine(spark, folder):
    run = scratch_path(spark, "run")
    return _coded(spark.read.parquet(W.write_quarantine(q_rows.bronze(spark, folder), run)))


@query(
    "write_rejects",
    ["claimed", "conflicts"],
    f"SELECT {REVISION}, source_line, 'REVISION_CONFLICT' AS code, 'REVISION_CONFLICT' AS errors "
    f"FROM claimed SEMI JOIN conflicts USING ({REVISION}) WHERE batch_id = 'B2'",
)
def write_rejects(spark, folder):
    rows = R.revision_conflict_rows(*batches(spark, folder, "claimed"))
    run = scratch_path(spark, "run")
    W.write_rejects(rows, "REVISION_CONFLICT", run)
    return spark.read.parquet(f"{run}/rejects").select(
        *ITEM_COLUMNS, "revision", "source_line", "code", F.array_join("errors", ",").alias("errors")
    )


@query(
    "read_delivery_documents",
    ["order_days"],
    """
    SELECT CAST(reference_id AS VARCHAR) AS reference_id, window_id,
           CASE WHEN d % 17 = 3 THEN 0 WHEN d % 13 = 4 OR d % 29 = 5 THEN len(stores) + 1
                ELSE len(stores) END AS stores
    FROM order_days
    """,
)
def read_delivery_documents(spark, folder):
    path = scratch_path(spark, "documents")
    q_documents.schedules(spark, folder).write.partitionBy("reference_id").text(path)
    texts = IN.read_documents(spark, path, "*.txt").select(
        F.regexp_extract("path", r"reference_id=([^/]*)", 1).alias("reference_id"), "document"
    )
    return DOC.schedule_windows(texts).select(
        "reference_id", "window_id", F.size("stores").cast("bigint").alias("stores")
    )


@query(
    "file_inventory",
    [],
    """
    SELECT CAST(m AS VARCHAR) AS name, length(v) + 1 AS bytes, sha256(v || chr(10)) AS sha256
    FROM (SELECT m, m || ':' || count(*) || ':' || sum(o_custkey) AS v
          FROM (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS m, o_custkey FROM orders)
          GROUP BY m)
    """,
)
def file_inventory(spark, folder):
    path = scratch_path(spark, "inventory")
    day = F.col("o_orderdate").cast("date")
    month = (F.year(day) * 100 + F.month(day)).alias("name")
    monthly = (
        table(spark, folder, "orders")
        .groupBy(month)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))
        .select("name", F.concat_ws(":", "name", "n", "s").alias("value"))
    )
    monthly.write.partitionBy("name").text(path)
    return IN.file_inventory(spark, path, "*.txt").select(
        F.regexp_extract("path", r"name=([^/]*)", 1).alias("name"), "bytes", "sha256"
    )


# ---- versioned tables -------------------------------------------------------------------
GOLD = (
    "SELECT business_date, store_id, {net} AS net_revenue_brl, units, item_lines, sales_count, "
    "{ticket} AS average_ticket_brl FROM {source}"
)
GOLD_FIELDS = {
    "net": money("net_cents"),
    "ticket": money(half_up("net_cents", "sales_count")),
}
part(
    "earlier_cents",
    ["previous"],
    """
    SELECT business_date, store_id, CAST(sum(net_cents) AS BIGINT) AS net_cents,
           CAST(sum(quantity) AS BIGINT) AS units, count(*) AS item_lines,
           count(DISTINCT (source_system, sale_id)) AS sales_count
    FROM previous WHERE operation = 'UPSERT' GROUP BY business_date, store_id
    """,
)


def two_versions(spark, folder, root):
    """Gold of the first batch as version 0, of both batches as version 1."""
    states = (build(spark, folder, GOLD_COLUMNS) for build in (previous_state, state))
    first, second = (
        W.write_gold(G.gold_store_day(s), G.gold_product_day(s), root, run)
        for run, s in zip(("run-B1", "run-B2"), (stored(s, "state") for s in states), strict=True)
    )
    return first, second


@query("read_table_version", ["earlier_cents"], GOLD.format(source="earlier_cents", **GOLD_FIELDS))
def read_table_version(spark, folder):
    first, _ = two_versions(spark, folder, scratch_path(spark, "root"))
    return TB.read_table_version(spark, {"tables": first}, "gold_store_day")


def _manifest(spark, root, number, tables, sources=()):
    from tillclose.schemas import PUBLICATION
    from tillclose.session import local_rows

    record = {
        "publication_id": f"P{number}",
        "run_id": f"run-B{number}",
        "published_at": f"2026-01-0{number}T00:00:00+00:00",
        "sequence": number,
        "previous_publication_id": f"P{number - 1}" if number > 1 else None,
        "accepted_batches": [f"B{i}" for i in range(1, number + 1)],
        "tables": {name: row.asDict() for name, row in tables.items()},
        "sources": list(sources),
    }
    return local_rows(spark, PUBLICATION, [record])


@query(
    "read_published_snapshot",
    ["store_cents", "product_cents"],
    f"""
    SELECT 'P2' AS publication_id, 'gold_store_day' AS name, count(*) AS rows,
           {money("sum(net_cents)")} AS net_revenue_brl FROM store_cents
    UNION ALL SELECT 'P2', 'gold_product_day', count(*), {money("sum(net_cents)")} FROM product_cents
    """,
)
def read_published_snapshot(spark, folder):
    root = scratch_path(spark, "root")
    for number, tables in enumerate(two_versions(spark, folder, root), 1):
        W.write_publication(_manifest(spark, root, number, tables), root)
    publication, frames = TB.read_published_snapshot(
        spark, root, ["gold_store_day", "gold_product_day"]
    )
    rows = None
    for name, frame in frames.items():
        totals = frame.agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("net_revenue_brl").cast("decimal(28,2)").alias("net_revenue_brl"),
        ).select(
            F.lit(publication["publication_id"]).alias("publication_id"),
            F.lit(name).alias("name"),
            "*",
        )
        rows = totals if rows is None else rows.unionByName(totals)
    return rows


@query("write_gold", ["store_cents"], GOLD.format(source="store_cents", **GOLD_FIELDS))
def write_gold(spark, folder):
    now = stored(state(spark, folder, GOLD_COLUMNS), "state")
    root = scratch_path(spark, "root")
    tables = W.write_gold(G.gold_store_day(now), G.gold_product_day(now), root, "run-B2")
    return TB.read_table_version(spark, {"tables": tables}, "gold_store_day")


@query(
    "write_history",
    ["feed"],
    f"""
    SELECT {REVISION}, batch_id, source_line, payload_hash, run_id FROM (
        SELECT *, row_number() OVER (PARTITION BY {REVISION}
                                     ORDER BY batch_id, source_file, source_line) AS rn FROM feed)
    WHERE rn = 1
    """,
)
def write_history(spark, folder):
    root = scratch_path(spark, "root")
    previous, incoming = batches(spark, folder)
    first = W.write_history(R.new_history_rows(None, previous), root, "run-B1")
    sources = [{"run_id": "run-B1"}]
    known = TB.read_table_version(
        spark, {"tables": {"history": first}, "sources": sources}, "history"
    )
    second = W.write_history(R.new_history_rows(known, incoming), root, "run-B2")
    publication = {"tables": {"history": second}, "sources": [*sources, {"run_id": "run-B2"}]}
    return TB.read_table_version(spark, publication, "history").select(
        *ITEM_COLUMNS, "revision", "batch_id", "source_line", "payload_hash", "run_id"
    )


@query(
    "write_publication",
    ["store_cents"],
    f"""
    SELECT 'P2' AS publication_id, 'P1' AS previous_publication_id, 'B1,B2' AS accepted_batches,
           count(*) AS rows FROM store_cents
    """,
)
def write_publication(spark, folder):
    root = scratch_path(spark, "root")
    for number, tables in enumerate(two_versions(spark, folder, root), 1):
        W.write_publication(_manifest(spark, root, number, tables), root)
    official = TB.load_publication(spark, root)
    rows = TB.read_table_version(spark, official, "gold_store_day")
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(official["publication_id"]).alias("publication_id"),
        F.lit(official["previous_publication_id"]).alias("previous_publication_id"),
        F.lit(",".join(official["accepted_batches"])).alias("accepted_batches"),
        "rows",
    )


@query(
    "write_profile",
    ["active"],
    """
    SELECT 'P1' AS publication_id, count(*) AS active_lines,
           count(DISTINCT (source_system, store_id, sale_id)) AS sales FROM active
    """,
)
def write_profile(spark, folder):
    root = scratch_path(spark, "root")
    totals = P.profile_totals(RC.active_lines(state(spark, folder)))
    profile = totals.select(
        F.lit("P1").alias("publication_id"),
        F.lit("run-B2").alias("run_id"),
        F.lit("totals").alias("section"),
        F.to_json(F.struct("*")).alias("document"),
    )
    stored = W.write_evidence(profile, f"{root}/run", "profile")
    W.write_profile(stored, root)
    W.write_profile(stored, root)  # the same content again changes nothing
    parsed = F.from_json("document", "active_lines bigint, sales bigint")
    return W.read_profiles(spark, root).select("publication_id", parsed.alias("t")).select(
        "publication_id", "t.*"
    )


@query(
    "write_batch_registry",
    ["identities"],
    "SELECT batch_id, manifest_hash, reference_hash FROM identities",
)
def write_batch_registry(spark, folder):
    root = scratch_path(spark, "root")
    identities = q_delivery.identities(spark, folder).select(
        "batch_id", "manifest_hash", "reference_hash"
    )
    W.write_batch_registry(identities, root)
    changed = identities.withColumn("manifest_hash", F.lit("0" * 64))
    W.write_batch_registry(changed, root)  # the first seen stays
    return W.read_batch_registry(spark, root)


@query(
    "write_quality_summary",
    ["coverage"],
    """
    SELECT count(*) FILTER (expected) AS expected, count(*) FILTER (received) AS received,
           count(*) FILTER (expected AND NOT received) AS missing FROM coverage
    """,
)
def write_quality_summary(spark, folder):
    run = scratch_path(spark, "run")
    bronze = stored(q_rows.bronze(spark, folder).select("batch_id", "source_file", "source_line", "errors"), "bronze")
    coverage = q_delivery.delivery_coverage(spark, folder)
    W.write_quality_summary(D.issue_rollup(bronze), D.delivery_stats(bronze), coverage, run)
    schema = "batch_id string, store_id string, expected boolean, received boolean, missing boolean"
    return (
        spark.read.schema(schema)
        .json(f"{run}/quality/coverage")
        .agg(*(F.count_if(F.col(n)).alias(n) for n in ("expected", "received", "missing")))
    )


@query("write_lineage_events", ["event_keys"], "SELECT run_id, kind FROM event_keys")
def write_lineage_events(spark, folder):
    root = scratch_path(spark, "root")
    events = q_lineage.lineage_frame(spark, folder)  # the sink stores what it gets
    W.write_lineage_events(events.filter("kind = 'start'"), root)
    W.write_lineage_events(events, root)  # adds the terminal events only
    return W.read_exported_events(spark, root).select("run_id", "kind")


@query(
    "read_attempts",
    ["attempts"],
    "SELECT run_id, state, started_utc, event_id % 900 AS received FROM attempts",
)
def read_attempts(spark, folder):
    path = scratch_path(spark, "attempts")
    q_report.attempts(spark, folder).drop("event_id").write.json(path)
    rows = IN.read_attempts(spark, path)
    return rows.select(
        "run_id",
        "state",
        F.date_format("started_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("started_utc"),
        F.try_element_at("stats", F.lit("received")).alias("received"),
    )


# ---- increments -------------------------------------------------------------------------
@query("advance_state", ["state"], STATE_SELECT + "state")
def advance_state(spark, folder):
    before, added = published(spark, folder, [x for x in STATE_COLUMNS if x not in REVISION_KEY])
    return R.advance_state(before, added).select(*STATE_COLUMNS)


@query("advance_gold", ["store_cents"], GOLD.format(source="store_cents", **GOLD_FIELDS))
def advance_gold(spark, folder):
    before, added = published(spark, folder, GOLD_COLUMNS)
    now = stored(R.advance_state(before, added), "state")
    dates = R.touched_dates(before, now, added)
    return G.advance_gold(G.gold_store_day(before), now, dates, G.gold_store_day)
