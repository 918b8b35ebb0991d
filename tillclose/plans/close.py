"""Closing a delivery end to end: check, resolve, aggregate, reconcile, profile, publish.

One-row totals, the issues and coverage lists of the delivery and the official manifest reach
the driver; rows never do. Each stage reads what the stage before has written, so a lost
executor replays one stage. The history grows by what a batch adds; the state is kept by
buckets of which a batch rewrites those it touches, and gold moves by signed changes.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tillclose.operators import audit, comparison, delivery as D, documents as DOC
from tillclose.operators import gold as G
from tillclose.operators import lineage as L
from tillclose.operators import profile as P
from tillclose.operators import report as R
from tillclose.operators import revisions as V
from tillclose.operators import row_contract as RC
from tillclose.operators import serving as S
from tillclose.schemas import ATTEMPT, LIMIT_JSON_BYTES, PUBLICATION
from tillclose.session import local_rows, prepare
from tillclose.sinks import buckets as BK
from tillclose.sinks import tables as W
from tillclose.sources import delivery as IN
from tillclose.sources import tables as TB
from tillclose.sources.buckets import read_buckets, touched

REFERENCES = "reference_id string, catalog string, schedule string, digest string"
EMPTY_STATS = ["received", "valid", "rejected", "violations", "duplicates", "conflicts", "stale",
               "revision_checks_executed"]


@dataclass
class Attempt:
    """Record of one run."""

    run_id: str
    started_at: str
    batch_id: str = "unknown"
    state: str = "RUNNING"
    finished_at: str | None = None
    stages: dict[str, float] = field(default_factory=dict)
    stats: dict[str, int] = field(default_factory=lambda: dict.fromkeys(EMPTY_STATS, 0))
    coverage: dict[str, list[str]] = field(default_factory=dict)
    issues: list[dict] = field(default_factory=list)
    publication_id: str | None = None
    job_mode: str = "publish"

    def add(self, code: str, severity: str = "ERROR", **context) -> None:
        self.issues.append({"code": code, "severity": severity, **context})

    def codes(self) -> list[str]:
        return sorted({issue["code"] for issue in self.issues})


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


class _Stage:
    def __init__(self, attempt: Attempt, name: str):
        self.attempt, self.name = attempt, name

    def __enter__(self):
        self.begun = time.monotonic()

    def __exit__(self, *failure):
        self.attempt.stages[self.name] = round(time.monotonic() - self.begun, 6)


# ---- references -------------------------------------------------------------------------
def _references(spark: SparkSession, root: str) -> DataFrame:
    return TB._read_json(spark, f"{root}/references", REFERENCES)


def configure_references(spark: SparkSession, root: str, catalog: str, schedule: str) -> str:
    """Approve a catalogue and a schedule (JSON texts) for a state; they never change after."""
    prepare(spark)
    documents = local_rows(
        spark,
        "reference_id string, c string, s string",
        [{"reference_id": "r", "c": catalog, "s": schedule}],
    )
    catalogs = documents.select("reference_id", F.col("c").alias("document"))
    schedules = documents.select("reference_id", F.col("s").alias("document"))
    found = DOC.check_catalog(catalogs).unionByName(
        DOC.check_schedule(schedules, DOC.active_stores(catalogs))
    )
    codes = [row["code"] for row in found.select("code").distinct().collect()]
    if codes:
        raise ValueError(f"invalid references: {sorted(codes)}")
    canonical = F.concat_ws(
        "\n", *(F.to_json(F.parse_json(F.col(name))) for name in ("c", "s"))
    )
    proposed = documents.select(
        F.lit("r").alias("state_id"), "c", "s", F.sha2(canonical, 256).alias("digest")
    )
    stored = _references(spark, root).select(F.lit("r").alias("state_id"), "digest")
    verdict = D.reference_identity_guard(proposed, stored).first()
    if verdict["verdict"] == "REFUSED":
        raise ValueError("references are already fixed for this state")
    if verdict["verdict"] == "ACCEPTED":
        record = {"reference_id": "r", "catalog": verdict["c"], "schedule": verdict["s"]}
        local_rows(spark, REFERENCES, [{**record, "digest": verdict["digest"]}]).coalesce(1).write.mode("append").json(
            f"{root}/references"
        )
    return verdict["digest"]


# ---- ingestion --------------------------------------------------------------------------
def _collect_issues(attempt: Attempt, issues: DataFrame) -> None:
    """All issues onto the attempt record. Row errors are rolled up per code before, so there are at
    most a few per file or store of the manifest, whose size the budget bounds."""
    wanted = ["code", "severity", "store_id", "file", "line", "count"]
    for row in issues.select(*wanted).orderBy("code", "store_id", "file").collect():
        attempt.add(**{k: v for k, v in row.asDict().items() if v is not None})


def _document_issues(found: DataFrame, key: str, batch_id: str) -> DataFrame:
    renamed = found.withColumn("batch_id", F.lit(batch_id))
    return D.issue(renamed, F.col("code"), file=F.col("value"), count=F.col("count"))


def _ingest(
    spark: SparkSession,
    root: str,
    folder: str,
    run_path: str,
    attempt: Attempt,
    reference: Row,
    budget: dict[str, int],
) -> dict | None:
    """Check the delivery and write bronze; None when it is over budget."""
    sizes = IN.file_sizes(spark, folder).withColumn("batch_id", F.lit("delivery"))
    over = D.input_budget(sizes, **budget)
    if not over.isEmpty():
        attempt.batch_id = f"incomplete-{attempt.run_id}"
        _collect_issues(attempt, over)
        return None
    inventory = W.write_evidence(IN.file_inventory(spark, folder), run_path, "inventory")
    texts = {
        row["path"]: row["document"]
        for row in IN.read_documents(spark, folder, "*.json")
        .filter(F.col("path").isin(D.DOCUMENTS))
        .collect()
    }

    def document(key: str, text: str | None) -> DataFrame:
        return local_rows(spark, f"{key} string, document string", [{key: "d", "document": text}])

    documents = document("delivery_id", texts.get("manifest.json"))
    header = (
        DOC.manifest_headers(documents)
        .join(DOC.manifest_identity(documents), "delivery_id")
        .withColumn("valid_id", DOC.C.valid_identifier(F.col("batch_id")))
        .first()
    )
    attempt.batch_id = (
        header["batch_id"] if header["valid_id"] else f"invalid-{header['manifest_hash'][:12]}"
    )
    named = F.lit(attempt.batch_id).alias("batch_id")
    inventory = inventory.withColumn("batch_id", named)
    files = W.write_evidence(
        DOC.manifest_files(documents).select(named, "path", "sha256", "row_count", "store_id"),
        run_path,
        "files",
    )
    approved = document("reference_id", reference["catalog"])
    calendar = document("reference_id", reference["schedule"])
    stores, products = DOC.active_stores(approved), DOC.catalog_products(approved)
    request = local_rows(
        spark,
        "batch_id string, reference_id string, window_id string, source_system string",
        [
            {
                "batch_id": attempt.batch_id,
                "reference_id": "d",
                "window_id": header["window_id"],
                "source_system": header["source_system"],
            }
        ],
    )
    # Stores of the delivery: expected by the window, confirming zero, active.
    on, off = F.lit(True), F.lit(False)
    sides = (
        DOC.expected_stores(request, calendar)
        .select("store_id", on.alias("e"), off.alias("z"), off.alias("a"))
        .unionByName(DOC.manifest_zeros(documents).select("store_id", off.alias("e"), on.alias("z"), off.alias("a")))
        .unionByName(stores.select("store_id", off.alias("e"), off.alias("z"), on.alias("a")))
        .groupBy("store_id")
        .agg(*(F.max(n).alias(n) for n in "eza"))
    )
    sides = W.write_evidence(sides.select(named, "*"), run_path, "stores")
    expected, zeros, active = (
        sides.filter(F.col(n)).select("batch_id", "store_id") for n in "eza"
    )
    # The delivered copies of the references are checked too; they grant nothing.
    hashes = dict.fromkeys(("catalog.json", "schedule.json"))
    for row in inventory.filter(F.col("path").isin(*hashes)).select("path", "sha256").collect():
        hashes[row["path"]] = row["sha256"]
    copies = [
        DOC.check_catalog(document("reference_id", texts.get("catalog.json"))),
        DOC.check_schedule(document("reference_id", texts.get("schedule.json")), stores),
    ]

    arrived = D.delivered(files, inventory)
    # Files outside the manifest are reported, not read.
    raw = (
        IN.read_delivery_csv(spark, folder, inventory)
        .join(arrived.select(F.col("path").alias("source_file")), "source_file", "left_semi")
        .select("*", named, F.lit(attempt.run_id).alias("run_id"))
    )
    declared = files.select(
        "batch_id", "path", F.lit(header["source_system"] or "").alias("source_system"), "store_id"
    )
    bronze_path = W.write_bronze(
        RC.bronze_rows(RC.with_references(raw, declared, active, products)), run_path
    )
    bronze = spark.read.parquet(bronze_path)
    W.write_quarantine(bronze, run_path)

    counts = W.write_evidence(D.observed_counts(files, bronze), run_path, "counts")
    coverage = W.write_evidence(
        D.delivery_coverage(expected, files, inventory, zeros), run_path, "coverage"
    )
    described = DOC.manifest_headers(documents).select(named, "covered_stores")
    unreadable = inventory.filter("path LIKE '%.csv' AND NOT readable")
    mismatched = D.row_count_mismatch(files, inventory, counts)
    wrong_headers = (
        IN.file_headers(inventory.filter("bytes > 0"))
        .filter("NOT header_ok")
        .join(arrived.select("path"), "path", "left_semi")
        .select("path", named)
    )
    identity = local_rows(
        spark,
        W.IDENTITY,
        [
            {
                "batch_id": attempt.batch_id,
                "manifest_hash": header["manifest_hash"],
                "reference_hash": json.dumps(hashes, sort_keys=True),
            }
        ],
    )
    issues = D.union_issues(
        _document_issues(DOC.check_manifest(documents), "delivery_id", attempt.batch_id),
        *(_document_issues(found, "reference_id", attempt.batch_id) for found in copies),
        D.issue(DOC.window_issues(request, calendar), F.col("code")),
        D.missing_files(files, inventory),
        D.unexpected_files(files, inventory),
        D.hash_mismatch(files, inventory),
        D.issue(mismatched, "ROW_COUNT_MISMATCH", file=F.col("file"), count=F.col("received")),
        D.empty_files(files, inventory, counts, zeros),
        D.unexpected_store(files, expected, active),
        D.invalid_zero_confirmation(zeros, expected, files, counts),
        D.missing_stores(coverage),
        D.coverage_mismatch(described, files, zeros),
        D.issue(unreadable, "CSV_DECODE_ERROR", file=F.col("path")),
        D.issue(wrong_headers, "SCHEMA_MISMATCH", file=F.col("path")),
        D.issue_rollup(bronze),
        D.batch_identity_conflict(identity, W.read_batch_registry(spark, root)),
    )
    stats = D.delivery_stats(bronze)
    W.write_quality_summary(issues, stats, coverage, run_path)
    W.write_batch_registry(identity, root)

    stored = spark.read.schema(
        "batch_id string, code string, severity string, store_id string, file string, line int, count bigint"
    ).json(f"{run_path}/quality/issues")
    _collect_issues(attempt, stored)
    row = stats.first()
    if row is not None:
        attempt.stats.update({k: row[k] for k in ("received", "valid", "rejected", "violations")})
    lists = coverage.agg(
        *(
            F.array_sort(F.collect_set(F.when(F.col(n), F.col("store_id")))).alias(n)
            for n in ("expected", "received", "missing", "zero_movement")
        )
    ).first()
    attempt.coverage = lists.asDict()
    return {
        "bronze": bronze,
        "bronze_path": bronze_path,
        "manifest_hash": header["manifest_hash"],
        "hashes": hashes,
        "coverage": coverage,
    }


# ---- quality ----------------------------------------------------------------------------
def _check_revisions(
    attempt: Attempt,
    incoming: DataFrame,
    history: DataFrame | None,
    candidate_state: DataFrame,
    run_path: str,
) -> bool:
    """Conflicts, duplicates, stale rows and split sales in one job; True when clean."""

    def counted(name: str, frame: DataFrame) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    # One scan of the history; the counts come from what it leaves.
    facts = V.revision_facts(history, incoming)
    conflicts = V.classified(incoming, facts).filter("is_conflict").select(*incoming.columns)
    split_rows = V.split_sale_rows(incoming, candidate_state)
    counts = V.revision_counts(facts)
    checks = counts.select(F.explode(F.array(*(
        F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in ("conflicts", "duplicates", "stale")
    ))).alias("c")).select("c.*")
    checks = checks.unionByName(counted("split_sales", V.split_sales(candidate_state))).unionByName(
        counted("split_rows", split_rows)
    )
    found = {row["name"]: row["n"] for row in checks.collect()}
    attempt.stats.update(
        conflicts=found["conflicts"],
        duplicates=found["duplicates"],
        stale=found["stale"],
        revision_checks_executed=1,
    )

    def reject(code: str, rows: DataFrame, rejected: int, count: int) -> None:
        attempt.stats["rejected"] += rejected
        attempt.stats["valid"] -= rejected
        attempt.stats["violations"] += rejected
        attempt.add(code, count=count)
        W.write_rejects(rows, code, run_path)

    if found["conflicts"]:
        reject("REVISION_CONFLICT", conflicts, found["conflicts"], found["conflicts"])
        return False
    for code, name in (("EXACT_DUPLICATE", "duplicates"), ("STALE_REVISION", "stale")):
        if found[name]:
            attempt.add(code, "INFO", count=found[name])
    if found["split_sales"]:
        reject("SALE_DATE_CONFLICT", split_rows, found["split_rows"], found["split_sales"])
        return False
    return True


# ---- profile ----------------------------------------------------------------------------
def build_profile(
    spark: SparkSession,
    publication_id: str,
    run_id: str,
    state: DataFrame,
    previous: DataFrame | None,
    coverage: DataFrame,
    previous_coverage: DataFrame | None,
    bronze: DataFrame,
    stats: dict[str, int],
) -> DataFrame:
    """Profile of a state as sections: publication_id, run_id, section, document."""
    active = RC.active_lines(state)
    sections = {
        "totals": P.profile_totals(active),
        "distributions": P.profile_distributions(active),
        "stores": P.profile_groups(active, "store_id"),
        "products": P.profile_groups(active, "product_id"),
        "cancelled": RC.cancelled_keys(state),
        "date_range": P.date_summary(state),
        "state_changes": V.state_changes(state, previous),
        "received_operations": V.received_operations(bronze),
        "coverage": coverage.select(
            "store_id", "expected", "received", "missing", "zero_movement"
        ),
        "batch": local_rows(spark, ", ".join(f"{n} bigint" for n in stats), [stats]),
    }
    if previous is not None and previous_coverage is not None:
        stores = comparison.store_sides(
            coverage.filter("received"), previous_coverage.filter("received")
        )
        totals = comparison.equivalent_scope_totals(
            state, previous, stores.filter("status = 'COMMON'")
        )
        sections |= {
            "compared_dates": comparison.date_scope(state, previous),
            "compared_stores": stores,
            "equivalent_totals": totals,
            "rules": comparison.mean_shift_rules(totals),
        }
    rows = None
    for name, frame in sections.items():
        # Every section is bounded: totals, top groups, stores of the coverage, two rules.
        document = F.to_json(F.array_sort(F.collect_list(F.to_json(F.struct("*")))))
        section = frame.agg(document.alias("document")).select(
            F.lit(publication_id).alias("publication_id"),
            F.lit(run_id).alias("run_id"),
            F.lit(name).alias("section"),
            "document",
        )
        rows = section if rows is None else rows.unionByName(section)
    return rows


def profile_section(spark: SparkSession, root: str, publication_id: str, section: str) -> list[dict]:
    """One section of a stored profile as a list of records."""
    row = (
        W.read_profiles(spark, root)
        .filter((F.col("publication_id") == publication_id) & (F.col("section") == section))
        .select("document")
        .first()
    )
    return [] if row is None else [json.loads(item) for item in json.loads(row["document"])]


def _stored_coverage(spark: SparkSession, root: str, publication_id: str) -> DataFrame | None:
    records = profile_section(spark, root, publication_id, "coverage")
    if not records:
        return None
    schema = "store_id string, expected boolean, received boolean, missing boolean, zero_movement boolean"
    return local_rows(spark, schema, records)


def _accumulate(coverage: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Expected and received stores add up over publications; the rest is the batch's."""
    mine = coverage.select("store_id", "expected", "received", "missing", "zero_movement")
    if previous is None:
        return mine
    off = F.lit(False)
    before = previous.select(
        "store_id", "expected", "received", off.alias("missing"), off.alias("zero_movement")
    )
    return mine.unionByName(before).groupBy("store_id").agg(
        *(F.max(n).alias(n) for n in ("expected", "received", "missing", "zero_movement"))
    )


# ---- the run ----------------------------------------------------------------------------
def _save_attempt(spark: SparkSession, root: str, attempt: Attempt) -> None:
    begun, ended = (datetime.fromisoformat(t) for t in (attempt.started_at, attempt.finished_at))
    record = {**attempt.__dict__, "duration_seconds": (ended - begun).total_seconds()}
    schema = f"book_id string, {ATTEMPT}"
    local_rows(spark, schema, [{**record, "book_id": "state"}]).coalesce(1).write.mode(
        "append"
    ).json(f"{root}/attempts")


def close_batch(
    spark: SparkSession,
    root: str,
    folder: str,
    validate_only: bool = False,
    run_id: str | None = None,
    budget: dict[str, int] | None = None,
) -> Attempt:
    """Process one delivery folder against the state below ``root``.

    ``budget`` replaces limits of ``operators.delivery.input_budget``: ``max_files``,
    ``max_file_bytes``, ``max_json_bytes``, ``max_total_bytes``.
    """
    prepare(spark)
    attempt = Attempt(run_id or uuid.uuid4().hex, _now())
    attempt.job_mode = "validate" if validate_only else "publish"
    try:
        _run(spark, root, folder, attempt, validate_only, budget or {})
    except Exception as error:
        attempt.state = "TECHNICAL_FAILURE"
        attempt.add("TECHNICAL_FAILURE", file=type(error).__name__)
        raise
    finally:
        attempt.finished_at = _now()
        _save_attempt(spark, root, attempt)
    return attempt


def _run(spark, root: str, folder: str, attempt: Attempt, validate_only: bool, budget: dict[str, int]) -> None:
    run_path = f"{root}/runs/run_id={attempt.run_id}"
    official = TB.load_publication(spark, root)
    reference = _references(spark, root).first()
    if reference is None:
        attempt.state = "BLOCKED"
        attempt.add("OPERATOR_REFERENCES_MISSING")
        return
    with _Stage(attempt, "ingestion"):
        prepared = _ingest(spark, root, folder, run_path, attempt, reference, budget)
    if any(issue["severity"] == "ERROR" for issue in attempt.issues) or prepared is None:
        attempt.state = "BLOCKED"
        return
    with _Stage(attempt, "quality"):
        incoming = RC.type_events(prepared["bronze"])
        previous = {
            name: TB.read_table_version(spark, official, name) if official else None
            for name in ("history", "silver", "gold_store_day", "gold_product_day")
        }
        layout = TB.state_layout(spark, official) if official else None
        added = V.new_history_rows(previous["history"], incoming)
        # All lines of a sale share a bucket, so the delivered sales are whole in those they touch.
        near = None if layout is None else read_buckets(spark, layout, touched(layout, incoming))
        candidate = V.advance_state(near, added)
        if not _check_revisions(attempt, incoming, previous["history"], candidate, run_path):
            attempt.state = "BLOCKED"
            return
    if validate_only:
        attempt.state = "VALIDATED"
        return
    if official and attempt.batch_id in official["accepted_batches"]:
        attempt.state, attempt.publication_id = "NO_CHANGE", official["publication_id"]
        return
    tables = {}
    with _Stage(attempt, "silver"):
        tables["history"] = W.write_history(added, root, attempt.run_id)
        added = spark.read.parquet(f"{tables['history'].path}/run_id={attempt.run_id}").withColumn(
            "run_id", F.lit(attempt.run_id)
        )
        numbers = None if layout is None else touched(layout, added)
        before = None if layout is None else read_buckets(spark, layout, numbers)
        after = BK.advance_buckets(
            spark, root, "silver", attempt.run_id, layout, added,
            lambda rows: V.advance_state(rows, added), numbers=numbers,
        )
        tables["silver"] = Row(path=after.path, version=after.version)
        state = read_buckets(spark, after)
    with _Stage(attempt, "gold"):
        # Gold moves by what the delivery takes away and brings; both are written once and read from there.
        changes = W.write_evidence(V.signed_changes(before, added), run_path, "changes")
        lines = None if before is None else G.sale_lines(before)
        sales = W.write_evidence(G.sale_deltas(lines, changes), run_path, "sales")
        tables |= W.write_gold(
            G.advance_store_day(previous["gold_store_day"], changes, sales),
            G.advance_product_day(previous["gold_product_day"], changes),
            root,
            attempt.run_id,
        )
    with _Stage(attempt, "reconciliation"):
        gold = {
            name: spark.read.parquet(f"{tables[name].path}/version={tables[name].version}")
            for name in ("gold_store_day", "gold_product_day")
        }
        totals = G.reconcile(state, gold["gold_store_day"], gold["gold_product_day"])
        if not totals.filter("NOT agrees").isEmpty():
            raise ValueError("gold tables do not reconcile with the state")
    with _Stage(attempt, "publication"):
        _publish(spark, root, attempt, prepared, official, reference, tables, state, previous["silver"])


def _publish(
    spark, root, attempt, prepared, official, reference, tables, state, previous_state
) -> None:
    publication_id = uuid.uuid4().hex
    before = _stored_coverage(spark, root, official["publication_id"]) if official else None
    coverage = _accumulate(prepared["coverage"], before)
    profile = build_profile(
        spark, publication_id, attempt.run_id, state, previous_state, coverage, before,
        prepared["bronze"], attempt.stats,
    )
    run_path = f"{root}/runs/run_id={attempt.run_id}"
    digest = W.write_profile(W.write_evidence(profile, run_path, "profile"), root)
    hashes = {**prepared["hashes"], "operator_reference_hash": reference["digest"]}
    source = {
        "batch_id": attempt.batch_id,
        "run_id": attempt.run_id,
        "bronze_path": prepared["bronze_path"],
        "bronze_version": 0,
        "reference_hashes": hashes,
        "operator_reference_hash": reference["digest"],
        "manifest_hash": prepared["manifest_hash"],
    }
    earlier = official.asDict(recursive=True) if official else {}
    manifest = {
        "publication_id": publication_id,
        "run_id": attempt.run_id,
        "published_at": _now(),
        "sequence": earlier.get("sequence", -1) + 1,
        "previous_publication_id": earlier.get("publication_id"),
        "accepted_batches": [*earlier.get("accepted_batches", []), attempt.batch_id],
        "tables": {name: row.asDict() for name, row in tables.items()}
        | {"bronze": {"path": prepared["bronze_path"], "version": 0}},
        "sources": [*earlier.get("sources", []), source],
        "profile": {"path": f"{root}/profiles", "sha256": digest, "contract_version": 1},
    }
    W.write_publication(local_rows(spark, PUBLICATION, [manifest]), root)
    attempt.publication_id, attempt.state = publication_id, "PUBLISHED"


# ---- reading what is published ----------------------------------------------------------
def _attempts(spark: SparkSession, root: str) -> DataFrame:
    return TB._read_json(spark, f"{root}/attempts", f"book_id string, {ATTEMPT}")


def _pointer(spark: SparkSession, root: str) -> DataFrame:
    return audit.current_publication(TB.read_publications(spark, root)).withColumn(
        "book_id", F.lit("state")
    )


def report(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All figures of the report, from one publication, and the state of the last attempts."""
    prepare(spark)
    publication, frames = TB.read_published_snapshot(
        spark, root, ["gold_store_day", "gold_product_day"]
    )
    attempts, pointer = _attempts(spark, root), _pointer(spark, root)
    books = local_rows(spark, "book_id string", [{"book_id": "state"}])
    found = {
        "latest_attempt": R.latest_attempt(attempts, pointer),
        "last_failed_attempt": R.last_failed_attempt(attempts, pointer),
        "decision": S.close_decision(attempts, pointer, books),
        "issues": R.issues_by_severity(attempts),
        "stages": R.stage_durations(attempts),
        "counters": R.rejection_rate(attempts),
    }
    if publication is None:
        return found
    store_day, product_day = frames["gold_store_day"], frames["gold_product_day"]
    daily = G.daily_revenue(store_day)
    return found | {
        "summary": G.publication_summary(store_day),
        "daily": R.limited_rows(daily, [F.col("business_date")], R.DAILY_LIMIT),
        "stores": R.store_day_listing(store_day),
        "products": R.top_products(product_day),
        "ranking": R.store_revenue_share(store_day),
        "mix": R.product_mix(product_day),
        "trend": R.daily_trend_points(daily),
        "matrix": R.store_day_matrix(store_day),
    }


def explain(
    spark: SparkSession,
    root: str,
    store_id: str | None = None,
    business_date: str | None = None,
    limit: int = 20,
) -> dict[str, DataFrame]:
    """Contributions, totals and revisions behind a published figure."""
    prepare(spark)
    publication, frames = TB.read_published_snapshot(spark, root, ["silver", "history"])
    if publication is None:
        raise ValueError("nothing is published")
    state, history = frames["silver"], frames["history"]
    return {
        "contributions": S.explain_contributions(state, store_id, business_date, limit),
        "totals": S.explain_totals(state, store_id, business_date),
        "revisions": S.explain_revisions(state, history, store_id, business_date, limit),
    }


def export_lineage(spark: SparkSession, root: str) -> DataFrame:
    """Reconcile the attempts with the committed publications and append missing events."""
    prepare(spark)
    publications = TB.read_publications(spark, root).withColumns(
        {"book_id": F.lit("state"), "is_legacy": F.lit(False)}
    )
    attempts = _attempts(spark, root)
    recorded = attempts.withColumn("error_codes", L.error_codes(F.col("issues")))
    committed = L.committed_publications(publications, _pointer(spark, root), recorded)
    final = L.reconcile_attempts(
        recorded.select("book_id", "run_id", "state", "publication_id", "error_codes"), committed
    )
    issue = F.transform(
        "error_codes",
        lambda code: F.struct(code.alias("code"), F.lit("ERROR").alias("severity")),
    )
    timed = attempts.select("run_id", "started_at", "finished_at", "job_mode")
    complete = final.withColumn("issues", issue).join(timed, "run_id", "left")
    events = L.lineage_events(complete, committed)
    W.write_lineage_events(events, root)
    return events
