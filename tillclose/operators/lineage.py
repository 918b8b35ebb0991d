"""Lineage of attempts and publications: events, ancestry, reconciliation, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.functions.contract import SHA256, instant, matches
from tillclose.functions.digest import packed
from tillclose.schemas import TABLE_TYPES, TERMINAL_TYPES
from tillclose.session import cut

# Fixed patterns and names of the events.
UUID = r"\A[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\z"
IDENTIFIER = r"\A[A-Za-z0-9_.:-]{1,128}\z"
JOB_PREFIX = "retail."
DATASETS = "urn:tillclose:tables"
REFERENCES = "urn:tillclose:references"


def canonical_run_id(run_id: Column) -> Column:
    """A UUID in its usual form; any other id gets a stable digest-based one."""
    digits = F.lower(F.regexp_replace(run_id, "-", ""))
    dashed = F.regexp_replace(digits, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
    return F.when(matches(run_id, UUID), dashed).otherwise(
        F.concat(F.lit("legacy:"), F.sha2(run_id, 256))
    )


def safe_identifier(value: Column) -> Column:
    return F.when(matches(value, IDENTIFIER), value).otherwise(
        F.concat(F.lit("sha256:"), F.sha2(value, 256))
    )


# ---- ancestry ---------------------------------------------------------------------------
def publication_ancestry(publications: DataFrame, pointers: DataFrame) -> DataFrame:
    """Publications reachable from each book's pointer, and whether the chain is sound.

    ``publications``: book_id, publication_id, previous_publication_id.
    ``pointers``: book_id, publication_id.
    Returns book_id, publication_id, generation (0 for the pointer) and chain, which is OK,
    CYCLE or BROKEN_LINK for the whole book.

    Chains may be long, so links double in every round: a chain of a million publications
    takes twenty joins. Each round works on unique ids, cuts its lineage, and stops when no
    link leads further; a link still alive after as many steps as its book has publications
    runs in a circle.
    """
    keys = ["book_id", "publication_id"]
    links = cut(
        publications.select(*keys, F.col("previous_publication_id").alias("ancestor")).distinct()
    )
    known = links.select(*keys)
    # A link to an unknown publication ends there and marks its book.
    dangling = (
        links.filter("ancestor IS NOT NULL")
        .select("book_id", F.col("ancestor").alias("publication_id"), F.col("publication_id").alias("child"))
        .join(known, keys, "left_anti")
        .select("book_id", F.col("child").alias("publication_id"))
    )
    reached = pointers.select(*keys, F.lit(0).cast("bigint").alias("generation"))
    jumps = links.filter("ancestor IS NOT NULL")
    # No chain is longer than the number of publications of its book.
    longest = links.groupBy("book_id").count().agg(F.max("count")).first()[0] or 0
    step = 1
    circling = None
    while not jumps.isEmpty():
        if step > longest:
            circling = jumps.select("book_id").distinct()
            break
        further = reached.join(jumps, keys).select(
            "book_id",
            F.col("ancestor").alias("publication_id"),
            (F.col("generation") + step).alias("generation"),
        )
        reached = cut(reached.unionByName(further))
        second = jumps.select(
            "book_id", F.col("publication_id").alias("ancestor"), F.col("ancestor").alias("_next")
        )
        jumps = cut(
            jumps.join(second, ["book_id", "ancestor"]).select(
                "book_id", "publication_id", F.col("_next").alias("ancestor")
            )
        )
        step *= 2
    # In a circle one publication is met again and again; it keeps its nearest generation.
    found = reached.groupBy(*keys).agg(F.min("generation").alias("generation"))
    chains = found.join(known, keys, "left_semi")
    broken = (
        chains.join(dangling, keys, "left_semi")
        .select("book_id")
        .unionByName(found.join(known, keys, "left_anti").select("book_id"))
        .distinct()
        .withColumn("_broken", F.lit(True))
    )
    result = chains.join(broken, "book_id", "left")
    if circling is None:
        result = result.withColumn("_cycle", F.lit(None).cast("boolean"))
    else:
        # Only publications the pointer can reach count.
        alive = circling_members(chains, links, circling)
        result = result.join(alive, "book_id", "left")
    chain = (
        F.when(F.col("_broken"), "BROKEN_LINK").when(F.col("_cycle"), "CYCLE").otherwise("OK")
    )
    return result.select(*keys, "generation", chain.alias("chain"))


def circling_members(chains: DataFrame, links: DataFrame, circling: DataFrame) -> DataFrame:
    """Books whose reachable publications have no first one: the chain never ends."""
    ends = (
        chains.join(links.filter("ancestor IS NULL"), ["book_id", "publication_id"], "left_semi")
        .select("book_id")
        .distinct()
    )
    return (
        chains.join(circling, "book_id", "left_semi")
        .select("book_id")
        .distinct()
        .join(ends, "book_id", "left_anti")
        .withColumn("_cycle", F.lit(True))
    )


def committed_publications(
    publications: DataFrame, pointers: DataFrame, attempts: DataFrame
) -> DataFrame:
    """Publications proved committed: the sound ancestry of the pointer, and, in a book whose
    chain meets a legacy publication (one that records no ancestry), those a PUBLISHED attempt
    of the same run proves."""
    keys = ["book_id", "publication_id"]
    ancestry = publication_ancestry(publications, pointers).filter("chain = 'OK'")
    chain = publications.join(ancestry.select(*keys), keys, "left_semi")
    legacy_books = chain.filter("is_legacy").select("book_id").distinct()
    proofs = attempts.filter("state = 'PUBLISHED'").select(*keys, "run_id")
    proved = publications.join(legacy_books, "book_id", "left_semi").join(
        proofs, [*keys, "run_id"], "left_semi"
    )
    return chain.unionByName(proved).dropDuplicates(keys)


def reconcile_attempts(attempts: DataFrame, committed: DataFrame) -> DataFrame:
    """Final state per run, given what is proved committed.

    ``attempts``: book_id, run_id, state, publication_id, error_codes.
    ``committed``: book_id, run_id, publication_id.
    """
    by_run = committed.select(
        "book_id", "run_id", F.col("publication_id").alias("_published")
    )
    by_id = committed.select(
        "book_id", F.col("publication_id"), F.lit(True).alias("_available")
    )
    joined = attempts.join(by_run, ["book_id", "run_id"], "full_outer").join(
        by_id, ["book_id", "publication_id"], "left"
    )
    recorded = F.col("state")
    published = F.col("_published").isNotNull()
    unavailable = (recorded == "NO_CHANGE") & F.col("_available").isNull()
    interrupted = recorded.isin("RUNNING", "PUBLISHED")
    failed = unavailable | interrupted
    reason = F.when(unavailable, "PUBLICATION_UNAVAILABLE").when(interrupted, "INTERRUPTED_ATTEMPT")
    state = F.when(published, "PUBLISHED").when(failed, "TECHNICAL_FAILURE").otherwise(recorded)
    codes = F.when(~published & failed, F.array(reason)).otherwise(
        F.coalesce("error_codes", F.array().cast("array<string>"))
    )
    return joined.select(
        "book_id",
        "run_id",
        state.alias("state"),
        F.when(published, F.col("_published"))
        .when(recorded == "NO_CHANGE", F.col("publication_id"))
        .alias("publication_id"),
        codes.alias("error_codes"),
    )


# ---- events -----------------------------------------------------------------------------
def error_codes(issues: Column) -> Column:
    """Sorted distinct codes of the ERROR issues."""
    errors = F.filter(issues, lambda i: (i["severity"] == "ERROR") & i["code"].isNotNull())
    return F.array_sort(F.array_distinct(F.transform(errors, lambda i: safe_identifier(i["code"]))))


def _schema_of(table: Column) -> Column:
    described = F.create_map(
        *(
            part
            for name, fields in TABLE_TYPES.items()
            for part in (
                F.lit(name),
                F.array(
                    *(
                        F.struct(F.lit(n).alias("name"), F.lit(kind).alias("type"))
                        for n, kind in fields.items()
                    )
                ),
            )
        )
    )
    return F.try_element_at(described, table)


def _dataset(namespace: Column, name: Column, version: Column, table: Column) -> Column:
    return F.struct(
        namespace.alias("namespace"),
        name.alias("name"),
        version.cast("string").alias("version"),
        _schema_of(table).alias("fields"),
    )


def _table_datasets(tables: Column, run_id: Column, keep_bronze: bool) -> Column:
    entries = F.map_entries(tables)
    if not keep_bronze:
        entries = F.filter(entries, lambda e: e["key"] != "bronze")
    return F.transform(
        entries,
        lambda e: _dataset(
            F.lit(DATASETS),
            F.when(e["key"] == "bronze", F.concat(F.lit("bronze/"), canonical_run_id(run_id)))
            .otherwise(e["key"]),
            e["value"]["version"],
            e["key"],
        ),
    )


def _source_datasets(sources: Column) -> Column:
    """Bronze of every accepted batch, and the reference documents it was checked with."""
    bronze = F.transform(
        sources,
        lambda s: _dataset(
            F.lit(DATASETS),
            F.concat(F.lit("bronze/"), canonical_run_id(s["run_id"])),
            s["bronze_version"],
            F.lit("bronze"),
        ),
    )
    received = F.flatten(
        F.transform(
            sources,
            lambda s: F.transform(
                F.filter(
                    F.map_entries(F.coalesce(s["reference_hashes"], F.create_map().cast("map<string,string>"))),
                    lambda e: matches(e["value"], SHA256),
                ),
                lambda e: F.concat(safe_identifier(e["key"]), F.lit("/sha256:"), e["value"]),
            ),
        )
    )
    approved = F.transform(
        F.filter(sources, lambda s: matches(s["operator_reference_hash"], SHA256)),
        lambda s: F.concat(F.lit("approved/sha256:"), s["operator_reference_hash"]),
    )
    references = F.transform(
        F.array_distinct(F.concat(received, approved)),
        lambda name: _dataset(F.lit(REFERENCES), name, F.lit(None), F.lit("")),
    )
    return F.array_distinct(F.concat(bronze, references))


def lineage_events(attempts: DataFrame, publications: DataFrame) -> DataFrame:
    """A START and, for a finished attempt, a terminal event per run.

    ``attempts``: run_id, state, job_mode, started_at, finished_at, issues, publication_id.
    ``publications``: committed ones, with run_id, published_at, accepted_batches, tables and
    sources. Only a PUBLISHED run has outputs; NO_CHANGE reads the official tables.
    """
    official = publications.select(
        F.col("publication_id"),
        F.col("run_id").alias("_run"),
        "published_at",
        "accepted_batches",
        "tables",
        "sources",
    )
    state = F.col("state")
    # A publication belongs to the event only where the state proves it.
    proved = (state == "NO_CHANGE") | ((state == "PUBLISHED") & (F.col("_run") == F.col("run_id")))
    # Attempts without a publication would all meet in one task, so each goes by its own run.
    unmatched = F.concat(F.lit("\u0000"), "run_id")
    keyed = attempts.withColumn("_key", F.coalesce("publication_id", unmatched))
    joined = keyed.join(official.withColumnRenamed("publication_id", "_key"), "_key", "left").withColumn(
        "_proved", F.coalesce(proved & F.col("_run").isNotNull(), F.lit(False))
    )
    terminal_types = F.create_map(*(F.lit(v) for pair in TERMINAL_TYPES.items() for v in pair))
    none = F.array().cast("array<string>")
    found = F.coalesce(error_codes(F.col("issues")), none)
    failed = state.isin("BLOCKED", "TECHNICAL_FAILURE")
    reasons = F.when(failed & (F.size(found) == 0), F.array(state)).otherwise(found)
    empty = F.array().cast(
        "array<struct<namespace:string,name:string,version:string,"
        "fields:array<struct<name:string,type:string>>>>"
    )
    outputs = F.when(
        F.col("_proved") & (state == "PUBLISHED"),
        F.array_sort(_table_datasets(F.col("tables"), F.col("_run"), keep_bronze=True)),
    ).otherwise(empty)
    inputs = F.when(
        F.col("_proved"),
        F.array_sort(
            F.concat(
                _source_datasets(F.col("sources")),
                F.when(
                    state == "NO_CHANGE",
                    _table_datasets(F.col("tables"), F.col("_run"), keep_bronze=False),
                ).otherwise(empty),
            )
        ),
    ).otherwise(empty)
    finished = F.coalesce(
        F.when(instant(F.col("finished_at")).isNotNull(), F.col("finished_at")),
        F.when(F.col("_proved") & (state == "PUBLISHED"), F.col("published_at")),
    )
    started = F.when(instant(F.col("started_at")).isNotNull(), F.col("started_at"))
    job = F.concat(
        F.lit(JOB_PREFIX),
        F.coalesce("job_mode", F.when(state == "VALIDATED", "validate").otherwise("publish")),
    )
    start = F.struct(
        F.lit("start").alias("kind"),
        F.lit("START").alias("event_type"),
        F.lit("RUNNING").alias("state"),
        started.alias("event_time"),
        none.alias("reason_codes"),
        F.lit(False).alias("new_publication"),
        F.lit(None).cast("string").alias("publication_id"),
        none.alias("accepted_batches"),
        empty.alias("inputs"),
        empty.alias("outputs"),
    )
    terminal = F.struct(
        F.lit("terminal").alias("kind"),
        F.try_element_at(terminal_types, state).alias("event_type"),
        state.alias("state"),
        finished.alias("event_time"),
        reasons.alias("reason_codes"),
        (state == "PUBLISHED").alias("new_publication"),
        F.when(F.col("_proved"), safe_identifier(F.col("publication_id"))).alias("publication_id"),
        F.when(
            F.col("_proved"),
            F.transform("accepted_batches", lambda b: safe_identifier(b)),
        ).otherwise(none).alias("accepted_batches"),
        inputs.alias("inputs"),
        outputs.alias("outputs"),
    )
    events = F.when(
        F.try_element_at(terminal_types, state).isNotNull(), F.array(start, terminal)
    ).otherwise(F.array(start))
    return joined.select(
        canonical_run_id(F.col("run_id")).alias("run_id"),
        job.alias("job"),
        F.explode(events).alias("e"),
    ).select("run_id", "job", "e.*")


def event_digest(events: DataFrame) -> DataFrame:
    """Digest of an event without its timing."""
    content = [name for name in sorted(events.columns) if name != "event_time"]
    return events.withColumn("digest", F.sha2(F.to_json(F.struct(*content)), 256))


def export_status(events: DataFrame, exported: DataFrame) -> DataFrame:
    """Per kind of event: how many are ``missing`` in the export, ``exported``, and exported otherwise (``diverging``).
    Only keys and digests move."""
    known = exported.select("run_id", "kind", packed(F.col("digest")).alias("_digest"), F.lit(True).alias("_known"))
    rows = events.select("run_id", "kind", packed(F.col("digest")).alias("digest"))
    return rows.join(known, ["run_id", "kind"], "left").groupBy("kind").agg(
        F.count_if(F.col("_known").isNull()).alias("missing"),
        F.count("_known").alias("exported"),
        F.count_if(F.col("digest") != F.col("_digest")).alias("diverging"),
    )


def missing_lineage_events(events: DataFrame, exported: DataFrame) -> DataFrame:
    """Events not exported yet."""
    return events.join(exported.select("run_id", "kind"), ["run_id", "kind"], "left_anti")


def diverging_lineage_events(events: DataFrame, exported: DataFrame) -> DataFrame:
    """Exported events that say something else than the reconstructed ones, timing aside."""
    known = exported.select("run_id", "kind", F.col("digest").alias("_digest"))
    return events.join(known, ["run_id", "kind"]).filter("digest <> _digest").drop("_digest")
