"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, PII, byte-level BPE.

Every stage works on all its predecessor kept and is written as Parquet before the next one reads it, so
a lost executor costs one stage at most. Stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillclose.llm import bpe, decontaminate, jaccard, pii, quality_rules
from tillclose.llm.frames import may_hold, written
from tillclose.session import prepare


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    prepare(spark)
    return quality_rules.kept(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest id stays, a null id first.

    Rows are told apart by id and text: a null or repeated id costs no row whose text is not a copy.
    Rows without words belong to no group and stay; of rows that repeat an id with its text, one stays.
    """
    prepare(spark)
    own = jaccard.members(docs).filter("n > 0 OR doc_id IS NOT NULL")
    go = F.coalesce((F.col("one") != F.col("lead.one")) | (F.col("two") != F.col("lead.two")), F.lit(False))
    rows = own.groupBy("one", "two").agg(F.max(go).alias("go"), F.count(F.lit(1)).alias("rows"))
    told = written(rows.filter("go OR rows > 1").select("one", "two", "go"), "copies")
    one, two = jaccard.row_prints(docs)
    # Names that no column of the documents can have.
    names = [f"print_{uuid.uuid4().hex}" for _ in range(3)]
    docs = docs.withColumns(dict(zip(names[:2], (one, two), strict=True)))
    # Rows that cannot be among the copies need no join and no shuffle.
    may = F.col(names[2])
    split = may_hold(docs, docs[names[0]], told.select("one"), names[2])
    rest, docs = split.filter(~may).drop(names[2]), split.filter(may).drop(names[2])
    match = (docs[names[0]] == told["one"]) & (docs[names[1]] == told["two"])
    once = docs.join(told.filter("NOT go"), match, "left_semi").dropDuplicates(names[:2])
    return rest.unionByName(docs.join(told, match, "left_anti")).unionByName(once).drop(*names[:2])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    items = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind; ``n_chars``, where there is one, follows."""
    prepare(spark)
    out = pii.masked(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", byte_bpe_stage),
]
#: Token ids cannot be computed in SQL; ``tests/llm`` holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
