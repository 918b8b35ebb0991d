"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document is measured in one pass of built-in functions. Each (language, source) gets KLL sketches
of its measures, merged from the partial sketches of the tasks, so a source with a third of all rows
sends one sketch per task. Fences around the quartiles of the sketches replace fixed cutoffs, and a
join of documents with their fences filters. No Python runs in a task.

A document is rejected by the base rules (fewer than 50 words, or over half of its words in repeated
three-word windows), or because a measure lies outside its group's fence:
``q3 + REACH * max(q3 - q1, spread)``, where ``spread`` is the least width of the measure. The quartiles are the
group's own at every size, drawn towards its language's and those towards everyone's: with ``n`` documents
that pass the base rules, the own quartile has the weight ``n / (n + PRIOR)``. So no size changes the rule, and
one more document moves a fence by little.

Nulls and edge cases: a null or empty text has no words and fails the base rules; null languages and
sources are groups of their own; repeated rows get equal verdicts; other columns stay, whatever their names. A
sketch is exact up to ``SKETCH_SIZE`` values; beyond, a rank may be off by about a thousandth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.llm.frames import written

LEAST_WORDS, MOST_REPEATED = 50, 0.5
SKETCH_SIZE, REACH, PRIOR = 4000, 3.0, 10
#: Measures that are bad when high, with the least width of their middle half.
SPREADS = {"symbols": 0.01, "dup_lines": 0.15, "repeats": 0.15, "word_length": 0.75}
_BLANKS = " \t\n\x0b\f\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def window(word: Column, at: Column, own: Column) -> Column:
        return F.xxhash64(word, F.get(own, at + 1), F.get(own, at + 2))

    def hashes(own: Column) -> Column:
        return F.transform(F.slice(own, 1, F.size(own) - 2), lambda word, at: window(word, at, own))

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda key, at: F.struct(key.alias("key"), at.alias("at"))))

        def again(pairs: Column) -> Column:
            def twice(pair: Column, at: Column) -> Column:
                before = F.when(at > 0, F.get(pairs, at - 1)["key"])
                after = F.get(pairs, at + 1)["key"]
                return F.coalesce(before == pair["key"], F.lit(False)) | F.coalesce(
                    after == pair["key"], F.lit(False)
                )

            return F.sort_array(F.transform(F.filter(pairs, twice), lambda pair: pair["at"]))

        start = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
        return F.aggregate(
            _bound(ordered, again),
            start,
            lambda state, at: F.struct(
                (state["sum"] + F.least(F.lit(3), at - state["last"])).alias("sum"), at.alias("last")
            ),
            lambda state: state["sum"],
        )

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered(keys)).otherwise(0)

    return F.when(F.size(words) > 3, _bound(_bound(words, hashes), count)).otherwise(0)


def counts_of(text: Column) -> Column:
    """All counts of a text, as one struct."""
    own = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(own, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    lines = F.filter(F.split(own, "\n"), lambda line: F.translate(line, _BLANKS, "") != "")

    def counts(w: Column) -> Column:
        return F.struct(
            w["n"].cast("long").alias("n_words"),
            F.length(F.translate(own, _BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(own) - F.length(F.translate(own, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            w["again"].cast("long").alias("n_repeat_words"),
            F.greatest(_bound(lines, F.size), F.lit(1)).cast("long").alias("n_lines"),
        )

    of_words = _bound(words, lambda own: F.struct(F.size(own).alias("n"), _repeated(own).alias("again")))
    return _bound(of_words, counts)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of every text."""
    counts = written(docs.select("doc_id", "lang", "source", counts_of(docs["text"]).alias("c")), "counts")
    return counts.select("doc_id", "lang", "source", "c.*")


def _measures() -> dict[str, Column]:
    def per(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return {
        "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
    }


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fences(counts: DataFrame) -> DataFrame:
    """``lang``, ``source`` and the fence of every measure."""
    measures = _measures()
    passed = counts.filter(~_base_failed()).select("lang", "source", *(v.alias(k) for k, v in measures.items()))
    sketches = passed.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("size"),
        *(F.kll_sketch_agg_double(k, F.lit(SKETCH_SIZE)).alias(k) for k in measures),
    )
    sketches = written(sketches, "sketches")
    merged = [F.kll_merge_agg_double(k, F.lit(SKETCH_SIZE)).alias(k) for k in measures]
    langs = sketches.groupBy("lang").agg(F.sum("size").alias("size"), *merged)
    total = sketches.agg(*merged)
    quarters = {"q1": 0.25, "q3": 0.75}

    def quartiles(level: str) -> list[Column]:
        def quartile(name: str, at: float) -> Column:
            # A sketch of no values has no quantiles: no fence.
            some = F.kll_sketch_get_n_double(name) > 0
            return F.when(some, F.kll_sketch_get_quantile_double(name, F.lit(at)))

        return [quartile(k, at).alias(f"{level}_{k}_{q}") for k in measures for q, at in quarters.items()]

    own = sketches.select("lang", "source", F.col("size").alias("own_size"), *quartiles("own"))
    named = langs.select(F.col("lang").alias("l_lang"), F.col("size").alias("lang_size"), *quartiles("lang"))
    both = own.join(named, F.col("lang").eqNullSafe(F.col("l_lang")))
    # One row of everyone: scalar subqueries.
    everyone = total.select(*quartiles("all"))

    def drawn(name: str, q: str) -> Column:
        out = everyone.select(f"all_{name}_{q}").scalar()
        for level in ("lang", "own"):
            weight = F.col(f"{level}_size") / (F.col(f"{level}_size") + PRIOR)
            out = weight * F.col(f"{level}_{name}_{q}") + (1 - weight) * out
        return out

    def fence(name: str) -> Column:
        high = F.col(f"{name}_q3")
        return (high + REACH * F.greatest(high - F.col(f"{name}_q1"), F.lit(SPREADS[name]))).alias(f"most_{name}")

    both = both.select("lang", "source", *(drawn(k, q).alias(f"{k}_{q}") for k in measures for q in quarters))
    return written(both.select("lang", "source", *map(fence, measures)), "fences")


def judged(counts: DataFrame) -> DataFrame:
    """The counts with ``base_failed`` and ``kept``."""
    own = fences(counts)
    own = own.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *own.columns[2:])
    joined = counts.join(
        own, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left"
    )
    outside = F.lit(False)
    for name, value in _measures().items():
        outside = outside | F.coalesce(value > F.col(f"most_{name}"), F.lit(False))
    return joined.withColumn("base_failed", _base_failed()).withColumn(
        "kept", ~(F.col("base_failed") | outside)
    )


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    return judged(measured(docs)).select("doc_id", *_COUNTS, "base_failed", "kept")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Rows are written with their counts, so that no text is shuffled; the fences, one row per language and
    source, come to them.
    """
    row = f"row_{uuid.uuid4().hex}"
    whole = docs.select(F.struct(*(docs[x] for x in docs.columns)).alias(row), "lang", "source", counts_of(docs["text"]).alias("c"))
    whole = written(whole, "counted")
    good = judged(whole.select(row, "lang", "source", "c.*")).filter("kept")
    return good.select(F.col(f"{row}.*"))
