"""The queries of the operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillclose.llm import (
    align,
    bpe,
    chat,
    decontaminate,
    jaccard,
    licenses,
    merkle,
    pii,
    quality_model,
    quality_rules,
    substring,
    token_counts,
    vectors,
)
from tillclose.session import prepare

RANKS, JSON, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 512
_CONTROL = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return bpe.round_trip(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, folder, "documents"))
    return kept.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.round_trip(turns.unionByName(control), public_tokenizers.path(JSON))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(
        _table(spark, folder, "documents"), public_tokenizers.path(JSON), TOKEN_LIMIT
    )


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality_model.scored(docs, quality_model.fit(docs, _table(spark, folder, "labels")))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(_table(spark, folder, "documents"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(_table(spark, folder, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path(JSON), public_tokenizers.path(PIECES)
    return align.alignment(_table(spark, folder, "documents"), *paths)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    changed = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, F.lit(False))
    claims = [docs[x] if x != "n_chars" else docs[x] + F.when(changed, 1).otherwise(0) for x in merkle.FIELDS]
    proofs = merkle.verified(merkle.manifest(docs, carry={"claimed": merkle.leaf(claims)}), "claimed")
    proof = merkle.path_digest(F.col("path")).alias("proof_sha256")
    return proofs.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.linked(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_decontamination,
        op2_ngram_jaccard_join,
        op3_byte_bpe,
        op4_substring_dedup,
        op5_chat_formatting,
        op6_license_scan,
        op7_token_counts,
        op8_quality_classifier,
        op9_quality_rules,
        op10_pii,
        op11_tokenizer_alignment,
        op12_merkle_manifest,
        op13_embedding_near_dedup,
    )
}

_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP2 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_SPLIT.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS p
        FROM d WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
r AS (
  WITH RECURSIVE reach(a, b) AS (
    SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
  SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id
"""

_OP4 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS words FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, p, array_to_string(words[p:p + {substring.WIDTH - 1}], ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {substring.WIDTH - 1})) AS p
        FROM d WHERE len(words) >= {substring.WIDTH})),
late AS MATERIALIZED (
  SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + {substring.WIDTH - 1})) AS i FROM late),
each AS (
  SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i
  FROM d WHERE len(words) > 0),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM each LEFT JOIN gone USING (doc_id, i) WHERE gone.doc_id IS NULL GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(g.n, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""


def _op6() -> str:
    known = ", ".join(f"'{k}': '{v}'" for k, v in licenses.SENTENCES.items())

    def ids(text: str) -> str:
        marked = rf"regexp_replace(lower({text}), '[.!?;]+([ \t\r\n\f]|$)', E'\n\\1', 'g')"
        plain = rf"regexp_replace({marked}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
        sentences = rf"string_split_regex({plain}, ' ?\n[ \n]*')"
        named = f"list_transform({sentences}, lambda x: map_extract_value(MAP {{{known}}}, trim(x)))"
        return f"list_filter({named}, lambda x: x IS NOT NULL)"

    joined = r"""replace(replace(regexp_replace(text, '\n[ \t\r]*\n', chr(1), 'g'), chr(10), ' '), chr(1), chr(10))"""
    steps = ["SELECT doc_id, lines, wrapped, side, ' ' || array_to_string(ids, '  ') || ' ' AS l0 FROM u"]
    for i, (_, rule) in enumerate(licenses.RULES):
        mark = " " + "  ".join(rule) + " "
        steps.append(
            f"SELECT *, contains(l{i}, '{mark}') AS h{i}, replace(l{i}, '{mark}', ' / ') AS l{i + 1} "
            f"FROM ({steps[-1]})"
        )
    found = ", ".join(f"CASE WHEN h{i} THEN '{name}' END" for i, (name, _) in enumerate(licenses.RULES))
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS MATERIALIZED (SELECT doc_id, {ids("text")} AS lines, {ids(joined)} AS wrapped FROM t),
u AS MATERIALIZED (
  SELECT *, 0 AS side, lines AS ids FROM b UNION ALL SELECT *, 1 AS side, wrapped AS ids FROM b),
m AS (
  SELECT doc_id, lines, wrapped, list_filter([{found}], lambda x: x IS NOT NULL) AS found FROM ({steps[-1]})),
g AS (
  SELECT doc_id, any_value(lines) AS lines, any_value(wrapped) AS wrapped,
    list_sort(list_distinct(flatten(list(found)))) AS found FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(wrapped) > len(lines) THEN len(wrapped) ELSE len(lines) END AS n_known,
  array_to_string(CASE WHEN len(wrapped) > len(lines) THEN wrapped ELSE lines END, ',') AS sentence_ids,
  array_to_string(found, ',') AS licenses
FROM g
"""


def _op9() -> str:
    names = list(quality_rules.SPREADS)
    quarters = {"q1": 0.25, "q3": 0.75}

    def quartiles(level: str) -> str:
        return ", ".join(f"quantile_disc({k}, {at}) AS {level}_{k}_{q}" for k in names for q, at in quarters.items())

    def drawn(name: str, q: str) -> str:
        out = f"all_{name}_{q}"
        for level in ("lang", "own"):
            weight = f"({level}_size / ({level}_size + {quality_rules.PRIOR}))"
            out = f"({weight} * {level}_{name}_{q} + (1 - {weight}) * {out})"
        return f"{out} AS {name}_{q}"

    moved = ", ".join(drawn(k, q) for k in names for q in quarters)
    fences = ", ".join(
        f"{k}_q3 + 3.0::DOUBLE * greatest({k}_q3 - {k}_q1, {v}::DOUBLE) AS most_{k}" for k, v in quality_rules.SPREADS.items()
    )
    outside = " OR ".join(f"m.{k} > f.most_{k}" for k in names)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_SPLIT.format("coalesce(text, '')")} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
t AS MATERIALIZED (
  SELECT doc_id, p, array_to_string(words[p:p + 2], ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS p FROM d WHERE len(words) > 2)),
again AS (SELECT doc_id, p FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (
  SELECT doc_id, count(*) AS n
  FROM (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS i FROM again) GROUP BY doc_id),
c AS MATERIALIZED (
  SELECT d.doc_id, lang, source, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    greatest(len(lines), 1) AS n_lines
  FROM d LEFT JOIN covered USING (doc_id)),
m AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END::DOUBLE AS symbols,
    (n_dup_lines / n_lines)::DOUBLE AS dup_lines,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END::DOUBLE AS repeats,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END::DOUBLE AS word_length FROM c),
g AS (SELECT lang, source, count(*)::DOUBLE AS own_size, {quartiles("own")} FROM m WHERE NOT base_failed GROUP BY lang, source),
l AS (SELECT lang, count(*)::DOUBLE AS lang_size, {quartiles("lang")} FROM m WHERE NOT base_failed GROUP BY lang),
a AS (SELECT {quartiles("all")} FROM m WHERE NOT base_failed),
q AS (SELECT g.lang, source, {moved} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang, a),
f AS (SELECT lang, source, {fences} FROM q)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce({outside}, FALSE)) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""


def _op12() -> str:
    def framed(value: str) -> str:
        text = f"CAST({value} AS VARCHAR)"
        return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", n_chars, "text"))) + ")"

    # CRC-32 bit by bit: a character is taken in, then eight shifts.
    steps = (
        "list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda c: list_concat([CAST(ord(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]))))"
    )
    crc = (
        f"xor(list_reduce({steps}, lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 "
        "THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295)"
    )

    def tree(name: str, base: str) -> str:
        return f"""
{name} AS (
  WITH RECURSIVE n(level, tree, idx, size, digest) AS (
    {base}
    UNION ALL
    SELECT level + 1, tree, idx // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
    FROM n WHERE size > 1 GROUP BY level, tree, idx // 2, size)
  SELECT * FROM n)"""

    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
    CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS claimed FROM documents),
l AS MATERIALIZED (
  SELECT *, coalesce('=' || lang, '') AS tree, count(*) OVER (PARTITION BY lang) AS size,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
{tree("low", "SELECT 0, tree, idx, size, leaf FROM l")},
s AS MATERIALIZED (
  SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS place,
    count(*) OVER () AS size FROM low WHERE size = 1),
{tree("high", "SELECT 0, 'all', place, size, subroot FROM s")},
steps AS MATERIALIZED (
  SELECT l.tree, l.idx, low.level + 1 AS step, low.digest AS sibling, low.idx < (l.idx >> low.level) AS earlier
  FROM l JOIN low ON low.tree = l.tree AND low.idx = xor(l.idx >> low.level, 1)
  UNION ALL
  SELECT l.tree, l.idx, s.height + high.level + 1, high.digest, high.idx < (s.place >> high.level)
  FROM l JOIN s ON s.tree = l.tree JOIN high ON high.idx = xor(s.place >> high.level, 1)),
total AS (
  SELECT s.tree, s.subroot, s.height, s.height + top.level AS levels, top.digest AS root
  FROM s, (SELECT level, digest FROM high WHERE size = 1) top),
up AS (
  WITH RECURSIVE f(tree, idx, step, levels, digest) AS (
    SELECT l.tree, l.idx, 0, levels, claimed FROM l JOIN total ON total.tree = l.tree
    UNION ALL
    SELECT f.tree, f.idx, f.step + 1, levels, sha256(
      CASE WHEN earlier THEN sibling ELSE '' END || f.digest || CASE WHEN NOT earlier THEN sibling ELSE '' END)
    FROM f LEFT JOIN steps ON steps.tree = f.tree AND steps.idx = f.idx AND steps.step = f.step + 1
    WHERE f.step < levels)
  SELECT * FROM f WHERE step = levels),
p AS (SELECT tree, idx, sha256(string_agg(sibling, '' ORDER BY step)) AS proof FROM steps GROUP BY tree, idx)
SELECT l.doc_id, l.leaf, total.subroot, total.root, coalesce(p.proof, sha256('')) AS proof_sha256,
  up.digest AS folded_root, up.digest = total.root AS verified
FROM l JOIN total ON total.tree = l.tree JOIN up ON up.tree = l.tree AND up.idx = l.idx
LEFT JOIN p ON p.tree = l.tree AND p.idx = l.idx
"""


_OP13 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (
  WITH RECURSIVE reach(a, b) AS (
    SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
  SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(r.low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(r.low, vec_id)) AS kept
FROM embeddings LEFT JOIN r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLES = {
    "op2_ngram_jaccard_join": _OP2,
    "op4_substring_dedup": _OP4,
    "op6_license_scan": _op6(),
    "op9_quality_rules": _op9(),
    "op12_merkle_manifest": _op12(),
    "op13_embedding_near_dedup": _OP13,
}
