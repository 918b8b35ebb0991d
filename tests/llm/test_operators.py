"""Every operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows,
empty tables and further columns."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tillclose.llm import (
    bpe,
    chat,
    decontaminate,
    jaccard,
    licenses,
    pii,
    quality_model,
    quality_rules,
    substring,
    token_counts,
)
from tillclose.llm import text as tx

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept string, words string, sign string, print long, component long"
)
VOCABULARY = [f"w{i}" for i in range(400)] + ["the", "of", "é", "Über"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    long = " ".join(rng.choice(VOCABULARY) for _ in range(6000))
    base = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([3, 4, 5, 19, 20, 60, 150]))) for _ in range(40)]
    near = []
    for text in base[:20]:
        own = text.split()
        for at in rng.sample(range(len(own)), len(own) // 60 + (len(own) > 30)):
            own[at] = "changed"
        near.append("\n".join(own))
    passage = " ".join(rng.choice(VOCABULARY) for _ in range(55))
    shared = [f"{x}\n{passage}\n{x}" for x in base[20:30]]
    odd = [None, "", " \n\t", "one", "a " * 400, "\x85  x\x0b\x0cy", long, long + " end", base[5].upper(), base[5]]
    return base + near + shared + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], "src0" if i % 2 else None, 0, "k", "w", "s", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], "en", "src0", 0, "k", "w", "s", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


def test_substring(docs, empty):
    own = {d: words(t) for d, t in rows_of(docs)}
    first = {}
    for d in sorted(own, key=order):
        for i in range(len(own[d]) - 19):
            first.setdefault(tuple(own[d][i : i + 20]), (d, i))
    found = substring.remove_repeats(docs).collect()
    assert len(found) == docs.count()
    for row in found:
        w = own[row.doc_id]
        gone = {
            j
            for i in range(len(w) - 19)
            if first[tuple(w[i : i + 20])] != (row.doc_id, i)
            for j in range(i, i + 20)
        }
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (row.n_words, row.n_removed, row.kept) == (len(w), len(gone), kept), row.doc_id
    assert substring.remove_repeats(empty).count() == 0


def test_substring_ids_of_several_texts(spark):
    def text(name, size=30):
        return " ".join(f"{name}{i}" for i in range(size))

    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (2, text("b")), (5, text("c") + " " + text("d"))]
    rows += [(None, text("d")), (None, text("e")), (None, text("f") + " " + text("e")), (None, None), (None, "")]
    rows += [(None, text(f"n{i}") + " " + text("shared", 25)) for i in range(40)]
    rows += [(9, text(f"m{i}", 19 + i) + " " + text("shared", 25)) for i in range(4)] + [(5, text("e", 22))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keys = {(r.doc_id, r.text): r.p for r in docs.selectExpr("*", "xxhash64(coalesce(text, '')) AS p").collect()}
    first = {}
    for d, t in sorted(keys, key=lambda x: (order(x[0]), keys[x])):
        for i in range(len(words(t)) - 19):
            first.setdefault(tuple(words(t)[i : i + 20]), (d, t, i))
    expected = Counter()
    for d, t in rows:
        w = words(t)
        late = [i for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (d, t, i)]
        gone = {j for i in late for j in range(i, i + 20)}
        expected[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    found = Counter(tuple(r) for r in substring.remove_repeats(docs).collect())
    assert found == expected
    assert (2, 30, 30, "") in found and found[2, 30, 0, text("b")] == 2


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets, key=order)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)), key=order)
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("tile", [jaccard.TILE, 2])
def test_jaccard(docs, tile):
    expected = brute_components(rows_of(docs))
    found = jaccard.near_duplicates(docs, tile=tile).collect()
    assert len(found) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_jaccard_of_a_borderline_family(spark):
    rng = random.Random(9)
    start = [rng.choice(VOCABULARY) for _ in range(80)]
    rows = []
    for i in range(40):
        own = list(start)
        for at in rng.sample(range(80), rng.choice([1, 2, 3])):
            own[at] = f"x{i}"
        rows.append((i, " ".join(own)))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)


def test_jaccard_counts_a_repeated_row_once(spark):
    text = " ".join(f"r{i}" for i in range(60))
    rows = [(1, text)] * 4 + [(2, text + " more"), (3, "less " + text)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)


def test_bpe_of_a_chunk_is_gathered_from_arrays(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_TOKENS", 3)
    own = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = ["", "Unwhertz unwhertz 12345678 ", "", "\u00fcberßheit" * 9, "Unwhertz \U0001f600\n\n x", ""]
    for limit in (0, bpe._REMEMBERED):
        monkeypatch.setattr(bpe, "_REMEMBERED", limit)
        ids, ends = own.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [own.encode(x) for x in texts]
        data, cuts = own.decode_all(*own.encode_all(texts))
        assert [data[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:])] == texts
    # A remembered piece is a place in the arrays, not a list of its own.
    assert all(type(x) is int for x in own._pieces.values())
    assert [x.tolist() for x in own.encode_all([])] == [[], [0]]


def long_chunk(size):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(VOCABULARY) + str(rng.randrange(999)) for _ in range(400)) for _ in range(100)]
    texts = [texts[i % 100] + f" {i}" for i in range(size // len(texts[0]))]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text"])


def test_sets_of_a_chunk_take_few_times_its_bytes(monkeypatch):
    chunk = long_chunk(tx.CHUNK_BYTES)
    jaccard.row_sets(chunk.slice(0, 2), 5)  # tables that a worker makes once
    tracemalloc.start()
    try:
        sets = jaccard.row_sets(chunk, 5)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(sets) == chunk.num_rows
    assert peak - kept < 7 * tx.CHUNK_BYTES
    # The steps change no set, also if every row, or the whole chunk, is one.
    for size in (1, 1 << 30):
        monkeypatch.setattr(tx, "STEP_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(sets, jaccard.row_sets(chunk, 5), strict=True))
    assert jaccard.row_sets(chunk.slice(0, 0), 5) == []


def test_a_worker_encodes_and_scans_a_step_at_a_time():
    chunk = long_chunk(2 * tx.CHUNK_BYTES)
    size = sum(map(len, chunk.column("text").to_pylist()))
    found = list(bpe._encoded(iter([chunk]), RANKS, public_tokenizers.PATTERN))
    assert len(found) >= size >> 20
    assert [x for b in found for x in b.column("doc_id").to_pylist()] == list(range(chunk.num_rows))
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    texts = chunk.column("text").to_pylist()
    ids = [x for b in found for x in b.column("ids").to_pylist()]
    assert all(ids[i] == own.encode(texts[i]) for i in range(0, len(texts), 97))


def test_jaccard_leaders_of_a_family(spark):
    # 40 classes share 30 tiles: the first leader is the one with the fewest rarer shingles, later ones differ by tile.
    rows = [(s, d, 100, s + (0 if d == 17 else 3), 16, d) for s in range(30) for d in range(40)]
    known = spark.createDataFrame(rows, "shingle long, doc_id long, n long, rank long, band long, component long")
    first, later = (jaccard._leader_pairs(known, turn).toPandas() for turn in (0, 1))
    assert set(first["a"]) == {17} and len(first) == 39
    assert later["a"].nunique() > 10


def test_jaccard_of_nothing(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_bpe(docs, empty, monkeypatch):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    found = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    expected = Counter()
    for d, t in rows_of(docs):
        ids = library.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        expected[d, len(ids), hashlib.sha256(raw).hexdigest(), sha(t or "")] += 1
    assert Counter(tuple(r) for r in found) == expected
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(bytes(r.decoded) for r in back) == Counter((t or "").encode() for _, t in rows_of(docs))
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for name, size in (("LEAF_CHARS", 16), ("LEAF_BYTES", 8), ("LEAF_TOKENS", 8)):
        monkeypatch.setattr(bpe, name, size)
    check_bpe(own, library)


def check_bpe(own, library):
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "'s", "'", "1", "23", "é", "中", "!", "<|endoftext|>", "\x1c", "²", "😀"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(400)]
    cases += ["a" * 900, " " * 900 + "x", "don't" * 200, "".join(rng.choice("abcdefgh") for _ in range(900))]
    for text in cases:
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)).decode() == text


def test_bpe_by_its_own_merges(monkeypatch):
    """No size at which the tree and the merges are not the operator's own: the library is only compared."""
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    own = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    check_bpe(own, library)
    rng = random.Random(3)
    long = ["".join(rng.choice("ab-") for _ in range(5000)), "=" * 20001, "xyz" * 7000, "中文字" * 3000, "é" * 4097]
    for text in long:
        assert own.encode(text) == library.encode_ordinary(text)
    for size in (1, 2, 7):
        for name in ("LEAF_CHARS", "LEAF_BYTES", "LEAF_TOKENS"):
            monkeypatch.setattr(bpe, name, size)
        check_bpe(bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), library)


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(JSON)

    def count(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    found = Counter(tuple(r) for r in token_counts.token_counts(docs, JSON, 512).collect())
    expected = Counter()
    for d, t in rows_of(docs):
        n = count(t or "")
        expected[d, len((t or "").encode()), n, n > 512] += 1
    assert found == expected
    assert token_counts.token_counts(empty, JSON, 512).count() == 0
    own = token_counts.counts(JSON)
    rng = random.Random(2)
    parts = ["a", "the", "ing", " ", "  ", "\n", "'s", "1", "é", "中", "!", "<|endoftext|>", "\x85", "Ⅷ", "̈"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        prefixes, at = own.prefixes(text), rng.randrange(len(text) + 1)
        assert prefixes.sums[-1] == count(text) == own.total(text)
        if "<" not in text:
            assert prefixes.count(at) == count(text[:at])
        assert count(text[: prefixes.cut(7)]) <= 7
    for row in token_counts.truncated(docs, JSON, 16).collect():
        assert count(row.text) <= 16


def test_chat(spark):
    rng = random.Random(3)
    marks = ["</s>", "[TURN user]", "\\", "[", "<", "]", "hello there", "é中", "\n", ""]
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(12):
        for t in range(rng.choice([1, 2, 9, 40])):
            role = "system" if t == 0 and c % 2 else ["user", "assistant", "tool]<[\\"][rng.randrange(3)]
            rows.append((c, t, role, "".join(rng.choice(marks) for _ in range(rng.randrange(30)))))
    rows += [(None, 0, None, None), (None, None, "assistant", "x"), (3, 1, "user", "again"), (3, 1, "user", "again")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    for budget, history, segment in ((2048, 512, 4096), (120, 40, 4096), (120, 40, 4), (1, 1, 1)):
        formatted = chat.windows(turns, JSON, budget, history, segment)
        formatted.persist()
        read = chat.read_back(formatted).collect()
        assert sorted(map(repr, read)) == sorted(
            map(repr, chat.round_trip(turns, JSON, budget, history, segment).collect())
        )
        seen = {r.conv_id: r for r in read}
        assert set(seen) == set(by) and len(read) == len(by)
        for c, own in by.items():
            own.sort()
            loss = "".join(x for _, r, x in own if r == "assistant")
            r = seen[c]
            assert r.n_turns == len(own)
            assert r.turns_sha256 == sha("".join(f"{a}\n{x}\n" for _, a, x in own))
            assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
            own_windows = [w for w in formatted.collect() if w.conv_id == c]
            assert {w.segment for w in own_windows} == set(range(-(-len(own) // segment)))
            for w in own_windows:
                shown = chat.parsed(w.text)
                if own[0][1] == "system":
                    assert shown[0] == own[0][1:]
                if w.window == 0:
                    # The turns before a segment are those that the window repeats.
                    told = shown[own[0][1] == "system" and w.segment > 0 : w.n_repeated]
                    start = w.segment * segment
                    assert told == [x[1:] for x in own[start - len(told) : start]]
        for w in formatted.collect():
            assert w.tokens <= budget or w.n_new == 1
        formatted.unpersist()
    assert chat.read_back(chat.windows(turns.limit(0), JSON)).count() == 0
    assert chat.round_trip(turns.limit(0), JSON).count() == 0


def test_spans_repeat_history_within_the_budget():
    assert chat.spans([10, 20, 20, 20, 20], True, 60, 20) == [(0, 0, 3), (2, 3, 4), (3, 4, 5)]


def test_licenses(docs, empty, spark):
    grant = next(k for k, v in licenses.SENTENCES.items() if v == "mit-grant").replace(" any ", "\nany ")
    condition = next(k for k, v in licenses.SENTENCES.items() if v == "mit-condition")
    rows = [
        (1, "Intro text.\nReleased under the MIT License.\nMore"),
        (2, f"{grant}:\n\n{condition}."),
        (3, "Licensed under the Apache License, Version 2.0. All rights reserved!"),
        (4, "we like the MIT license a lot"),
        (5, None),
        (6, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_known, r.licenses) for r in found} == {
        1: (1, "MIT"),
        2: (1, "MIT") if ":" in grant else (2, "MIT"),
        3: (2, "Apache-2.0,Proprietary"),
        4: (0, ""),
        5: (0, ""),
        6: (2, "CC-BY-NC-4.0"),
    }
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(empty).count() == 0


def test_quality_rules(docs, empty):
    found = quality_rules.quality(docs).collect()
    assert len(found) == docs.count()
    text = dict(rows_of(docs))
    for r in found:
        t = text[r.doc_id] or ""
        w = words(t)
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        seen, repeated = set(), 0
        for line in t.split("\n"):
            if words(line):
                repeated += line in seen
                seen.add(line)
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        expected = (len(w), sum(map(len, w)), symbols, repeated, len(again))
        assert tuple(r[1:6]) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in found)
    assert quality_rules.quality(empty).count() == 0
    assert quality_rules.kept(empty).count() == 0


def test_fences_catch_what_a_group_does_not_do(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(80)), "en", "a") for i in range(150)]
    rows += [(1000 + i, " ".join(rng.choice(VOCABULARY) + "***" for _ in range(80)), "en", "a") for i in range(5)]
    found = quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in found.collect() if not r.kept} == set(range(1000, 1005))


def test_pii(docs, empty):
    pieces = ["a.b+c@mail7.example.com", "x@y", "@", "1.2.3.4", "999.1.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111"]
    pieces += ["5500-0000-0000-0004", "4111111111111112", "+1 (017) 555-7713", "+12", "+" + "9" * 20, "é", " ", "\n", "12"]
    pieces += ["0" * 400 + "1.2.3.4", "DE89370400440532013000", 'token = "04d' + "a1" * 20 + '"', "b@c.d@e.f"]
    rng = random.Random(6)
    cases = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(500)]
    for text in cases:
        base, every = pii.spans(text)
        expected = []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
            expected.append((m.start(), 0, m.end()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(x) <= 255 for x in m[0].split(".")):
                expected.append((m.start(), 1, m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[ -]", "", m[0])
            total = sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(digits[::-1]))
            if 14 <= len(digits) <= 19 and total % 10 == 0:
                expected.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                expected.append((m.start(), 3, m.end()))
        assert base == [(pii.BASE[k], s, e) for s, k, e in sorted(expected)], text
        assert set(base) <= set(every)
    _, every = pii.spans('iban DE89370400440532013000 and token = "' + "a1" * 20 + '"')
    assert [x[0] for x in every] == ["iban", "secret"]
    assert pii.spans("DE89370400440532013001 " + "a1" * 20)[1] == []
    assert pii.mask("mail a@b.cd or 1.2.3.4", pii.spans("mail a@b.cd or 1.2.3.4")[1]) == "mail [EMAIL] or [IP]"
    assert pii.scan(docs).count() == docs.count()
    assert pii.scan(empty).count() == 0
    out = pii.masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    vocabulary = [f"q{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (30, 18, 12, 7, 4)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(10)]

    def planted(text, every):
        own = text.upper().split()
        for at in range(every, len(own), every):
            own[at] = "other"
        return f"{clean[0]}, {' '.join(own)}. {clean[1]}"

    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, planted(t, 1000)) for i, t in enumerate(items)]
    rows += [(200, planted(items[0], 7)), (201, planted(items[1], 9)), (None, planted(items[0], 1000)), (300, None)]
    rows += [rows[-4], (301, items[0].split(" ", 10)[-1]), (302, " ".join(items[0].split()[:11]))]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(own, bench).collect()}
    assert found == {(100, 0), (101, 1), (102, 2), (103, 3), (200, 0), (201, 1), (None, 0), (301, 0)}
    left = decontaminate.clean(own, bench)
    gone = {100, 101, 102, 103, 200, 201, 301, None}
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in rows if d not in gone)
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(own, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_quality_model(spark, docs, empty):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(rng.choice(VOCABULARY) + ("" if good else rng.choice(["***", "%%%", " |"])) for _ in range(150))
        rows.append((i, text))
        labels.append((i, int(good) if i % 50 else None, "x"))
    rows += [(1000, ""), (1001, None), (None, "some words")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality_model.fit(own, marks, sample=300)
    found = {r.doc_id: r for r in quality_model.scored(own, model).collect()}
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    held = [(r, i % 3 > 0) for i, r in found.items() if i is not None and i < 600 and r.held_out]
    assert len(held) > 60 and sum(r.predicted == good for r, good in held) >= 0.95 * len(held)
    assert found[1000].score == found[1001].score
    again = quality_model.fit(own.repartition(3), marks, sample=300)
    assert all(abs(a - b).max() < 1e-6 for a, b in zip(model.p.values(), again.p.values(), strict=True))
    assert quality_model.scored(docs, quality_model.fit(docs, marks.limit(0))).count() == docs.count()
    assert quality_model.scored(empty, model).count() == 0


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(1)
    x, first, label = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality_model.Model(np.zeros(5), np.ones(5))

    def loss():
        s = model.score(x, first)
        fit = -np.mean(label * np.log(s) + (1 - label) * np.log(1 - s))
        return fit + sum(quality_model.DECAY / 2 * (v**2).sum() for k, v in model.p.items() if k != "b")

    grads = model.gradients(model.forward(x, first), first, label)
    for name, grad in grads.items():
        for at in np.ndindex(grad.shape):
            model.p[name][at] += 1e-6
            high = loss()
            model.p[name][at] -= 2e-6
            low = loss()
            model.p[name][at] += 1e-6
            assert abs((high - low) / 2e-6 - grad[at]) < 1e-5


def test_decontamination_finds_every_one_and_two_word_change(spark):
    from itertools import combinations

    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(5, 20)]
    rows, expected = [], set()
    for n, text in items:
        for changes in (1, 2, 3):
            # From 15 words on, a fifth of the words are three; of those, a part is enough here.
            for places in list(combinations(range(n), changes))[:: 1 if changes < 3 else 7]:
                own = text.split()
                for place in places:
                    own[place] = "other"
                rows.append((len(rows), " ".join(["before it", *own, "after it"])))
                if (n - changes) * 100 >= n * 80:
                    expected.add((rows[-1][0], n, n - changes))
        rows.append((len(rows), text.split(" ", 1)[1]))
        expected.add((rows[-1][0], n, n - 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    enough = {(r.doc_id, r.item_id, r.n_matched) for r in found}
    assert expected <= enough
    # What else is found has a long segment.
    assert all(m >= decontaminate.LEAST_MATCHES for _, _, m in enough - expected)


def test_seeds_of_three_changes_in_fifteen_to_nineteen_words():
    from itertools import combinations

    for n in range(15, 20):
        fits = [{x + at for x in m} for _, m in decontaminate.masks([]) for at in range(n - m[-1])]
        assert all(any(not own & set(places) for own in fits) for places in combinations(range(n), 3))


def test_ibans_end_where_their_country_says():
    def found(text):
        return [text[s:e] for kind, s, e in pii.spans(text)[1] if kind == "iban"]

    plain, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for after in ("", " BIC COBADEFF", " BIC: COBADEFFXXX", " 12345", " EUR 100", " AMOUNT 5", ".", ", X", "\nBIC"):
        for own in (plain, spaced, plain.lower(), spaced.lower()):
            assert found(f"IBAN: {own}{after}") == [own], (own, after)
            assert found(f"Pay to {own}{after}") == [own], (own, after)
    assert found("GB82 WEST 1234 5698 7654 32 BIC WESTGB2L NL91ABNA0417164300 INGB") == [
        "GB82 WEST 1234 5698 7654 32",
        "NL91ABNA0417164300",
    ]
    assert found(f"an example {plain} here") == []
    assert found(f"example account {plain} here") == [plain]
    assert found(f"x{plain}") == found(f"{plain}x") == found("IBAN DE88370400440532013000") == []
    text = f"IBAN {spaced} BIC COBADEFF"
    assert pii.mask(text, pii.spans(text)[1]) == "IBAN [IBAN] BIC COBADEFF"


def test_licenses_of_common_texts(spark):
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    name = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    lesser = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy is missing"
    cases = [(bsd, "BSD-2-Clause"), (bsd + name, "BSD-3-Clause"), (isc, "ISC"), (mpl, "MPL-2.0"), (lesser, "LGPL-2.1-or-later")]
    for old, new in (("Lesser General", "General"), ("Lesser", "Affero")):
        for version in ("2", "3") if old == "Lesser General" else ("3",):
            own = "AGPL" if new == "Affero" else "GPL"
            cases.append((lesser.replace(old, new).replace("2.1", version), f"{own}-{version}.0-or-later"))
    epl = "are made\n * available under the terms of the Eclipse Public License"
    for version in ("2.0", "v. 2.0"):
        place = "which is\n * available at https://www.eclipse.org/legal/epl-2.0/"
        cases.append((f" * This program and the accompanying materials {epl} {version} {place}\n", "EPL-2.0"))
    cases += [("This is free and unencumbered software released into the public domain.", "Unlicense")]
    cases += [("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Released under the BSD 3-Clause License", "BSD-3-Clause")]
    cases += [(f"x = 1\n# SPDX-License-Identifier: {x}\n", x) for x in licenses._NAMED]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    assert {cases[i][0]: x for i, x in found.items()} == dict(cases)
