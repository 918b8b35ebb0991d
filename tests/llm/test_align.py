"""Cross-tokenizer alignment against the two libraries and a byte-by-byte version."""

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_operators import SCHEMA
from tillclose.llm import align, queries

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
FOLDER = "/root/testdata/sf0.001"


def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def encode(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return left, right

    return encode


def brute(rows):
    """Every byte names the two tokens it belongs to."""
    encode, docs, held = libraries(), [], Counter()
    for doc, text in rows:
        left, right = encode(text) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if any(b"".join(x for _, x in side) != whole for side in (left, right)):
            left, right = [], []
        owner = [[k for k, (_, data) in enumerate(side) for _ in data] for side in (left, right)]
        links = sorted(set(zip(*owner, strict=True)))
        groups, at = [], 0
        for end in range(1, len(owner[0]) + 1):
            if end == len(owner[0]) or all(side[end] != side[end - 1] for side in owner):
                parts = [sorted(set(side[at:end])) for side in owner]
                groups.append("|".join(",".join(str(x[k][0]) for k in p) for x, p in zip((left, right), parts)))
                at = end
        pairs = [(left[i][0], right[j][0]) for i, j in links]
        held.update(set(pairs))
        digest = sha256(";".join(groups).encode()).hexdigest() if groups else ""
        docs.append((doc, len(left), len(right), len(groups), pairs, digest))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = [
        (doc, a, b, n, len(p), sum(held[x] == most[x[0]] for x in p), sum(held[x] for x in p), digest)
        for doc, a, b, n, p, digest in docs
    ]
    return out, held, most


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(found, expected):
    mine = [tuple(r[x] for x in NAMES) for r in found]
    assert sorted(map(repr, mine)) == sorted(map(repr, expected))


def odd():
    rng = random.Random(3)
    letters = "ab  e\n\t.,'s0€é漢🙂́\x00▁<|endoftext|></s><0x0A>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    texts += [None, "", " ", "  x", "▁", "<|endoftext|> a </s>", "x" * 3000, "the cat. " * 400, "same", "same"]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, "twice"), (5, "other")]


def test_odd_texts(spark):
    rows = odd()
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "k", "w", "s", 1, 2) for d, t in rows], SCHEMA).repartition(3)
    expected, held, most = brute(rows)
    same(align.alignment(docs, A, B).collect(), expected)
    table = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in align.id_pairs(docs, A, B).collect()}
    assert table == {k: (n, n == most[k[0]]) for k, n in held.items()}
    texts = {r.doc_id: r.groups for r in align.groups(docs.filter("doc_id = 118"), A, B).collect()}
    assert all(g.a and g.b for g in texts[118])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert align.alignment(docs, A, B).collect() == []
    assert align.id_pairs(docs, A, B).collect() == []
    assert align.alignment(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).first()[1:] == (0,) * 6 + ("",)


def test_query(spark):
    expected, _, _ = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()])
    same(queries.op11_tokenizer_alignment(spark, FOLDER).collect(), expected)
