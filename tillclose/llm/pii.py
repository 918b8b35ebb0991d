"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds and what confirms them: e-mail addresses (shape), IPv4 addresses (parts up to 255), payment cards
(14 to 19 digits, Luhn), phone numbers (international form, 10 to 15 digits), IBANs (mod 97) and secrets
(long hexadecimal strings). The first four are certain enough alone, whatever stands around them. An IBAN
ends where the length of its country says, whatever follows, and passes with its checksum unless words
that speak of samples lower its score; under a country code without a known length, every end is tried
and a word such as "account" must stand just before it. A secret starts below the threshold: it needs a
word such as "token" before it, and words that speak of samples or hashes lower the score.

All patterns run in linear time: runs of digits are matched once from their beginning and e-mail
addresses are found from their "@". Every whole text is read; rows are independent.

Nulls and edge cases: a null or empty text has no spans; null or repeated ``doc_id`` and further columns
are left as they are. Positions are code points, ends exclusive; spans of one kind never overlap, spans
of different kinds may and are masked together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tillclose.llm import text as tx

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
THRESHOLD, NEAR = 0.5, 40
# Patterns of the base kinds, with possessive runs of digits.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?= ?[A-Za-z0-9])")
_REST = re.compile(r"(?: ?[A-Za-z0-9]){11,30}")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Score before context, what a word nearby adds, and the words.
_START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "secret": 0.4}
#: Characters of an IBAN by country (fixed values of the IBAN registry).
_LENGTHS = {
    country: size
    for size, countries in {
        15: "NO",
        16: "BE",
        18: "DK FI FK FO GL NL SD",
        19: "MK SI",
        20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG YE",
        25: "LY PT ST",
        26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA",
        30: "JO KW MU",
        31: "MT SC",
        32: "LC",
        33: "RU",
    }.items()
    for country in countries.split()
}
_RAISE = {
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("token", "secret", "key", "password", "passwort", "api"),
}
_LOWER = ("example", "sample", "checksum", "sha256", "md5", "commit", "beispiel", "exemple", "ejemplo")
_STEP = 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        total += value if i % 2 == 0 else value * 2 - 9 * (value > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Check digits of an IBAN without blanks."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            free = end.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _base(text: str) -> dict[str, list[tuple[int, int]]]:
    """Confirmed spans of the four base kinds."""
    found = {kind: [] for kind in BASE}
    if "@" in text:
        found["email"] = list(_emails(text))
    for match in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in match.groups()):
            found["ip"].append(match.span())
    for match in _CARD.finditer(text):
        if match.end() - match.start() < 14:
            continue
        digits = match[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(match.span())
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= sum("0" <= x <= "9" for x in match[0]) <= 15:
                found["phone"].append(match.span())
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """Confidence of a span, from its kind and the words around it."""
    before = text[max(0, start - NEAR) : start].lower()
    around = before + " " + text[end : end + NEAR].lower()
    value = _START[kind]
    if any(word in before for word in _RAISE.get(kind, ())):
        value += _STEP
    if kind not in BASE and any(word in around for word in _LOWER):
        value -= _STEP
    return value


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for match in _IBAN.finditer(text):
        start = match.start()
        if start < free:
            continue
        known = _LENGTHS.get(match[0][:2].upper())
        rest = _REST.match(text, match.end())
        if not rest:
            continue
        # Ends of 15 to 34 characters, longest first, that no letter or digit follows.
        places = [at for at in range(match.end(), rest.end()) if text[at] != " "]
        sizes = [known] if known else range(len(places) + 4, 14, -1)
        for size in sizes:
            if size - 4 > len(places):
                continue
            end = places[size - 5] + 1
            if text[end : end + 1].isascii() and text[end : end + 1].isalnum():
                continue
            value = score(text, "iban", start, end) - (0 if known else _STEP)
            if value >= THRESHOLD and mod97(text[start:end].replace(" ", "")):
                free = end
                yield start, end
                break


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each ``(kind, start, end)`` in order of start and kind."""
    found: dict[str, list[tuple[int, int]]] = _base(text)
    found["iban"] = list(_ibans(text))
    found["secret"] = [
        m.span() for m in _SECRET.finditer(text) if score(text, "secret", *m.span()) >= THRESHOLD
    ]
    every = sorted(
        (start, KINDS.index(kind), end) for kind, own in found.items() for start, end in own
    )
    every = [(KINDS[k], start, end) for start, k, end in every]
    return [x for x in every if x[0] in BASE], every


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with spans replaced by the kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, digest of base spans and all spans of every text."""
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            found = [spans(x or "") for x in chunk.column("text").to_pylist()]
            counts = [
                pa.array([sum(x[0] == kind for x in base) for base, _ in found], pa.int64()) for kind in BASE
            ]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    *counts,
                    pa.array(digests, pa.string()),
                    pa.array([_joined(every) for _, every in found], pa.string()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def masked(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with personal data in ``text`` replaced; a null text stays null."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            texts = [x if x is None else mask(x, spans(x)[1]) for x in chunk.column(place).to_pylist()]
            yield chunk.set_column(place, "text", pa.array(texts, chunk.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
