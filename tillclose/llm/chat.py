"""Chat formatting in budgeted windows of whole turns.

Prefix sums of the turns' token counts choose spans of turns: a window holds the system turn, a limited
history repeated from the window before, and as many new turns as the budget allows. Every turn is new
in exactly one window, so the loss mask (the texts of new assistant turns) has each assistant text
once; repeated turns are masked out. A turn longer than the budget gets a window of its own.

The template is ``[TURN role]text</s>`` per turn. Inside roles and texts, a backslash goes before every
backslash, ``[`` and ``<``, so no text can contain a mark, and removing it gives the text back.

The unit of work is a segment: ``SEGMENT`` consecutive turns of a conversation, and a segment begins a
window. Longer conversations are sorted and numbered over many tasks; a later segment also gets the
system turn and the turns before it that its history can repeat. No task holds a longer conversation.
Digests of a whole conversation are a chain over its segments by definition of the hash, so for longer
ones that last step streams its segments in order, one at a time in memory.

Nulls and edge cases: a null text or role is empty; turns are ordered by turn (nulls first), role, the
first 64 characters of the text, then a hash of it, so ties have one order and repeated rows stay
repeated turns; rows with a null ``conv_id`` are one conversation; an empty table gives no windows.
Other columns do not travel.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillclose.llm.frames import written
from tillclose.llm.token_counts import counts

BUDGET, HISTORY, SEGMENT = 2048, 512, 4096
_TIE = 64
_SPECIAL, _ESCAPED = re.compile(r"[\\\[<]"), re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[TURN ((?:\\.|[^\\\[<\]])*)\]((?:\\.|[^\\\[<])*)</s>", re.DOTALL)
_OPEN, _MIDDLE, _CLOSE = "[TURN ", "]", "</s>"
WINDOWS = (
    "conv_id long, segment long, n_segments long, window int, text string, tokens long, "
    "n_repeated int, n_new int, loss array<struct<start:int,end:int>>"
)
_WINDOW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("segment", pa.int64()),
        ("n_segments", pa.int64()),
        ("window", pa.int32()),
        ("text", pa.string()),
        ("tokens", pa.int64()),
        ("n_repeated", pa.int32()),
        ("n_new", pa.int32()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_windows long, max_tokens long"
)
#: A segment read back: digests if it is the whole conversation, else what the digests go over.
_SEGMENTS = f"{DIGESTS}, segment long, n_segments long, turns binary, loss binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])



def escaped(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _role(role: str) -> str:
    # The mark of a role ends at "]", so that is escaped there as well.
    return escaped(role).replace("]", "\\]")


def spans(
    sizes: list[int], system: bool, budget: int, history: int, first: int = 0
) -> list[tuple[int, int, int]]:
    """``(history start, first new, end)`` of every window over turns of these sizes; turns before
    ``first`` are only repeated."""
    sums = [0, *accumulate(sizes)]
    head = sizes[0] if system else 0
    out = []
    while first < len(sizes):
        own = 1 if system and first > 0 else 0
        room = budget - (head if own else 0)
        # The earliest turn that still fits the history limit, but only if one new turn fits too.
        limit = min(history, max(0, room - sizes[first]))
        back = min(max(bisect_left(sums, sums[first] - limit), own), first) if first else 0
        end = bisect_right(sums, sums[back] + room) - 1
        end = max(end, first + 1)
        out.append((back, first, end))
        first = end
    return out


def _format(path: str, budget: int, history: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(list(_TURNS)).to_pylist()
        segment, n_segments, conv = (rows[0][x] for x in ("segment", "n_segments", "conv_id"))
        # Where a conversation has one segment, its turns are numbered here.
        rows.sort(
            key=lambda r: (
                r["position"] or 0, r["turn"] is not None, r["turn"] or 0, r["role"], r["text"][:_TIE], r["tie"]
            )
        )
        begin = sum(r["guest"] for r in rows)
        if begin == len(rows):
            return _WINDOW.empty_table()
        turns = [(r["role"], r["text"]) for r in rows]
        heads = [f"{_OPEN}{_role(role)}{_MIDDLE}" for role, _ in turns]
        bodies = [escaped(text) for _, text in turns]
        sizes = counts(path).totals([f"{h}{b}{_CLOSE}" for h, b in zip(heads, bodies, strict=True)])
        system = turns[0][0] == "system" and (rows[0]["position"] or 0) == 0
        out = []
        for number, (back, first, end) in enumerate(spans(sizes, system, budget, history, begin)):
            shown = [*([0] if system and first > 0 else []), *range(back, end)]
            parts, loss, at = [], [], 0
            for i in shown:
                start = at + len(heads[i])
                at = start + len(bodies[i]) + len(_CLOSE)
                parts += [heads[i], bodies[i], _CLOSE]
                if i >= first and turns[i][0] == "assistant":
                    loss.append({"start": start, "end": at - len(_CLOSE)})
            tokens = sum(sizes[i] for i in shown)
            new = end - first
            values = (conv, segment, n_segments, number, "".join(parts), tokens, len(shown) - new, new, loss)
            out.append(dict(zip(_WINDOW.names, values, strict=True)))
        return pa.Table.from_pylist(out, _WINDOW)

    return run


_TURNS = ("conv_id", "turn", "role", "text", "tie", "position", "segment", "n_segments", "guest")


def segments(turns: DataFrame, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """Turns with the segment they are new in, and once more as guests of later segments that may
    repeat them."""
    own = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    long = own.groupBy("conv_id").count().filter(F.col("count") > segment)
    long = written(long.select(F.col("conv_id").alias("_c"), F.col("count").alias("total")), "long")
    match = F.col("conv_id").eqNullSafe(F.col("_c"))
    one = own.join(long, match, "left_anti").selectExpr(
        "*", "CAST(NULL AS long) AS position", "0L AS segment", "1L AS n_segments", "FALSE AS guest"
    )
    # Equal turns are told apart by a row number, so that a range can end between them.
    many = own.join(long, match).drop("_c").withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", F.substring("text", 1, _TIE), "tie", "row"]
    many = many.repartitionByRange(*order).sortWithinPartitions(*order)
    many = many.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    many = written(many.drop("row"), "ordered")
    # One row per conversation and task: where its turns begin there, and how many come before.
    runs = many.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("low"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("conv_id").alias("_c"),
        F.col("part").alias("_p"),
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("low")).alias("shift"),
    )
    runs = written(runs, "runs")
    many = many.join(runs, match & (F.col("part") == F.col("_p"))).withColumn("position", F.expr("at + shift"))
    many = many.withColumn("segment", F.expr(f"position DIV {segment}"))
    many = many.withColumn("n_segments", F.expr(f"(total + {segment - 1}) DIV {segment}"))
    reach = min(history, segment - 1)
    more = many.filter("segment + 1 < n_segments").filter(f"position % {segment} >= {segment - reach}")
    more = more.withColumn("segment", F.expr("segment + 1"))
    heads = many.filter("position = 0 AND role = 'system'")
    heads = heads.withColumn("segment", F.explode(F.expr("sequence(1L, n_segments - 1)")))
    guests = more.unionByName(heads).withColumn("guest", F.lit(True))
    many = many.withColumn("guest", F.lit(False)).unionByName(guests)
    return one.select(*_TURNS).unionByName(many.select(*_TURNS))


def windows(
    turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT
) -> DataFrame:
    """Formatted windows of conversations ``(conv_id, turn, role, text)``, by segment and window."""
    groups = segments(turns, history, segment).groupBy("conv_id", "segment")
    return groups.applyInArrow(_format(path, budget, history), WINDOWS)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window; every character belongs to a turn."""
    out, at = [], 0
    for match in _TURN.finditer(text):
        if match.start() != at:
            raise ValueError(f"not a turn at {at}")
        out.append((unescaped(match[1]), unescaped(match[2])))
        at = match.end()
    if at != len(text):
        raise ValueError(f"not a turn at {at}")
    return out


def _read(table: pa.Table) -> pa.Table:
    """One segment, from its windows."""
    schema = _schema(_SEGMENTS)
    rows = sorted(table.to_pylist(), key=lambda r: r["window"])
    if not rows:
        return schema.empty_table()
    turns, loss, n_turns = [], [], 0
    for row in rows:
        for role, text in parsed(row["text"])[row["n_repeated"] :]:
            turns.append(f"{role}\n{text}\n")
            n_turns += 1
        loss += [unescaped(row["text"][x["start"] : x["end"]]) for x in row["loss"]]
    turns, loss = "".join(turns).encode(), "".join(loss)
    whole = rows[0]["n_segments"] == 1
    values = {
        "conv_id": rows[0]["conv_id"],
        "n_turns": n_turns,
        "turns_sha256": hashlib.sha256(turns).hexdigest() if whole else None,
        "loss_chars": len(loss),
        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest() if whole else None,
        "formatted_chars": sum(len(r["text"]) for r in rows),
        "n_windows": len(rows),
        "max_tokens": max(r["tokens"] for r in rows),
        "segment": rows[0]["segment"],
        "n_segments": rows[0]["n_segments"],
        "turns": None if whole else turns,
        "loss": None if whole else loss.encode(),
    }
    return pa.Table.from_pylist([values], schema)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests over segments that come in order; holds one batch and the state of two hashes."""
    schema, now, turns, loss = _schema(DIGESTS), None, None, None

    def ended() -> pa.RecordBatch:
        done = now | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}
        return pa.RecordBatch.from_pylist([done], schema)

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield ended()
                now, turns, loss = {"conv_id": row["conv_id"], "max_tokens": 0}, hashlib.sha256(), hashlib.sha256()
            turns.update(row["turns"])
            loss.update(row["loss"])
            for name in ("n_turns", "loss_chars", "formatted_chars", "n_windows"):
                now[name] = now.get(name, 0) + row[name]
            now["max_tokens"] = max(now["max_tokens"], row["max_tokens"])
    if now is not None:
        yield ended()


def _digests(read: DataFrame) -> DataFrame:
    read = written(read, "read")
    one = read.filter("n_segments = 1").select(*_schema(DIGESTS).names)
    many = read.filter("n_segments > 1").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return one.unionByName(many.mapInArrow(_chain, DIGESTS))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, parsed from stored windows."""
    return _digests(formatted.groupBy("conv_id", "segment").applyInArrow(_read, _SEGMENTS))


def round_trip(
    turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT
) -> DataFrame:
    """``read_back`` of ``windows``; a segment is read where it was formatted, so texts move once."""
    form = _format(path, budget, history)

    def run(table: pa.Table) -> pa.Table:
        return _read(form(table))

    groups = segments(turns, history, segment).groupBy("conv_id", "segment")
    return _digests(groups.applyInArrow(run, _SEGMENTS))
