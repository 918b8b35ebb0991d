"""Registration of queries with their checking SQL, and composition of shared SQL parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillclose.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], sql: str) -> None:
    """A named common table expression and the parts it reads."""
    _PARTS[name] = (needs, sql)


def _order(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _order(_PARTS[name][0], seen)
            seen.append(name)
    return seen


def compose(needs: list[str], sql: str, recursive: bool = False) -> str:
    """``WITH`` clause of all parts needed, followed by the final select. A part that several read is
    computed once."""
    names = _order(needs, [])
    readers = [reader for name in names for reader in _PARTS[name][0]] + needs
    kinds = {name: "AS MATERIALIZED" if readers.count(name) > 1 else "AS" for name in names}
    parts = ",\n".join(f"{name} {kinds[name]} ({_PARTS[name][1]})" for name in names)
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {parts}\n{sql}" if parts else sql


def query(name: str, needs: list[str] | None = None, sql: str | None = None, recursive=False):
    """Register a query; ``sql`` is its check, left out where SQL cannot express it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = compose(needs or [], sql, recursive)
        return fn

    return register
