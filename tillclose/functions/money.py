"""Exact decimal arithmetic: money is never a float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENT = "0.01"


def cents_to_money(cents: Column, kind: str = "decimal(18,2)") -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(CENT).cast("decimal(3,2)")).cast(kind)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null for a missing or zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def half_up(value: Column, places: int = 2) -> Column:
    return F.round(value, places)


def half_even(value: Column, places: int = 6) -> Column:
    return F.bround(value, places)
