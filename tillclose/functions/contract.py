"""Field rules of the row contract, each as one boolean or canonical-value Column.

Patterns are anchored with ``\\A`` and ``\\z`` because ``$`` would accept a trailing newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillclose.schemas import BUSINESS_ZONE

# Fixed patterns of the contract.
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,63}\z"
SHA256 = r"\A[0-9a-f]{64}\z"
DIGITS = r"\A[0-9]{1,12}\z"
MONEY = r"\A[0-9]+(\.[0-9]{1,2})?\z"
INSTANT = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(\.[0-9]{1,6})?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
)
FIRST_MICROS = -62135596800000000  # 0001-01-01T00:00:00Z
LAST_MICROS = 253402300799999999  # 9999-12-31T23:59:59.999999Z


def matches(value: Column, pattern: str) -> Column:
    """``rlike`` that is false, never null, on a missing value."""
    return F.coalesce(value.rlike(pattern), F.lit(False))


def valid_identifier(value: Column) -> Column:
    return matches(value, IDENTIFIER)


def bounded_integer(value: Column, maximum: int) -> Column:
    """Canonical number in 1..maximum, null when the text breaks the rule."""
    number = F.when(matches(value, DIGITS), value.try_cast("bigint"))
    return F.when(number.between(1, maximum), number)


def bounded_money(value: Column, maximum: str) -> Column:
    """Exact amount with two decimals, null when the text breaks the rule."""
    amount = F.when(
        matches(value, MONEY) & (F.length(value) <= 32), value.try_cast("decimal(34,2)")
    )
    return F.when(amount <= F.lit(maximum).cast("decimal(34,2)"), amount)


def offset_micros(value: Column) -> Column:
    """UTC microseconds of an ISO-8601 text; only meaningful where ``usable_instant`` holds.

    The offset is applied by hand because the contract allows up to 23:59, more than the
    built-in parser takes.
    """
    zulu = value.endswith("Z")
    local = F.when(zulu, value).otherwise(
        F.concat(value.substr(F.lit(1), F.length(value) - 6), F.lit("Z"))
    )
    sign = F.when(value.substr(-6, 1) == "-", -1).otherwise(1)
    minutes = F.when(zulu, 0).otherwise(
        sign * (value.substr(-5, 2).try_cast("int") * 60 + value.substr(-2, 2).try_cast("int"))
    )
    return F.unix_micros(local.try_cast("timestamp")) - minutes.cast("bigint") * 60000000


def usable_instant(value: Column, micros: Column) -> Column:
    """Right form, a local year above 0, and a UTC instant within years 1 to 9999."""
    return (
        matches(value, INSTANT)
        & ~value.startswith("0000")
        & micros.between(FIRST_MICROS, LAST_MICROS)
    )


def instant(value: Column) -> Column:
    """UTC instant of an ISO-8601 text with a mandatory offset, null when invalid."""
    micros = offset_micros(value)
    return F.when(usable_instant(value, micros), F.timestamp_micros(micros))


def business_day(moment: Column) -> Column:
    """Calendar day of an instant in the business time zone."""
    return F.to_date(F.from_utc_timestamp(moment, BUSINESS_ZONE))


def within_calendar(moment: Column) -> Column:
    """Does the business day of the instant exist? Year 1 may underflow in the local zone."""
    return business_day(moment) >= F.lit("0001-01-01").cast("date")


def instant_text(moment: Column) -> Column:
    """Canonical rendering: UTC, microseconds, explicit offset."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
