"""A filter of 2 MB from hashes: it lets every row pass whose hash is among them, and few others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 24


def position_filter(hashes: DataFrame) -> Callable[[Column], Column]:
    """The test for a hash. ``hashes`` has one column ``h`` of 64 bits; what reaches the driver is at most one row
    per byte of the filter."""
    at = hashes.select(F.pmod("h", F.lit(FILTER_BITS)).alias("at"))
    filled = bytearray(FILTER_BITS // 8)
    bytes_of = at.groupBy(F.shiftright("at", 3).cast("int").alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(at % 8 as int))")).alias("bits")
    )
    for row in bytes_of.collect():
        filled[row["byte"]] = row["bits"]
    table = hashes.sparkSession.createDataFrame([(filled,)], "bits binary").scalar()

    def test(value: Column) -> Column:
        place = F.pmod(value, F.lit(FILTER_BITS))
        byte = F.substring(table, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1

    return test
