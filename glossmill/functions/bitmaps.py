"""Bits of the bitmaps that ``bitmap_construct_agg`` makes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of one bitmap of ``bitmap_construct_agg``.
BITMAP_BITS = 1 << 15


def is_set(bitmap: Column, position: Column) -> Column:
    byte = F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(position, F.lit(8)).cast("int")) == 1
