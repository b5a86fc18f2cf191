"""Deterministic samples and bit masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """0 to buckets - 1 from the first 32 bits of an md5: the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def hash_sample(key: Column, percent: int = 8) -> Column:
    return hash_bucket(key) < percent


def has_bit(mask: Column, bit: int) -> Column:
    return F.shiftright(mask, bit).bitwiseAND(1) == 1


def any_mask(masks: list[Column]) -> Column:
    """Whether any bit of any mask is set; false without masks."""
    return reduce(lambda a, b: a.bitwiseOR(b), masks) != 0 if masks else F.lit(False)


def bit_of(bit: Column) -> Column:
    """A long with one bit set; ``bit`` may be a column."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
