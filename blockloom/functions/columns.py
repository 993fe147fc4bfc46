"""Scalar functions of the codec as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions.parse import BEYOND, TIERS

# The multiplier of the four-byte hash, and the sizes at which its table grows.
MULTIPLIER = 0x9E3779B1
TABLE_LOGS = ((16 * 1024 * 1024, 13), (128 * 1024 * 1024, 15))
LARGEST_LOG = 17


def u32(payload: Column, at: int = 1) -> Column:
    """The little-endian 32-bit value at a byte position (from 1) of a BINARY column."""
    parts = [F.conv(F.hex(F.substring(payload, at + k, 1)), 16, 10).cast("long") * (1 << (8 * k)) for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def hash4(value: Column, log: int) -> Column:
    """((value * multiplier mod 2^32) >> 10) & (2^log - 1), in halves so that nothing overflows."""
    low, high = value.bitwiseAND(F.lit(65535)), F.shiftrightunsigned(value, 16)
    product = (low * MULTIPLIER + F.shiftleft((high * MULTIPLIER).bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(4294967295))
    return F.shiftrightunsigned(product, 10).bitwiseAND(F.lit((1 << log) - 1))


def table_log(size: Column) -> Column:
    """Hash bits for an input of ``size`` bytes."""
    found = F.lit(LARGEST_LOG)
    for bound, log in reversed(TABLE_LOGS):
        found = F.when(size < bound, F.lit(log)).otherwise(found)
    return found


def min_match_length(distance: Column) -> Column:
    found = F.lit(BEYOND)
    for bound, n in reversed(TIERS):
        found = F.when(distance < bound, F.lit(n)).otherwise(found)
    return found


def effort(level: Column) -> Column:
    """Search attempts of a level; 0 or less means the default, 2."""
    return F.when((level >= 2) | (level <= 0), F.lit(32)).otherwise(F.lit(4))


def varint_length(value: Column) -> Column:
    """Bytes of the LEB128 form of an unsigned 32-bit value."""
    found = F.lit(5)
    for n in (4, 3, 2, 1):
        found = F.when(value < 1 << (7 * n), F.lit(n)).otherwise(found)
    return found


def varint_encode(value: Column) -> Column:
    """LEB128 as BINARY."""
    n = varint_length(value)
    groups = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.lpad(F.hex(F.floor(value / F.pow(F.lit(2.0), 7 * i)).cast("long").bitwiseAND(F.lit(127)) + F.when(i < n - 1, F.lit(128)).otherwise(F.lit(0))), 2, "0"),
    )
    return F.unhex(F.array_join(groups, ""))


def compress_bound(size: Column) -> Column:
    """Most bytes that an encoding of ``size`` bytes takes."""
    return (size + F.floor(size / 8) + 1024).cast("long")


def capacity_status(size: Column, capacity: Column) -> Column:
    """0 if an encoding surely fits, -1 if the capacity is too small, -2 for null."""
    return F.when(size.isNull() | capacity.isNull(), F.lit(-2)).when(compress_bound(size) > capacity, F.lit(-1)).otherwise(F.lit(0))
