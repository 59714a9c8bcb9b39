"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import BACKOFF_BASE, BACKOFF_MOST, BACKOFF_STREAK, PRIORITY_LEAST, PRIORITY_MOST, PRIORITY_NORMAL

_MASK32 = (1 << 32) - 1
_CRC_DELTA = 0xA282EAD8


def owner(key: Column, cores: int) -> Column:
    """The core that owns a key, from its md5 (DuckDB can compute it, too)."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(cores)).cast("int")


def fast_owner(key: Column, cores: int) -> Column:
    """The same by xxhash64, for layouts that nothing else has to agree with."""
    return F.pmod(F.xxhash64(key), F.lit(cores)).cast("int")


def backoff_high(streak: Column, priority: Column) -> Column:
    """The longest wait after ``streak`` conflicts, in ms: doubling, scaled by priority, limited."""
    grown = F.lit(BACKOFF_BASE).cast("bigint") * F.element_at(F.array(*[F.lit(1 << k) for k in range(BACKOFF_STREAK + 1)]), F.least(streak.cast("int"), F.lit(BACKOFF_STREAK)) + 1)
    safe = F.greatest(F.lit(PRIORITY_LEAST), F.least(F.lit(PRIORITY_MOST), priority)).cast("bigint")
    return F.least(F.floor(grown * PRIORITY_NORMAL / safe), F.lit(BACKOFF_MOST)).cast("bigint")


def backoff_low(streak: Column, priority: Column) -> Column:
    return F.floor(backoff_high(streak, priority) / 2).cast("bigint")


def backoff_jitter(streak: Column, priority: Column, *seed: Column) -> Column:
    """A wait between the bounds, inclusive, from the md5 of ``seed`` (DuckDB can compute it, too)."""
    low, high = backoff_low(streak, priority), backoff_high(streak, priority)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", *(x.cast("string") for x in seed)).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return low + F.pmod(drawn, high - low + 1)


def nearest_rank(value: str, share: float) -> Column:
    """The nearest-rank percentile of a numeric column in its group, 0 for an empty one."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").cast("double"), F.lit(0.0))


def crc_mask(crc: Column) -> Column:
    """Rotate right by 15 bits and add a constant, within 32 bits."""
    turned = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(_MASK32))
    return (turned + _CRC_DELTA).bitwiseAND(F.lit(_MASK32))


def crc_unmask(masked: Column) -> Column:
    turned = (masked - _CRC_DELTA).bitwiseAND(F.lit(_MASK32))
    return F.shiftleft(turned, 15).bitwiseOR(F.shiftrightunsigned(turned, 17)).bitwiseAND(F.lit(_MASK32))


def sample_key(row: Column, seed: int, keys: int) -> Column:
    """A key of a synthetic workload."""
    return F.concat(F.lit("key:"), F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(keys)).cast("string"))


def sample_is_read(row: Column, seed: int, read_ratio: float) -> Column:
    """Whether an operation of a synthetic workload reads."""
    return F.pmod(F.xxhash64(row, F.lit(seed), F.lit("op")), F.lit(1 << 30)) / float(1 << 30) < read_ratio


def to_value(text: Column) -> Column:
    """Text as the opaque bytes of a value."""
    return text.cast("binary")


def from_value(value: Column) -> Column:
    """The bytes of a value as upper-case hex, which any engine can compare."""
    return F.hex(value)
