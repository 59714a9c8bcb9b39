"""Garbage collection below a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_garbage(versions: DataFrame, watermark: int | None, keep_readable: bool = False) -> DataFrame:
    """``versions`` with ``removed``.

    Committed versions below the key's latest committed one go if older than
    the watermark; then a key goes whose only version left is an old tombstone.
    Intents stay.  ``keep_readable`` (strict mode) keeps what a reader at the
    watermark still sees.  Without a watermark, or at 0, nothing goes.
    """
    has_intents = "is_intent" in versions.columns
    rows = versions if has_intents else versions.withColumn("is_intent", F.lit(False))
    if not watermark:
        out = rows.withColumn("removed", F.lit(False))
        return out if has_intents else out.drop("is_intent")
    key = Window.partitionBy("key")
    latest = F.max(F.when(~F.col("is_intent"), F.col("chain_pos"))).over(key)
    old = F.col("commit_ts") < watermark
    first = ~F.col("is_intent") & (F.col("chain_pos") < latest) & old
    if keep_readable:
        first &= F.col("chain_pos") < F.max(F.when(~F.col("is_intent") & (F.col("commit_ts") <= watermark), F.col("chain_pos"))).over(key)
    out = rows.withColumn("__first", first)
    left = F.sum((~F.col("__first")).cast("int")).over(key)
    second = ~F.col("__first") & (left == 1) & F.col("is_deleted") & ~F.col("is_intent") & old
    out = out.withColumn("removed", F.col("__first") | second).drop("__first")
    return out if has_intents else out.drop("is_intent")


def survivors(versions: DataFrame, watermark: int | None, keep_readable: bool = False) -> DataFrame:
    return mark_garbage(versions, watermark, keep_readable).where("not removed").drop("removed")


def removed_counts(versions: DataFrame, watermark: int | None) -> DataFrame:
    """``key``, ``removed`` for keys that lose versions."""
    return mark_garbage(versions, watermark).groupBy("key").agg(F.count_if("removed").alias("removed")).where("removed > 0")
