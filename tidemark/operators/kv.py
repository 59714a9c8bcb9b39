"""The plain store: blind writes, point lookups, size; disjoint from the versioned one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_values(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append writes; the last one of a key wins."""
    return log.unionByName(rows.withColumn("is_deleted", F.lit(False)).select(*log.columns))


def delete_keys(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append tombstones for ``rows`` (seq, key)."""
    return log.unionByName(rows.select("seq", "key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("is_deleted")).select(*log.columns))


def current(log: DataFrame) -> DataFrame:
    """``key``, ``value`` of every live key."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "is_deleted"), "seq").alias("v"))
    return last.where("not v.is_deleted").select("key", "v.value")


def get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """``key``, ``found``, ``value`` for each row of ``keys``; only their part of the log is aggregated."""
    wanted = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.join(current(wanted).withColumn("hit", F.lit(True)), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def get_in_log(log: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (seq, key), what the key held just before it in the log."""
    both = log.select("key", "seq", F.struct("value", "is_deleted").alias("w"), F.lit(False).alias("ask")).unionByName(requests.select("key", "seq", F.lit(None).cast("struct<value:binary,is_deleted:boolean>").alias("w"), F.lit(True).alias("ask")))
    before = Window.partitionBy("key").orderBy("seq", F.col("ask").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("w", F.last("w", ignorenulls=True).over(before)).where("ask")
    live = F.col("w").isNotNull() & ~F.coalesce(F.col("w.is_deleted"), F.lit(False))
    return seen.select("seq", "key", live.alias("found"), F.when(live, F.col("w.value")).alias("value"))


def size(log: DataFrame) -> DataFrame:
    return current(log).agg(F.count("*").alias("n_keys"))


def clear(table: DataFrame) -> DataFrame:
    """Nothing of a store is left, its schema is."""
    return table.limit(0)
