"""Reads of the versioned store.

``versions`` has key, chain_pos, commit_ts, value, is_deleted (and is_intent,
tx_id where intents are among them).  A read at a snapshot sees, of the
versions committed at or before it, the last in chain order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SEEN = "struct<chain_pos:bigint,value:binary,is_deleted:boolean,commit_ts:bigint>"


def snapshot_read(versions: DataFrame, snapshot_ts: int) -> DataFrame:
    """What a read at ``snapshot_ts`` finds under every key; tombstones are found and marked. The filter reaches the scan if ``commit_ts`` is a stored column."""
    seen = versions.where(F.col("commit_ts") <= snapshot_ts).groupBy("key").agg(F.max(F.struct("chain_pos", "value", "is_deleted", "commit_ts")).alias("v"))
    return seen.select("key", "v.value", "v.is_deleted", "v.commit_ts")


def read_batch(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (request_id, key, snapshot_ts) with ``found``, ``value``, ``is_deleted``, ``commit_ts``.

    Versions and requests of a key are merged in the order of time and one
    pass carries the latest version: no pair of them is formed.
    """
    seen = F.struct(F.col("chain_pos").cast("bigint").alias("chain_pos"), "value", "is_deleted", "commit_ts")
    both = versions.select("key", F.col("commit_ts").alias("at"), F.lit(0).alias("kind"), seen.alias("v"), F.lit(None).cast("bigint").alias("request_id"))
    both = both.unionByName(requests.select("key", F.col("snapshot_ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(_SEEN).alias("v"), "request_id"))
    upto = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("v", F.max("v").over(upto)).where("kind = 1")
    return out.select("request_id", "key", F.col("at").alias("snapshot_ts"), F.col("v").isNotNull().alias("found"), "v.value", F.coalesce("v.is_deleted", F.lit(False)).alias("is_deleted"), "v.commit_ts")


def read_with_own_writes(committed: DataFrame, own: DataFrame) -> DataFrame:
    """``committed``: answers of :func:`read_batch`; ``own``: (request_id, own_value) where the transaction itself holds an intent. The own write wins; it is no tombstone."""
    both = committed.join(own.withColumn("is_own", F.lit(True)), "request_id", "left")
    mine = F.coalesce("is_own", F.lit(False))
    return both.select("request_id", "key", "snapshot_ts", (F.col("found") | mine).alias("found"), F.when(mine, F.col("own_value")).otherwise(F.col("value")).alias("value"), (F.col("is_deleted") & ~mine).alias("is_deleted"), mine.alias("is_own"))


def latest_committed(versions: DataFrame) -> DataFrame:
    """The newest committed version of every key, tombstones included: the store's full scan."""
    rows = versions.where(~F.col("is_intent")) if "is_intent" in versions.columns else versions
    return rows.groupBy("key").agg(F.max(F.struct("chain_pos", "commit_ts", "value", "is_deleted")).alias("v")).select("key", "v.commit_ts", "v.value", "v.is_deleted")


def restore(versions: DataFrame, entries: DataFrame) -> DataFrame:
    """Put snapshot entries (key, value, commit_ts, is_deleted) before the chains; their order isn't checked."""
    first = entries.select("key", F.lit(-1).cast("bigint").alias("chain_pos"), "commit_ts", "value", F.lit(0).cast("bigint").alias("tx_id"), F.lit(False).alias("is_intent"), "is_deleted")
    return first.unionByName(versions.select(*first.columns))


def read_set(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """``tx_id``, ``key`` of committed versions that transactions have read; own writes and misses don't count."""
    return answers.where("found and not is_own").join(requests.select("request_id", "tx_id"), "request_id").select("tx_id", "key").distinct()
