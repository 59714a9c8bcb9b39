"""Histories of the store, derived from the driver's tables.

Every history has a strict order (``event_id`` or ``o_orderkey``), so results
are free of ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import owner

#: Events of a block of overlapping transactions, transactions in it, and when one ends after its first operation.
BLOCK, PER_BLOCK, ENDS_AFTER = 160, 40, 140
CORES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def serial_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: each event is a transaction of one write; an ``error`` leaves a tombstone."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        e.alias("chain_pos"),
        (3 * e + 3).alias("commit_ts"),
        F.col("props").cast("binary").alias("value"),
        (e + 1).alias("tx_id"),
        (3 * e + 1).alias("snapshot_ts"),
        (F.col("event_type") == "error").alias("is_deleted"),
    )


def overlapping_ops(spark: SparkSession, sf_dir: str, reads: bool = False) -> DataFrame:
    """S2: operations of transactions that overlap (``reads``: S4, where views are GETs)."""
    e = F.col("event_id")
    block = F.floor(e / BLOCK).cast("bigint")
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    tx = e % PER_BLOCK + PER_BLOCK * block
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        (tx + 1).alias("tx_id"),
        key.alias("key"),
        (BLOCK * block + e % PER_BLOCK + ENDS_AFTER).alias("end_seq"),
        F.col("props").cast("binary").alias("value"),
        (F.lit(100) + 100 * (tx % 9)).cast("int").alias("priority"),
        (F.when(F.col("event_type") == "view", "GET").otherwise("SET") if reads else F.lit("SET")).alias("op"),
        owner(key, CORES).alias("owner"),
    )


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: orders as blind writes of a plain store; cancelled-looking ones (status ``P``) delete."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_orderpriority").cast("binary").alias("value"),
        (F.col("o_orderstatus") == "P").alias("is_deleted"),
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5: samples in microseconds."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("thread"), F.col("event_type").alias("metric"), F.floor(F.col("value") * 1000).cast("bigint").alias("us"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6: what renews the lease of a user's transaction."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tx_id"), "ts", F.col("event_id").alias("seq"))
