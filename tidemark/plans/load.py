"""A synthetic load, as a command log, and its options."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import sample_is_read, sample_key


def options(args: list[str]) -> argparse.Namespace:
    """Flags of a load run; a run has a number of operations or a duration, not both."""
    parser = argparse.ArgumentParser(prog="load")
    parser.add_argument("--mode", choices=("kv", "tx"), default="kv")
    parser.add_argument("--threads", type=int, default=32)
    parser.add_argument("--keys", type=int, default=100_000)
    parser.add_argument("--value-size", type=int, default=128)
    parser.add_argument("--read-ratio", type=float, default=0.5)
    parser.add_argument("--tx-ops", type=int, default=4)
    parser.add_argument("--seed", type=int, default=1)
    amount = parser.add_mutually_exclusive_group()
    amount.add_argument("--ops", type=int)
    amount.add_argument("--duration", type=float)
    out = parser.parse_args(args)
    if out.threads < 1 or out.keys < 1 or out.value_size < 0 or out.tx_ops < 1 or not 0 <= out.read_ratio <= 1:
        parser.error("a number is out of range")
    return out


def kv_load(spark: SparkSession, n: int, keys: int, value_size: int, read_ratio: float, seed: int) -> DataFrame:
    """``n`` commands of a plain-store load; the same for the same seed, however it is partitioned."""
    row = F.col("id")
    read = sample_is_read(row, seed, read_ratio)
    value = F.when(~read, F.substring(F.repeat(F.sha2(row.cast("string").cast("binary"), 256), value_size // 64 + 1), 1, value_size).cast("binary"))
    return spark.range(n).select(row.alias("seq"), F.lit(0).cast("bigint").alias("now_ms"), row.alias("request_id"), F.when(read, "GET").otherwise("SET").alias("op"), F.lit(None).cast("bigint").alias("tx_id"), sample_key(row, seed, keys).alias("key"), value.alias("value"), F.lit(None).cast("int").alias("priority"))


def outcome_counters(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """ok, application errors and requests without an answer, by operation; gets and sets that succeed add up to the total without errors."""
    both = requests.select("request_id", F.col("op").alias("asked")).join(responses, "request_id", "left")
    return both.groupBy("asked").agg(F.count("*").alias("total"), F.count_if("success").alias("ok"), F.count_if(F.col("success") == F.lit(False)).alias("app_errors"), F.count_if(F.col("success").isNull()).alias("unanswered"))
