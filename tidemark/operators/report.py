"""Reports of a load run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import nearest_rank

SHARES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99, "p999_ms": 0.999}


def latency_report(samples: DataFrame, seconds: float) -> DataFrame:
    """Per metric: count, rate (0 for no duration) and nearest-rank percentiles in ms. Samples of several threads are merged by the grouping itself."""
    rate = (F.count("*") / seconds) if seconds > 0 else F.lit(0.0)
    return samples.groupBy("metric").agg(F.count("*").alias("n"), rate.cast("double").alias("qps"), *((nearest_rank("us", p) / 1000.0).alias(n) for n, p in SHARES.items()))


def merge_counters(stats: DataFrame) -> DataFrame:
    """Counters of all threads, summed; every column but ``thread`` is one."""
    return stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats.columns if c != "thread"))


def outcome_mix(tx: DataFrame, retries: DataFrame) -> DataFrame:
    """Transactions by outcome with percentages and mean retries (all 0 without any). ``retries``: tx_id, n_conflicts."""
    both = tx.join(retries, "tx_id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
    good = F.col("state") == "COMMITTED"
    conflicted = ~good & (F.col("n_conflicts") > 0)
    out = both.agg(F.count("*").alias("attempts"), F.count_if(good).alias("committed"), F.count_if(conflicted).alias("conflict_abort"), F.count_if(~good & ~conflicted).alias("other_abort"), F.coalesce(F.sum("n_conflicts"), F.lit(0)).alias("retries"))
    share = lambda c: F.when(F.col("attempts") > 0, F.col(c) * 100.0 / F.col("attempts")).otherwise(0.0)
    return out.select("*", share("committed").alias("committed_pct"), share("conflict_abort").alias("conflict_pct"), share("other_abort").alias("other_pct"), F.when(F.col("attempts") > 0, F.col("retries") / F.col("attempts")).otherwise(0.0).alias("retries_per_tx"))


def measured(samples: DataFrame, warmup_until: int) -> DataFrame:
    """Samples after the warm-up. ``samples``: at_us."""
    return samples.where(F.col("at_us") >= warmup_until)


def write_summary(report: DataFrame, path: str) -> None:
    """Append a report as CSV with a header in each file."""
    report.coalesce(1).write.mode("append").option("header", True).csv(path)
