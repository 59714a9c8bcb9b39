"""Write intents: the first one holds its key until its transaction ends; others conflict at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import NO_INTENTS

FOLD_TYPES = "ok boolean, holder bigint"


def _fold(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key and order; what is carried is one holder, so a key may have any number of rows."""
        held_key, holder, until = None, None, -1
        for batch in batches:
            oks, holders = [], []
            for key, tx, seq, end in zip(batch.column("key").to_pylist(), batch.column("tx_id").to_pylist(), batch.column("seq").to_pylist(), batch.column("end_seq").to_pylist(), strict=True):
                if key != held_key:
                    held_key, holder, until = key, None, -1
                ok = holder is None or holder == tx or until <= seq
                if ok:
                    holder, until = tx, end
                oks.append(ok)
                holders.append(holder)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(oks, pa.bool_()), pa.array(holders, pa.int64())], names=[*names, "ok", "holder"])

    return run


def fold_conflicts(writes: DataFrame) -> DataFrame:
    """``writes`` (seq, key, tx_id, end_seq, ...) with ``ok`` and ``holder``, the transaction whose intent is on the key afterwards.

    A write succeeds if nobody, the same transaction or one that has ended by
    then (``end_seq <= seq``) holds the key.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in writes.schema.fields)
    return writes.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(_fold(writes.columns), f"{fields}, {FOLD_TYPES}")


def strict_first_committer(folded: DataFrame, committed: DataFrame) -> DataFrame:
    """Strict mode: a write also fails if the key got a version after the transaction's snapshot. ``folded`` needs ``snapshot_ts`` and ``at_ts``; ``committed``: key, commit_ts."""
    both = folded.select("key", F.col("at_ts").alias("at"), F.lit(1).alias("kind"), F.struct(*folded.columns).alias("w"), F.lit(None).cast("bigint").alias("ts"))
    both = both.unionByName(committed.select("key", F.col("commit_ts").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(both.schema["w"].dataType).alias("w"), F.col("commit_ts").alias("ts")))
    last = F.max("ts").over(Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("last", last).where("kind = 1").select("w.*", "last")
    return out.withColumn("ok", F.col("ok") & (F.col("last").isNull() | (F.col("last") <= F.col("snapshot_ts")))).drop("last")


def streaks(folded: DataFrame) -> DataFrame:
    """``streak``: a transaction's conflicts in a row on a core, 0 after a success."""
    w = Window.partitionBy("tx_id", "owner").orderBy("seq")
    runs = folded.withColumn("run", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy("tx_id", "owner", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("streak", F.when(F.col("ok"), F.lit(0)).otherwise(F.sum((~F.col("ok")).cast("int")).over(inside)).cast("bigint")).drop("run")


def intents(folded: DataFrame) -> DataFrame:
    """The intent of each transaction on each key: its last successful write."""
    return folded.where("ok").groupBy("tx_id", "key", "owner").agg(F.max(F.struct("seq", "value")).alias("w")).select("tx_id", "key", "owner", "w.seq", "w.value")


def commit(held: DataFrame, decided: DataFrame) -> DataFrame:
    """Versions that the intents of committed transactions become. ``decided``: tx_id, commit_ts."""
    return held.join(decided.select("tx_id", "commit_ts"), "tx_id").select("key", "tx_id", "commit_ts", "value")


def abort(held: DataFrame, aborted: DataFrame) -> DataFrame:
    """The intents that are left after those of ``aborted`` are dropped."""
    return held.join(aborted.select("tx_id"), "tx_id", "left_anti")


def own_intents(requests: DataFrame, folded: DataFrame) -> DataFrame:
    """(request_id, own_value) of GETs (request_id, seq, tx_id, key) before which the transaction has written the key itself."""
    both = folded.where("ok").select("tx_id", "key", "seq", F.struct("seq", "value").alias("w"), F.lit(None).cast("bigint").alias("request_id"))
    both = both.unionByName(requests.select("tx_id", "key", "seq", F.lit(None).cast("struct<seq:bigint,value:binary>").alias("w"), "request_id"))
    before = Window.partitionBy("tx_id", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("w", F.max("w").over(before)).where("request_id is not null and w is not null").select("request_id", F.col("w.value").alias("own_value"))


def participants(ops: DataFrame) -> DataFrame:
    """``tx_id``, ``owner`` of every core that a write was sent to, whether it succeeded or not."""
    return ops.where("op = 'SET'").select("tx_id", "owner").distinct()


def prepare_votes(folded: DataFrame) -> DataFrame:
    """A participant votes yes if it holds an intent of the transaction."""
    yes = F.count_if("ok") > 0
    return folded.groupBy("tx_id", "owner").agg(yes.alias("can_commit"), F.when(yes, F.lit("")).otherwise(F.lit(NO_INTENTS)).alias("reason"))
