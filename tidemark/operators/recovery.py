"""The log, checkpoints, recovery and repartitioning as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import owner
from tidemark.operators.intents import intents
from tidemark.operators.running import running_before
from tidemark.schema import ABORTED, ACTIVE, COMMITTED

_EMPTY = {"snapshot_ts": "bigint", "commit_ts": "bigint", "key": "string", "value": "binary", "is_deleted": "boolean", "vote_yes": "boolean"}


def build_log(tx: DataFrame, folded: DataFrame) -> DataFrame:
    """The log that a run leaves: begins and decisions on core 0, the rest with its core; ``lsn`` counts from 1 on each core.

    ``tx`` needs timestamps; ``folded`` the writes after the conflict fold.
    """

    def row(core, pos, sub, kind, **given):
        return F.struct(core.cast("int").alias("core_id"), pos.cast("bigint").alias("pos"), F.lit(sub).alias("sub"), F.lit(kind).alias("type"), F.col("tx_id"), *((given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in _EMPTY.items()))

    end = 2 * F.col("end_seq")
    core = F.col("core")
    commits, writes = F.col("state") == COMMITTED, F.size("participants") > 0
    begin = tx.select(row(F.lit(0), 2 * F.col("first_seq") + 1, 0, "TX_BEGIN", snapshot_ts=F.col("snapshot_ts")).alias("r"))
    intent = folded.where("ok").select(row(F.col("owner"), 2 * F.col("seq") + 1, 1, "INTENT", key=F.col("key"), value=F.col("value"), is_deleted=F.lit(False)).alias("r"))
    decided = tx.where(writes | (F.col("client_end") != "COMMIT"))
    commit = decided.where(commits).select(row(F.lit(0), end, 1, "COMMIT_DECISION", commit_ts=F.col("commit_ts")).alias("r"))
    abort = decided.where(~commits).select(row(F.lit(0), end, 1, "ABORT_DECISION").alias("r"))
    each = tx.select("*", F.explode("participants").alias("core"))
    held = folded.where("ok").select("tx_id", F.col("owner").alias("core")).distinct()
    prepare = each.where("client_end = 'COMMIT'").join(held, ["tx_id", "core"], "left_semi").select(row(core, end, 0, "PREPARE", vote_yes=F.lit(True)).alias("r"))
    done = each.where(commits).select(row(core, end, 2, "COMMIT_FINALIZE", commit_ts=F.col("commit_ts")).alias("r"))
    undone = each.where(~commits).select(row(core, end, 2, "ABORT_FINALIZE").alias("r"))
    rows = begin
    for part in (intent, prepare, commit, abort, done, undone):
        rows = rows.unionByName(part)
    rows = rows.select("r.*").withColumn("order", F.col("pos") * 4 + F.col("sub"))
    numbered = running_before(rows, "order", {"before": F.lit(1)}, by=["core_id"])
    return numbered.withColumn("lsn", F.col("before") + 1).drop("before", "order", "sub")


def tail(log: DataFrame, after_lsn: int) -> DataFrame:
    """Records with a larger LSN; the filter reaches the scan."""
    return log.where(F.col("lsn") > after_lsn)


def next_lsn(log: DataFrame) -> DataFrame:
    """``core_id`` and the LSN of its next record."""
    return log.groupBy("core_id").agg((F.max("lsn") + 1).alias("next_lsn"))


def valid_prefix(log: DataFrame) -> DataFrame:
    """Records of each core before its first bad one (``valid`` false)."""
    bad = log.where("not valid").groupBy("core_id").agg(F.min("lsn").alias("bad"))
    return log.join(F.broadcast(bad), "core_id", "left").where("bad is null or lsn < bad").drop("bad", "valid")


def replay_core(log: DataFrame, snapshot: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """Committed versions after a restart: key, commit_ts, value, is_deleted, core_id.

    ``snapshot`` entries come first; of the log, records after the header's
    ``wal_lsn`` count.  Intents without a finalize stay invisible.
    """
    if headers is not None:
        log = log.join(F.broadcast(headers.select("core_id", "wal_lsn")), "core_id", "left").where(F.col("lsn") > F.coalesce("wal_lsn", F.lit(0))).drop("wal_lsn")
    last = log.where("type = 'INTENT'").groupBy("core_id", "tx_id", "key").agg(F.max(F.struct("lsn", "value")).alias("w"))
    done = log.where("type = 'COMMIT_FINALIZE'").groupBy("core_id", "tx_id").agg(F.min("commit_ts").alias("commit_ts"))
    made = last.join(done, ["core_id", "tx_id"]).select("core_id", "key", "commit_ts", "w.value", F.lit(False).alias("is_deleted"))
    return made if snapshot is None else snapshot.select(*made.columns).unionByName(made)


def largest_applied(log: DataFrame) -> DataFrame:
    """``core_id`` and the largest LSN of a record that recovery applies."""
    return log.groupBy("core_id").agg(F.coalesce(F.max(F.when(F.col("type").isin("INTENT", "COMMIT_FINALIZE", "ABORT_FINALIZE"), F.col("lsn"))), F.lit(0)).alias("max_lsn"))


def recover_coordinator(log: DataFrame) -> DataFrame:
    """``tx_id``, ``state``, ``commit_ts`` from core 0's log; whatever isn't decided is aborted."""
    kinds = F.when(F.col("type") == "COMMIT_DECISION", COMMITTED).when(F.col("type") == "ABORT_DECISION", ABORTED).otherwise(ACTIVE)
    own = log.where((F.col("core_id") == 0) & F.col("type").isin("TX_BEGIN", "COMMIT_DECISION", "ABORT_DECISION"))
    last = own.groupBy("tx_id").agg(F.max_by(F.struct(kinds.alias("state"), "commit_ts"), "lsn").alias("s"), F.max("snapshot_ts").alias("snapshot_ts"))
    return last.select("tx_id", F.when(F.col("s.state") == ACTIVE, ABORTED).otherwise(F.col("s.state")).alias("state"), "snapshot_ts", "s.commit_ts")


def counters(log: DataFrame) -> DataFrame:
    """The largest transaction id and timestamp of core 0's log; the counters go on from there."""
    return log.where("core_id = 0").agg(F.coalesce(F.max("tx_id"), F.lit(0)).alias("max_tx_id"), F.coalesce(F.max(F.greatest(F.coalesce("snapshot_ts", F.lit(0)), F.coalesce("commit_ts", F.lit(0)))), F.lit(0)).alias("max_ts"))


def in_doubt(log: DataFrame) -> DataFrame:
    """``tx_id``, ``participants``: intents that no finalize has settled."""
    held = log.where("type = 'INTENT'").select("core_id", "tx_id").distinct()
    done = log.where("type in ('COMMIT_FINALIZE', 'ABORT_FINALIZE')").select("core_id", "tx_id")
    return held.join(done, ["core_id", "tx_id"], "left_anti").groupBy("tx_id").agg(F.array_sort(F.collect_set("core_id")).alias("participants"))


def checkpoint_entries(latest: DataFrame, cores: int) -> DataFrame:
    """Snapshot entries: the latest committed versions with their core, tombstones included."""
    return latest.select(owner(F.col("key"), cores).alias("core_id"), "key", "value", "commit_ts", "is_deleted")


def checkpoint_headers(entries: DataFrame, cores: int, epoch: int, lsn: DataFrame | None = None) -> DataFrame:
    """A header for every core, also for one without entries. ``lsn``: core_id, wal_lsn."""
    spark = entries.sparkSession
    counted = entries.groupBy("core_id").agg(F.count("*").alias("entry_count"))
    all_cores = spark.range(cores).select(F.col("id").cast("int").alias("core_id"))
    out = all_cores.join(counted, "core_id", "left")
    out = out.join(lsn, "core_id", "left") if lsn is not None else out.withColumn("wal_lsn", F.lit(0).cast("bigint"))
    return out.select("core_id", F.lit(cores).alias("num_cores"), F.lit(epoch).cast("bigint").alias("layout_epoch"), F.coalesce("wal_lsn", F.lit(0)).alias("wal_lsn"), F.coalesce("entry_count", F.lit(0)).alias("entry_count"))


def repartition_layout(latest: DataFrame, old_cores: int, new_cores: int) -> DataFrame:
    """Live keys with their old and new core; tombstones and history aren't carried over."""
    return latest.where("not is_deleted").select("key", "commit_ts", "value", owner(F.col("key"), old_cores).alias("old_core"), owner(F.col("key"), new_cores).alias("core_id"))


def check_topology(stored: tuple[int, int] | None, cores: int) -> str:
    """Empty, or what differs between the stored (num_cores, layout_epoch) and the wanted number of cores."""
    if stored is None or stored[0] == cores:
        return ""
    return f"topology mismatch: stored num_cores={stored[0]}, requested num_cores={cores}"


def held_intents(folded: DataFrame) -> DataFrame:
    return intents(folded)
