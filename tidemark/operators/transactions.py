"""The coordinator: timestamps, two-phase commit, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intents import prepare_votes
from tidemark.operators.running import running_before
from tidemark.schema import ABORTED, ACTIVE, COMMITTED, LEASE_MS, PREPARE_REJECTED, PREPARE_TIMEOUT, PREPARING, PRIORITY_NORMAL, PURGE_MS, STUCK_MS


def priority_or_default(priority: Column) -> Column:
    """0 or none means the normal priority; nothing is clamped here."""
    return F.when(F.coalesce(priority, F.lit(0)) == 0, PRIORITY_NORMAL).otherwise(priority).cast("int")


def transactions(ops: DataFrame, folded: DataFrame) -> DataFrame:
    """One row per transaction: first and last step, participants, votes and outcome.

    ``ops``: seq, tx_id, op, owner, end_seq, client_end; ``folded``: its SETs
    after the conflict fold.  Without participants a commit succeeds at once;
    otherwise all must vote yes, and the first no (by core) is the error.
    """
    tx = ops.groupBy("tx_id").agg(F.min("seq").alias("first_seq"), F.max("end_seq").alias("end_seq"), F.max("priority").alias("priority"), F.max("client_end").alias("client_end"))
    votes = prepare_votes(folded).groupBy("tx_id").agg(
        F.array_sort(F.collect_list("owner")).alias("participants"),
        F.bool_and("can_commit").alias("all_yes"),
        F.min(F.when(~F.col("can_commit"), F.struct("owner", "reason"))).alias("first_no"),
    )
    both = tx.join(votes, "tx_id", "left")
    commits = F.col("client_end") == "COMMIT"
    state = F.when(commits & F.coalesce("all_yes", F.lit(True)), COMMITTED).otherwise(ABORTED)
    error = F.when(commits & ~F.coalesce("all_yes", F.lit(True)), F.coalesce("first_no.reason", F.lit(PREPARE_REJECTED))).otherwise("")
    return both.select("tx_id", "first_seq", "end_seq", "priority", "client_end", F.coalesce("participants", F.array().cast("array<int>")).alias("participants"), state.alias("state"), error.alias("error"))


def allocate_timestamps(tx: DataFrame) -> DataFrame:
    """``tx`` with ``snapshot_ts``, ``created_ts`` and ``commit_ts``.

    One counter from 1: a begin takes two ticks, the commit of a transaction
    with participants one, all else none.  A transaction that ends at the step
    at which another begins ends first.
    """
    ticks_end = F.when((F.col("state") == COMMITTED) & (F.size("participants") > 0), 1).otherwise(0)
    steps = tx.select("tx_id", F.explode(F.array(F.struct((2 * F.col("first_seq") + 1).alias("pos"), F.lit(2).alias("ticks"), F.lit("begin").alias("kind")), F.struct((2 * F.col("end_seq")).alias("pos"), ticks_end.alias("ticks"), F.lit("end").alias("kind")))).alias("s")).select("tx_id", "s.*")
    at = running_before(steps, "pos", {"before": F.col("ticks")})
    both = at.groupBy("tx_id").agg(F.max(F.when(F.col("kind") == "begin", F.col("before") + 1)).alias("snapshot_ts"), F.max(F.when((F.col("kind") == "end") & (F.col("ticks") == 1), F.col("before") + 1)).alias("commit_ts"))
    return tx.join(both, "tx_id").withColumn("created_ts", F.col("snapshot_ts") + 1)


def states_at(tx: DataFrame, seq: int) -> DataFrame:
    """``tx`` with ``state_at``: ACTIVE between begin and end, the outcome from the end on; later ones are left out."""
    return tx.where(F.col("first_seq") <= seq).withColumn("state_at", F.when(F.col("end_seq") <= seq, F.col("state")).otherwise(ACTIVE))


def least_active_snapshot(tx: DataFrame, seq: int) -> DataFrame:
    """The garbage watermark at a step: the least snapshot of ACTIVE transactions, null if there are none."""
    return states_at(tx, seq).where(F.col("state_at") == ACTIVE).agg(F.min("snapshot_ts").alias("watermark"), F.count("*").alias("n_active"))


def commit_batches(tx: DataFrame, width: int) -> DataFrame:
    """Group commit: decisions with participants that fall into one window of steps are made durable together."""
    decided = tx.where((F.col("state") == COMMITTED) & (F.size("participants") > 0))
    return decided.groupBy(F.floor(F.col("end_seq") / width).cast("bigint").alias("batch")).agg(F.count("*").alias("n_commits"), F.min("commit_ts").alias("first_ts"), F.max("commit_ts").alias("last_ts"), F.sum(F.size("participants").cast("bigint")).alias("n_finalize"))


def acknowledged(tx: DataFrame, acks: DataFrame) -> DataFrame:
    """Transactions all of whose participants have acknowledged, each counted once. ``acks``: tx_id, core."""
    counted = acks.select("tx_id", "core").distinct().groupBy("tx_id").agg(F.count("*").alias("n_acks"))
    return tx.join(counted, "tx_id", "left").withColumn("answered", F.coalesce("n_acks", F.lit(0)) >= F.size("participants"))


def lease_gaps(activity: DataFrame, lease_us: int) -> DataFrame:
    """``tx_id`` and the last activity before each gap that is longer than the lease (one just as long is not). ``activity``: tx_id, ts, seq."""
    from pyspark.sql import Window

    nxt = F.lead("ts").over(Window.partitionBy("tx_id").orderBy("ts", "seq"))
    gap = F.unix_micros("next_ts") - F.unix_micros("ts")
    return activity.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("next_ts", nxt).where(gap > lease_us).select("tx_id", "seq", gap.alias("gap_us"))


def expired(tx: DataFrame, now_ms: Column, lease_ms: int = LEASE_MS, stuck_ms: int = STUCK_MS) -> DataFrame:
    """What the reaper does at ``now_ms``: ACTIVE ones without activity for longer than the lease are aborted silently, PREPARING ones for longer than the limit with an error. ``tx``: state, last_heartbeat_ms, prepare_start_ms."""
    lost = (F.col("state") == ACTIVE) & (now_ms - F.col("last_heartbeat_ms") > lease_ms)
    stuck = (F.col("state") == PREPARING) & (now_ms - F.col("prepare_start_ms") > stuck_ms)
    return tx.where(lost | stuck).withColumn("error", F.when(stuck, PREPARE_TIMEOUT)).withColumn("state", F.lit(ABORTED))


def resend_finalize(pending: DataFrame, now_ms: Column, stuck_ms: int = STUCK_MS) -> DataFrame:
    """Unacknowledged finalize messages (tx_id, core, sent_ms) that are sent again, with the timer set anew."""
    return pending.where(now_ms - F.col("sent_ms") > stuck_ms).withColumn("sent_ms", now_ms)


def purge(tx: DataFrame, now: Column, age: int = PURGE_MS) -> DataFrame:
    """Terminal transactions without pending messages that are older than ``age`` go. ``tx``: state, created, pending."""
    gone = F.col("state").isin(COMMITTED, ABORTED) & ~F.col("pending") & (now - F.col("created") > age)
    return tx.where(~gone)


def resolve_in_doubt(tx: DataFrame, cores: int) -> DataFrame:
    """After a restart: ``tx_id``, ``core``, ``action`` for every recovered transaction. Those without known participants are told to all cores; all but committed ones abort."""
    all_cores = F.sequence(F.lit(0), F.lit(cores - 1))
    known = F.col("participants").isNotNull() & (F.size("participants") > 0)
    action = F.when(F.coalesce("state", F.lit(ABORTED)) == COMMITTED, "FINALIZE_COMMIT").otherwise("FINALIZE_ABORT")
    return tx.select("tx_id", F.explode(F.when(known, F.col("participants")).otherwise(all_cores)).alias("core"), action.alias("action"), F.when(F.col("state") == COMMITTED, F.col("commit_ts")).alias("commit_ts"))
