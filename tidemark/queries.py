"""The registered queries over the driver's tables (histories: see ``plans.histories``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.checksum import crc32c_column
from tidemark.functions.scalar import backoff_high, backoff_jitter, backoff_low, crc_mask, crc_unmask, from_value, owner, to_value
from tidemark.operators import gc, intents, kv, mvcc, recovery, report, router, transactions
from tidemark.plans import histories
from tidemark.plans.histories import CORES

#: A share of the versions, in ticks, that the fixed snapshots and watermarks stand at (see :func:`_ticks`).
SNAPSHOT_SHARE, WATERMARK_SHARE = 2, 3


def _ticks(spark: SparkSession, sf_dir: str, share: int) -> int:
    """A point of S1's time line: ``3 n / share`` for n events."""
    return 3 * histories.table(spark, sf_dir, "events").count() // share


def _text(column: str):
    return F.hex(column).alias("value_hex")


# Plain store (S3)


def kv_current(spark, sf_dir):
    return kv.current(histories.kv_log(spark, sf_dir)).select("key", _text("value"))


def kv_get(spark, sf_dir):
    """Every customer's key; nobody wrote some of them."""
    keys = histories.table(spark, sf_dir, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"))
    return kv.get(histories.kv_log(spark, sf_dir), keys).select("key", "found", _text("value"))


def kv_get_prior(spark, sf_dir):
    log = histories.kv_log(spark, sf_dir)
    return kv.get_in_log(log, log.select("seq", "key")).select("seq", "key", "found", _text("value"))


def kv_delete(spark, sf_dir):
    """Current keys after one more tombstone for every key of an odd customer."""
    log = histories.kv_log(spark, sf_dir)
    odd = histories.table(spark, sf_dir, "orders").where("o_custkey % 2 = 1").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m")).select((F.col("m") + 1_000_000_000).alias("seq"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"))
    return kv.current(kv.delete_keys(log, odd)).select("key", _text("value"))


def kv_size(spark, sf_dir):
    return kv.size(histories.kv_log(spark, sf_dir))


# Versioned reads (S1)


def mvcc_snapshot_read(spark, sf_dir):
    return mvcc.snapshot_read(histories.serial_versions(spark, sf_dir), _ticks(spark, sf_dir, SNAPSHOT_SHARE)).select("key", _text("value"), "is_deleted", "commit_ts")


def _requests(spark, sf_dir):
    """A read for every order: of a user's key, at a snapshot from the order's number."""
    n = histories.table(spark, sf_dir, "events").count()
    return histories.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("user:"), (F.col("o_custkey") % 200).cast("string")).alias("key"), (F.col("o_orderkey") * 7 % (3 * n)).alias("snapshot_ts"))


def mvcc_read_batch(spark, sf_dir):
    return mvcc.read_batch(histories.serial_versions(spark, sf_dir), _requests(spark, sf_dir)).select("request_id", "key", "snapshot_ts", "found", _text("value"), "is_deleted", "commit_ts")


def mvcc_latest_committed(spark, sf_dir):
    return mvcc.latest_committed(histories.serial_versions(spark, sf_dir)).select("key", "commit_ts", _text("value"), "is_deleted")


# Overlapping transactions (S2, S4)


def _ops(spark, sf_dir, reads=False):
    ops = histories.overlapping_ops(spark, sf_dir, reads)
    return ops.withColumn("client_end", F.when(F.col("tx_id") % 10 == 0, "ROLLBACK").otherwise("COMMIT"))


def _folded(ops):
    return intents.fold_conflicts(ops.where("op = 'SET'"))


def _run(spark, sf_dir, reads=False):
    """Operations, folded writes and timed transactions. The last two feed several branches of a plan and are kept in the cache, which spills, meanwhile."""
    ops = _ops(spark, sf_dir, reads)
    folded = _folded(ops).persist()
    return ops, folded, transactions.allocate_timestamps(transactions.transactions(ops, folded)).persist()


def intent_conflict_fold(spark, sf_dir):
    return _folded(_ops(spark, sf_dir)).select("seq", "tx_id", "key", "ok", "holder")


def conflict_streak(spark, sf_dir):
    return intents.streaks(_folded(_ops(spark, sf_dir))).select("seq", "tx_id", F.col("owner").cast("bigint").alias("owner"), "streak")


def backoff_bounds(spark, sf_dir):
    lost = intents.streaks(_folded(_ops(spark, sf_dir))).where("not ok")
    return lost.select("seq", "streak", backoff_low(F.col("streak"), F.col("priority")).alias("low_ms"), backoff_high(F.col("streak"), F.col("priority")).alias("high_ms"))


def backoff_waits(spark, sf_dir):
    """Waits with jitter from a hash of transaction and step."""
    lost = intents.streaks(_folded(_ops(spark, sf_dir))).where("not ok")
    return lost.select("seq", backoff_jitter(F.col("streak"), F.col("priority"), F.col("tx_id"), F.col("seq")).alias("wait_ms"))


def participants(spark, sf_dir):
    return intents.participants(_ops(spark, sf_dir)).select("tx_id", F.col("owner").cast("bigint").alias("owner"))


def prepare_votes(spark, sf_dir):
    return intents.prepare_votes(_folded(_ops(spark, sf_dir))).select("tx_id", F.col("owner").cast("bigint").alias("owner"), "can_commit", "reason")


def tx_outcomes(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return transactions.transactions(ops, _folded(ops)).select("tx_id", "state", "error", F.size("participants").cast("bigint").alias("n_participants"))


def ts_allocation(spark, sf_dir):
    return _run(spark, sf_dir)[2].select("tx_id", "snapshot_ts", "created_ts", "commit_ts")


def tx_commit_versions(spark, sf_dir):
    _, folded, tx = _run(spark, sf_dir)
    return intents.commit(intents.intents(folded), tx.where("state = 'COMMITTED'")).select("key", "tx_id", "commit_ts", _text("value"))


def tx_abort_cleanup(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    folded = _folded(ops)
    aborted = transactions.transactions(ops, folded).where("state = 'ABORTED'")
    return intents.abort(intents.intents(folded), aborted).select("tx_id", "key", "seq")


def _reads(spark, sf_dir):
    ops, folded, tx = _run(spark, sf_dir, reads=True)
    versions = intents.commit(intents.intents(folded), tx.where("state = 'COMMITTED'")).select("key", F.col("commit_ts").alias("chain_pos"), "commit_ts", "value", F.lit(False).alias("is_deleted"))
    gets = ops.where("op = 'GET'").join(tx.select("tx_id", "snapshot_ts"), "tx_id").select(F.col("seq").alias("request_id"), "seq", "tx_id", "key", "snapshot_ts")
    return mvcc.read_with_own_writes(mvcc.read_batch(versions, gets), intents.own_intents(gets, folded)), gets


def mvcc_own_intent_overlay(spark, sf_dir):
    return _reads(spark, sf_dir)[0].select("request_id", "key", "found", "is_own", _text("value"))


def mvcc_read_set(spark, sf_dir):
    return mvcc.read_set(*_reads(spark, sf_dir))


# Garbage collection, leases, batches


def gc_survivors(spark, sf_dir):
    return gc.survivors(histories.serial_versions(spark, sf_dir), _ticks(spark, sf_dir, WATERMARK_SHARE)).select("key", "commit_ts", "is_deleted")


def gc_removed_counts(spark, sf_dir):
    return gc.removed_counts(histories.serial_versions(spark, sf_dir), _ticks(spark, sf_dir, WATERMARK_SHARE))


def _middle(spark, sf_dir):
    return histories.table(spark, sf_dir, "events").count() // 2


def gc_watermark(spark, sf_dir):
    return transactions.least_active_snapshot(_run(spark, sf_dir)[2], _middle(spark, sf_dir))


def tx_states(spark, sf_dir):
    return transactions.states_at(_run(spark, sf_dir)[2], _middle(spark, sf_dir)).groupBy("state_at").agg(F.count("*").alias("n"))


LEASE_US = 6 * 3600 * 1_000_000


def lease_expired(spark, sf_dir):
    return transactions.lease_gaps(histories.activity(spark, sf_dir), LEASE_US)


def terminal_purge(spark, sf_dir):
    """What is left, in the middle of the run, of terminal transactions that began more than 1,000 ticks before."""
    tx = transactions.states_at(_run(spark, sf_dir)[2], _middle(spark, sf_dir))
    rows = tx.select("tx_id", F.col("state_at").alias("state"), F.col("created_ts").alias("created"), F.lit(False).alias("pending"))
    return transactions.purge(rows, F.lit(2 * _middle(spark, sf_dir) // 4), 1000).select("tx_id", "state")


def group_commit_batches(spark, sf_dir):
    return transactions.commit_batches(_run(spark, sf_dir)[2], 64)


# Log, recovery, checkpoints (S7, S1)


def _log(spark, sf_dir, cut=True):
    """The log, as it is when the run breaks off in its middle."""
    _, folded, tx = _run(spark, sf_dir)
    log = recovery.build_log(tx, folded)
    return log.where(F.col("pos") < 2 * _middle(spark, sf_dir)) if cut else log


def wal_tail(spark, sf_dir):
    return recovery.tail(_log(spark, sf_dir, cut=False), 100).select(F.col("core_id").cast("bigint").alias("core_id"), "lsn", "type", "tx_id", "key", _text("value"), "snapshot_ts", "commit_ts")


def wal_next_lsn(spark, sf_dir):
    return recovery.next_lsn(_log(spark, sf_dir)).select(F.col("core_id").cast("bigint").alias("core_id"), "next_lsn")


def wal_replay_core(spark, sf_dir):
    return recovery.replay_core(_log(spark, sf_dir)).select(F.col("core_id").cast("bigint").alias("core_id"), "key", "commit_ts", _text("value"))


def recover_coordinator(spark, sf_dir):
    return recovery.recover_coordinator(_log(spark, sf_dir)).select("tx_id", "state", "snapshot_ts", "commit_ts")


def recovery_counters(spark, sf_dir):
    return recovery.counters(_log(spark, sf_dir))


def resolve_in_doubt(spark, sf_dir):
    log = _log(spark, sf_dir)
    doubtful = recovery.in_doubt(log).join(recovery.recover_coordinator(log), "tx_id", "left")
    return transactions.resolve_in_doubt(doubtful, CORES).select("tx_id", F.col("core").cast("bigint").alias("core"), "action", "commit_ts")


def checkpoint_entries(spark, sf_dir):
    return recovery.checkpoint_entries(mvcc.latest_committed(histories.serial_versions(spark, sf_dir)), CORES).select(F.col("core_id").cast("bigint").alias("core_id"), "key", _text("value"), "commit_ts", "is_deleted")


def checkpoint_header(spark, sf_dir):
    entries = recovery.checkpoint_entries(mvcc.latest_committed(histories.serial_versions(spark, sf_dir)), CORES)
    return recovery.checkpoint_headers(entries, CORES, 1).select(*(F.col(c).cast("bigint").alias(c) for c in ("core_id", "num_cores", "layout_epoch", "wal_lsn", "entry_count")))


def repartition_layout(spark, sf_dir):
    moved = recovery.repartition_layout(mvcc.latest_committed(histories.serial_versions(spark, sf_dir)), CORES, 6)
    return moved.select("key", "commit_ts", F.col("old_core").cast("bigint").alias("old_core"), F.col("core_id").cast("bigint").alias("core_id"))


def router_distribution(spark, sf_dir):
    keys = histories.serial_versions(spark, sf_dir).select(owner(F.col("key"), CORES).cast("bigint").alias("core_id"), "key")
    return keys.groupBy("core_id").agg(F.count("*").alias("n_tasks"), F.count_distinct("key").alias("n_keys"))


# Reports and checksums


def latency_report(spark, sf_dir):
    return report.latency_report(histories.latencies(spark, sf_dir), 20.0)


def bench_outcome_mix(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    folded = _folded(ops)
    retries = folded.where("not ok").groupBy("tx_id").agg(F.count("*").alias("n_conflicts"))
    return report.outcome_mix(transactions.transactions(ops, folded), retries)


def crc32c_check(spark, sf_dir):
    """Checksums of the values, masked and unmasked."""
    rows = histories.serial_versions(spark, sf_dir).select("chain_pos", crc32c_column("value").alias("crc"))
    return rows.select("chain_pos", "crc", crc_mask(F.col("crc")).alias("masked"), (crc_unmask(crc_mask(F.col("crc"))) == F.col("crc")).alias("same"))


def wal_binary_roundtrip(spark, sf_dir):
    """The log in its binary form and back, counted by type and core."""
    from tidemark.sources.wal import decode_records, encode_records

    log = _log(spark, sf_dir)
    back = decode_records(encode_records(log))
    return back.groupBy(F.col("core_id").cast("bigint").alias("core_id"), "type").agg(F.count("*").alias("n"), F.max("lsn").alias("max_lsn"), F.sum(F.length("value").cast("bigint")).alias("n_bytes"))


# Paths that the histories above don't reach


def mvcc_restore(spark, sf_dir):
    """The full scan of a store that starts from a snapshot in the middle and takes the versions after it."""
    versions = histories.serial_versions(spark, sf_dir).withColumn("is_intent", F.lit(False))
    middle = _ticks(spark, sf_dir, SNAPSHOT_SHARE)
    entries = mvcc.snapshot_read(versions, middle)
    return mvcc.latest_committed(mvcc.restore(versions.where(F.col("commit_ts") > middle), entries)).select("key", "commit_ts", _text("value"), "is_deleted")


def kv_clear(spark, sf_dir):
    return kv.size(kv.clear(histories.kv_log(spark, sf_dir)))


def tx_acknowledged(spark, sf_dir):
    """Transactions after acknowledgements from all cores but core 3, each sent twice."""
    tx = _run(spark, sf_dir)[2]
    acks = router.fan_out(tx).where("core <> 3").select("tx_id", "core")
    return transactions.acknowledged(tx, acks.unionByName(acks)).select("tx_id", F.coalesce("n_acks", F.lit(0)).alias("n_acks"), "answered")


def _stuck(spark, sf_dir):
    """Transactions with times in ms from their steps; every third one is preparing."""
    tx = _run(spark, sf_dir)[2]
    preparing = F.col("tx_id") % 3 == 0
    return tx.select("tx_id", F.when(preparing, "PREPARING").otherwise("ACTIVE").alias("state"), (100 * F.col("first_seq")).alias("last_heartbeat_ms"), F.when(preparing, 100 * F.col("end_seq")).alias("prepare_start_ms"))


def tx_expired(spark, sf_dir):
    """What the reaper ends in the middle of the run."""
    return transactions.expired(_stuck(spark, sf_dir), F.lit(100 * _middle(spark, sf_dir))).select("tx_id", "state", "error")


def finalize_resent(spark, sf_dir):
    """Finalize messages without an answer that are sent again in the middle of the run."""
    pending = router.fan_out(_run(spark, sf_dir)[2]).select("tx_id", "core", (100 * F.col("end_seq")).alias("sent_ms"))
    return transactions.resend_finalize(pending, F.lit(100 * _middle(spark, sf_dir)).cast("bigint")).select("tx_id", F.col("core").cast("bigint").alias("core"), "sent_ms")


def _tasks(spark, sf_dir):
    """Tasks of every kind, of an unknown one, and local ones for cores that aren't there."""
    kinds = F.array(*(F.lit(x) for x in ("GET", "SET", "BEGIN", "TX_GET", "TX_SET", "COMMIT", "ROLLBACK", "HEARTBEAT", "PREPARE", "GC", "OTHER")))
    e = F.col("event_id")
    return histories.table(spark, sf_dir, "events").select(e.alias("request_id"), F.get(kinds, (e % 11).cast("int")).alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), (e % 6).cast("int").alias("core"))


def routed_tasks(spark, sf_dir):
    routed = router.route(_tasks(spark, sf_dir), CORES)
    return routed.select("request_id", router.op_label(F.col("op")).alias("label"), router.is_control(F.col("op")).alias("control"), router.is_execute(F.col("op")).alias("execute"), F.col("target").cast("bigint").alias("target"))


def matched_responses(spark, sf_dir):
    """Tasks with the answers of core 1; some answers belong to no task."""
    tasks = _tasks(spark, sf_dir)
    answers = router.route(tasks, CORES).where("target = 1").select((F.col("request_id") * 2).alias("request_id"), F.col("key").alias("value"))
    return router.match_responses(tasks.select("request_id", "op"), answers)


def value_bytes(spark, sf_dir):
    """Texts as opaque bytes and back."""
    rows = histories.table(spark, sf_dir, "events").select("event_id", to_value(F.col("props")).alias("value"))
    return rows.select("event_id", from_value(F.col("value")).alias("value_hex"), F.length("value").cast("bigint").alias("n_bytes"))


def merged_counters(spark, sf_dir):
    """Counters of eight threads, summed."""
    each = histories.latencies(spark, sf_dir).groupBy("thread").agg(F.count("*").alias("ops"), F.sum("us").alias("us"), F.count_if(F.col("metric") == "error").alias("errors"))
    return report.merge_counters(each)


def measured_samples(spark, sf_dir):
    """Samples after the warm-up, a tenth of the run."""
    n = histories.table(spark, sf_dir, "events").count()
    samples = histories.table(spark, sf_dir, "events").select(F.col("event_id").alias("at_us"), F.col("event_type").alias("metric"))
    return report.measured(samples, n // 10).groupBy("metric").agg(F.count("*").alias("n"))


def repartition_headers(spark, sf_dir):
    """Headers of the snapshots after a move from 4 to 6 cores: a new epoch, no log before them."""
    moved = recovery.repartition_layout(mvcc.latest_committed(histories.serial_versions(spark, sf_dir)), CORES, 6)
    headers = recovery.checkpoint_headers(moved.select("core_id", "key"), 6, 2)
    return headers.select(*(F.col(c).cast("bigint").alias(c) for c in ("core_id", "num_cores", "layout_epoch", "wal_lsn", "entry_count")))


def largest_applied(spark, sf_dir):
    return recovery.largest_applied(_log(spark, sf_dir)).select(F.col("core_id").cast("bigint").alias("core_id"), "max_lsn")


_NAMES = (
    "kv_current kv_get kv_get_prior kv_delete kv_size mvcc_snapshot_read mvcc_read_batch mvcc_latest_committed intent_conflict_fold "
    "conflict_streak backoff_bounds backoff_waits participants prepare_votes tx_outcomes ts_allocation tx_commit_versions tx_abort_cleanup "
    "mvcc_own_intent_overlay mvcc_read_set gc_survivors gc_removed_counts gc_watermark tx_states lease_expired terminal_purge "
    "group_commit_batches wal_tail wal_next_lsn wal_replay_core recover_coordinator recovery_counters resolve_in_doubt checkpoint_entries "
    "checkpoint_header repartition_layout router_distribution latency_report bench_outcome_mix crc32c_check wal_binary_roundtrip "
    "mvcc_restore kv_clear tx_acknowledged tx_expired finalize_resent routed_tasks matched_responses value_bytes merged_counters "
    "measured_samples repartition_headers largest_applied"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES}
