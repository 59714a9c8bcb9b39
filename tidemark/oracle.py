"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_OWNER = "(('0x' || substr(md5(key), 1, 8))::BIGINT) % {cores}"

_VERSIONS = """versions AS (
  SELECT 'user:' || user_id AS key, event_id AS chain_pos, 3 * event_id + 3 AS commit_ts, hex(encode(props)) AS value_hex, event_type = 'error' AS is_deleted
  FROM events)"""

_LOG = """kv AS (
  SELECT o_orderkey AS seq, 'cust:' || o_custkey AS key, hex(encode(o_orderpriority)) AS value_hex, o_orderstatus = 'P' AS is_deleted FROM orders)"""


def _run(sets: str = "TRUE") -> str:
    """S2 (or S4, where ``sets`` tells writes) up to timestamps; begins with WITH RECURSIVE."""
    return f"""WITH RECURSIVE ops AS (
  SELECT *, {_OWNER.format(cores=4)} AS owner, 100 + 100 * ((tx_id - 1) % 9) AS priority, CASE WHEN tx_id % 10 = 0 THEN 'ROLLBACK' ELSE 'COMMIT' END AS client_end
  FROM (SELECT event_id AS seq, event_id % 40 + 40 * (event_id // 160) + 1 AS tx_id, 'user:' || user_id AS key,
               160 * (event_id // 160) + event_id % 40 + 140 AS end_seq, hex(encode(props)) AS value_hex, {sets} AS is_set FROM events)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM ops WHERE is_set),
fold AS (
  SELECT key, rn, TRUE AS ok, tx_id AS holder, end_seq AS until FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.key, n.rn, f.holder = n.tx_id OR f.until <= n.seq,
         CASE WHEN f.holder = n.tx_id OR f.until <= n.seq THEN n.tx_id ELSE f.holder END,
         CASE WHEN f.holder = n.tx_id OR f.until <= n.seq THEN n.end_seq ELSE f.until END
  FROM fold f JOIN numbered n ON n.key = f.key AND n.rn = f.rn + 1),
folded AS (SELECT n.*, f.ok, f.holder FROM numbered n JOIN fold f USING (key, rn)),
votes AS (SELECT tx_id, owner, bool_or(ok) AS can_commit FROM folded GROUP BY ALL),
voted AS (SELECT tx_id, bool_and(can_commit) AS all_yes, count(*) AS n_participants FROM votes GROUP BY ALL),
tx AS (
  SELECT tx_id, first_seq, last_seq, priority, client_end, coalesce(n_participants, 0) AS n_participants,
         CASE WHEN client_end = 'COMMIT' AND coalesce(all_yes, TRUE) THEN 'COMMITTED' ELSE 'ABORTED' END AS state,
         CASE WHEN client_end = 'COMMIT' AND NOT coalesce(all_yes, TRUE) THEN 'no_intents' ELSE '' END AS error
  FROM (SELECT tx_id, min(seq) AS first_seq, max(end_seq) AS last_seq, max(priority) AS priority, max(client_end) AS client_end FROM ops GROUP BY ALL) LEFT JOIN voted USING (tx_id)),
steps AS (
  SELECT tx_id, 2 * first_seq + 1 AS pos, 2 AS ticks, 'begin' AS kind FROM tx
  UNION ALL SELECT tx_id, 2 * last_seq, CASE WHEN state = 'COMMITTED' AND n_participants > 0 THEN 1 ELSE 0 END, 'end' FROM tx),
counted AS (SELECT *, coalesce(sum(ticks) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM steps),
timed AS (
  SELECT tx.*, b.before + 1 AS snapshot_ts, b.before + 2 AS created_ts, CASE WHEN e.ticks = 1 THEN e.before + 1 END AS commit_ts
  FROM tx JOIN counted b ON b.tx_id = tx.tx_id AND b.kind = 'begin' JOIN counted e ON e.tx_id = tx.tx_id AND e.kind = 'end'),
held AS (SELECT tx_id, key, owner, max(seq) AS seq, arg_max(value_hex, seq) AS value_hex FROM folded WHERE ok GROUP BY ALL)
"""


_STREAKS = """, runs AS (SELECT *, sum(ok::INT) OVER (PARTITION BY tx_id, owner ORDER BY seq) AS run FROM folded),
streaks AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY tx_id, owner, run ORDER BY seq) END::BIGINT AS streak FROM runs)
"""

_HIGH = "least(5 * (1 << least(streak, 8)::INT) * 500 // greatest(1, least(1000, priority)), 2000)"

_MIDDLE = "(SELECT count(*) // 2 FROM events)"

_READS = """, gets AS (SELECT seq AS request_id, tx_id, key, snapshot_ts FROM ops JOIN timed USING (tx_id) WHERE NOT is_set),
made AS (SELECT key, commit_ts, h.value_hex FROM held h JOIN timed USING (tx_id) WHERE state = 'COMMITTED'),
seen AS (SELECT g.request_id, max(m.commit_ts) AS commit_ts, arg_max(m.value_hex, m.commit_ts) AS value_hex FROM gets g JOIN made m ON m.key = g.key AND m.commit_ts <= g.snapshot_ts GROUP BY ALL),
own AS (SELECT g.request_id, arg_max(f.value_hex, f.seq) AS value_hex FROM gets g JOIN folded f ON f.ok AND f.tx_id = g.tx_id AND f.key = g.key AND f.seq < g.request_id GROUP BY ALL),
answers AS (SELECT g.*, s.request_id IS NOT NULL OR o.request_id IS NOT NULL AS found, o.request_id IS NOT NULL AS is_own, CASE WHEN o.request_id IS NOT NULL THEN o.value_hex ELSE s.value_hex END AS value_hex
  FROM gets g LEFT JOIN seen s USING (request_id) LEFT JOIN own o USING (request_id))
"""

_WAL = """, told AS (SELECT DISTINCT t.*, v.owner AS core FROM timed t JOIN votes v USING (tx_id)),
records AS (
  SELECT 0 AS core_id, 2 * first_seq + 1 AS pos, 0 AS sub, 'TX_BEGIN' AS type, tx_id, NULL AS key, NULL AS value_hex, snapshot_ts, NULL::BIGINT AS commit_ts FROM timed
  UNION ALL SELECT owner, 2 * seq + 1, 1, 'INTENT', tx_id, key, value_hex, NULL, NULL FROM folded WHERE ok
  UNION ALL SELECT core, 2 * last_seq, 0, 'PREPARE', tx_id, NULL, NULL, NULL, NULL FROM told WHERE client_end = 'COMMIT' AND (tx_id, core) IN (SELECT (tx_id, owner) FROM votes WHERE can_commit)
  UNION ALL SELECT 0, 2 * last_seq, 1, CASE WHEN state = 'COMMITTED' THEN 'COMMIT_DECISION' ELSE 'ABORT_DECISION' END, tx_id, NULL, NULL, NULL, CASE WHEN state = 'COMMITTED' THEN commit_ts END FROM timed WHERE n_participants > 0 OR client_end <> 'COMMIT'
  UNION ALL SELECT core, 2 * last_seq, 2, CASE WHEN state = 'COMMITTED' THEN 'COMMIT_FINALIZE' ELSE 'ABORT_FINALIZE' END, tx_id, NULL, NULL, NULL, CASE WHEN state = 'COMMITTED' THEN commit_ts END FROM told),
wal AS (SELECT *, row_number() OVER (PARTITION BY core_id ORDER BY pos, sub) AS lsn FROM records),
cut AS (SELECT * FROM wal WHERE pos < 2 * (SELECT count(*) // 2 FROM events)),
coordinator AS (
  SELECT tx_id, CASE WHEN bool_or(type = 'COMMIT_DECISION') THEN 'COMMITTED' ELSE 'ABORTED' END AS state, max(snapshot_ts) AS snapshot_ts, max(commit_ts) AS commit_ts
  FROM cut WHERE core_id = 0 AND type IN ('TX_BEGIN', 'COMMIT_DECISION', 'ABORT_DECISION') GROUP BY ALL)
"""

_LATEST = f"WITH {_VERSIONS}, latest AS (SELECT key, max(chain_pos) AS chain_pos, arg_max(commit_ts, chain_pos) AS commit_ts, arg_max(value_hex, chain_pos) AS value_hex, arg_max(is_deleted, chain_pos) AS is_deleted FROM versions GROUP BY key) "

_GC = f"""WITH {_VERSIONS}, marked AS (SELECT *, chain_pos < max(chain_pos) OVER (PARTITION BY key) AND commit_ts < (SELECT 3 * count(*) // 3 FROM events) AS one FROM versions),
counted AS (SELECT *, sum((NOT one)::INT) OVER (PARTITION BY key) AS kept FROM marked),
gone AS (SELECT *, one OR (kept = 1 AND is_deleted AND commit_ts < (SELECT 3 * count(*) // 3 FROM events)) AS removed FROM counted) """

_TASKS = f"""WITH tasks AS (
  SELECT event_id AS request_id, ['GET', 'SET', 'BEGIN', 'TX_GET', 'TX_SET', 'COMMIT', 'ROLLBACK', 'HEARTBEAT', 'PREPARE', 'GC', 'OTHER'][event_id % 11 + 1] AS op, 'user:' || user_id AS key, event_id % 6 AS core FROM events),
sent AS (SELECT *, CASE WHEN op IN ('BEGIN', 'COMMIT', 'ROLLBACK', 'HEARTBEAT') THEN 0 WHEN op IN ('PREPARE', 'GC') THEN core WHEN op <> 'OTHER' THEN {_OWNER.format(cores=4)} END AS target FROM tasks),
routed AS (SELECT * FROM sent WHERE target BETWEEN 0 AND 3) """

_TOLD = ", told AS (SELECT DISTINCT t.*, v.owner AS core FROM timed t JOIN votes v USING (tx_id)) "

#: The reflected polynomial's table, and the checksum of a value's bytes.
_CRC = """WITH eight AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END)) AS t),
raw AS (SELECT event_id AS chain_pos, hex(encode(props)) AS h FROM events),
bytes AS (SELECT chain_pos, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, (i + 1)::BIGINT, 2))::BIGINT) AS b FROM raw),
summed AS (SELECT chain_pos, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS crc FROM bytes, eight) """

ORACLE_SQL: dict[str, str] = {
    "kv_current": f"WITH {_LOG} SELECT key, value_hex FROM (SELECT key, arg_max(value_hex, seq) AS value_hex, arg_max(is_deleted, seq) AS gone FROM kv GROUP BY key) WHERE NOT gone",
    "kv_get": f"""WITH {_LOG}, live AS (SELECT key, value_hex FROM (SELECT key, arg_max(value_hex, seq) AS value_hex, arg_max(is_deleted, seq) AS gone FROM kv GROUP BY key) WHERE NOT gone)
SELECT k.key, l.key IS NOT NULL AS found, l.value_hex FROM (SELECT 'cust:' || c_custkey AS key FROM customer) k LEFT JOIN live l ON l.key = k.key""",
    "kv_get_prior": f"""WITH {_LOG}, prior AS (SELECT seq, key, lag(value_hex) OVER w AS value_hex, lag(is_deleted) OVER w AS gone FROM kv WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT seq, key, gone IS NOT NULL AND NOT gone AS found, CASE WHEN NOT gone THEN value_hex END AS value_hex FROM prior""",
    "kv_delete": f"WITH {_LOG} SELECT key, value_hex FROM (SELECT key, arg_max(value_hex, seq) AS value_hex, arg_max(is_deleted, seq) AS gone FROM kv GROUP BY key) WHERE NOT gone AND substr(key, 6)::BIGINT % 2 = 0",
    "kv_size": f"WITH {_LOG} SELECT count(*) AS n_keys FROM (SELECT key, arg_max(is_deleted, seq) AS gone FROM kv GROUP BY key) WHERE NOT gone",
    "mvcc_snapshot_read": f"WITH {_VERSIONS} SELECT key, arg_max(value_hex, chain_pos) AS value_hex, arg_max(is_deleted, chain_pos) AS is_deleted, arg_max(commit_ts, chain_pos) AS commit_ts FROM versions WHERE commit_ts <= (SELECT 3 * count(*) // 2 FROM events) GROUP BY key",
    "mvcc_read_batch": f"""WITH {_VERSIONS}, requests AS (SELECT o_orderkey AS request_id, 'user:' || (o_custkey % 200) AS key, o_orderkey * 7 % (3 * (SELECT count(*) FROM events)) AS snapshot_ts FROM orders)
SELECT r.request_id, r.key, r.snapshot_ts, v.key IS NOT NULL AS found, v.value_hex, coalesce(v.is_deleted, FALSE) AS is_deleted, v.commit_ts
FROM requests r ASOF LEFT JOIN versions v ON r.key = v.key AND r.snapshot_ts >= v.commit_ts""",
    "mvcc_latest_committed": f"{_LATEST} SELECT key, commit_ts, value_hex, is_deleted FROM latest",
    "intent_conflict_fold": f"{_run()} SELECT seq, tx_id, key, ok, holder FROM folded",
    "conflict_streak": f"{_run()}{_STREAKS} SELECT seq, tx_id, owner, streak FROM streaks",
    "backoff_bounds": f"{_run()}{_STREAKS} SELECT seq, streak, ({_HIGH} // 2)::BIGINT AS low_ms, ({_HIGH})::BIGINT AS high_ms FROM streaks WHERE NOT ok",
    "participants": f"{_run()} SELECT DISTINCT tx_id, owner FROM ops",
    "prepare_votes": f"{_run()} SELECT tx_id, owner, can_commit, CASE WHEN can_commit THEN '' ELSE 'no_intents' END AS reason FROM votes",
    "tx_outcomes": f"{_run()} SELECT tx_id, state, error, n_participants FROM tx",
    "ts_allocation": f"{_run()} SELECT tx_id, snapshot_ts, created_ts, commit_ts FROM timed",
    "tx_commit_versions": f"{_run()} SELECT h.key, tx_id, commit_ts, h.value_hex FROM held h JOIN timed USING (tx_id) WHERE state = 'COMMITTED'",
    "tx_abort_cleanup": f"{_run()} SELECT tx_id, key, seq FROM held WHERE tx_id NOT IN (SELECT tx_id FROM tx WHERE state = 'ABORTED')",
    "mvcc_own_intent_overlay": _run("event_type <> 'view'") + _READS + "SELECT request_id, key, found, is_own, value_hex FROM answers",
    "mvcc_read_set": _run("event_type <> 'view'") + _READS + "SELECT DISTINCT tx_id, key FROM answers WHERE found AND NOT is_own",
    "gc_survivors": f"{_GC} SELECT key, commit_ts, is_deleted FROM gone WHERE NOT removed",
    "gc_removed_counts": f"{_GC} SELECT key, count(*) AS removed FROM gone WHERE removed GROUP BY key",
    "gc_watermark": f"{_run()} SELECT min(snapshot_ts) AS watermark, count(*) AS n_active FROM timed WHERE first_seq <= {_MIDDLE} AND last_seq > {_MIDDLE}",
    "tx_states": f"{_run()} SELECT CASE WHEN last_seq <= {_MIDDLE} THEN state ELSE 'ACTIVE' END AS state_at, count(*) AS n FROM timed WHERE first_seq <= {_MIDDLE} GROUP BY ALL",
    "lease_expired": """SELECT tx_id, seq, gap_us FROM (SELECT user_id AS tx_id, event_id AS seq, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap_us FROM events) WHERE gap_us > 21600000000""",
    "terminal_purge": f"""{_run()} SELECT tx_id, state FROM (SELECT tx_id, created_ts, CASE WHEN last_seq <= {_MIDDLE} THEN state ELSE 'ACTIVE' END AS state FROM timed WHERE first_seq <= {_MIDDLE})
WHERE NOT (state <> 'ACTIVE' AND 2 * {_MIDDLE} // 4 - created_ts > 1000)""",
    "group_commit_batches": f"{_run()} SELECT last_seq // 64 AS batch, count(*) AS n_commits, min(commit_ts) AS first_ts, max(commit_ts) AS last_ts, sum(n_participants)::BIGINT AS n_finalize FROM timed WHERE state = 'COMMITTED' AND n_participants > 0 GROUP BY ALL",
    "wal_tail": f"{_run()}{_WAL} SELECT core_id, lsn, type, tx_id, key, value_hex, snapshot_ts, commit_ts FROM wal WHERE lsn > 100",
    "wal_next_lsn": f"{_run()}{_WAL} SELECT core_id, max(lsn) + 1 AS next_lsn FROM cut GROUP BY ALL",
    "wal_replay_core": f"""{_run()}{_WAL} SELECT i.core_id, i.key, f.commit_ts, i.value_hex
FROM (SELECT core_id, tx_id, key, arg_max(value_hex, lsn) AS value_hex FROM cut WHERE type = 'INTENT' GROUP BY ALL) i JOIN (SELECT core_id, tx_id, commit_ts FROM cut WHERE type = 'COMMIT_FINALIZE') f USING (core_id, tx_id)""",
    "recover_coordinator": f"{_run()}{_WAL} SELECT tx_id, state, snapshot_ts, commit_ts FROM coordinator",
    "recovery_counters": f"{_run()}{_WAL} SELECT max(tx_id) AS max_tx_id, max(greatest(coalesce(snapshot_ts, 0), coalesce(commit_ts, 0))) AS max_ts FROM cut WHERE core_id = 0",
    "resolve_in_doubt": f"""{_run()}{_WAL}, open AS (SELECT DISTINCT core_id, tx_id FROM cut WHERE type = 'INTENT' AND (core_id, tx_id) NOT IN (SELECT (core_id, tx_id) FROM cut WHERE type IN ('COMMIT_FINALIZE', 'ABORT_FINALIZE')))
SELECT o.tx_id, o.core_id AS core, CASE WHEN c.state = 'COMMITTED' THEN 'FINALIZE_COMMIT' ELSE 'FINALIZE_ABORT' END AS action, CASE WHEN c.state = 'COMMITTED' THEN c.commit_ts END AS commit_ts FROM open o LEFT JOIN coordinator c USING (tx_id)""",
    "checkpoint_entries": f"{_LATEST} SELECT {_OWNER.format(cores=4)} AS core_id, key, value_hex, commit_ts, is_deleted FROM latest",
    "checkpoint_header": f"""{_LATEST} SELECT c.core_id::BIGINT AS core_id, 4::BIGINT AS num_cores, 1::BIGINT AS layout_epoch, 0::BIGINT AS wal_lsn, coalesce(n, 0) AS entry_count
FROM range(4) c(core_id) LEFT JOIN (SELECT {_OWNER.format(cores=4)} AS core_id, count(*) AS n FROM latest GROUP BY ALL) e ON e.core_id = c.core_id""",
    "repartition_layout": f"{_LATEST} SELECT key, commit_ts, {_OWNER.format(cores=4)} AS old_core, {_OWNER.format(cores=6)} AS core_id FROM latest WHERE NOT is_deleted",
    "router_distribution": f"WITH {_VERSIONS} SELECT {_OWNER.format(cores=4)} AS core_id, count(*) AS n_tasks, count(DISTINCT key) AS n_keys FROM versions GROUP BY 1",
    "latency_report": """WITH s AS (SELECT event_type AS metric, floor(value * 1000)::BIGINT AS us FROM events)
SELECT metric, count(*) AS n, count(*) / 20.0::DOUBLE AS qps, percentile_disc(0.5) WITHIN GROUP (ORDER BY us) / 1000.0::DOUBLE AS p50_ms, percentile_disc(0.95) WITHIN GROUP (ORDER BY us) / 1000.0::DOUBLE AS p95_ms,
  percentile_disc(0.99) WITHIN GROUP (ORDER BY us) / 1000.0::DOUBLE AS p99_ms, percentile_disc(0.999) WITHIN GROUP (ORDER BY us) / 1000.0::DOUBLE AS p999_ms FROM s GROUP BY metric""",
    "bench_outcome_mix": f"""{_run()}, lost AS (SELECT tx_id, count(*) AS n FROM folded WHERE NOT ok GROUP BY ALL),
mix AS (SELECT count(*) AS attempts, count(*) FILTER (state = 'COMMITTED') AS committed, count(*) FILTER (state <> 'COMMITTED' AND coalesce(n, 0) > 0) AS conflict_abort, count(*) FILTER (state <> 'COMMITTED' AND coalesce(n, 0) = 0) AS other_abort, coalesce(sum(n), 0)::BIGINT AS retries FROM tx LEFT JOIN lost USING (tx_id))
SELECT *, (committed * 100.0::DOUBLE) / attempts AS committed_pct, (conflict_abort * 100.0::DOUBLE) / attempts AS conflict_pct, (other_abort * 100.0::DOUBLE) / attempts AS other_pct, retries::DOUBLE / attempts AS retries_per_tx FROM mix""",
    "backoff_waits": f"{_run()}{_STREAKS} SELECT seq, ({_HIGH} // 2 + ('0x' || substr(md5(tx_id || ':' || seq), 1, 8))::BIGINT % ({_HIGH} - {_HIGH} // 2 + 1))::BIGINT AS wait_ms FROM streaks WHERE NOT ok",
    "crc32c_check": f"{_CRC} SELECT chain_pos, crc, ((((crc >> 15) | (crc << 17)) & 4294967295) + 2726488792) & 4294967295 AS masked, TRUE AS same FROM summed",
    "wal_binary_roundtrip": f"{_run()}{_WAL} SELECT core_id::BIGINT AS core_id, type, count(*) AS n, max(lsn) AS max_lsn, sum(length(value_hex) // 2)::BIGINT AS n_bytes FROM cut GROUP BY ALL",
    "mvcc_restore": f"{_LATEST} SELECT key, commit_ts, value_hex, is_deleted FROM latest",
    "kv_clear": "SELECT 0::BIGINT AS n_keys",
    "tx_acknowledged": f"{_run()}{_TOLD} SELECT t.tx_id, coalesce(n, 0) AS n_acks, coalesce(n, 0) >= n_participants AS answered FROM timed t LEFT JOIN (SELECT tx_id, count(*) AS n FROM told WHERE core <> 3 GROUP BY ALL) a ON a.tx_id = t.tx_id",
    "tx_expired": f"""{_run()} SELECT tx_id, 'ABORTED' AS state, CASE WHEN tx_id % 3 = 0 THEN 'prepare_timeout' END AS error FROM timed
WHERE (tx_id % 3 <> 0 AND 100 * {_MIDDLE} - 100 * first_seq > 30000) OR (tx_id % 3 = 0 AND 100 * {_MIDDLE} - 100 * last_seq > 10000)""",
    "finalize_resent": f"{_run()}{_TOLD} SELECT tx_id, core, 100 * {_MIDDLE} AS sent_ms FROM told WHERE 100 * {_MIDDLE} - 100 * last_seq > 10000",
    "routed_tasks": f"""{_TASKS} SELECT request_id, CASE WHEN op IN ('PREPARE', 'GC') THEN 'unknown' WHEN op LIKE 'TX%' THEN 'tx ' || lower(substr(op, 4)) ELSE lower(op) END AS label,
  op IN ('BEGIN', 'COMMIT', 'ROLLBACK', 'HEARTBEAT') AS control, op IN ('TX_GET', 'TX_SET') AS execute, target FROM routed""",
    "matched_responses": f"{_TASKS} SELECT t.request_id, t.op, r.key AS value FROM tasks t LEFT JOIN (SELECT 2 * request_id AS request_id, key FROM routed WHERE target = 1) r ON r.request_id = t.request_id",
    "value_bytes": "SELECT event_id, hex(encode(props)) AS value_hex, octet_length(encode(props)) AS n_bytes FROM events",
    "merged_counters": "SELECT count(*) AS ops, sum(floor(value * 1000)::BIGINT)::BIGINT AS us, count(*) FILTER (event_type = 'error') AS errors FROM events",
    "measured_samples": "SELECT event_type AS metric, count(*) AS n FROM events WHERE event_id >= (SELECT count(*) // 10 FROM events) GROUP BY ALL",
    "repartition_headers": f"""{_LATEST} SELECT c.core_id::BIGINT AS core_id, 6::BIGINT AS num_cores, 2::BIGINT AS layout_epoch, 0::BIGINT AS wal_lsn, coalesce(n, 0) AS entry_count
FROM range(6) c(core_id) LEFT JOIN (SELECT {_OWNER.format(cores=6)} AS core_id, count(*) AS n FROM latest WHERE NOT is_deleted GROUP BY ALL) e ON e.core_id = c.core_id""",
    "largest_applied": f"{_run()}{_WAL} SELECT core_id::BIGINT AS core_id, coalesce(max(lsn) FILTER (type IN ('INTENT', 'COMMIT_FINALIZE', 'ABORT_FINALIZE')), 0) AS max_lsn FROM cut GROUP BY ALL",
}
