"""Schemas, error names and fixed numbers of the store whose history is replayed."""

from __future__ import annotations

VERSIONS = "key string, chain_pos bigint, commit_ts bigint, value binary, tx_id bigint, is_intent boolean, is_deleted boolean"
KV_LOG = "seq bigint, key string, value binary, is_deleted boolean"
COMMANDS = "seq bigint, now_ms bigint, request_id bigint, op string, tx_id bigint, key string, value binary, priority int"
RESPONSES = "request_id bigint, op string, tx_id bigint, found boolean, value binary, success boolean, error string, retry_after_ms int, snapshot_ts bigint, priority int"
TX = "tx_id bigint, snapshot_ts bigint, commit_ts bigint, state string, participants array<int>, priority int, created_ms bigint, last_heartbeat_ms bigint"
WAL = "core_id int, lsn bigint, type string, tx_id bigint, snapshot_ts bigint, commit_ts bigint, key string, value binary, is_deleted boolean, vote_yes boolean, snapshot_lsn bigint"
SNAPSHOT_HEADER = "core_id int, num_cores int, layout_epoch bigint, wal_lsn bigint, entry_count bigint"
SNAPSHOT_ENTRY = "core_id int, key string, value binary, commit_ts bigint, is_deleted boolean"
TOPOLOGY = "num_cores int, layout_epoch bigint"
LATENCY = "thread int, metric string, us int"

# The names that answers carry.
TX_NOT_FOUND = "tx_not_found"
TX_NOT_ACTIVE = "tx_not_active"
WRITE_CONFLICT = "write_write_conflict"
NO_INTENTS = "no_intents"
PREPARE_REJECTED = "prepare_rejected"
PREPARE_TIMEOUT = "prepare_timeout"
INVALID_OPERATION = "invalid_operation: expected GET or SET"
ACTIVE, PREPARING, COMMITTED, ABORTED = "ACTIVE", "PREPARING", "COMMITTED", "ABORTED"

# Priorities, backoff (ms) and time limits (ms).
PRIORITY_LEAST, PRIORITY_NORMAL, PRIORITY_MOST = 1, 500, 1000
BACKOFF_BASE, BACKOFF_MOST, BACKOFF_STREAK = 5, 2000, 8
LEASE_MS, STUCK_MS, PURGE_MS = 30_000, 10_000, 60_000

# Record types of the log, in the order of their codes from 1.
WAL_TYPES = ("TX_BEGIN", "INTENT", "PREPARE", "COMMIT_DECISION", "ABORT_DECISION", "COMMIT_FINALIZE", "ABORT_FINALIZE", "CHECKPOINT")
