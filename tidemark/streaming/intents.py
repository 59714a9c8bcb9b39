"""The conflict fold and leases on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOLD_SCHEMA = "seq bigint, key string, tx_id bigint, ok boolean, holder bigint"
LEASE_SCHEMA = "tx_id bigint, last_ms bigint, event string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    holder, until = state.get if state.exists else (-1, -1)
    rows = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    out = []
    for seq, tx, end in zip(rows["seq"].tolist(), rows["tx_id"].tolist(), rows["end_seq"].tolist(), strict=True):
        ok = holder == -1 or holder == tx or until <= seq
        if ok:
            holder, until = tx, end
        out.append((seq, key[0], tx, ok, holder))
    state.update((holder, until))
    yield pd.DataFrame(out, columns=["seq", "key", "tx_id", "ok", "holder"])


def fold_conflicts_stream(writes: DataFrame) -> DataFrame:
    """The batch fold on a stream of writes (seq, key, tx_id, end_seq), keyed by key; a key's rows must arrive in order across micro-batches. The state of a key is one holder."""
    return writes.groupBy("key").applyInPandasWithState(_fold, FOLD_SCHEMA, "holder bigint, until bigint", "append", GroupStateTimeout.NoTimeout)


def _lease(lease_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], last, "expired")], columns=["tx_id", "last_ms", "event"])
            return
        last = max([state.get[0]] if state.exists else [-1])
        out = []
        for now in sorted(t for b in batches for t in b["ts"].astype("int64").floordiv(1000 if str(b["ts"].dtype).endswith("us]") else 1_000_000).tolist()):
            if last >= 0 and now - last > lease_ms:
                out.append((key[0], last, "expired"))
            last = now
        state.update((last,))
        # A gap as long as the lease isn't one; the timer is for one millisecond more.
        state.setTimeoutTimestamp(max(last + lease_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["tx_id", "last_ms", "event"])

    return run


def expired_leases_stream(activity: DataFrame, lease_ms: int, delay: str = "1 minute") -> DataFrame:
    """``expired`` for each transaction (tx_id, ts) without activity for longer than the lease, by event time."""
    return activity.withWatermark("ts", delay).groupBy("tx_id").applyInPandasWithState(_lease(lease_ms), LEASE_SCHEMA, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
