"""The coordinator's and the chains' scripts with their literal results."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import gc, intents, mvcc, transactions
from tidemark.plans.replay import Client, Engine, Replay, Store, backoff_range, md5_owner, recovered_rows, replay


def test_snapshot_reads():
    s, one, two = Store(), Client(), Client()
    assert s.get(1, one, "k", 10) == (False, None, False)
    s.put(1, one, "k", b"mine")
    assert s.get(1, one, "k", 10)[1] == b"mine" and not s.get(2, two, "k", 10)[0] and not one.reads
    s, three = Store(), Client()
    s.add("k", 100, b"v100")
    s.add("k", 50, b"v50")
    assert [s.get(3, three, "k", t)[1] for t in (49, 50, 75, 99, 100, 150)] == [None, b"v50", b"v50", b"v50", b"v100", b"v100"]
    assert three.reads == {"k"}
    s.put(2, two, "k", b"intent")
    assert s.get(2, two, "k", 50)[1] == b"intent" and s.get(9, Client(), "k", 50)[1] == b"v50"
    s.end(2, two, None)
    s.end(3, three, None)
    assert three.reads == {"k"} and s.get(2, two, "k", 60)[1] == b"v50"


def test_write_conflicts_and_votes():
    s, one, two, four = Store(), Client(), Client(), Client()
    assert s.put(1, one, "k", b"1") and not s.put(2, two, "k", b"2") and s.put(1, one, "k", b"3")
    assert s.ready(1, one) == "" and s.ready(2, two) == s.ready(1, one, {"other"}) == S.NO_INTENTS
    s.end(1, one, 7)
    assert s.ready(1, one) == S.NO_INTENTS and s.get(5, Client(), "k", 7)[1] == b"3" and list(s.newest()) == [("k", 7, False, b"3")]
    s.put(4, four, "n", b"x")
    s.holder["n"] = 5
    assert s.ready(4, four) == "intent_replaced:n"
    del s.holder["n"]
    assert s.ready(4, four) == "intent_missing:n"
    s.end(4, four, 9)
    assert "n" not in s.versions


def test_streaks():
    r = Replay(md5_owner(1))
    call = lambda op, tx=None, key=None: r.handle({"op": op, "now_ms": 0, "key": key, "request_id": 0, "tx_id": tx, "value": b"v", "priority": 500})
    a, b, c = (call("BEGIN")["tx_id"] for _ in range(3))
    call("TX_SET", a, "k")
    assert [call("TX_SET", b, "k")["retry_after_ms"] for _ in range(3)] == [backoff_range(n, 500)[1] for n in (1, 2, 3)]
    assert call("TX_SET", c, "k")["retry_after_ms"] == backoff_range(1, 500)[1]
    assert call("TX_SET", b, "free")["success"] and call("TX_SET", b, "k")["retry_after_ms"] == backoff_range(1, 500)[1]


def test_a_recovered_store_goes_on(spark):
    versions = spark.createDataFrame([("a", b"1", 50, False), ("a", b"2", 60, False), ("t", b"", 55, True)], "key string, value binary, commit_ts bigint, is_deleted boolean")
    outcomes = spark.createDataFrame([(4, S.COMMITTED), (6, S.ABORTED)], "tx_id bigint, state string")
    counters = spark.createDataFrame([(6, 60)], "max_tx_id bigint, max_ts bigint")
    e = Engine(spark, 2)
    e.begin()
    got, gone, old = e.execute(7, "GET", "a"), e.execute(7, "GET", "t"), e.commit(4)
    r = {x.request_id: x for x in replay(recovered_rows(versions, outcomes, counters).unionByName(e.commands()), 2).collect()}
    assert (r[0].tx_id, r[0].snapshot_ts) == (7, 61) and bytes(r[got].value) == b"2" and r[gone].found and r[old].error == S.TX_NOT_ACTIVE


GC_CASES = [
    ({"k": [(10, 0), (20, 0), (30, 0)]}, 25, 2, {("k", 30)}), ({"k": [(5, 0)]}, 100, 0, {("k", 5)}), ({"k": [(5, 1)]}, 10, 1, set()),
    ({"k": [(15, 1)]}, 10, 0, {("k", 15)}), ({"k": [(5, 0)]}, 0, 0, {("k", 5)}), ({"a": [(5, 0), (15, 0)], "b": [(20, 0)]}, 10, 1, {("a", 15), ("b", 20)}),
    ({"x": [(10, 0), (20, 0), (30, 0)], "y": [(5, 0), (15, 0)]}, 25, 3, {("x", 30), ("y", 15)}),
]


@pytest.mark.parametrize("chains, watermark, removed, left", GC_CASES)
def test_garbage(spark, chains, watermark, removed, left):
    c = Store()
    for k, versions in chains.items():
        for ts, gone in versions:
            c.add(k, ts, b"v", bool(gone))
    assert c.forget_before(watermark) == removed and {(k, v[0]) for k, vs in c.versions.items() for v in vs} == left
    rows = [(k, i, ts, bool(gone)) for k, versions in chains.items() for i, (ts, gone) in enumerate(versions)]
    df = spark.createDataFrame(rows, "key string, chain_pos bigint, commit_ts bigint, is_deleted boolean")
    assert {(r.key, r.commit_ts) for r in gc.survivors(df, watermark).collect()} == left
    assert (gc.removed_counts(df, watermark).agg(F.sum("removed")).head()[0] or 0) == removed


def test_garbage_keeps_intents_and_strict_mode_keeps_readable_versions(spark):
    df = spark.createDataFrame([("k", 0, 10, False, False), ("k", 1, 0, True, False), ("i", 0, 0, True, False), ("r", 0, 10, False, False), ("r", 1, 20, False, False), ("r", 2, 30, False, False)], "key string, chain_pos bigint, commit_ts bigint, is_intent boolean, is_deleted boolean")
    assert {(r.key, r.chain_pos) for r in gc.survivors(df, 25).collect()} == {("k", 0), ("k", 1), ("i", 0), ("r", 2)}
    assert {(r.key, r.chain_pos) for r in gc.survivors(df, 25, keep_readable=True).collect()} == {("k", 0), ("k", 1), ("i", 0), ("r", 1), ("r", 2)}


@pytest.mark.parametrize("streak, priority, bounds", [(0, 500, (2, 5)), (1, 500, (5, 10)), (8, 500, (640, 1280)), (58, 1, (1000, 2000)), (4, 900, (22, 44)), (2, 0, (1000, 2000))])
def test_backoff(spark, streak, priority, bounds):
    from tidemark.functions.scalar import backoff_high, backoff_jitter, backoff_low

    assert backoff_range(streak, priority) == bounds
    row = spark.range(50).select(backoff_low(F.lit(streak), F.lit(priority)), backoff_high(F.lit(streak), F.lit(priority)), backoff_jitter(F.lit(streak), F.lit(priority), F.col("id"))).collect()
    assert all((a, b) == bounds and a <= j <= b for a, b, j in row)


def test_calls(spark):
    e = Engine(spark, 2)
    e.set("p", b"plain")
    got = e.get("p")
    a, b = e.begin(), e.begin(priority=900)
    w = e.execute(a, "SET", "p", b"1")
    lost = e.execute(b, "SET", "p", b"2")
    own, other = e.execute(a, "GET", "p"), e.execute(b, "GET", "p")
    bad = e.execute(b, "set", "p")
    done, no, again = e.commit(a), e.commit(b), e.commit(a)
    unknown = e.heartbeat(77)
    c = e.begin(now_ms=1000)
    seen = e.execute(c, "GET", "p", now_ms=1000)
    e.tick(31_001)
    late = e.heartbeat(c, now_ms=31_001)
    d = e.begin(now_ms=40_000)
    e.tick(70_000)
    alive = e.heartbeat(d, now_ms=70_000)
    ended = e.rollback(d)
    r = {x.request_id: x for x in e.responses().collect()}
    assert bytes(r[got].value) == b"plain" and r[w].success and r[lost].error == S.WRITE_CONFLICT and r[lost].retry_after_ms == 5
    assert bytes(r[own].value) == b"1" and not r[other].found and r[bad].error == S.INVALID_OPERATION
    assert r[done].success and r[no].error == S.NO_INTENTS and r[again].error == S.TX_NOT_ACTIVE and r[unknown].error == S.TX_NOT_FOUND
    assert bytes(r[seen].value) == b"1" and r[late].error == S.TX_NOT_ACTIVE and r[alive].success and r[ended].success
    begins = sorted((x for x in r.values() if x.op == "BEGIN"), key=lambda x: x.request_id)
    assert [(x.tx_id, x.snapshot_ts, x.priority) for x in begins] == [(1, 1, 500), (2, 3, 900), (3, 6, 500), (4, 8, 500)]


@pytest.mark.parametrize("seed", range(4))
def test_operators_equal_the_state_machine_on_random_logs(spark, seed):
    """Transactions that end at known steps: fold, votes, outcomes, timestamps and reads against the replay."""
    rng = random.Random(seed)
    ops, ends = [], {}
    for tx in range(1, 40):
        begin = tx * 10 + rng.randrange(5)
        steps = sorted(rng.sample(range(begin, begin + 60), rng.randint(1, 5)))
        ends[tx] = steps[-1] + rng.randint(1, 30)
        ops += [(s, tx, f"k{rng.randrange(12)}", rng.choice(["SET", "SET", "GET"])) for s in steps]
    ops = [(i, *o[1:]) if False else o for i, o in enumerate(sorted(ops))]
    # One step for each operation; ends come between.
    order = sorted([(s, 1, i, tx, k, op) for i, (s, tx, k, op) in enumerate(ops)] + [(e, 0, -1, tx, "", "END") for tx, e in ends.items()])
    at, rows, end_of = 0, [], {}
    for _, _, _, tx, k, op in order:
        at += 1
        if op == "END":
            end_of[tx] = at
        else:
            rows.append((at, tx, k, op))
    client = {tx: "ROLLBACK" if tx % 7 == 0 else "COMMIT" for tx in ends}
    owner, machine = md5_owner(3), Replay(md5_owner(3))
    first, name, answers = {}, {}, {}
    for seq, tx, k, op in sorted(rows + [(e, tx, "", "END") for tx, e in end_of.items()]):
        call = lambda o, **x: machine.handle({"op": o, "now_ms": 0, "key": None, "request_id": seq, "tx_id": name.get(tx), "value": None, "priority": None} | x)  # noqa: B023, E731
        if op == "END":
            answers[tx, "end"] = call(client[tx])
            continue
        if tx not in first:
            first[tx] = call("BEGIN")
            name[tx] = first[tx]["tx_id"]
        answers[seq] = call(f"TX_{op}", key=k, value=str(seq).encode())
    df = spark.createDataFrame([(s, tx, k, op, owner(k), end_of[tx], client[tx], str(s).encode(), 500) for s, tx, k, op in rows], "seq bigint, tx_id bigint, key string, op string, owner int, end_seq bigint, client_end string, value binary, priority int")
    folded = intents.fold_conflicts(df.where("op = 'SET'"))
    for r in folded.collect():
        assert r.ok == answers[r.seq]["success"], r
    tx = transactions.allocate_timestamps(transactions.transactions(df, folded))
    for r in tx.collect():
        assert r.snapshot_ts == first[r.tx_id]["snapshot_ts"]
        end = answers[r.tx_id, "end"]
        assert (r.state == "COMMITTED", r.error) == (client[r.tx_id] == "COMMIT" and end["success"], end["error"])
    versions = intents.commit(intents.intents(folded), tx.where("state = 'COMMITTED'")).select("key", F.col("commit_ts").alias("chain_pos"), "commit_ts", "value", F.lit(False).alias("is_deleted"))
    gets = df.where("op = 'GET'").join(tx.select("tx_id", "snapshot_ts"), "tx_id").select(F.col("seq").alias("request_id"), "seq", "tx_id", "key", "snapshot_ts")
    for r in mvcc.read_with_own_writes(mvcc.read_batch(versions, gets), intents.own_intents(gets, folded)).collect():
        assert (r.found, r.value and bytes(r.value)) == (answers[r.request_id]["found"], answers[r.request_id]["value"]), r
