import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import nearest_rank
from tidemark.operators import kv, report, router, transactions
from tidemark.operators.running import running_before
from tidemark.plans.load import kv_load, options, outcome_counters
from tidemark.plans.replay import replay


@pytest.mark.parametrize("share, want", [(0.5, 50), (0.9, 90), (1.0, 100), (0.01, 10)])
def test_nearest_rank(spark, share, want):
    df = spark.createDataFrame([(10 * i,) for i in range(1, 11)], "us bigint")
    assert df.agg(nearest_rank("us", share)).head()[0] == want and df.limit(0).agg(nearest_rank("us", share)).head()[0] == 0.0


def test_latency_report(spark):
    df = spark.createDataFrame([("get", u) for u in (100, 200, 300, 400)], "metric string, us bigint")
    r = report.latency_report(df, 2.0).head()
    assert (r.n, r.qps, r.p50_ms, r.p999_ms) == (4, 2.0, 0.2, 0.4) and report.latency_report(df.limit(1), 0).head().qps == 0.0
    assert report.merge_counters(spark.createDataFrame([(1, 2, 3), (2, 5, 7)], "thread int, ok bigint, bad bigint")).head().asDict() == {"ok": 7, "bad": 10}


def test_running_before(spark):
    rng = random.Random(2)
    rows = [(o, rng.randrange(3), rng.randrange(5)) for o in rng.sample(range(100_000), 500)]
    df = spark.createDataFrame(rows, "o bigint, g int, x bigint")
    total = {r.o: (r.before, r.n) for r in running_before(df, "o", {"before": F.col("x"), "n": F.lit(1)}).collect()}
    inside = {r.o: r.before for r in running_before(df, "o", {"before": F.col("x")}, by=["g"]).collect()}
    for o, g, _ in rows:
        assert total[o] == (sum(x for p, _, x in rows if p < o), sum(p < o for p, _, _ in rows))
        assert inside[o] == sum(x for p, h, x in rows if p < o and h == g)
    assert running_before(df.limit(0), "o", {"before": F.col("x")}).count() == 0


def test_routing(spark):
    tasks = spark.createDataFrame([("GET", "a", 0), ("TX_SET", "a", 1), ("BEGIN", None, 1), ("PREPARE", None, 2), ("GC", None, 9), ("NONE", "a", 0)], "op string, key string, core int")
    placed = {r.op: r.target for r in router.route(tasks, 3).collect()}
    assert placed["GET"] == placed["TX_SET"] and placed["BEGIN"] == 0 and placed["PREPARE"] == 2 and set(placed) == {"GET", "TX_SET", "BEGIN", "PREPARE"}
    assert [r[0] for r in tasks.select(router.op_label(F.col("op"))).collect()] == ["get", "tx set", "begin", "unknown", "unknown", "unknown"]


def test_reaper(spark):
    tx = spark.createDataFrame([(1, "ACTIVE", 0, None), (2, "ACTIVE", 1, None), (3, "PREPARING", 0, 0), (4, "PREPARING", 0, 20_001), (5, "COMMITTED", 0, 0)], "tx_id bigint, state string, last_heartbeat_ms bigint, prepare_start_ms bigint")
    assert {r.tx_id: r.error for r in transactions.expired(tx, F.lit(30_001)).collect()} == {1: None, 3: "prepare_timeout"}
    pending = spark.createDataFrame([(1, 0, 0), (1, 1, 10_000)], "tx_id bigint, core int, sent_ms bigint")
    assert [(r.core, r.sent_ms) for r in transactions.resend_finalize(pending, F.lit(20_000)).collect()] == [(0, 20_000)]
    rows = spark.createDataFrame([(1, "ABORTED", 0, False), (2, "ABORTED", 1, False), (3, "ABORTED", 0, True), (4, "ACTIVE", 0, False)], "tx_id bigint, state string, created bigint, pending boolean")
    assert sorted(r.tx_id for r in transactions.purge(rows, F.lit(60_001)).collect()) == [2, 3, 4]
    tx = spark.createDataFrame([(1, [0, 1]), (2, [2])], "tx_id bigint, participants array<int>")
    acks = spark.createDataFrame([(1, 0), (1, 0), (2, 2)], "tx_id bigint, core int")
    assert {r.tx_id: r.answered for r in transactions.acknowledged(tx, acks).collect()} == {1: False, 2: True}
    doubt = spark.createDataFrame([(1, [1], "COMMITTED", 4242), (2, None, None, None)], "tx_id bigint, participants array<int>, state string, commit_ts bigint")
    assert sorted(map(tuple, transactions.resolve_in_doubt(doubt, 2).collect())) == [(1, 1, "FINALIZE_COMMIT", 4242), (2, 0, "FINALIZE_ABORT", None), (2, 1, "FINALIZE_ABORT", None)]


def test_plain_store(spark):
    log = spark.createDataFrame([(1, "a", b"1", False), (2, "b", b"", False), (3, "a", b"2", False)], "seq bigint, key string, value binary, is_deleted boolean")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r.key: (r.found, r.value and bytes(r.value)) for r in kv.get(log, keys).collect()} == {"a": (True, b"2"), "b": (True, bytearray()), "c": (False, None)}
    gone = kv.delete_keys(log, spark.createDataFrame([(4, "a")], "seq bigint, key string"))
    assert kv.size(gone).head()[0] == 1 and kv.size(kv.clear(log)).head()[0] == 0
    again = kv.set_values(gone, spark.createDataFrame([(5, "a", b"9")], "seq bigint, key string, value binary"))
    assert kv.size(again).head()[0] == 2


def test_load(spark):
    o = options(["--mode", "kv", "--ops", "10", "--read-ratio", "0.3"])
    assert (o.mode, o.ops, o.read_ratio) == ("kv", 10, 0.3)
    for bad in (["--mode", "x"], ["--ops", "1", "--duration", "2"], ["--read-ratio", "2"], ["--threads", "0"]):
        with pytest.raises(SystemExit):
            options(bad)
    log = kv_load(spark, 2000, 50, 128, 0.5, 3)
    assert log.where("op = 'SET'").agg(F.min(F.length("value")), F.max(F.length("value"))).head() == (128, 128)
    counted = {r.asked: r for r in outcome_counters(log, replay(log, 2)).collect()}
    assert counted["GET"].ok + counted["SET"].ok == 2000 and 800 < counted["GET"].total < 1200
