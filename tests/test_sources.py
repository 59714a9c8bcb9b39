import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.checksum import crc32c, crc32c_column, crc32c_many, mask, unmask
from tidemark.functions.scalar import crc_mask, crc_unmask
from tidemark.operators import recovery
from tidemark.schema import WAL_TYPES
from tidemark.sources import snapshot
from tidemark.sources.wal import WalFile, decode, decode_records, encode, encode_records, log_state, read_all, register, write_log


def record(lsn, kind, tx_id=1, **given):
    return {"lsn": lsn, "type": kind, "tx_id": tx_id, **given}


EACH = [
    record(1, "TX_BEGIN", snapshot_ts=5), record(2, "INTENT", key="kä", value=b"\0v", is_deleted=False), record(3, "PREPARE", vote_yes=True), record(4, "COMMIT_DECISION", commit_ts=9),
    record(5, "ABORT_DECISION"), record(6, "COMMIT_FINALIZE", commit_ts=9), record(7, "ABORT_FINALIZE"), record(8, "CHECKPOINT", snapshot_lsn=3),
]


def test_checksum(spark):
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    values = [b"", b"123456789", b"x" * 37, bytes(range(256)) * 3]
    assert crc32c_many(values).tolist() == [crc32c(v) for v in values] and all(unmask(mask(crc32c(v))) == crc32c(v) for v in values)
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v binary").select("v", crc32c_column("v").alias("c")).select("v", "c", crc_mask(F.col("c")).alias("m"), crc_unmask(crc_mask(F.col("c"))).alias("u")).collect()
    for r in rows:
        assert (r.c, r.m, r.u) == ((None,) * 3 if r.v is None else (crc32c(bytes(r.v)), mask(crc32c(bytes(r.v))), crc32c(bytes(r.v))))


def test_records_round_trip_and_damage_is_rejected():
    for r in EACH:
        raw = encode(r)
        assert {k: v for k, v in decode(raw).items()} == r
        for i in range(len(raw)):
            assert decode(raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1 :]) is None
        assert decode(raw[:-1]) is None and decode(b"") is None
    data = b"".join(map(encode, EACH))
    assert read_all(data) == (EACH, len(data), False)
    assert read_all(data, 6)[0] == EACH[6:]
    assert [r["lsn"] for r in read_all(data[:-8])[0]] == list(range(1, 8)) and read_all(data[:-8])[2]
    assert read_all(data + b"tail")[1:] == (len(data), True)


def test_file_drops_a_damaged_tail_and_goes_on(tmp_path):
    path = str(tmp_path / "core_0.wal")
    log = WalFile(path)
    for tx in (1, 2, 3):
        log.append(record(0, "TX_BEGIN", tx, snapshot_ts=tx))
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 8)
    log = WalFile(path)
    assert log.dropped_tail and log.append(record(0, "TX_BEGIN", 99, snapshot_ts=1)) == 3
    with open(path, "rb") as f:
        records, _, bad = read_all(f.read())
    assert [(r["lsn"], r["tx_id"]) for r in records] == [(1, 1), (2, 2), (3, 99)] and not bad


def test_data_source(spark, tmp_path):
    register(spark)
    rows = [(c, r["lsn"], r["type"], r["tx_id"] + c, r.get("snapshot_ts"), r.get("commit_ts"), r.get("key"), r.get("value"), r.get("is_deleted"), r.get("vote_yes"), r.get("snapshot_lsn")) for c in (0, 3) for r in EACH]
    log = spark.createDataFrame(rows, "core_id int, lsn bigint, type string, tx_id bigint, snapshot_ts bigint, commit_ts bigint, key string, value binary, is_deleted boolean, vote_yes boolean, snapshot_lsn bigint")
    write_log(log, str(tmp_path / "log"))
    back = spark.read.format("tidemark_wal").load(str(tmp_path / "log"))
    assert sorted(map(str, back.collect())) == sorted(map(str, log.collect())) == sorted(map(str, decode_records(encode_records(log)).collect()))
    assert spark.read.format("tidemark_wal").option("min_lsn", 6).load(str(tmp_path / "log")).count() == 4
    assert len(WAL_TYPES) == 8
    # What is appended follows what is there; damage at the end of a file from elsewhere is left behind.
    write_log(log.where("core_id = 3 AND lsn <= 2"), str(tmp_path / "log"))
    write_log(log.where("core_id = 5 AND lsn < 0"), str(tmp_path / "log"))
    read = lambda: spark.read.format("tidemark_wal").load(str(tmp_path / "log"))
    assert sorted((r.core_id, r.lsn, r.type) for r in read().collect() if r.lsn > 8) == [(3, 9, "TX_BEGIN"), (3, 10, "INTENT")] and read().count() == 18
    tail = read().where("lsn > 7 AND core_id = 3 AND type <> 'TX_BEGIN'")
    assert sorted(r.lsn for r in tail.collect()) == [8, 10] and "> 7" not in tail._jdf.queryExecution().executedPlan().toString().split("Filter ")[1].split("\n")[0]
    write_log(log.where("core_id = 0"), str(tmp_path / "log"), "overwrite")
    assert read().count() == 8 and len(list((tmp_path / "log").glob("*.seg"))) == 1
    own = tmp_path / "own"
    own.mkdir()
    (own / "core_0.wal").write_bytes(b"".join(map(encode, EACH[:4]))[:-8])
    assert [tuple(r)[2:] for r in log_state(spark, str(own)).select("core_id", "segment", "records", "last_lsn", "damaged").collect()] == [(3, 3, True)]
    write_log(log.where("core_id = 0 AND lsn = 1"), str(own))
    assert sorted(r.lsn for r in spark.read.format("tidemark_wal").load(str(own)).collect()) == [1, 2, 3, 4]


def test_snapshot_and_topology_files(tmp_path):
    path = snapshot.snapshot_path(str(tmp_path), 2)
    entries = [{"key": "a", "value": b"1", "commit_ts": 50, "is_deleted": False}, {"key": "ß", "value": b"", "commit_ts": 7, "is_deleted": True}]
    assert snapshot.read_header(path) is None and snapshot.read_topology(str(tmp_path)) is None
    snapshot.write_snapshot(path, 2, 4, 1, 17, entries)
    header, back = snapshot.read_snapshot(path)
    assert (header["core_id"], header["num_cores"], header["layout_epoch"], header["wal_lsn"], header["entry_count"]) == (2, 4, 1, 17, 2)
    assert back == [{"core_id": 2} | e for e in entries] and not os.path.exists(path + ".tmp")
    with open(path, "rb") as f:
        raw = f.read()
    with open(path, "wb") as f:
        f.write(raw[:-3])
    with pytest.raises(ValueError):
        snapshot.read_snapshot(path)
    with open(path, "wb") as f:
        f.write(raw[:9] + b"\x07" + raw[10:])
    assert snapshot.read_header(path) is None
    snapshot.write_topology(str(tmp_path), 4, 2)
    assert snapshot.read_topology(str(tmp_path)) == (4, 2)
    with open(snapshot.topology_path(str(tmp_path)), "r+b") as f:
        f.write(b"xxxx")
    with pytest.raises(ValueError):
        snapshot.read_topology(str(tmp_path))


def test_checkpoint_as_parquet(spark, tmp_path):
    latest = spark.createDataFrame([(f"k{i}", b"v", i, i % 3 == 0) for i in range(20)], "key string, value binary, commit_ts bigint, is_deleted boolean")
    entries = recovery.checkpoint_entries(latest, 4)
    headers = recovery.checkpoint_headers(entries, 4, 1)
    snapshot.write_checkpoint(entries, headers, str(tmp_path / "c"))
    back, heads = snapshot.read_checkpoint(spark, str(tmp_path / "c"))
    assert back.count() == 20 and heads.agg(F.sum("entry_count")).head()[0] == 20
    moved = {r.key: r.core_id for r in recovery.repartition_layout(latest, 4, 6).collect()}
    assert len(moved) == 13 and set(moved.values()) <= set(range(6))
    assert recovery.check_topology(None, 4) == recovery.check_topology((4, 1), 4) == "" and recovery.check_topology((4, 1), 6)


def test_recovery_scripts(spark):
    cols = "core_id int, lsn bigint, type string, tx_id bigint, snapshot_ts bigint, commit_ts bigint, key string, value binary"
    log = spark.createDataFrame([(0, 1, "TX_BEGIN", 1, 10, None, None, None), (0, 2, "TX_BEGIN", 5, 20, None, None, None), (0, 3, "TX_BEGIN", 3, 30, None, None, None), (0, 4, "COMMIT_DECISION", 1, None, 100, None, None), (0, 5, "ABORT_DECISION", 5, None, None, None, None), (1, 1, "INTENT", 1, None, None, "k", b"v"), (1, 2, "COMMIT_FINALIZE", 1, None, 100, None, None), (1, 3, "INTENT", 3, None, None, "n", b"w"), (1, 4, "INTENT", 5, None, None, "m", b"w"), (1, 5, "ABORT_FINALIZE", 5, None, None, None, None)], cols)
    assert {r.tx_id: (r.state, r.commit_ts) for r in recovery.recover_coordinator(log).collect()} == {1: ("COMMITTED", 100), 5: ("ABORTED", None), 3: ("ABORTED", None)}
    assert tuple(recovery.counters(log).head()) == (5, 100)
    assert [(r.key, r.commit_ts) for r in recovery.replay_core(log).collect()] == [("k", 100)]
    assert [(r.tx_id, r.participants) for r in recovery.in_doubt(log).collect()] == [(3, [1])]
    snap = spark.createDataFrame([(1, "a", b"1", 50, False)], "core_id int, key string, value binary, commit_ts bigint, is_deleted boolean")
    heads = spark.createDataFrame([(1, 2)], "core_id int, wal_lsn bigint")
    assert [r.key for r in recovery.replay_core(log, snap, heads).collect()] == ["a"]
    bad = spark.createDataFrame([(0, 1, True), (0, 2, True), (0, 3, False), (0, 4, True), (1, 9, True)], "core_id int, lsn bigint, valid boolean")
    assert sorted((r.core_id, r.lsn) for r in recovery.valid_prefix(bad).collect()) == [(0, 1), (0, 2), (1, 9)]
