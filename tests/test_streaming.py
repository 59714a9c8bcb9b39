from pyspark.sql import functions as F

from tidemark.operators.intents import fold_conflicts
from tidemark.plans.histories import overlapping_ops
from tidemark.streaming.intents import expired_leases_stream, fold_conflicts_stream


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_fold_equals_batch(spark, tmp_path):
    writes = overlapping_ops(spark, "/root/testdata/sf0.001").select("seq", "key", "tx_id", "end_seq")
    for i in range(3):  # a file for each micro-batch, in the order of the log
        writes.where((F.col("seq") >= 400 * i) & (F.col("seq") < 400 * (i + 1))).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(fold_conflicts_stream(stream), "folded")
    want = fold_conflicts(writes).select("seq", "key", "tx_id", "ok", "holder")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 1000


def test_leases(spark, tmp_path):
    rows = [(1, 0), (1, 30), (2, 0), (2, 31), (1, 45), (3, 200)]
    df = spark.createDataFrame(rows, "tx_id bigint, s int").select("tx_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    for i, r in enumerate(("s < 100", "s >= 100")):
        df.where(F.unix_timestamp("ts") - 1_700_000_000 < 100 if i == 0 else F.unix_timestamp("ts") - 1_700_000_000 >= 100).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = sorted((r.tx_id, r.last_ms // 1000 - 1_700_000_000) for r in run(expired_leases_stream(stream, 30_000, "0 seconds"), "leases").collect())
    assert got == [(1, 45), (2, 0), (2, 31)]
