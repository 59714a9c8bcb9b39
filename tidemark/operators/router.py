"""Placement of keys and tasks on cores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import owner

# Operations by where they run.
CONTROL_OPS = ("BEGIN", "COMMIT", "ROLLBACK", "HEARTBEAT")
EXECUTE_OPS = ("TX_GET", "TX_SET")
LOCAL_OPS = ("PREPARE", "FINALIZE_COMMIT", "FINALIZE_ABORT", "GC")
KEY_OPS = ("GET", "SET")
#: What an operation of the API is called in reports.
OP_LABELS = {"GET": "get", "SET": "set", "BEGIN": "begin", "TX_GET": "tx get", "TX_SET": "tx set", "COMMIT": "commit", "ROLLBACK": "rollback", "HEARTBEAT": "heartbeat"}


def is_control(op: Column) -> Column:
    return op.isin(*CONTROL_OPS)


def is_execute(op: Column) -> Column:
    return op.isin(*EXECUTE_OPS)


def op_label(op: Column) -> Column:
    pairs = [F.lit(x) for pair in OP_LABELS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), op), F.lit("unknown"))


def route(tasks: DataFrame, cores: int) -> DataFrame:
    """Tasks (op, key, core) with ``target``: control on core 0, local work where it was sent, the rest with the key's owner; unknown operations and cores out of range are dropped."""
    op = F.col("op")
    target = F.when(is_control(op), F.lit(0)).when(op.isin(*LOCAL_OPS), F.col("core")).when(op.isin(*EXECUTE_OPS, *KEY_OPS), owner(F.col("key"), cores))
    return tasks.withColumn("target", target.cast("int")).where((F.col("target") >= 0) & (F.col("target") < cores))


def place(rows: DataFrame, cores: int) -> DataFrame:
    """Rows with their owner, dealt out by it."""
    return rows.withColumn("owner", owner(F.col("key"), cores)).repartition(cores, "owner")


def fan_out(tx: DataFrame) -> DataFrame:
    """A row for each transaction and participant."""
    return tx.select("*", F.explode("participants").alias("core"))


def match_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their answers; a request without one stays, an answer without a request goes."""
    return requests.join(responses, "request_id", "left")
