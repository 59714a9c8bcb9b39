"""Token files: ids of documents in order of their ids, coded in checksummed blocks.

A store is a folder of Parquet files, so any file system that Spark reaches
will do and a lost task leaves nothing behind.  A row is a block of the coder's
format with the documents that it holds; ``file`` and ``block`` give the order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import tidied, whole_text
from tidemark.llm.block_coder import decoded, encoded
from tidemark.llm.mixing_coder import BLOCK
from tidemark.llm.tokens import encoder

#: Blocks that a task holds side by side.
LANES = 2048

STORE_SCHEMA = "file bigint, block bigint, n_ids bigint, continues boolean, doc_ids array<bigint>, counts array<bigint>, payload binary"
_RAW_SCHEMA = STORE_SCHEMA.replace("payload", "ids")
_STORE_TYPES = [("file", pa.int64()), ("block", pa.int64()), ("n_ids", pa.int64()), ("continues", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())]


class _Cutter:
    """Cuts documents' ids into blocks; ``full`` holds (ids, continues, doc_ids, counts) of finished ones."""

    def __init__(self):
        self.full: list[tuple] = []
        self._start(False)

    def _start(self, continues: bool) -> None:
        self._ids, self._held, self._continues, self._docs, self._counts = [], 0, continues, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + BLOCK - self._held]
            self._ids.append(part)
            self._docs.append(doc_id)
            self._counts.append(len(part))
            self._held += len(part)
            at += len(part)
            if self._held == BLOCK:
                self.close(at < len(ids))

    def close(self, continues: bool = False) -> None:
        if self._held:
            self.full.append((np.concatenate(self._ids), self._continues, self._docs, self._counts))
        self._start(continues)


def _writer(path: str, keeps_space: bool, end_id: int, lanes: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, numbers, cutter, encode = TaskContext.get().partitionId(), itertools.count(), _Cutter(), encoder(path, keeps_space).encode_batch
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            blocks, cutter.full = cutter.full, []
            rows = [(file, next(numbers), len(ids), continues, docs, counts, ids.tobytes()) for ids, continues, docs, counts in blocks]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_STORE_TYPES)], names=[n for n, _ in _STORE_TYPES])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                cutter.add(doc_id, np.concatenate((np.frombuffer(encode([text.as_py()])[0], "<u4"), end)))
                if len(cutter.full) >= lanes:
                    yield flush()
        cutter.close()
        yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, keeps_space: bool = True, end_id: int = 0, lanes: int = LANES) -> None:
    """Write every document's ids, ``end_id`` after them, to a new store at ``path``, in ascending order of ``doc_id``.

    A null or empty text is the end id alone.  Null ids come first, rows with
    one id in the order of their texts; equal rows are kept; other columns are
    ignored.  Texts are shuffled once, by ranges of ids.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    read = read.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = read.mapInArrow(_writer(tokenizer_path, keeps_space, end_id, lanes), _RAW_SCHEMA)
    blocks.withColumns({"payload": encoded(docs.sparkSession, F.col("ids"))}).drop("ids").write.parquet(path)


def _reader(lanes: int):
    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by file and block; a document's parts lie in blocks that follow each other."""
        names, types = ["doc_id", "file", "begin", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        parts: list[memoryview] = []
        file, at, doc = None, 0, None
        rows: list[list] = [[], [], [], []]

        def finish() -> None:
            nonlocal at
            ids = b"".join(parts)
            parts.clear()
            for column, value in zip(rows, (doc, file, at, ids), strict=True):
                column.append(value)
            at += len(ids) // 4

        def settle() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)
            for column in rows:
                column.clear()
            return out

        for batch in batches:
            for i in range(0, len(batch), lanes):
                for row in batch.slice(i, lanes).to_pylist():
                    ids, place = memoryview(row["ids"]), 0
                    if len(ids) != 4 * row["n_ids"] or sum(row["counts"]) != row["n_ids"]:
                        raise ValueError("a block doesn't hold the ids that its row tells of")
                    for k, (doc_id, n) in enumerate(zip(row["doc_ids"], row["counts"], strict=True)):
                        if parts and (k or not row["continues"]):
                            finish()
                        if row["file"] != file:
                            file, at = row["file"], 0
                        doc = doc_id
                        parts.append(ids[4 * place : 4 * (place + n)])
                        place += n
                yield settle()
        if parts:
            finish()
            yield settle()

    return read


def read_tokens(spark: SparkSession, path: str, lanes: int = LANES) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (little-endian uint32) of every document in the store.

    A damaged block raises an error.  The driver gathers one number for each
    file that was written.
    """
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    sizes = {r["file"]: r["n"] for r in store.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    before = dict(zip(sorted(sizes), itertools.accumulate((sizes[f] for f in sorted(sizes)), initial=0), strict=False))
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "file bigint, before bigint")
    blocks = store.repartition("file").sortWithinPartitions("file", "block").withColumns({"ids": decoded(spark, F.col("payload"))}).drop("payload")
    found = blocks.mapInArrow(_reader(lanes), "doc_id bigint, file bigint, begin bigint, ids binary")
    return found.join(F.broadcast(offsets), "file").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "ids")
