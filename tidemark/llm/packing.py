"""Hierarchical packing of documents into windows of several lengths.

What is left of a document after its full windows goes to the tier of the
smallest window that holds it.  Tiers are packed from the longest down: a piece
opens a window, whose gap takes whole pieces of shorter tiers, best fit first,
and then the head of one more.  Each input partition packs its own documents,
so nothing is shuffled and memory is bounded by the pool.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import tidied, whole_text
from tidemark.llm.tokens import encoder

#: Window lengths; all are powers of two, so a full window has no padding.
TIERS = (256, 512, 1024, 2048)
#: Tokens of a step: eight of the longest windows, or as many tokens in shorter ones.
STEP_TOKENS = 8 * TIERS[-1]
#: Pieces that wait for a window in a task, at most.
POOL = 2048

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint, step_id bigint, ids binary"


class Packer:
    """Packs the documents of one partition; ``take`` yields finished pieces."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        self._tiers, self._pool = tuple(sorted(tiers)), pool
        self._waiting: list[tuple[int, int, tuple]] = []  # (length, number, piece) by length
        self._number = 0
        self._next = partition << 40
        self._steps, self._step_of = {}, partition << 40
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, longest, at = len(ids) // 4, self._tiers[-1], 0
        while total - at >= longest:
            self._emit([(doc_id, at, longest, total, ids[4 * at : 4 * (at + longest)])])
            at += longest
        if total > at:
            self._wait((doc_id, at, total - at, total, ids[4 * at :]))
        if len(self._waiting) >= self._pool:
            self._pack(self._pool // 4)

    def _wait(self, piece: tuple) -> None:
        self._number += 1
        insort(self._waiting, (piece[2], self._number, piece))

    def _window_of(self, length: int) -> int:
        return next(t for t in self._tiers if t >= length)

    def _pack(self, leave: int) -> None:
        """Close windows, longest pieces first, until ``leave`` pieces wait or none can be filled."""
        while len(self._waiting) > leave:
            length, _, piece = self._waiting.pop()
            window, pieces = self._window_of(length), [piece]
            gap = window - length
            while gap and self._waiting:
                at = bisect_right(self._waiting, (gap, float("inf"))) - 1
                if at >= 0:
                    pieces.append(self._waiting.pop(at)[2])
                else:  # all that wait are longer than the gap: the shortest gives its head
                    doc_id, start, n, total, ids = self._waiting.pop(0)[2]
                    pieces.append((doc_id, start, gap, total, ids[: 4 * gap]))
                    self._wait((doc_id, start + gap, n - gap, total, ids[4 * gap :]))
                gap -= pieces[-1][2]
            if gap:
                self._tail(pieces)
            else:
                self._emit(pieces)

    def _tail(self, pieces: list[tuple]) -> None:
        """What no other piece can fill: cut to windows of powers of two, so that none is padded."""
        left = sum(p[2] for p in pieces)
        while left:
            window = 1 << (left.bit_length() - 1)
            left -= window
            row = []
            while window:
                doc_id, start, n, total, ids = pieces.pop(0)
                if n > window:
                    pieces.insert(0, (doc_id, start + window, n - window, total, ids[4 * window :]))
                    n, ids = window, ids[: 4 * window]
                row.append((doc_id, start, n, total, ids))
                window -= n
            self._emit(row)

    def _emit(self, pieces: list[tuple]) -> None:
        window, offset = sum(p[2] for p in pieces), 0
        step, room = self._steps.get(window, (0, 0))
        if room < window:
            step, room = self._step_of, max(STEP_TOKENS, window)
            self._step_of += 1
        self._steps[window] = (step, room - window)
        for doc_id, start, n, total, ids in pieces:
            self.done.append((doc_id, start, n, total, self._next, offset, window, step, ids))
            offset += n
        self._next += 1

    def finish(self) -> None:
        self._pack(0)


def _pack(path: str, keeps_space: bool, end_id: int):
    types = [pa.int64()] * 8 + [pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_id", "ids"]
    end = end_id.to_bytes(4, "little")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(TaskContext.get().partitionId()), encoder(path, keeps_space).encode_batch

        def flush() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, encode([text.as_py()])[0] + end)
                if len(packer.done) >= 4096:
                    yield flush()
        packer.finish()
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, keeps_space: bool = False, end_id: int = 1) -> DataFrame:
    """Cut and pack every document's ids, with ``end_id`` after them, into windows.

    Returns one row per piece: ``doc_id``, ``start`` (ids of the document
    before it), ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` in the
    sequence, ``window`` (the sequence's tokens; all windows are full),
    ``step_id`` (sequences of one window length and of ``STEP_TOKENS`` tokens
    together) and ``ids`` (little-endian uint32).  A partition's last windows
    may be shorter powers of two.

    A null or empty text is the end id alone; a long one is cut into full
    windows as it comes; equal rows are packed each for itself; other columns are ignored; no rows give no pieces.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return read.mapInArrow(_pack(tokenizer_path, keeps_space, end_id), PIECE_SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id")
