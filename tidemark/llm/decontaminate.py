"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the tokens at the set positions of a fixed mask and ignores the
others, so it survives substitutions there.  Seeds of the benchmark and of the
texts are joined, and around each hit the two token sequences are compared
position by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialize, texts_of, tidied
from tidemark.llm.hashing import BASE, mix

_TOKEN = re.compile(r"[^\W_]+")
#: Masks of one weight; ones are compared (fixed values).
MASKS = ("111111", "110110011", "1011010011", "11010001011")
#: Windows of fewer tokens are also found by blocks of theirs, one more than may differ: one block always agrees whole.
BLOCKS_BELOW = 16
#: Items of fewer tokens must agree in all of them.
EXACT_BELOW = 8
#: Benchmark tokens that one pass over the texts holds in memory, about; a larger benchmark takes more passes, one after the other.
TOKENS_PER_PASS = 2_000_000

HITS = "array<struct<item_id:bigint,start:int,length:int,equal:int>>"
_FIELDS = ("item_id", "start", "length", "equal")
_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("equal", pa.int32())]))


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _offsets(mask: str) -> np.ndarray:
    return np.array([i for i, c in enumerate(mask) if c == "1"])


def seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the mask's tokens at every place where it fits."""
    at = _offsets(mask)
    n = len(ids) - int(at[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for j in at:
        out = out * np.uint64(BASE) + ids[j : j + n]
    return mix(out)


def blocks(width: int, share: float) -> tuple[int, int]:
    """How many blocks a window of ``width`` tokens has, one more than may differ, and the least tokens of a block."""
    differ = next(d for d in range(width, -1, -1) if width - d >= share * width)
    return min(differ + 1, width), max(1, width // (differ + 1))


def needed(width: int, share: float) -> float:
    """How many of ``width`` tokens in a row must agree."""
    return width if width < EXACT_BELOW else share * width


class SeedIndex:
    """Seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int, share: float):
        self.window, self.share = window, share
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            words = tokens_of(text or "")
            if words:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)))
        self.table = []
        every = [(mask, [(n, seeds(ids, mask), None) for n, (_, ids) in enumerate(self.items)]) for mask in MASKS]
        short: dict[int, list] = {}
        for n, (_, ids) in enumerate(self.items):
            width = min(window, len(ids))
            if width < BLOCKS_BELOW:
                count, size = blocks(width, needed(width, share) / width)
                # Blocks of a window at any place; of a shorter item, its own.
                at = np.unique(np.arange(len(ids) - width + 1)[:, None] + np.arange(count) * size)
                short.setdefault(size, []).append((n, seeds(ids, "1" * size)[at], at))
        for mask, found in [*every, *(("1" * size, rows) for size, rows in sorted(short.items()))]:
            values = np.concatenate([v for _, v, _ in found]) if found else np.zeros(0, np.uint64)
            item = np.concatenate([np.full(len(v), n) for n, v, _ in found]) if found else np.zeros(0, np.int64)
            place = np.concatenate([np.arange(len(v)) if at is None else at for _, v, at in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(values, kind="stable")
            self.table.append((mask, values[order], item[order], place[order]))

    def overlaps(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, first token, tokens, equal tokens)`` of verified overlaps, one at most for each item and alignment."""
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in tokens_of(text)), np.uint64)
        here = ids > 0
        lines: set[tuple[int, int]] = set()
        for mask, values, item, place in self.table:
            at = _offsets(mask)
            n = len(ids) - int(at[-1])
            if n <= 0 or not len(values):
                continue
            full = here[:n].copy()
            for j in at[1:]:
                full &= here[j : j + n]
            spots = np.flatnonzero(full)
            if not len(spots):
                continue
            out = np.full(len(spots), len(mask), np.uint64)
            for j in at:
                out = out * np.uint64(BASE) + ids[spots + j]
            out = mix(out)
            low, high = np.searchsorted(values, out, "left"), np.searchsorted(values, out, "right")
            for spot, a, b in zip(spots[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                lines.update((int(item[k]), spot - int(place[k])) for k in range(a, b))
        return [v for k, d in sorted(lines) if (v := self._verify(ids, k, d))]

    def _verify(self, ids: np.ndarray, number: int, diagonal: int) -> tuple[int, int, int, int] | None:
        """Whether, on this alignment, some ``window`` tokens in a row (all of a shorter item) agree in at least ``share`` of their places."""
        item_id, item = self.items[number]
        a, b = max(0, -diagonal), min(len(item), len(ids) - diagonal)
        width = min(self.window, len(item))
        if b - a < width:
            return None
        equal = ids[a + diagonal : b + diagonal] == item[a:b]
        run = np.concatenate(([0], np.cumsum(equal)))
        if (run[width:] - run[:-width]).max() < needed(width, self.share):
            return None
        return item_id, a + diagonal, b - a, int(run[-1])


def found_overlaps(index: SeedIndex, text: Column) -> Column:
    """The overlaps of a text column with the index; only the texts travel to Python and only overlaps come back."""

    @tidied
    def overlaps(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([[dict(zip(_FIELDS, x, strict=True)) for x in index.overlaps(t or "")] for t in texts_of(column)], _HIT_TYPE)

    return F.arrow_udf(overlaps, HITS)(text)


def _indexes(benchmark: DataFrame, window: int, share: float) -> Iterator[SeedIndex]:
    """An index for each pass over the texts; the driver holds one of them at a time."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).head()[0] or 0
    passes = max(1, -(-int(size) // TOKENS_PER_PASS))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield SeedIndex(sorted((r["item_id"], r["text"]) for r in part.toLocalIterator()), window, share)


def with_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 20, share: float = 0.8) -> DataFrame:
    """``docs`` with ``overlaps``: an array of (item_id, start, length, equal), in tokens, for each row.

    An overlap is an alignment of a benchmark item in which ``window`` tokens
    in a row (or all of a shorter item) agree in at least ``share`` of their
    places, and in all of them where the item has fewer than ``EXACT_BELOW``;
    case and punctuation don't count.  Items with a null id or text, or without
    tokens, match nothing, and neither do null and empty texts.  Texts are read
    whole, however long.  Equal rows and items are treated each for itself; a
    column of ``docs`` named ``overlaps`` is replaced, others are kept whatever
    their names.  Empty tables give no rows and no overlaps.

    The benchmark goes to the executors in groups of about ``TOKENS_PER_PASS``
    tokens.  Each takes a pass over the texts, whose result is written before
    the next one starts, so a task holds one group whatever the benchmark's
    size; texts are never shuffled.
    """
    out = None
    for index in _indexes(benchmark, window, share):
        found = found_overlaps(index, F.col("text"))
        out = docs.drop("overlaps").withColumn("overlaps", found) if out is None else materialize(out, "overlaps").withColumn("overlaps", F.concat("overlaps", found))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 20, share: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that overlap no benchmark item; see :func:`with_overlaps` for nulls, empty, long and repeated ones."""
    out = None
    for index in _indexes(benchmark, window, share):
        out = (docs if out is None else materialize(out, "clean")).where(F.size(found_overlaps(index, F.col("text"))) == 0)
    return out
