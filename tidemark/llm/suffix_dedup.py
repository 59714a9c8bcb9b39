"""Removal of repeated byte strings by a hash-compared suffix sort.

Every 200-byte string has an anchor: of the 32-byte strings in it, the one with
the smallest hash.  Equal strings have equal anchors at equal places, so a
string recurs exactly if another place of its anchor agrees with it far enough
to the right and to the left.  The bytes around each place (its surroundings)
are sorted twice among those of the same anchor: the suffixes from the anchor
on, and, in the reversed text, those from the anchor back.  The sort is a
mergesort whose comparisons find the common extension of two suffixes by binary
search over prefix polynomial hashes; afterwards the extensions of neighbours
and their order are verified byte by byte.  Both orders then tell, for every
distance from the anchor, which strings are equal.

Equal surroundings, by a 128-bit cryptographic digest, are one suffix with a
count; all strings of those that occur twice recur.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import discard, materialize, tidied, whole_text
from tidemark.llm.hashing import powers, prefix_hashes, substring_hashes, text_chunks

#: Bytes of a string that must recur, and of an anchor.
LENGTH, ANCHOR = 200, 32
#: The farthest that an anchor is from the start of its string.
FAR = LENGTH - ANCHOR
#: Surroundings that a task sorts together, of one anchor; more of them are dealt out by what more of their bytes are.
GROUP = 20_000
#: Bytes that are sorted together, and those of a long text that are searched together.
SORT_BYTES, FIND_BYTES = 1 << 20, 1 << 20
#: Rows that leave Python at once.
_ROWS = 1 << 15

_FOUND = "k bigint, c1 bigint, c2 bigint, h1 bigint, h2 bigint, low int, width smallint, at smallint"
_RUN = "h1 bigint, h2 bigint, low int, high int"
_SEGMENT = "g bigint, c1 bigint, c2 bigint, h1 bigint, h2 bigint, anchor int, first smallint, last smallint, near smallint, far smallint, single boolean, left smallint, body binary"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For some texts: the first and last start of each run of strings with one anchor, the anchor's place and its hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    n = len(data)
    if n < LENGTH:
        return none
    prefix = prefix_hashes(data)
    begins = np.arange(n - ANCHOR + 1)
    hashes = substring_hashes(prefix, begins, begins + ANCHOR)
    # The upper half of the hash decides, and among equals the first place.
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | begins.astype(np.uint64)
    width, span = LENGTH - ANCHOR + 1, 1
    least = keys
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n - LENGTH + 1], least[width - span : width - span + n - LENGTH + 1])
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)[: n - LENGTH + 1]
    starts = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= ends)
    if not len(starts):
        return none
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(starts)])) - 1
    return starts[first], starts[last], place[first], hashes[place[first]]


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The bytes as they are, or of one long text overlapping windows that hold each string once."""
    if len(offsets) > 2 or len(data) <= 2 * FIND_BYTES:
        yield 0, data, offsets
        return
    for start in range(0, len(data) - LENGTH + 1, FIND_BYTES):
        part = data[start : start + FIND_BYTES + LENGTH - 1]
        yield start, part, np.array([0, len(part)])


def _two_longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


@tidied
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of strings with one anchor: the anchor's hash, the digest of the surroundings, the text and the place."""
    names = [f.split()[0] for f in _FOUND.split(", ")]
    held, rows = [], 0

    def flush() -> pa.RecordBatch:
        nonlocal held, rows
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held, rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for batch in batches:
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        for row, _, whole, bounds in text_chunks(batch.column("text")):
            for shift, data, offsets in _windows(whole, bounds):
                low, high, place, k = anchors(data, offsets)
                if not len(low):
                    continue
                doc = np.searchsorted(offsets, low, "right") - 1
                raw = data.tobytes()
                # The place within the surroundings is part of what they are.
                c = [_two_longs(hashlib.blake2b(raw[s : e + LENGTH], digest_size=16, salt=a.to_bytes(2, "little")).digest()) for s, e, a in zip(low.tolist(), high.tolist(), (place - low).tolist(), strict=True)]
                c = np.array(c, np.int64)
                held.append((k.view(np.int64), c[:, 0], c[:, 1], h1[row + doc], h2[row + doc], (low - offsets[doc] + shift).astype(np.int32), (high - low).astype(np.int16), (place - low).astype(np.int16)))
                rows += len(low)
                if rows >= _ROWS:
                    yield flush()
    if held:
        yield flush()


class SuffixOrder:
    """Suffixes of one array, each with an end of its own, sorted within groups."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: np.ndarray):
        """``groups`` must be in ascending order."""
        self._data, self._prefix = np.append(data, np.uint8(0)), prefix_hashes(data)
        self._inverse = powers(len(data) + 1)[1]
        self._starts, self._ends = starts, ends
        self.order = np.arange(len(starts))
        self._sort(groups)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes x and y have in common: the largest length, by binary search, whose prefix hashes agree."""
        a, b = self._starts[x], self._starts[y]
        limit = np.minimum(self._ends[x] - a, self._ends[y] - b)
        length = np.zeros(len(x), np.int64)
        step = 1 << max(0, int(limit.max(initial=0)).bit_length() - 1)
        while step:
            more = length + step
            fits = np.flatnonzero(more <= limit)
            i, j, s = a[fits] + length[fits], b[fits] + length[fits], step
            same = (self._prefix[i + s] - self._prefix[i]) * self._inverse[i] == (self._prefix[j + s] - self._prefix[j]) * self._inverse[j]
            length[fits[same]] += s
            step >>= 1
        return length

    def _less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        i, j = self._starts[x] + n, self._starts[y] + n
        x_over, y_over = i >= self._ends[x], j >= self._ends[y]
        return np.where(x_over & y_over, or_equal, np.where(x_over | y_over, x_over, self._data[i] < self._data[j]))

    def _sort(self, groups: np.ndarray) -> None:
        """Bottom-up mergesort of all groups at once: an element's place is its own in its run and its rank in the run beside it."""
        if not len(groups):
            return
        begin = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        size = np.diff(np.concatenate((begin, [len(groups)])))
        first, many = np.repeat(begin, size), np.repeat(size, size)
        local = np.arange(len(groups)) - first
        width = 1
        while width < size.max():
            at = np.flatnonzero(many > width)
            run = local[at] // width
            other = first[at] + (run ^ 1) * width
            low, high = np.zeros(len(at), np.int64), np.clip(first[at] + many[at] - other, 0, width)
            right = (run & 1).astype(bool)
            x = self.order[at]
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                before = self._less(self.order[other[open_] + mid], x[open_], right[open_])
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            self.order[first[at] + (run // 2) * 2 * width + local[at] - run * width + low] = x
            width *= 2

    def neighbours(self, groups: np.ndarray) -> np.ndarray:
        """For each place in the order but the first, the bytes that its suffix has in common with the one before it; -1 where another group begins. Verified."""
        out = np.full(max(0, len(groups) - 1), -1, np.int64)
        same = np.flatnonzero(groups[1:] == groups[:-1])  # the order keeps groups in place
        x, y = self.order[same], self.order[same + 1]
        n = self.common(x, y)
        if not self._agree(x, y, n):
            return self._plainly(groups)
        out[same] = n
        return out

    def _agree(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
        """Whether x and y have n bytes in common, and x comes first by the next one. Equal bytes have equal hashes, so n can't be too small."""
        a, b = self._starts[x], self._starts[y]
        for i in range(0, len(x), 4096):
            size = n[i : i + 4096]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            if (self._data[np.repeat(a[i : i + 4096], size) + inside] != self._data[np.repeat(b[i : i + 4096], size) + inside]).any():
                return False
        i, j = a + n, b + n
        over = i >= self._ends[x]
        return bool((over | ((j < self._ends[y]) & (self._data[np.minimum(i, len(self._data) - 1)] < self._data[np.minimum(j, len(self._data) - 1)]))).all())

    def _plainly(self, groups: np.ndarray) -> np.ndarray:
        """The order and the neighbours' common bytes without hashes, where two of them collide."""
        raw = self._data.tobytes()
        bodies = [raw[a:b] for a, b in zip(self._starts.tolist(), self._ends.tolist(), strict=True)]
        self.order = np.array(sorted(range(len(bodies)), key=lambda i: (groups[i], bodies[i])), np.int64)
        out = np.full(max(0, len(groups) - 1), -1, np.int64)
        for i in np.flatnonzero(groups[1:] == groups[:-1]).tolist():
            out[i] = len(os.path.commonprefix([bodies[self.order[i]], bodies[self.order[i + 1]]]))
        return out


class _Classes:
    """Which suffixes agree in their first n bytes, for any n, from an order."""

    def __init__(self, order: SuffixOrder, groups: np.ndarray):
        self._common = order.neighbours(groups)
        self._place = np.empty(len(groups), np.int64)
        self._place[order.order] = np.arange(len(groups))
        self.most = np.zeros(len(groups), np.int64)
        np.maximum.at(self.most, order.order[:-1], self._common)
        np.maximum.at(self.most, order.order[1:], self._common)

    def of(self, n: int, rows: np.ndarray) -> np.ndarray:
        """A number for each of ``rows``, the same for those that agree in n bytes: a run of the order whose neighbours do."""
        number = np.zeros(len(self._place), np.int64)
        np.cumsum(self._common < n, out=number[1:])
        return number[self._place[rows]]


def repeated_strings(bodies: list[bytes], left: np.ndarray, first: np.ndarray, last: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which strings of some surroundings also stand in others of the same group: a row for each, a column for each distance of the anchor from the string's start.

    ``left``: bytes before the anchor; ``first`` and ``last``: the least and the
    largest distance that a string of the surroundings has; ``groups``: in
    ascending order.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    end, at, total = begin + sizes, begin + left, len(data)
    right_of = _Classes(SuffixOrder(data, at, end, groups), groups)
    left_of = _Classes(SuffixOrder(data[::-1], total - at, total - begin, groups), groups)
    out = np.zeros((len(bodies), FAR + 1), bool)
    for far in range(FAR + 1):
        rows = np.flatnonzero((first <= far) & (far <= last) & (right_of.most >= LENGTH - far) & (left_of.most >= far))
        if len(rows) < 2:
            continue
        # Strings are equal that agree to the right and to the left.
        both = right_of.of(LENGTH - far, rows) * (len(bodies) + 1) + left_of.of(far, rows)
        by = np.argsort(both, kind="stable")
        same = np.flatnonzero(both[by][1:] == both[by][:-1])
        out[rows[by[same]], far] = out[rows[by[same + 1]], far] = True
    return out


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


_RUN_TYPES = [("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]
_SEGMENT_TYPES = [
    ("g", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("anchor", pa.int32()), ("first", pa.int16()), ("last", pa.int16()), ("near", pa.int16()), ("far", pa.int16()),
    ("single", pa.bool_()), ("left", pa.int16()), ("body", pa.binary()),
]


@tidied
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the surroundings that are asked for. Rows of one text mostly follow each other; it is cut once then."""
    before = None
    for batch in batches:
        rows, size = [], 0
        for text, h1, h2, wants in zip(batch.column("text"), batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), batch.column("wants"), strict=True):
            if (h1, h2) == before:
                continue
            before = h1, h2
            raw = text.as_py().encode()
            for w in wants.as_py():
                body = raw[w["low"] : w["low"] + w["width"] + LENGTH]
                rows.append((w["k"], w["c1"], w["c2"], h1, h2, w["low"] + w["at"], w["at"] - w["width"], w["at"], 0, FAR, w["single"], w["at"], body))
                size += len(body)
            if size > SORT_BYTES:
                yield _batch(rows, _SEGMENT_TYPES)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _SEGMENT_TYPES)


def _segment_sorter(sort_bytes: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and digest; whole groups of them are sorted when enough have come."""

        def settle(rows: list[dict]) -> pa.RecordBatch:
            groups = np.array([r["g"] for r in rows], np.int64)
            column = lambda name: np.array([r[name] for r in rows], np.int64)
            found = repeated_strings([r["body"] for r in rows], column("left"), column("first"), column("last"), groups)
            found &= np.array([r["single"] for r in rows])[:, None]
            edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (row, nearest), (_, beyond) = np.nonzero(edges == 1), np.nonzero(edges == -1)
            return _batch([(rows[i]["h1"], rows[i]["h2"], rows[i]["anchor"] - b + 1, rows[i]["anchor"] - a) for i, a, b in zip(row.tolist(), nearest.tolist(), beyond.tolist(), strict=True)], _RUN_TYPES)

        held, size, before = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["g"], row["c1"], row["c2"])
                if here == before:  # cut from several copies of a text
                    continue
                before = here
                if size > sort_bytes and row["g"] != held[-1]["g"]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["body"])
        if held:
            yield settle(held)

    return run


@tidied
def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings by halves of the distances from the anchor; those of a half are equal only if all bytes agree that its strings share."""
    for batch in batches:
        rows, size = [], 0
        for r in batch.to_pylist():
            middle = (r["near"] + r["far"]) // 2
            for near, far in ((r["near"], middle), (middle + 1, r["far"])):
                first, last = max(near, r["first"]), min(far, r["last"])
                if first > last:
                    continue
                body = r["body"][r["left"] - last : r["left"] + LENGTH - first]
                shared = body[last - near : last + LENGTH - far]
                g = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=near.to_bytes(2, "little"), person=far.to_bytes(2, "little")).digest(), "little", signed=True)
                rows.append((g, r["c1"], r["c2"], r["h1"], r["h2"], r["anchor"], first, last, near, far, r["single"], last, body))
                size += len(body)
            if size > SORT_BYTES:
                yield _batch(rows, _SEGMENT_TYPES)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _SEGMENT_TYPES)


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def _cut_from(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The surroundings of ``sets``, one of equal ones."""
    wants = sets.groupBy("h1", "h2").agg(F.collect_list(F.struct("k", "c1", "c2", "low", "width", "at", (F.col("n") == 1).alias("single"))).alias("wants"))
    return texts.join(wants, ["h1", "h2"]).select("text", "h1", "h2", "wants").mapInArrow(_cut, _SEGMENT)


def _sorted_runs(segments: DataFrame, sort_bytes: int) -> DataFrame:
    """Runs of recurring strings in surroundings that occur once, of groups that fit a task."""
    return segments.repartition("g").sortWithinPartitions("g", "c1", "c2").mapInArrow(_segment_sorter(sort_bytes), _RUN)


def _halved_runs(segments: DataFrame, group: int, sort_bytes: int) -> DataFrame:
    """The same of larger groups.

    They are halved by distances from the anchor, each half dealt out by the
    bytes that all its strings share, until they fit a task; at a single
    distance the rows of a group are equal strings, which are counted.
    """
    out = None
    while True:
        segments = materialize(segments.where("near < far").mapInArrow(_halve, _SEGMENT), "halves")
        large = materialize(segments.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") > group).select("g"), "large")
        runs = _sorted_runs(segments.join(large, "g", "left_anti"), sort_bytes)
        out = runs if out is None else out.unionByName(runs)
        segments = segments.join(large, "g", "left_semi")
        narrow = segments.where("near = far")
        strings = narrow.groupBy("far", "body").agg(F.count_distinct("c1", "c2").alias("n")).where("n > 1").select("far", "body")
        place = F.col("anchor") - F.col("far")
        out = out.unionByName(narrow.where("single").join(strings, ["far", "body"], "left_semi").select("h1", "h2", place.alias("low"), place.alias("high")))
        if large.isEmpty():
            return out


def repeated_runs(docs: DataFrame, group: int = GROUP, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """``h1``, ``h2`` (a text's digest) and ``runs``: first and last starts, in bytes, of its strings that also start elsewhere; a table of its own."""
    texts = docs.select(whole_text().alias("text")).where(F.octet_length("text") >= LENGTH).select("text", *_digests(F.col("text")))
    found = materialize(texts.mapInArrow(_find, _FOUND), "anchors")
    differ = (F.min("c1") < F.max("c1")) | (F.min("c2") < F.max("c2"))
    # Written first, so that the join below can split a common anchor.
    kinds = materialize(found.groupBy("k").agg(F.count("*").alias("n"), differ.alias("mixed")).where("n > 1").select("k", "mixed"), "kinds", free=True)
    recurring = materialize(found.join(kinds, "k"), "recurring", free=True)
    discard(found, kinds)
    run = ("h1", "h2", "low", (F.col("low") + F.col("width")).alias("high"))
    alike = recurring.where("not mixed").select(*run)
    # One of each set of equal surroundings is enough to compare with the others.
    mixed = recurring.where("mixed").drop("mixed")
    sets = mixed.groupBy("k", "c1", "c2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("h1", "h2", "low", "width", "at")))
    sets = materialize(sets, "surroundings", free=True)
    copied = mixed.join(sets.where("n > 1").select("k", "c1", "c2"), ["k", "c1", "c2"], "left_semi").select(*run)
    large = materialize(sets.groupBy("k").agg(F.count("*").alias("rows")).where(F.col("rows") > group).select("k"), "large")
    if large.isEmpty():
        runs = _sorted_runs(_cut_from(texts, sets), sort_bytes)
    else:
        runs = _sorted_runs(_cut_from(texts, sets.join(large, "k", "left_anti")), sort_bytes)
        runs = runs.unionByName(_halved_runs(_cut_from(texts, sets.join(large, "k", "left_semi")), group, sort_bytes))
    # Copies of a text have the same runs.
    runs = alike.unionByName(copied).unionByName(runs).groupBy("h1", "h2", "low").agg(F.max("high").alias("high"))
    made = materialize(runs.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs")), "runs", free=True)
    discard(recurring, sets)
    return made


def covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The byte ranges, ends exclusive, that strings with starts in ``runs`` (ascending) cover, merged."""
    out: list[list[int]] = []
    for low, high in runs:
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + LENGTH)
        else:
            out.append([low, high + LENGTH])
    return [(a, b) for a, b in out]


@tidied
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
    for batch in batches:
        rows, size = [], 0
        for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs"), strict=True):
            raw = text.as_py().encode()
            gone = covered([(r["low"], r["high"]) for r in runs.as_py() or ()])
            edges = [0, *(x for g in gone for x in g), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else raw
            rows.append((doc_id, len(raw), [{"start": a, "end": b} for a, b in gone], kept))
            size += len(raw)
            if size > SORT_BYTES:
                yield _batch(rows, types)
                rows, size = [], 0
        yield _batch(rows, types)


def remove_repeats(docs: DataFrame, group: int = GROUP, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` and ``kept`` for each row.

    ``spans`` are the maximal byte ranges (start, end) that 200-byte strings
    cover which also start anywhere else in the corpus, the same text included;
    ``kept`` are the other bytes.  Strings are judged on the input, so all
    copies of a string go.

    Null texts are empty; texts of fewer than 200 bytes stay whole.  Equal rows
    count each for itself, so long ones are removed whole.  Long texts are
    searched in overlapping windows.  Other columns are ignored, and no rows
    give none.  ``group`` and ``sort_bytes`` bound a task's memory and change
    no result.
    """
    runs = repeated_runs(docs, group, sort_bytes)
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).select("*", *_digests(F.col("text")))
    both = read.join(runs, ["h1", "h2"], "left").select("doc_id", "text", "runs")
    return both.mapInArrow(_remove, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
