"""Line dedup by a log-template tree.

A line's path in the tree is its number of tokens and its leading tokens; below
that, fields that look variable (with a digit, or eight or more hex letters)
become ``<*>``.  What is left is the line's template.  Lines on one path that
agree in most tokens count as one template as well, with the others variable:
short lines where all but one or two tokens agree and these are ``LEAST_AGREE``
of all, longer ones where two of four quarters below the path agree.  Templates
that recur in unrelated documents are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import discard, materialize, texts_of, tidied
from tidemark.llm.hashing import shingles, text_chunks, words

_FIELD = re.compile(r"\d|(?<!\S)(?:[a-f]{8,}|[A-F]{8,})(?!\S)")
VARIABLE = "<*>"
#: Leading tokens in a path; tokens that a merged template must state; tokens from which on quarters count, too.
DEPTH, LEAST_STATED, QUARTERS_FROM = 2, 3, 12
#: Share of a short line's tokens, in hundredths, that agree where one or two don't.
LEAST_AGREE = 60
#: Shingle hashes in a text's sample; the shares of shingles from which on texts are related, outside some lines and as wholes; texts of one part of a template's.
SAMPLE, ALIKE, COPIES, PART = 64, 0.4, 0.8, 500
#: Tokens stated from which on a template can't recur by chance.
LONG = 20
_NO_LIMIT = (1 << 31) - 1

SAMPLED = "key bigint, part bigint, h1 bigint, h2 bigint, sample array<int>, text array<int>, alone boolean, most int, least int"
_SAMPLED = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sample", pa.list_(pa.int32())), ("text", pa.list_(pa.int32())), ("alone", pa.bool_()), ("most", pa.int32()), ("least", pa.int32())])


def template(line: str) -> list[str]:
    """The line's tokens, variable ones generalised."""
    tokens = line.split()
    return [VARIABLE if _FIELD.search(t) else t for t in tokens] if _FIELD.search(line) else tokens


def _hash(token: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"), seed)


#: Seeds beyond all positions: of a line's number of tokens, and of pairs of quarters; the hash of a variable token at the positions of short lines.
_COUNT, _PAIRS = (1 << 62), {pair: (1 << 62) + 1 + k for k, pair in enumerate(combinations(range(4), 2))}
_PAIR_HASHES = {pair: _hash(VARIABLE, seed) for pair, seed in _PAIRS.items()}
_OPEN = [_hash(VARIABLE, i) for i in range(QUARTERS_FROM)]


def _signed(x: int) -> int:
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def stated_keys(line: str) -> list[tuple[int, bool]]:
    """Hashes of the whole template and of the parts that may stand for it, and whether it is a whole one that states ``LONG`` tokens; none for a line without tokens.

    A template's hash is the sum of those of its tokens at their positions, so
    a part's takes a few additions.
    """
    tokens = template(line)
    n = len(tokens)
    if not n:
        return []
    each = [_hash(t, i) for i, t in enumerate(tokens)]
    count = _hash(str(n), _COUNT)
    whole = count + sum(each)
    found = [(_signed(whole), n >= LONG and sum(t != VARIABLE for t in tokens) >= LONG)]
    if n >= QUARTERS_FROM:
        path = count + sum(each[:DEPTH])
        edges = [DEPTH + (n - DEPTH) * i // 4 for i in range(5)]
        quarters = [sum(each[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        found += [(_signed(path + own + quarters[i] + quarters[j]), False) for (i, j), own in _PAIR_HASHES.items()]
    else:
        open_ = [i for i in range(DEPTH, n) if tokens[i] != VARIABLE]
        for out in (1, 2):
            if 100 * (n - out) >= LEAST_AGREE * n and n - out >= LEAST_STATED and len(open_) > out:
                found += [(_signed(whole + sum(_OPEN[i] - each[i] for i in places)), False) for places in combinations(open_, out)]
    return found


def template_keys(line: str) -> list[int]:
    return [key for key, _ in stated_keys(line)]


def _path(tokens: list[str]) -> int:
    """The path of a line with these tokens, as they are."""
    lead = [VARIABLE if _FIELD.search(t) else t for t in tokens[:DEPTH]]
    return xxhash.xxh3_64_intdigest("\x00".join([str(len(tokens)), *lead]).encode("utf-8", "surrogatepass")) - (1 << 63)


@tidied
def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that has keys: the text's digest, the line's number and its path."""
    for batch in batches:
        h1, h2, number, path, long = [], [], [], [], []
        for one, two, text in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), texts_of(batch.column("text")), strict=True):
            for j, line in enumerate(text.split("\n")):
                tokens = line.split()
                if tokens:
                    h1.append(one)
                    h2.append(two)
                    number.append(j)
                    path.append(_path(tokens))
                    long.append(len(tokens) >= LONG)
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(number, pa.int32()), pa.array(path, pa.int64()), pa.array(long, pa.bool_())], names=["h1", "h2", "line", "path", "long"])


def _line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, where each text's begin, and the number that each word's line has in its text."""
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    text = np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, "right") - 1))
    start = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((start, text))
    hashes, line, bounds = words(data, np.concatenate((start[order], offsets[-1:])))
    first = np.searchsorted(text[order], np.arange(n + 1))
    begins = bounds[first]
    return hashes, begins, line - np.repeat(first[:-1], np.diff(begins))


class _Sample:
    """The ``SAMPLE`` smallest shingle hashes of a text, cut to 31 bits, with the lines that each reaches."""

    def __init__(self, words_: np.ndarray, lines: np.ndarray, made: np.ndarray):
        values = (made >> np.uint64(33)).astype(np.int32)
        known = np.unique(values)
        self.whole = len(known) <= SAMPLE
        self.limit = _NO_LIMIT if self.whole else int(known[SAMPLE - 1])
        at = np.flatnonzero(values <= self.limit)
        self.words, self.lines, self.values = words_, lines, values[at]
        self.first = lines[at] if len(lines) else at
        self.last = lines[np.minimum(at + 4, len(lines) - 1)] if len(lines) else at

    def of(self, numbers: list[int]) -> tuple[list[int], list[int], bool]:
        """The values outside these lines, all values, and whether the text has no more than these lines; the first are all values then."""
        number = np.array(numbers)
        # The first of the lines that a shingle doesn't end before; it is outside if that begins after it.
        after = np.searchsorted(number, self.first)
        inside = (after < len(number)) & (number[np.minimum(after, len(number) - 1)] <= self.last)
        rest = np.unique(self.values[~inside])
        if not len(rest) and self.whole:  # too few words for a shingle: all of them are one
            left = self.words[~np.isin(self.lines, number)]
            rest = (shingles(left, np.array([0, len(left)]), max(len(left), 1))[0] >> np.uint64(33)).astype(np.int32)
        every = np.unique(self.values).tolist()
        return (rest.tolist(), every, False) if len(rest) else (every, every, True)


@tidied
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and key of its lines ``active``: the digest, the key, whether it is ``long``, and the lines."""
    for batch in batches:
        h1, h2, key, long, lines = [], [], [], [], []
        for one, two, active, text in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "active")), texts_of(batch.column("text")), strict=True):
            split, keys = text.split("\n"), {}
            for j in sorted(active):
                for k in stated_keys(split[j]):
                    numbers = keys.setdefault(k, [])
                    if numbers[-1:] != [j]:
                        numbers.append(j)
            for (k, whole), numbers in keys.items():
                h1.append(one)
                h2.append(two)
                key.append(k)
                long.append(whole)
                lines.append(numbers)
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(key, pa.int64()), pa.array(long, pa.bool_()), pa.array(lines, pa.list_(pa.int32()))], names=["h1", "h2", "key", "long", "lines"])


@tidied
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and key ``wanted``, with a sample of the text."""
    for batch in batches:
        for first, last, data, offsets in text_chunks(batch.column("text")):
            hashes, bounds, lines = _line_words(data, offsets)
            made, begins = shingles(hashes, bounds)
            rows: list[tuple] = []
            part = batch.slice(first, last - first)
            ones, twos, wanted = (part.column(c).to_pylist() for c in ("h1", "h2", "wanted"))
            for i, keys in enumerate(wanted):
                sample = _Sample(hashes[bounds[i] : bounds[i + 1]], lines[bounds[i] : bounds[i + 1]], made[begins[i] : begins[i + 1]])
                known: dict[tuple, tuple] = {}
                for k in keys:
                    if (t := tuple(k["lines"])) not in known:
                        known[t] = sample.of(k["lines"])
                    rows.append((k["key"], k["part"], ones[i], twos[i], *known[t], sample.limit, k["least"]))
            columns = zip(*rows, strict=True) if rows else [()] * len(_SAMPLED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SAMPLED, strict=True)], schema=_SAMPLED)


def _share(a: frozenset, b: frozenset, most_a: int, most_b: int) -> float:
    """The estimated share of shingles that two samples have in common."""
    if a.isdisjoint(b):
        return 0.0
    if most_a != most_b:
        limit = min(most_a, most_b)
        a, b = frozenset(x for x in a if x <= limit), frozenset(x for x in b if x <= limit)
    return len(a & b) / max(1, len(a | b))


def related(one: tuple[frozenset, frozenset, int, bool], two: tuple[frozenset, frozenset, int, bool]) -> bool:
    """Whether two samples (values outside some lines, all values, limit, alone) come from related texts."""
    (a, all_a, most_a, alone_a), (b, all_b, most_b, alone_b) = one, two
    return (alone_a == alone_b and _share(a, b, most_a, most_b) >= ALIKE) or _share(all_a, all_b, most_a, most_b) >= COPIES


def _unrelated(names: list[str]):
    """Of rows sorted by ``names``, for each value of these: rows that aren't related to one taken before, ``least`` at most."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, []
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            most, least, alone = (batch.column(c).to_pylist() for c in ("most", "least", "alone"))
            # Lists only become objects where a row is compared.
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("sample"), batch.column("text"))]
            keep = []
            for i, here in enumerate(places):
                if here != at:
                    at, taken = here, []
                if len(taken) < least[i]:
                    made = (*(frozenset(values[offsets[i] : offsets[i + 1]].tolist()) for offsets, values in lists), most[i], alone[i])
                    if not any(related(made, t) for t in taken):
                        taken.append(made)
                        keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def dropped_lines(docs: DataFrame, least_families: int = 10, least_families_long: int = 2) -> DataFrame:
    """``h1``, ``h2`` (a text's digest) and ``lines``: the numbers of its lines whose template recurs.

    A template recurs if ``least_families`` of the texts that hold it
    (``least_families_long`` where it is a whole line's and states at least
    ``LONG`` tokens) are unrelated to each other, however many copies hold it
    as well.  Texts are
    related that share ``ALIKE`` of their shingles outside the template's own
    lines, estimated from the ``SAMPLE`` smallest hashes, so a text that was
    copied and edited a thousand times keeps its own lines, and a long passage
    doesn't relate the texts that hold it.  Texts of nothing else are compared
    as wholes with each other.  Texts that share ``COPIES`` of all their
    shingles are related in any case.
    """
    least = F.when(F.col("long"), least_families_long).otherwise(least_families)
    texts = docs.where(F.col("text").isNotNull()).select(*_digest(F.col("text")), "text")
    texts = materialize(texts.dropDuplicates(["h1", "h2"]), "texts", free=True)
    # Only a path that enough texts have can hold a template that recurs.
    lines = materialize(texts.mapInArrow(_paths, "h1 bigint, h2 bigint, line int, path bigint, long boolean"), "lines")
    common = lines.groupBy("path", "long", "h1", "h2").agg(F.lit(1).alias("one")).groupBy("path", "long").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    common = materialize(common.select("path").distinct(), "common", free=True)  # written first, so that the join below can split a common path
    active = materialize(lines.join(common, "path").groupBy("h1", "h2").agg(F.collect_set("line").alias("active")), "active", free=True)
    discard(lines, common)
    keyed = materialize(texts.join(active, ["h1", "h2"]).mapInArrow(_keyed, "h1 bigint, h2 bigint, key bigint, long boolean, lines array<int>"), "keyed", free=True)
    sizes = keyed.groupBy("key", least.alias("least")).agg(F.count("*").alias("texts"), F.bit_xor(F.xxhash64("h1", "h2", "lines")).alias("holders")).where("texts >= least")
    # Of keys that the same lines hold, one is enough: the one that needs the fewest families.
    sizes = sizes.groupBy("texts", "holders").agg(F.min(F.struct("least", "key")).alias("k")).select("k.*", "texts")
    sizes = materialize(sizes.select("key", "least", F.ceil(F.col("texts") / F.lit(PART)).alias("parts")), "sizes", free=True)
    discard(active)
    wanted = keyed.join(sizes, "key").select("h1", "h2", F.struct("key", F.pmod("h2", "parts").alias("part"), "least", "lines").alias("k"))
    wanted = materialize(wanted.groupBy("h1", "h2").agg(F.collect_list("k").alias("wanted")), "wanted", free=True)
    rows = texts.join(wanted, ["h1", "h2"]).mapInArrow(_sampled, SAMPLED)
    # First within parts of a template's texts, then among those that each part has kept.
    some = rows.repartition("key", "part").sortWithinPartitions("key", "part", "h1", "h2").mapInArrow(_unrelated(["key", "part"]), SAMPLED)
    best = some.repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(_unrelated(["key"]), SAMPLED)
    recurs = materialize(best.groupBy("key", "least").agg(F.count("*").alias("families")).where("families >= least").select("key"), "recurring", free=True)
    discard(texts, sizes, wanted)
    hits = keyed.join(recurs, "key").select("h1", "h2", F.explode("lines").alias("line"))
    gone = materialize(hits.groupBy("h1", "h2").agg(F.collect_set("line").alias("lines")), "dropped", free=True)
    discard(keyed, recurs)
    return gone


def drop_lines(docs: DataFrame, least_families: int = 10, least_families_long: int = 2) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and ``n_dropped``; all rows and columns stay.

    Lines end at ``\\n``.  A null text stays null, an empty one empty; a text
    of recurring lines only becomes empty.  Equal texts lose the same lines.  A
    column of ``docs`` named ``n_dropped`` is replaced, others are kept.  Lines
    without tokens always stay.  Long texts are read whole; no rows give none.
    """
    gone = dropped_lines(docs, least_families, least_families_long)
    text = F.col("text")
    keyed = docs.drop("n_dropped").withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(text, F.lit(1))})
    gone = gone.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("lines").alias("__lines"))
    both = keyed.join(gone, ["__h1", "__h2"], "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__lines", i)), "\n")
    columns = [F.when(F.col("__lines").isNull() | text.isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "n_dropped"]
    return both.select(*columns, F.when(text.isNull(), 0).otherwise(F.coalesce(F.size("__lines"), F.lit(0))).cast("bigint").alias("n_dropped"))
