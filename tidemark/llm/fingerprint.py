"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a weighted set: its words with their counts.  Sample ``i`` of word
``k`` with weight ``w`` draws r and c from Gamma(2, 1) and b from the unit
interval, all from hashes of (i, k), takes ``t = floor(ln w / r + b)`` and the
value ``ln c - r (t - b) - r``; the fingerprint keeps (k, t) of the smallest
value.  Two texts agree in a sample with the probability of their generalised
Jaccard similarity.

r and c come from the inverse of Gamma(2, 1)'s distribution at uniform numbers
of 32 bits: between the entries of a table, and in both tails, which decide the
minimum where a text has many words, by formulas.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import whole_text

SAMPLES = 64
#: Hex digits that a sample has in the fingerprint.
DIGITS = 4
#: Documents of a block, which a task handles together.
BLOCK = 500
_LOWEST = -(1 << 63)
#: Samples of a row; the code for more of them is too long for the JVM to compile.
AT_ONCE = 2
#: Steps of the tables (12 bits), and how many of them at either end a formula replaces.
_STEPS, _TAIL = 1 << 12, 1 << 5
#: Beyond all values of a sample but for one in 2**100, and steps of a value.
_OFFSET, _SCALE = 128.0, float(1 << 35)


def _array(values: list, kind: str) -> Column:
    """A literal array in one small expression, which the optimizer folds; a literal for each element would swell every plan that holds it."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def gamma_quantile(p: float) -> float:
    """The inverse of ``1 - exp(-x) (1 + x)``, by bisection."""
    low, high = 0.0, 64.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if -math.expm1(-x) - x * math.exp(-x) < p else (low, x)
    return (low + high) / 2


def _tables() -> tuple[Column, Column]:
    """The inverse at every step, and its logarithm."""
    entries = [gamma_quantile(max(i, 0.5) / _STEPS) for i in range(_STEPS)]
    entries.append(gamma_quantile(1 - 0.5 / _STEPS))
    return _array([0.0, *entries[1:]], "double"), _array([math.log(x) for x in entries], "double")


def _with_draws(df: DataFrame, each: range) -> DataFrame:
    """Columns r, c (its logarithm), b and f (a hash, for the name), numbered, of the samples ``each`` of ``part`` and ``term``.

    Between the tables' entries lie straight lines.  Near 0, c is ``s + s^2 / 3
    + 11 s^3 / 72`` with ``s = sqrt(2 u)``; near 1, r is what solves ``r = ln(1
    + r) + y`` with ``y = -ln(1 - u)``.  What is used more than once is a
    column of its own, so that it is computed once, and its code stays small.
    (The smallest r, which hardly move a value, and the largest c, which are no
    minimum, stay on the lines.)
    """
    plain, logs = _tables()
    step = lambda bits: bits.bitwiseAND(F.lit(_STEPS - 1)).cast("int")
    rest = lambda bits: (bits.bitwiseAND(F.lit((1 << 20) - 1)) + F.lit(0.5)) * F.lit(2.0**-20)
    share = lambda x, y: (F.col(x) + F.col(y)) * F.lit(1.0 / _STEPS)
    df = df.withColumns({f"h{i}": F.xxhash64(F.col("part") * F.lit(len(each)) + F.lit(i), F.col("term")) for i in each})
    df = df.withColumns({x + str(i): c for i in each for x, c in (
        ("f", F.xxhash64(f"h{i}")), ("u", step(F.shiftrightunsigned(f"h{i}", 52))), ("v", step(F.shiftrightunsigned(f"h{i}", 20))),
        ("p", rest(F.shiftrightunsigned(f"h{i}", 32))), ("q", rest(F.col(f"h{i}"))),
    )})
    df = df.withColumns({x + str(i): c for i in each for x, c in (
        ("s", F.when(F.col(f"v{i}") < _TAIL, F.sqrt(share(f"v{i}", f"q{i}") * F.lit(2.0)))), ("y", F.when(F.col(f"u{i}") >= _STEPS - _TAIL, -F.log(F.lit(1.0) - share(f"u{i}", f"p{i}")))),
        ("i", F.get(plain, F.col(f"u{i}"))), ("j", F.get(logs, F.col(f"v{i}"))),
    )})

    def line(table: Column, low: str, at: str, part: str) -> Column:
        return F.col(low) + (F.get(table, F.col(at) + 1) - F.col(low)) * F.col(part)

    def beyond(y: Column, times: int) -> Column:
        return y + F.log(F.lit(1.0) + beyond(y, times - 1)) if times else y

    def drawn(i: int) -> dict[str, Column]:
        s, y = F.col(f"s{i}"), F.col(f"y{i}")
        r = F.when(y.isNull(), line(plain, f"i{i}", f"u{i}", f"p{i}")).otherwise(beyond(y, 4))
        c = F.when(s.isNull(), line(logs, f"j{i}", f"v{i}", f"q{i}")).otherwise(F.log(s) + s * (F.lit(1 / 3) + s * F.lit(7 / 72)))
        return {f"r{i}": r, f"c{i}": c, f"b{i}": F.shiftrightunsigned(f"f{i}", 20) * F.lit(2.0**-44)}

    return df.withColumns({k: c for i in each for k, c in drawn(i).items()})


def _with_values(df: DataFrame) -> DataFrame:
    """Columns ``va`` and ``vb``, numbered, for the samples of ``part``, a ``term`` and log-weights ``wa`` and ``wb``: the value above 20 bits of its name, as one long, so that a minimum picks both; null where the weight is."""
    each = range(AT_ONCE)
    df = _with_draws(df, each).withColumns({f"t{w}{i}": F.floor(F.col(f"w{w}") / F.col(f"r{i}") + F.col(f"b{i}")) for i in each for w in "ab"})

    def value(w: str, i: int) -> Column:
        t = F.col(f"t{w}{i}")
        found = F.col(f"c{i}") - F.col(f"r{i}") * (t - F.col(f"b{i}") + F.lit(1.0))
        who = F.col(f"f{i}").bitwiseXOR(t * F.lit(40503)).bitwiseAND(F.lit((1 << 20) - 1))
        return F.shiftleft(F.floor((found + F.lit(_OFFSET)) * F.lit(_SCALE)), 20).bitwiseOR(who)

    return df.withColumns({f"v{w}{i}": value(w, i) for i in each for w in "ab"})


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _fingerprint(side: str) -> Column:
    """The names of all samples, in their order; empty without any."""
    columns = [f"v{side}{i}" for i in range(AT_ONCE)]
    found = F.array_sort(F.collect_list(F.when((F.col("part") >= 0) & F.col(columns[0]).isNotNull(), F.struct("part", *columns))))
    cell = lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))), DIGITS, "0"))
    return F.array_join(F.transform(found, lambda x: F.concat(*(cell(x[c]) for c in columns))), "")


def likeness(one: Column, two: Column) -> Column:
    """The share of samples in which two fingerprints agree; 1 for two empty ones, 0 where one is empty."""
    at = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    same = F.size(F.filter(at, lambda i: one.substr(i * DIGITS + 1, F.lit(DIGITS)) == two.substr(i * DIGITS + 1, F.lit(DIGITS))))
    return F.when((one == "") | (two == ""), (one == two).cast("double")).otherwise(same / F.lit(float(SAMPLES)))


def _with_blocks(read: DataFrame) -> DataFrame:
    """Rows (key, tie, text, ...) with their ``block``, a range of (key, tie), and ``late``; the first row after a block comes with it, too.

    The driver gathers two numbers for each block: where it begins.  Where one
    key fills several blocks, they are ranges of its ties, which are hashes.
    """
    n = read.count()
    blocks = max(1, n // BLOCK)
    shares = [i / blocks for i in range(blocks)]
    found = sorted(read.agg(F.percentile_approx("key", _array(shares, "double"), 4 * blocks + 10000)).head()[0] or [_LOWEST])
    begins: list[tuple[int, int]] = []
    for key, same in itertools.groupby(found):
        parts = len(list(same))
        begins += [(key, _LOWEST + (j << 64) // parts) for j in range(parts)]
    begins[0] = (_LOWEST, _LOWEST)
    count = len(begins)
    keys, ties = _array([k for k, _ in begins], "bigint"), _array([t for _, t in begins], "bigint")
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(count.bit_length()))])

    def reached(place: Column) -> Column:
        at = F.least(place, F.lit(count - 1))
        return (place < count) & ((F.get(keys, at) < F.col("key")) | ((F.get(keys, at) == F.col("key")) & (F.get(ties, at) <= F.col("tie"))))

    # A binary search for the last begin that isn't beyond the row.
    number = F.aggregate(bits, F.lit(0), lambda at, step: F.when(reached(at + step), at + step).otherwise(at))
    placed = read.withColumn("block", number)
    # A block's first row in descending order is the next one of the block above it.
    tops = placed.groupBy("block").agg(F.max(F.struct("key", "tie")).alias("top"))
    above = Window.partitionBy(F.lit(0)).orderBy("block")
    around = tops.select("block", "top", F.coalesce(F.lead("block").over(above), F.min("block").over(Window.partitionBy(F.lit(0)))).alias("above"), F.lead("block").over(above).isNull().alias("last"))
    joined = placed.join(F.broadcast(around), "block")
    own = F.struct(F.col("block"), F.lit(False).alias("ghost"), F.lit(False).alias("late"))
    ghost = F.struct(F.col("above").alias("block"), F.lit(True).alias("ghost"), F.col("last").alias("late"))
    where = F.explode(F.when(F.struct("key", "tie") == F.col("top"), F.array(own, ghost)).otherwise(F.array(own)))
    return joined.select("key", "tie", "doc_id", "text", where.alias("at")).select("key", "tie", "doc_id", "text", "at.*")


def _sides(half: Column) -> Column:
    """What is counted of a row: its text, its edited text, and, in further rows of one number each, what belongs to the row itself."""
    text, sha = F.col("text"), F.sha2(F.col("edited").cast("binary"), 256)
    kind = lambda k, body: F.struct(F.lit(k).alias("side"), body.alias("body"))
    own = [F.col("n").cast("string"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"), F.col("doc_id").isNull().cast("int").cast("string")]
    own += [F.conv(F.substring(sha, 15 * k + 1, 15), 16, 10) for k in range(5)]
    plain = [kind(0, text), kind(2, F.lit("0")), *(kind(3 + k, c) for k, c in enumerate(own[:3]))]
    return F.explode(F.when(F.col("ghost"), F.array(kind(0, text), kind(2, F.lit("1")))).otherwise(F.array(*plain, kind(1, F.col("edited")), *(kind(6 + k, c) for k, c in enumerate(own[3:])))))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text's.

    The edited text replaces the last floor(n/2) code points by the first as
    many of the next document in descending order of ``doc_id``; the first
    follows the last.  Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint`` (64 samples of 4 hex digits),
    ``near_edited`` and ``near_next``.

    Null texts are empty; a text without words has an empty fingerprint, which
    is like another empty one only.  Null ids come last, rows with one id in
    the order of a hash of their texts.  Equal rows are kept; other columns are
    ignored.  Texts are taken whole, however long; no rows give none.

    Texts are shuffled once, by blocks of neighbouring ids; all else happens
    within a block's partition.  Blocks grow in number with the rows; rows of
    one id are dealt to several as well, except equal ones.
    """
    read = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("key"), F.xxhash64(whole_text()).alias("tie"), F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    dealt = _with_blocks(read).repartition("block")
    order = Window.partitionBy("block").orderBy("late", F.col("key").desc(), F.col("tie").desc(), "text", "ghost")
    rows = dealt.withColumns({"rid": F.row_number().over(order), "next": F.lead("text").over(order), "n": F.length("text")})
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n") - half), F.coalesce(F.col("next"), F.lit("")).substr(F.lit(1), half))
    bodies = rows.withColumn("edited", edited).select("block", "rid", _sides(half).alias("b")).select("block", "rid", "b.*")
    each = bodies.select("block", "rid", "side", F.explode(_words(F.col("body"))).alias("word")).where("word <> ''")
    word = F.col("side") < 2
    each = each.select("block", "rid", F.greatest("side", F.lit(1)).alias("kind"), F.when(word, F.xxhash64("word")).otherwise(0).alias("term"), F.when(word, F.when(F.col("side") == 0, 1).otherwise(0)).otherwise(F.col("word").try_cast("bigint")).alias("a"), F.when(F.col("side") == 1, 1).otherwise(0).alias("b"))
    # Both texts' counts of a word are one row, as their draws are the same.
    counted = each.groupBy("block", "rid", "kind", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    weight = lambda c: F.when((F.col("kind") == 1) & (F.col(c) > 0), F.log(F.col(c).cast("double")))
    # A row for each two samples; a number of the row's own is one more, as it is.
    weighted = counted.select("block", "rid", "kind", "term", "a", weight("a").alias("wa"), weight("b").alias("wb"))
    own, every = F.col("kind") > 1, F.sequence(F.lit(0), F.lit(SAMPLES // AT_ONCE - 1))
    spread = weighted.select("block", "rid", "kind", "term", "a", "wa", "wb", F.explode(F.when(own, F.array(-F.col("kind"))).otherwise(every)).alias("part"))
    values = [f"v{w}{i}" for i in range(AT_ONCE) for w in "ab"]
    drawn = _with_values(spread).groupBy("block", "rid", "part").agg(F.min(F.when(own, F.col("a")).otherwise(F.col("va0"))).alias("va0"), *(F.min(c).alias(c) for c in values[1:]))
    of = lambda k: F.max(F.when(F.col("part") == -k, F.col("va0")))
    digest = F.concat(*(F.lpad(F.lower(F.hex(of(6 + k))), 15 if k < 4 else 4, "0") for k in range(5)))
    both = drawn.groupBy("block", "rid").agg(
        of(2).alias("ghost"), of(3).alias("n_chars"), F.when(of(5) == 0, of(4)).alias("doc_id"), digest.alias("edited_sha256"),
        _fingerprint("a").alias("fingerprint"), _fingerprint("b").alias("edited_fingerprint"),
    )
    near = both.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("rid"))).where("ghost = 0")
    return near.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
