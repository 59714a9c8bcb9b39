"""Near-duplicate detection by MinHash with tensored banding.

Two collections of ``GROUPS`` small MinHash groups are computed, and every pair
of a group from the first with one from the second keys a table: 2 x 16 groups
of 4 hashes make 256 tables of 8 hashes for the price of 128.  A pair at the
least similarity of 0.85 misses all tables once in about 70 000 times.

Links are confirmed on full shingle sets, first by hashes and then, where these
agree, by the words themselves.  Texts with the same words in a row are one
from the start, by a cryptographic digest of the words.  Within a table entry
only enough pairs are compared to settle which documents hang together: members
against a few centres, round by round, and never two that are known to be
connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialize, tidied, whole_text
from tidemark.llm.hashing import BASE, LOWER, mix, shingles, text_chunks, words

GROUPS, HASHES = 16, 4
#: How many times more centres an entry has in each round.
MORE = 16
_FACTORS = np.random.default_rng(4041).integers(0, 1 << 63, (2, GROUPS, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURE_SCHEMA = "doc_id bigint, n_shingles bigint, digest binary, first array<bigint>, second array<bigint>"


def group_keys(made: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys of the groups of both collections for each set of shingle hashes; ``starts``: where each set, none of them empty, begins."""
    keys = np.empty((2, len(starts), GROUPS), np.uint64)
    for c in range(2):
        for g in range(GROUPS):
            key = np.full(len(starts), g + 1, np.uint64)
            for h in range(HASHES):
                key = mix(key * np.uint64(BASE) + np.minimum.reduceat(made * _FACTORS[c, g, h], starts))
            keys[c, :, g] = key
    return keys.view(np.int64)


def _longs(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    """A list for each text, empty for those that aren't in ``full``."""
    sizes = np.where(full, rows.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(rows.reshape(-1)))


def _words(raw: bytes) -> list[bytes]:
    """The words themselves; ``bytes.split`` splits at the space and at bytes 9 to 13."""
    return raw.translate(LOWER).split()


def shingle_set(raw: bytes, k: int = 5) -> set[tuple[bytes, ...]]:
    """A text's set: the shingles themselves."""
    found = _words(raw)
    if len(found) < k:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(k)), strict=False))


def _raws(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@tidied
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for first, last, data, offsets in text_chunks(column):
            hashes, _, bounds = words(data, offsets)
            made, begins = shingles(hashes, bounds)
            full = np.diff(begins) > 0
            keys = group_keys(made, begins[:-1][full]) if full.any() else np.zeros((2, 0, GROUPS), np.int64)
            sets = [np.unique(made[begins[i] : begins[i + 1]]) for i in range(last - first)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(b" ".join(_words(raw)), digest_size=16).digest() for raw in _raws(data, offsets)], pa.binary()),
                    _longs(keys[0], full),
                    _longs(keys[1], full),
                ],
                names=["doc_id", "n_shingles", "digest", "first", "second"],
            )


def _sets(column: pa.Array) -> list[np.ndarray]:
    out = []
    for first, last, data, offsets in text_chunks(column):
        hashes, _, bounds = words(data, offsets)
        made, begins = shingles(hashes, bounds)
        out += [np.unique(made[begins[i] : begins[i + 1]]) for i in range(last - first)]
    return out


def _similar(shared: int, one: int, two: int, percent: int) -> bool:
    return shared > 0 and 100 * shared >= percent * (one + two - shared)


def _confirmer(percent: int):
    @tidied
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the pairs whose full sets are similar; runs of one right-hand text are shingled once."""
        for batch in batches:
            ones, twos = batch.column("a"), batch.column("b")
            left_texts, right_texts = batch.column("text_a"), batch.column("text_b")
            left = _sets(left_texts)
            right_ids = twos.to_pylist()
            new = [i for i in range(len(right_ids)) if not i or right_ids[i] != right_ids[i - 1] or right_texts[i] != right_texts[i - 1]]
            right = _sets(right_texts.take(pa.array(new, pa.int64())))
            which = np.searchsorted(new, np.arange(len(right_ids)), "right") - 1
            linked, of, exact = [], -1, set()
            for i, x in enumerate(left):
                y = right[which[i]]
                # Equal shingles have equal hashes, so what fails here can't be similar.
                near = min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and _similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)
                if near:
                    if of != which[i]:
                        of, exact = which[i], shingle_set(right_texts[i].as_py().encode())
                    own = shingle_set(left_texts[i].as_py().encode())
                    near = _similar(len(own & exact), len(own), len(exact), percent)
                linked.append(near)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([ones.filter(keep), twos.filter(keep)], names=["a", "b"])

    return confirm


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that it reaches, for every node of ``edges`` (a, b).

    Every round, a node's parent and the parent's parent take the smallest
    grandparent among the neighbours, and paths are halved, until nothing
    changes: the number of rounds grows with the logarithm of the longest path.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("f")).withColumnRenamed("a", "node")
    parents = materialize(parents, "parents")
    while True:
        up = parents.select(F.col("node").alias("f"), F.col("f").alias("g"))
        grand = parents.join(up, "f")
        seen = both.join(grand.select(F.col("node").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("g")).withColumnRenamed("a", "node")
        hooks = seen.join(parents, "node").select(F.explode(F.array("node", "f")).alias("node"), "g")
        best = hooks.unionByName(grand.select("node", "g")).groupBy("node").agg(F.min("g").alias("g"))
        after = materialize(parents.join(best, "node").select("node", F.least("f", "g").alias("f"), (F.col("g") < F.col("f")).alias("moved")), "parents")
        parents = after.drop("moved")
        if after.where("moved").isEmpty():
            return parents.select("node", F.col("f").alias("label"))


def _nothing(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row.

    Words are runs of bytes other than the space and bytes 9 to 13, with A-Z in
    lower case; a text's set holds its 5-word shingles, the whole sequence
    where there are fewer words, and nothing without words.  Texts are linked
    where 100 * intersection >= ``percent`` * union; ``component_id`` is the
    smallest ``doc_id`` that links reach, itself included.

    Null and empty texts have an empty set and no links.  A null ``doc_id``
    takes part in no link and has a null component.  Equal rows share their
    links, as do rows with one ``doc_id``.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    signed = materialize(texts.mapInArrow(_signatures, SIGNATURE_SCHEMA), "signatures")
    known = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Texts of the same words are one node from here on, named by its smallest doc_id.
    nodes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("first").alias("first"), F.first("second").alias("second")), "nodes")
    # Only nodes that share a group of either collection with another can share a table entry.
    groups = [nodes.select("node", F.posexplode(side).alias("g", "key")) for side in ("first", "second")]
    shared = [_repeated(g, ["g", "key"]) for g in groups]
    active = materialize(shared[0].select("node").distinct().join(shared[1].select("node").distinct(), "node"), "active", free=True)
    # Their texts are fetched once and used in every round.
    held = materialize(texts.join(active.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("doc_id", "node"), "texts", free=True)
    hopeful = materialize(_sharable(active, held, nodes.select("node", "n"), percent), "sharable", free=True)
    left = materialize(nodes.select("node", "first", "second").join(hopeful, "node"), "hopeful")
    firsts = _repeated(left.select("node", "n", "most", "second", F.posexplode("first").alias("g", "one")), ["g", "one"])
    tables = firsts.select("node", "n", "most", "one", F.explode("second").alias("two")).select("node", "n", "most", F.xxhash64("one", "two").alias("key"))
    members = materialize(_repeated(tables, ["key"]).withColumn("label", F.col("node")), "tables", free=True)

    labels = materialize(_settle(spark, held, left, members, percent), "labels")
    named = nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias("digest"))
    out = rows.join(named, "digest", "left")
    ids = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return ids


@tidied
def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles by half their hash: where two meet in one value, they count as shared, which is the safe side."""
    for batch in batches:
        node = batch.column("node").to_numpy()
        for first, last, data, offsets in text_chunks(batch.column("text")):
            hashes, _, bounds = words(data, offsets)
            made, begins = shingles(hashes, bounds)
            sets = [np.unique(made[begins[i] : begins[i + 1]]) for i in range(last - first)]
            half = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[first:last], [len(x) for x in sets])), pa.array(half)], names=["node", "shingle"])


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key others have, too."""
    return rows.join(rows.groupBy(*key).agg(F.count("*").alias("__c")).where("__c > 1").select(*key), key, "left_semi")


def _sharable(inside: DataFrame, held: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``node``, ``n`` and ``most``, how many shingles a node has that another one holds, too.

    Two sets share no more than the smaller ``most``, so pairs and nodes that
    can't link fall out without a comparison: in a large group of copies, those
    that were edited too much.
    """
    each = held.mapInArrow(_shingle_rows, "node bigint, shingle int")
    lone = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    # Of rows with one id each may have a text of its own; they keep their size as the bound.
    several = held.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
    missing = lone.join(several, "node", "left_anti").groupBy("node").agg(F.count("*").alias("lone"))
    known = sizes.join(inside, "node").join(missing, "node", "left").select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("most"))
    return known.where(F.col("most") * 100 >= F.col("n") * percent)


def _settle(spark, held: DataFrame, nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``label`` of the nodes that have links.

    ``held``: node, text; ``nodes``: node, n, most, first, second; ``members``
    of table entries: node, key, n, most, label (of its component so far).
    Each round takes centres from every entry that spans several components,
    compares them with the entry's members in other components, and takes them
    out: all that could link them here is known then.  The first centre is the
    member that shares most of its shingles, in a group of edited copies the
    one that was edited least; from the second round on there are more,
    ``MORE`` times as many each round.

    From the second round on, the sixteen entries that have a group of the
    first collection in common are one: a pair is taken where this is the
    first group that the two have in common, if they also have one of the
    second in common, and so once, and not once for each entry.
    """
    labels = _nothing(spark, "node bigint, label bigint")
    tested = _nothing(spark, "a bigint, b bigint")
    centres, round_ = 1, 0
    while True:
        rank = F.xxhash64("node", F.lit(round_))
        entries = members.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("lone"), rank.alias("r"), "node")).alias("c"), F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
        mixed = entries.where("low < high").select("key", F.col("c.node").alias("centre"), "size")
        chosen = (F.col("node") == F.col("centre")) | (F.pmod(rank, F.col("size")) < (centres if centres > 1 else 0))
        members = materialize(members.join(mixed, "key").withColumn("is_centre", chosen).drop("centre", "size"), "tables", free=True)
        if members.isEmpty():
            return labels
        names = {c: f"centre_{c}" for c in members.columns if c not in ("key", "is_centre", "g")}
        picked = members.where("is_centre").drop("is_centre", "g").withColumnsRenamed(names)
        # 100 x shared >= percent x union, with shared at most what either can share.
        likely = F.least("most", "centre_most") * (100 + percent) >= (F.col("n") + F.col("centre_n")) * percent
        wanted = (F.col("label") != F.col("centre_label")) & likely
        if round_:
            wanted &= _equal_groups("first", "centre_first").bitwiseAND(F.expr("shiftleft(2, g) - 1")) == F.expr("shiftleft(1, g)")
            wanted &= _equal_groups("second", "centre_second") != 0
        pairs = members.join(picked, "key").where(wanted).select(F.col("node").alias("a"), F.col("centre_node").alias("b"))
        # Of (x, y) and (y, x), which two centres make, one is enough.
        pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(F.struct("b", "a")).alias("p")).select("lo", "hi", "p.a", "p.b")
        fresh = materialize(pairs.join(tested.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), ["lo", "hi"], "left_anti").select("a", "b"), "pairs")
        tested = tested.unionByName(fresh)
        left = fresh.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        full = left.join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        links = materialize(full.mapInArrow(_confirmer(percent), "a bigint, b bigint"), "links", free=True)
        members = members.where("not is_centre").drop("is_centre")
        if not links.isEmpty():
            named = links.join(_old(labels, "a"), "a", "left").join(_old(labels, "b"), "b", "left")
            joined = named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b").distinct()
            moved = connected_components(joined)
            # A component's label is itself a node, which may have had no row so far.
            was = labels.select("node", F.col("label").alias("old")).unionByName(moved.select("node", F.col("node").alias("old"))).distinct()
            labels = materialize(was.join(moved.select(F.col("node").alias("old"), F.col("label").alias("new")), "old", "left").groupBy("node").agg(F.min(F.coalesce("new", "old")).alias("label")), "labels")
            members = _labelled(members.drop("label"), labels)
        if not round_:
            spans = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
            open_ = members.join(spans, "key", "left_semi").select("node").distinct()
            # Entries that this leaves out lie within one component, and the first centres have met all others in theirs.
            rows = nodes.join(open_, "node").select("node", "n", "most", "first", "second", F.posexplode("first").alias("g", "one"))
            members = _labelled(rows.select("node", "n", "most", "first", "second", "g", F.xxhash64("g", "one").alias("key")), labels)
        centres, round_ = centres * MORE, round_ + 1


def _equal_groups(one: str, two: str):
    """A bit for each place in which two arrays of group keys agree."""
    bits = [F.when(F.get(one, F.lit(k)) == F.get(two, F.lit(k)), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(GROUPS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _old(labels: DataFrame, side: str) -> DataFrame:
    return labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))


def drop_near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``doc_id`` is the smallest of its component; rows without a ``doc_id`` stay."""
    found = near_components(docs, percent)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == F.col("__gone"), "left_anti")
