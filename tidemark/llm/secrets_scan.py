"""Secret scan with corpus-wide ownership frequency.

Candidates are found in each text, their values hashed, and the hashes counted
over the whole corpus by distinct repositories and owners.  A value that many
owners hold is a copied example; one that a single owner holds looks live.
Loose candidates (long mixed strings without a keyword) count as secrets only
where the corpus shows one owner.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialize, texts_of, tidied, whole_text

#: Kinds in the order in which spans at one place are listed (fixed values).
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))

SCAN_SCHEMA = "uid bigint, doc_id bigint, repository string, owner string, n_assign bigint, n_access bigint, n_hex bigint, found array<struct<kind:int,start:int,end:int,value:binary>>"


def _entropy(value: str) -> float:
    counts, n = Counter(value).values(), len(value)
    return -sum(c / n * math.log2(c / n) for c in counts)


def find_candidates(text: str) -> list[tuple[int, int, int, bytes]]:
    """``(kind, start, end, hash of the value)`` of every candidate, by start and then kind; ends are exclusive."""
    found = [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    base = [x[1:3] for x in found]
    for m in _LOOSE.finditer(text):
        if all(c.search(m[0]) for c in _CLASSES) and not any(s < m.end() and m.start() < e for s, e in base) and _entropy(m[0]) >= 3.5:
            found.append((3, *m.span(), m[0]))
    found.sort(key=lambda x: (x[1], x[0]))
    return [(k, s, e, hashlib.blake2b(v.encode(), digest_size=16).digest()) for k, s, e, v in found]


@tidied
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())])
    for batch in batches:
        found = [find_candidates(t) for t in texts_of(batch.column("text"))]
        n = len(found)
        counts = [pa.array([sum(x[0] == k for x in f) for f in found], pa.int64()) for k in range(3)]
        rows = pa.array([[dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in f] for f in found], pa.list_(item))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(uid, uid + n), pa.int64()), batch.column("doc_id"), batch.column("repository"), batch.column("owner"), *counts, rows],
            names=["uid", "doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "found"],
        )
        uid += n


def scan_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, example_owners: int = 3) -> DataFrame:
    """Spans of secrets for each document, with what the corpus says of their values.

    ``owner`` and ``repository`` default to ``source`` and to a source's
    documents in one language.  Returns one row per input row: ``doc_id``, the
    counts ``n_assign``, ``n_access``, ``n_hex``, and ``spans``, an array of
    structs (kind, start, end, owners, repositories, occurrences, verdict) by
    start and kind.  Offsets are code points.  ``verdict`` is ``live`` (one
    owner), ``shared`` or ``example`` (at least ``example_owners`` owners).

    Null texts are empty and have no spans; a null owner or repository counts
    as one owner of its own name, the empty one.  Equal rows are kept apart.
    Other columns of ``docs`` are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))
    scanned = materialize(read.mapInArrow(_scan, SCAN_SCHEMA), "secrets")
    each = scanned.where(F.size("found") > 0).select("uid", "owner", "repository", F.explode("found").alias("f")).select("uid", "owner", "repository", "f.*")
    # A row for each value, owner and repository comes first: a value copied a million times is a few rows from then on.
    held = each.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    stats = held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.sum("n").alias("occurrences"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("owners") > 1, "shared").otherwise("live")
    known = each.join(stats, "value").withColumn("verdict", verdict).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    spans = known.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "occurrences", "verdict"))).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    out = scanned.drop("found", "owner", "repository").join(spans, "uid", "left").drop("uid")
    named = F.transform("spans", lambda x: F.struct(names[x["kind"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["owners"].alias("owners"), x["repositories"].alias("repositories"), x["occurrences"].alias("occurrences"), x["verdict"].alias("verdict")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,owners:bigint,repositories:bigint,occurrences:bigint,verdict:string>>")
    return out.withColumn("spans", F.coalesce(named, empty))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`scan_secrets`."""
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["verdict"] == "live")).cast("bigint").alias("n_live"),
        F.size(F.filter("spans", lambda x: x["verdict"] == "example")).cast("bigint").alias("n_example"),
    )
