"""What the operators share: scratch tables, text access, labels, hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that Unicode calls white space (fixed values).
UNICODE_SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: ``str.split()`` also splits at these four, which are no white space in Unicode.
_SPLIT_ONLY = ("\x1c", "\x1d", "\x1e", "\x1f")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see.

    Where the session names none, a local session gets a temporary one; a
    cluster's executors couldn't see each other's, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage (a lost executor costs no recomputation) and fixes the
    values of row ids, which may differ from run to run of the same plan.
    ``free``: the shuffle files of finished steps go now, and not whenever the
    driver happens to collect its garbage; nothing needs them any more.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if free:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` has written and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the id, written as text, leaves ``remainder``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def texts_of(column: pa.Array, step: int = 256) -> Iterator[str]:
    """The strings of a column, of which only ``step`` are Python objects at a time."""
    forget()
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def split_words(text: str) -> list[str]:
    """The runs of characters that aren't Unicode white space."""
    if any(c in text for c in _SPLIT_ONLY):
        import re

        return re.findall(f"[^{UNICODE_SPACE}]+", text)
    return text.split()


def bucket(term: str | bytes, mask: int) -> int:
    """A stable hash of ``term``: crc32 of its UTF-8 bytes, cut to ``mask``."""
    return zlib.crc32(term if isinstance(term, bytes) else term.encode("utf-8", "surrogatepass")) & mask


#: What a Python worker remembers from task to task.
REMEMBERED: list[dict] = []


def forget() -> None:
    """Drop what the worker remembers for another operator than the one that it works for now."""
    for held in REMEMBERED:
        held.clear()


def tidy() -> None:
    """Give memory that this process has freed back to the system; an idle worker would hold it beside the one that works."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over the batches of a partition, that tidies up at its end."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return inner


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, seed: int) -> DataFrame:
    """At most ``per_class`` labelled documents of either class: ``doc_id``, ``text``, ``label``.

    Only ids are sorted (by a hash, so that the choice doesn't depend on the
    order of rows); texts are reached by a broadcast of at most
    ``2 * per_class`` ids and never shuffled.  A document with several labels
    takes the largest; null ids and labels teach nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    mixed = F.xxhash64(F.col("doc_id"), F.lit(seed))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(mixed, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
