"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet and read again as the next one's docs.

In all stages but the last, columns stay as they are, whatever else ``docs``
holds; an empty table gives an empty one.  Null texts count as empty ones, long
texts are taken whole, equal rows are treated alike, and rows without a
``doc_id`` take part in everything but near-copies, of which they are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from tidemark.llm._common import held_out, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; it learns from the labels that op8 learns from. A null or empty text has the score of a text without terms."""
    model = toxicity.fit_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 4, 2))
    return toxicity.reject_toxic(spark, docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; ``n_chars`` follows. All documents stay, null texts null and empty ones empty."""
    own = docs.withColumnRenamed("n_dropped", "__n_dropped")
    kept = line_dedup.drop_lines(own).drop("n_dropped").withColumnRenamed("__n_dropped", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays; of rows with that id, all. Null and empty texts are no copies."""
    return near_dedup.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Null and empty texts overlap none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is the end id alone."""
    import public_tokenizers

    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: A learned model, a tokenizer and confirmed links take part, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
