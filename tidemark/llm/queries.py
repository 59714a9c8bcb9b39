"""The registered queries of this subpackage, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprint, line_dedup, near_dedup, packing, quality, secrets_scan, suffix_dedup, token_store, toxicity
from tidemark.llm._common import held_out, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_digests(secrets_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.piece_digests(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it overlaps the benchmark, with which items, and the longest overlap."""
    found = decontaminate.with_overlaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("overlaps", lambda x: x["item_id"].cast("string"))))
    return found.select(
        "doc_id",
        (F.size("overlaps") > 0).alias("contaminated"),
        F.size("overlaps").cast("bigint").alias("n_overlaps"),
        F.array_join(items, ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("overlaps", lambda x: x["equal"])), F.lit(0)).cast("bigint").alias("most_equal"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines went, and the digest of what stays."""
    kept = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_dropped", F.length(text).cast("bigint").alias("n_chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), ~out)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), ~out)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.col("ids")
    return token_store.read_tokens(spark, path).select("doc_id", "start", (F.octet_length(ids) / 4).cast("bigint").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_packing": op3_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_fingerprint": op5_fingerprint,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_token_store": op10_token_store,
}

_NEAR_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, list_aggregate(CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END, 'string_agg', ' ') AS s
  FROM tokens, LATERAL unnest(generate_series(1, greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

_LEAKS_SQL = r"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM benchmark),
item_words AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM items),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents),
doc_words AS (SELECT doc_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM docs),
equal AS (SELECT doc_id, item_id, q - p AS d, p, n, m FROM doc_words JOIN item_words USING (word)),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, d ORDER BY p RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM equal
  QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, d) >= least(6, n)),
found AS (
  SELECT doc_id, item_id, d, count(*) AS n_equal FROM counted
  GROUP BY doc_id, item_id, d, n, m HAVING max(run) >= CASE WHEN n < 8 THEN n ELSE 0.8 * least(20, n) END AND least(n, m - d) - greatest(0, -d) >= least(20, n)),
summed AS (SELECT doc_id, count(*) AS n_overlaps, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS item_ids, max(n_equal) AS most_equal FROM found GROUP BY doc_id)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(n_overlaps, 0) AS n_overlaps, coalesce(item_ids, '') AS item_ids, coalesce(most_equal, 0) AS most_equal
FROM documents d LEFT JOIN summed f ON f.doc_id = d.doc_id
"""

#: The others need a tokenizer, a learned model, hashes or offsets that SQL doesn't have.
ORACLE_SQL: dict[str, str] = {"op4_near_dedup": _NEAR_SQL, "op6_decontamination": _LEAKS_SQL}
