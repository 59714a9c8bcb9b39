"""The pipeline against a plain version of every stage, each on its own input."""

import os
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_decontaminate import brute as brute_leaks
from test_near_dedup import brute as brute_near
from test_near_dedup import shingle_set

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm._common import held_out, materialize
from tidemark.llm.hashing import shingles, words
from tidemark.llm.line_dedup import template_keys

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_stages_keep_the_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(columns == COLUMNS for name, (_, _, columns) in results.items() if name != "packing")


def test_toxicity(spark, results):
    before, after, _ = results["toxicity"]
    model = toxicity.fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), ~held_out("doc_id", 4, 2))
    place = {int(t): i for i, t in enumerate(model.terms)}
    keep = [r for r in before if model.logit(np.array(sorted(place[t] for t in toxicity.text_terms(r.text) if t in place), "i8")) < np.log(0.3 / 0.7)]
    assert sorted(keep) == sorted(after) and 0 < len(after) < len(before)


def family(text):
    data = np.frombuffer(text.encode(), np.uint8)
    hashes, _, bounds = words(data, np.array([0, len(data)]))
    made, _ = shingles(hashes, bounds)
    return int(made.min()) if len(made) else None


def test_line_dedup(results):
    before, after, _ = results["line_dedup"]
    texts = {r.text: family(r.text) for r in before}
    holders = defaultdict(set)
    for text in texts:
        for line in text.split("\n"):
            for key in template_keys(line):
                holders[key].add(text)
    gone = {k for k, t in holders.items() if (n := len({texts[x] for x in t})) >= 10 and n >= 0.5 * len(t)}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not gone & set(template_keys(x))) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    assert xxhash.xxh3_64_intdigest("") and any(len(want[r.doc_id]) < len(r.text) for r in before)


def test_near_dedup(results):
    before, after, _ = results["near_dedup"]
    labels = brute_near([(r.doc_id, r.text) for r in before])
    assert sorted(after) == sorted(r for r in before if labels[r.doc_id][1] == r.doc_id) and len(after) < len(before)
    assert all(shingle_set(r.text) is not None for r in after)


def test_decontamination(spark, results):
    before, after, _ = results["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not brute_leaks(items, r.text)}


def test_packing(results):
    before, after, _ = results["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for p in after:
        pieces[p.doc_id].append((p.start, p.length))
    for r in before:
        at = 0
        for start, length in sorted(pieces[r.doc_id]):
            assert start == at
            at += length
        assert at == len(t.encode(r.text, add_special_tokens=False).ids) + 1


def test_run_gives_the_last_stage(spark, results):
    made = corpus_pipeline.run(spark, SF)
    tokens = lambda rows: sum(r.length for r in rows)
    assert tokens(made.collect()) == tokens(results["packing"][1]) and os.path.isdir(SF)


def test_stages_on_odd_rows(spark, docs):
    """Nulls in every column, empty, repeated and long texts, clashing columns, no rows."""
    texts = [None, "", "one same text of some words", "one same text of some words", "long words here " * 20_000, "\n\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, None), (None, "a text without an id")]
    odd = docs(*rows).selectExpr("doc_id", "text", "nullif(lang, 'en') AS lang", "CAST(NULL AS STRING) AS source", "n_chars", "1 AS overlaps", "2 AS n_dropped", "3 AS label", "4 AS score", "5 AS node")
    left = odd
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, left, SF), f"odd-{name}")
        assert stage(spark, odd.limit(0), SF).count() == 0
        if name == "packing":
            assert {(r.start, r.length, r.doc_tokens) for r in after.where("doc_id = 0").collect()} <= {(0, 1, 1)}
            assert after.agg({"length": "sum"}).head()[0] > 20_000
        else:
            assert after.columns == odd.columns and {r.n_dropped for r in after.collect()} == {2}
            if name in ("line_dedup", "decontamination"):
                assert after.count() == left.count()
            left = after
    assert left.where("doc_id = 3").count() == 0 and left.where("doc_id = 2").count() == 2 and left.where("doc_id IS NULL").count() == 2
