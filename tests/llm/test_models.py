import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm._common import held_out
from tidemark.llm.quality import SubwordClassifier, fit_quality, score_quality, text_words, word_buckets
from tidemark.llm.toxicity import _WORD, TWICE, FactorizationMachine, fit_toxicity, reject_toxic, score_toxicity, text_terms, word_terms

SF = "/root/testdata/sf0.1"


def test_pairs_are_learned_that_no_sum_of_weights_can_tell():
    """Toxic where exactly one of two terms is there."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        docs.append(np.array([t for t, x in ((11, a), (22, b), (33, 1), (44 + rng.integers(0, 3), 1)) if x], "i4"))
        labels.append(int(a != b))
    labels = np.array(labels)
    # Neither term tells anything alone, so the selection by chi-square is taken out of the way here.
    model = FactorizationMachine.fit(docs, labels, prior=0.5, rank=4, epochs=400, least_chi=-1.0, scale=0.5)
    place = {int(t): i for i, t in enumerate(model.terms)}
    right = [(model.logit(np.array([place[t] for t in d.tolist() if t in place])) > 0) == y for d, y in zip(docs, labels, strict=True)]
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("fit, score, label, modulus, remainder, threshold, least", [(fit_toxicity, score_toxicity, "toxic", 4, 2, 0.3, 0.95), (fit_quality, score_quality, "quality", 3, 1, 0.5, 0.95)])
def test_held_out_accuracy(spark, fit, score, label, modulus, remainder, threshold, least):
    # Some 4 in 100 of the toxic rows here are junk without any toxic word.
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = held_out("doc_id", modulus, remainder)
    scored = score(docs, fit(docs, labels, ~out)).join(labels, "doc_id").where(out)
    counts = scored.groupBy(label).agg(F.avg(((F.col("score") >= threshold).cast("int") == F.col(label)).cast("int")).alias("right")).collect()
    assert len(counts) == 2 and all(r.right > least for r in counts), counts


def test_scores_equal_a_plain_loop(spark, docs):
    texts = ["", None, "some words here", "Some WORDS, here!", "x" * 3000, "a b " * 3000, "again again again x x"]
    rng = np.random.default_rng(2)
    terms = np.array(sorted({t for w in _WORD.findall("some words a b") for t in word_terms(w)} | {t ^ TWICE for t in word_terms("some")}), "i4")
    fm = FactorizationMachine(terms, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3)), -1.0)
    place = {int(t): i for i, t in enumerate(terms)}
    sc = SubwordClassifier(rng.normal(size=(1 << 15, 4)), rng.normal(size=(4, 2)), rng.normal(size=2))
    tox = {r.doc_id: r.score for r in score_toxicity(docs(*texts), fm).collect()}
    qual = {r.doc_id: r.score for r in score_quality(docs(*texts), sc).collect()}
    for i, text in enumerate(texts):
        have = sorted({place[t] for t in text_terms(text or "") if t in place})
        z = -1.0 + sum(fm.weights[k] for k in have) + sum(fm.vectors[a] @ fm.vectors[b] for n, a in enumerate(have) for b in have[:n])
        assert tox[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        ids = [b for w in text_words(text or "") for b in word_buckets(w)]
        logits = (sc.table[ids].mean(0) if ids else np.zeros(4)) @ sc.out + sc.bias
        assert qual[i] == pytest.approx(1 / (1 + np.exp(logits[0] - logits[1])))


def test_labels_with_gaps(spark, docs):
    made = docs(*[(i, f"bad insult{i % 3} text" if i % 2 else "good text") for i in range(40)], (50, None), (None, "good")).selectExpr("*", "9 AS score", "1 AS label")
    rows = [(i, i % 2, i % 2) for i in range(30)] + [(3, 1, 1), (31, None, None), (None, 1, 1), (32, 7, 7), (999, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    model = fit_toxicity(made, labels, F.lit(True))
    kept = reject_toxic(spark, made, model)
    assert kept.columns == made.columns and {r.doc_id for r in kept.collect()} == {*range(0, 40, 2), 50, None}
    assert score_toxicity(made.limit(0), model).count() == reject_toxic(spark, made.limit(0), model).count() == 0
    none = fit_toxicity(made, labels.limit(0), F.lit(True))
    assert {round(r.score, 6) for r in score_toxicity(made, none).collect()} == {0.3}
    flat = fit_quality(made, labels.limit(0), F.lit(True))
    assert {r.score for r in score_quality(made, flat).collect()} == {0.5}
    fitted = fit_quality(made, labels, F.lit(True))
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in score_quality(made, fitted).where("doc_id < 40").collect())
