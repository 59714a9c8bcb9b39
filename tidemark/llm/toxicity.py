"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words and character n-grams.  Each chosen
term has a weight and a latent vector; the products of the vectors let the
model learn pairs (an insult with the mention of a group) that a sum of
weights misses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import bucket, texts_of, tidied, tidy, training_rows

_WORD = re.compile(r"[^\W\d_]+")
#: Hash space of the terms, the lengths of character n-grams, and those of word beginnings.
MASK, GRAMS, BEGINNINGS = (1 << 20) - 1, (3, 4, 5), (6, 7, 8, 9)
#: What turns a term into that of "in two words at least".
TWICE = 0x5BD1E
#: Words remembered by a Python worker at most.
WORDS_HELD = 400_000
_NONE: frozenset[int] = frozenset()


def word_terms(word: str) -> set[int]:
    """Hashes of a word, of its beginnings and of its n-grams, with marked ends."""
    marked: str | bytes = f"<{word}>"
    if marked.isascii():
        marked = marked.encode()  # cut as bytes, which bucket() then needn't encode
    terms = {bucket(marked, MASK), *(bucket(marked[: n + 1], MASK) for n in BEGINNINGS if len(word) > n)}
    for n in GRAMS:
        terms.update(bucket(marked[i : i + n], MASK) for i in range(len(marked) - n + 1))
    return terms


def text_terms(text: str) -> set[int]:
    """Hashes of what stands in any of the text's words, and of what stands in two different ones at least."""
    once: set[int] = set()
    twice: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        terms = word_terms(word)
        twice |= once & terms
        once |= terms
    return once | {t ^ TWICE for t in twice}


@tidied
def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, the document's distinct term hashes as little-endian int32)."""
    for batch in batches:
        out = [np.fromiter(t := text_terms(text), "<i4", len(t)).tobytes() for text in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], names=["label", "terms"])


class FactorizationMachine:
    """``bias + sum(w) + pairwise products`` of the terms that a document has."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, vectors: np.ndarray, bias: float):
        self.terms, self.weights, self.vectors, self.bias = terms, weights, vectors, bias

    def logit(self, rows: np.ndarray) -> float:
        """``rows``: positions, in the model's tables, of the document's terms."""
        if not len(rows):
            return self.bias
        v = self.vectors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    @classmethod
    def fit(cls, docs: list[np.ndarray], labels: np.ndarray, prior: float, n_terms: int = 4096, rank: int = 4, epochs: int = 200, rate: float = 0.1, decay: float = 1e-4, seed: int = 7, least_chi: float = 3.84, scale: float = 0.01) -> FactorizationMachine:
        """Logistic loss, Adagrad over the whole sample, after keeping the ``n_terms`` terms with the largest chi-square against the label.

        ``least_chi``: what a term must exceed (3.84 is the 5 % level of one
        degree of freedom); ``scale``: spread of the latent vectors at first.
        """
        none = cls(np.zeros(0, "i4"), np.zeros(0), np.zeros((0, rank)), float(np.log(prior / (1 - prior))))
        pos, neg = int(labels.sum()), int((1 - labels).sum())
        if not pos or not neg:
            return none
        counts = np.zeros((2, MASK + 1))
        for terms, label in zip(docs, labels, strict=True):
            counts[label, terms] += 1
        in_neg, in_pos = counts
        n, seen = pos + neg, in_pos + in_neg
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = n * (in_pos * (neg - in_neg) - in_neg * (pos - in_pos)) ** 2.0 / (seen * (n - seen) * float(pos) * neg)
        chi = np.where(seen >= 2, np.nan_to_num(chi, nan=0.0, posinf=0.0), 0.0)
        terms = np.sort(np.argsort(-chi, kind="stable")[:n_terms])
        terms = terms[(chi[terms] > least_chi) & (seen[terms] >= 2)].astype("i4")
        if not len(terms):
            return none
        at = np.full(MASK + 1, -1, "i4")
        at[terms] = np.arange(len(terms))
        chosen = [x[x >= 0] for x in (at[d] for d in docs)]
        rows, cols = np.repeat(np.arange(len(docs), dtype="i4"), [len(x) for x in chosen]), np.concatenate(chosen)
        del chosen, counts, in_neg, in_pos, seen, chi, at
        rng = np.random.default_rng(seed)
        w, v, b = np.zeros(len(terms)), rng.normal(0, scale, (len(terms), rank)), 0.0
        gw, gv, gb = np.full_like(w, 1e-8), np.full_like(v, 1e-8), 1e-8
        weight = np.where(labels == 1, 0.5 / pos, 0.5 / neg)
        for _ in range(epochs):
            total = np.stack([np.bincount(rows, v[cols, f], len(docs)) for f in range(rank)], 1)
            squares = np.bincount(rows, (v * v).sum(1)[cols], len(docs))
            z = b + np.bincount(rows, w[cols], len(docs)) + 0.5 * ((total * total).sum(1) - squares)
            err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
            g = np.bincount(cols, err[rows], len(terms)) + decay * w
            h = np.stack([np.bincount(cols, err[rows] * total[rows, f], len(terms)) for f in range(rank)], 1) - v * np.bincount(cols, err[rows], len(terms))[:, None] + decay * v
            gw += g * g
            gv += h * h
            gb += err.sum() ** 2
            w -= rate * g / np.sqrt(gw)
            v -= rate * h / np.sqrt(gv) * 0.3
            b -= rate * err.sum() / np.sqrt(gb)
        return cls(terms, w, v, b + float(np.log(prior / (1 - prior))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 2000, seed: int = 11) -> FactorizationMachine:
    """Learn ``labels.toxic`` from at most ``per_class`` rows of either class for which ``train`` holds; without rows of both classes the score is the prior."""
    rows = training_rows(docs, labels, "toxic", train, per_class, seed).select("label", "text").mapInArrow(_terms_of, "label int, terms binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["terms"])))
    y, terms = np.array([r["label"] for r in rows], "i8"), [np.frombuffer(r["terms"], "<i4") for r in rows]
    del rows
    model = FactorizationMachine.fit(terms, y, prior=0.3)
    del terms
    tidy()
    return model


def _text_scorer(model: FactorizationMachine):
    """A function from texts (null: empty) to scores, which remembers words."""
    place = {int(t): i for i, t in enumerate(model.terms)}
    known = set(place) | {t ^ TWICE for t in place}
    held: dict[str, frozenset[int]] = {}  # of a word's terms, those that the model knows by themselves or twice

    def score(text: str | None) -> float:
        once: set[int] = set()
        twice: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            hit = held.get(word)
            if hit is None:
                if len(held) >= WORDS_HELD:
                    held.clear()
                hit = held[word] = frozenset(known & word_terms(word)) or _NONE
            if hit:
                twice |= once & hit
                once |= hit
        rows = {place[t] for t in once if t in place} | {place[t ^ TWICE] for t in twice if t ^ TWICE in place}
        z = model.logit(np.fromiter(sorted(rows), "i8", len(rows)))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

    return score


def toxicity_score(model: FactorizationMachine, text: Column) -> Column:
    """The score (0 to 1) of a text column; a null or empty text has that of a text without terms.

    Only the texts travel to Python and only scores come back.
    """

    @tidied
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _text_scorer(model)
        for column in columns:
            yield pa.array([score(t) for t in texts_of(column)], pa.float64())

    return F.arrow_udf(scores, "double")(text)


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for each row.

    Null and empty texts get the score of a text without terms; texts are
    scored whole, however long.  Equal rows are kept, equal texts score alike;
    other columns are ignored, and no rows give none.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), toxicity_score(model, F.col("text")).alias("score"))


def reject_toxic(spark: SparkSession, docs: DataFrame, model: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that score below ``threshold``.

    Null and empty texts, ties and repeated rows are treated as by
    :func:`score_toxicity`.  Texts travel to Python once, don't come back and
    are not shuffled.
    """
    return docs.where(toxicity_score(model, F.col("text")) < threshold)
