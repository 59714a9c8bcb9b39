"""Quality by supervised subword embeddings.

Words and their character n-grams are hashed to learned vectors; a document is
their average, a softmax layer classifies it, and stochastic gradient descent
in numpy trains both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import bucket, split_words, texts_of, tidied, tidy, training_rows, whole_text

#: Buckets of the embedding table, and the lengths of character n-grams.
MASK, GRAMS = (1 << 15) - 1, (1, 2, 3)
#: Words remembered by a Python worker at most.
WORDS_HELD = 400_000
#: What stands for a word that repeats the one before it; no split text holds it.
AGAIN = " "


def text_words(text: str) -> list[str]:
    """The text's words, with ``AGAIN`` for those that repeat the one before."""
    found = split_words(text)
    return found[:1] + [AGAIN if word == before else word for before, word in zip(found, found[1:], strict=False)]


def word_buckets(word: str) -> list[int]:
    """Buckets of a word and of its n-grams with marked ends, repeats included; letter case counts. ``AGAIN`` has one of its own."""
    if word == AGAIN:
        return [bucket(word, MASK)]
    marked: str | bytes = f"\x02{word}\x03"
    if marked.isascii():
        marked = marked.encode()  # cut as bytes, which bucket() then needn't encode
    return [bucket(marked, MASK), *(bucket(marked[i : i + n], MASK) for n in GRAMS for i in range(len(marked) - n + 1))]


@tidied
def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for text in texts_of(batch.column("text")):
            seen: Counter[int] = Counter()
            for word, n in Counter(text_words(text)).items():
                for b in word_buckets(word):
                    seen[b] += n
            keys = sorted(seen)
            ids.append(np.array(keys, "<i4").tobytes())
            counts.append(np.array([seen[k] for k in keys], "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["label", "ids", "counts"])


class SubwordClassifier:
    """Average of ``table`` rows, then softmax over ``out``."""

    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.table, self.out, self.bias = table, out, bias

    def slopes(self) -> np.ndarray:
        """What each bucket adds to the difference of the two logits: the output layer is linear, so it can be applied before the average."""
        return self.table @ (self.out[:, 1] - self.out[:, 0])

    @classmethod
    def fit(cls, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 12, epochs: int = 12, rate: float = 1.0, seed: int = 5) -> SubwordClassifier:
        rng = np.random.default_rng(seed)
        table, out, bias = rng.uniform(-1 / dim, 1 / dim, (MASK + 1, dim)), np.zeros((dim, 2)), np.zeros(2)
        if not len(docs):
            return cls(table, out, bias)
        steps, done = epochs * len(docs), 0
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                ids, counts = docs[i]
                step = rate * (1 - done / steps)
                done += 1
                share = (counts / max(1, counts.sum()))[:, None]
                hidden = (table[ids] * share).sum(0)
                z = hidden @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = out @ p
                out -= step * np.outer(hidden, p)
                bias -= 0.05 * step * p
                table[ids] -= step * len(ids) ** 0.5 * share * back
        return cls(table, out, bias)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 2000, seed: int = 13) -> SubwordClassifier:
    """Learn ``labels.quality`` from at most ``per_class`` rows of either class for which ``train`` holds; without rows every score is 0.5."""
    rows = training_rows(docs, labels, "quality", train, per_class, seed).select("label", "text").mapInArrow(_buckets_of, "label int, ids binary, counts binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["ids"]), bytes(r["counts"])))
    model = SubwordClassifier.fit([(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in rows], np.array([r["label"] for r in rows], "i8"))
    del rows
    tidy()
    return model


def _scorer(model: SubwordClassifier):
    slopes, bias = model.slopes(), float(model.bias[1] - model.bias[0])

    @tidied
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, complex] = {}  # the sum of a word's slopes, and how many there are

        def of(word: str) -> complex:
            found = held.get(word)
            if found is None:
                if len(held) >= WORDS_HELD:
                    held.clear()
                ids = word_buckets(word)
                found = held[word] = complex(float(slopes[ids].sum()), len(ids))
            return found

        for batch in batches:
            totals = [sum(map(of, text_words(t)), 0j) for t in texts_of(batch.column("text"))]
            z = np.array([t.real / t.imag if t.imag else 0.0 for t in totals], "f8") + bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, model: SubwordClassifier) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for each row; a null or empty text has only the bias.

    Texts are scored whole, however long.  Equal rows are kept, equal texts
    score alike; other columns are ignored, and no rows give none.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return read.mapInArrow(_scorer(model), "doc_id bigint, score double")
