from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a ``documents`` table of texts, or of (doc_id, text[, source])."""

    def make(*rows, schema=DOCS, parts=3):
        made = []
        for i, row in enumerate(rows):
            doc_id, text, *source = row if isinstance(row, tuple) else (i, row)
            made.append((doc_id, text, "en", source[0] if source else f"s{i % 3}", None if text is None else len(text)))
        return spark.createDataFrame(made, schema).repartition(parts)

    return make
