import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm._common import UNICODE_SPACE, scratch_path
from tidemark.llm.block_coder import decoded, encoded
from tidemark.llm.mixing_coder import BLOCK, decode_blocks, encode_blocks
from tidemark.llm.tokens import _SPACED, _spaced


def blocks():
    rng = np.random.default_rng(5)
    made = [rng.integers(0, 1 << 16, n) for n in (BLOCK, 0, 1, 7, 8, 9, 64, 65, 257, BLOCK - 1)]
    made += [np.zeros(BLOCK, int), np.full(BLOCK, 65535), np.tile([1, 2, 3], 1000), np.repeat(rng.integers(0, 9, 400), 10)]
    return made + [rng.zipf(1.3, BLOCK) % 50257 for _ in range(300)]


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, raw binary").repartition(3)


def test_same_bytes_as_the_coder_in_numpy_at_a_fraction_of_its_time(spark):
    made = blocks()
    raw = [b.astype("<u4").tobytes() for b in made]
    table(spark, raw[:5]).select(decoded(spark, encoded(spark, F.col("raw")))).collect()  # starts what a session starts once
    begin = time.perf_counter()
    coded = encode_blocks(made)
    decode_blocks(coded)
    plain = time.perf_counter() - begin
    begin = time.perf_counter()
    path = scratch_path(spark, "blocks")
    table(spark, raw).withColumns({"coded": encoded(spark, F.col("raw"))}).write.parquet(path)
    found = spark.read.parquet(path).withColumns({"ids": decoded(spark, F.col("coded"))}).orderBy("i").collect()
    assert time.perf_counter() - begin < plain
    assert [bytes(r.coded) for r in found] == coded
    assert [bytes(r.ids) for r in found] == raw


def test_damage_and_large_ids_are_errors(spark):
    (good,) = encode_blocks([np.arange(500)])
    for bad in (good[:-2], good[:30] + bytes([good[30] ^ 1]) + good[31:], b"x" + good[1:], good[:3], good[:12] + b"\0\0\0\0" + good[16:]):
        with pytest.raises(Exception, match="a block"):
            table(spark, [bad]).select(decoded(spark, F.col("raw"))).collect()
    with pytest.raises(Exception, match="below 65536"):
        table(spark, [np.array([3, 1 << 16], "<u4").tobytes()]).select(encoded(spark, F.col("raw"))).collect()


def test_in_another_session(spark):
    other = spark.newSession()
    raw = np.arange(9, dtype="<u4").tobytes()
    assert bytes(table(other, [raw]).select(decoded(other, encoded(other, F.col("raw")))).first()[0]) == raw


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=" \n\t\0　\x1c'ab.1é", max_size=12))
def test_pieces_of_texts(text):
    assert [p for p in _spaced(text) if p] == _SPACED.findall(text)
    assert re.sub(f"[{UNICODE_SPACE}]", "", "".join(_spaced(text))) == re.sub(f"[{UNICODE_SPACE}]", "", text)
