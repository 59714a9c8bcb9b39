import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm._common import scratch_path
from tidemark.llm.mixing_coder import decode_blocks, encode_blocks
from tidemark.llm.token_store import read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def cases():
    rng = np.random.default_rng(3)
    yield [rng.integers(0, 1 << 16, n) for n in (4096, 0, 1, 17, 4096, 4095)]
    yield [np.zeros(4096, int), np.full(4096, 65535), np.tile([1, 2, 3], 1000), rng.zipf(1.3, 4096) % 50257]
    yield [np.repeat(rng.integers(0, 9, 400), 10) for _ in range(40)]
    yield [np.array([], int)]
    yield []


@pytest.mark.parametrize("blocks", list(cases()))
def test_round_trip(blocks):
    coded = encode_blocks(blocks)
    assert [d.tolist() for d in decode_blocks(coded)] == [b.tolist() for b in blocks]
    assert all(decode_blocks([c])[0].tolist() == b.tolist() for c, b in zip(coded[:3], blocks[:3], strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 65535)), max_size=300), max_size=6))
def test_any_ids_round_trip(blocks):
    assert [d.tolist() for d in decode_blocks(encode_blocks([np.array(b, int) for b in blocks]))] == blocks


def test_repeats_shrink_and_damage_is_noticed():
    (coded,) = encode_blocks([np.tile(np.arange(50), 80)])
    assert len(coded) < 4000 * 2 / 8
    for bad in (coded[:-2], coded[:30] + bytes([coded[30] ^ 1]) + coded[31:], b"x" + coded[1:], coded[:3]):
        with pytest.raises(ValueError):
            decode_blocks([bad])
    with pytest.raises(ValueError):
        encode_blocks([np.array([1 << 16])])


@pytest.mark.parametrize("lanes", [2, 2048])
def test_store(spark, docs, lanes):
    rows = [(7, None), (3, ""), (9, "ab " * 9000), (1, "one\n two"), (3, "tie"), (3, "tie"), (20, "last<|endoftext|>"), (None, "no id")] + [(100 + i, f"text {i} " * (i % 40)) for i in range(200)]
    path = scratch_path(spark, "test")
    write_tokens(docs(*rows).selectExpr("*", "1 AS file", "2 AS ids"), path, PATH, lanes=lanes)
    found = sorted(read_tokens(spark, path, lanes).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(PATH)
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in found] == [i for i, _ in order]
    for r, (_, text) in zip(found, order, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert r.start == start and zlib.crc32(r.ids) == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_empty_store(spark, docs):
    path = scratch_path(spark, "none")
    write_tokens(docs("a").limit(0), path, PATH)
    assert read_tokens(spark, path).count() == 0
