import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import Packer, pack, piece_digests
from tidemark.llm.tokens import WordEncoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def whole(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text, add_special_tokens=False).ids


ENCODERS = {p: (WordEncoder(p, k), Tokenizer.from_file(p)) for p, k in ((WORDS, False), (BYTES, True))}


@pytest.mark.parametrize("path", [WORDS, BYTES])
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\x0b\x1c\x1f\x85\xa0 　'sStT.,!1é́ΣσK<|>endoftxr")), st.characters(codec="utf-8")), max_size=40))
def test_pieces_encode_as_the_whole_text(path, text):
    ours, theirs = ENCODERS[path]
    assert np.frombuffer(ours.encode_batch([text])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", " ", "  ", "\n", "a", "Ab.", "\u0338", "é"])


@pytest.mark.parametrize("path", [WORDS, BYTES])
@settings(max_examples=200, deadline=None)
@given(st.lists(SPECIAL, max_size=8).map("".join))
def test_strings_of_special_tokens_are_what_the_library_takes_them_for(path, text):
    ours, theirs = ENCODERS[path]
    assert np.frombuffer(ours.encode_batch([text])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x17F), st.characters(max_codepoint=0x24F), st.sampled_from(list(" 's\u0130\u0131\u00aa\u00b5\u00d7\u1e9e\u0301"))), max_size=25))
def test_latin_words_encode_as_the_library_does(path, text):
    ours, theirs = ENCODERS[path]
    assert np.frombuffer(ours.encode_batch([text])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([1, 8, 2048]))
def test_every_id_lies_in_one_piece_and_no_window_is_padded(sizes, pool):
    packer = Packer(3, pool=pool)
    for doc, n in enumerate(sizes):
        packer.add(doc, np.arange(n, dtype="<u4").tobytes())
    packer.finish()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, n, total, sequence, offset, window, step, ids in packer.done:
        assert total == sizes[doc] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + n))
        by_doc[doc].append((start, n))
        by_sequence[sequence].append((offset, n, window, step))
    for doc, n in enumerate(sizes):
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == n
    for pieces in by_sequence.values():
        at = 0
        for offset, n, window, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at == window <= 2048 and window & (window - 1) == 0


def test_steps_hold_one_window_length_and_equal_tokens():
    packer = Packer(0)
    for doc in range(3000):
        packer.add(doc, b"\0\0\0\0" * (1 + doc * 37 % 2500))
    packer.finish()
    tokens, windows = defaultdict(int), defaultdict(set)
    for r in packer.done:
        tokens[r[7]] += r[2]
        windows[r[7]].add(r[6])
    assert all(len(w) == 1 for w in windows.values())
    assert sum(t == 8 * 2048 for t in tokens.values()) >= len(tokens) - 12 and max(tokens.values()) == 8 * 2048


def test_query_rows(spark, docs):
    texts = ["", None, "one two", "one two", "word " * 9000, "x", None, "stop <|endoftext|>  here"]
    rows = piece_digests(pack(docs(*texts).selectExpr("*", "1 AS ids", "2 AS start"), WORDS)).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    for doc, text in enumerate(texts):
        ids = np.array([*whole(WORDS, text or ""), 1], "<u4")
        at = 0
        for r in sorted(found[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert pack(docs("a").limit(0), WORDS).count() == 0
