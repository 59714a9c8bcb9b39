import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.hashing import prefix_hashes, shingles, substring_hashes, text_chunks, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.text(alphabet="aAbÉé \n\t\x0b\x1c.", max_size=30), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([1, 10, 1000]))
def test_words_and_shingles_equal_those_of_a_pattern(texts, limit):
    seen, rows = {}, 0
    for first, last, data, offsets in text_chunks(pa.array(texts, pa.string()), limit):
        assert first == rows
        rows = last
        hashes, owner, bounds = words(data, offsets)
        made, begins = shingles(hashes, bounds)
        for i, text in enumerate(texts[first:last]):
            want = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
            got = hashes[bounds[i] : bounds[i + 1]].tolist()
            assert len(got) == len(want) and (owner[bounds[i] : bounds[i + 1]] == i).all()
            for w, h in zip(want, got, strict=True):
                assert seen.setdefault(w, h) == h
            runs = [tuple(want[j : j + 5]) for j in range(len(want) - 4)] if len(want) >= 5 else [tuple(want)] if want else []
            ours = made[begins[i] : begins[i + 1]].tolist()
            assert len(ours) == len(runs)
            for r, h in zip(runs, ours, strict=True):
                assert seen.setdefault(r, h) == h
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def test_substrings_have_one_hash_wherever_they_stand():
    data = np.frombuffer(b"abcabcabxabc", np.uint8)
    p = prefix_hashes(data)
    h = substring_hashes(p, np.array([0, 3, 9, 6]), np.array([3, 6, 12, 9]))
    assert h[0] == h[1] == h[2] != h[3]
