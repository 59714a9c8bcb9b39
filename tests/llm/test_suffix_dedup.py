import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.suffix_dedup import LENGTH, SuffixOrder, remove_repeats


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - LENGTH + 1):
            if count[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        yield len(r), bytes(np.frombuffer(r, np.uint8)[~gone]), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())


def check(docs, texts, **limits):
    found = {r.doc_id: r for r in remove_repeats(docs(*texts).selectExpr("*", "1 AS h1", "2 AS k"), **limits).collect()}
    assert len(found) == len(texts)
    for i, (n, kept, spans) in enumerate(brute(texts)):
        assert (found[i].n_bytes, bytes(found[i].kept), len(found[i].spans)) == (n, kept, spans), i


def mixed_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (30, 45, 60, 90, 200)]
    texts = []
    for _ in range(60):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p) + 1)))
            parts += [rng.choice((p, p[a:b])), text(rng.randint(0, 20))]
        texts.append("".join(parts))
    return texts + texts[:3] + ["a" * 900, "ab" * 400, "a" * 199, "a" * 200, "", None, text(4000), "é" * 150]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, docs, seed):
    check(docs, mixed_corpus(seed))


def test_common_anchors_are_spread_and_groups_cut(spark, docs):
    check(docs, mixed_corpus(4), group=2, sort_bytes=500)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abc", k=n))
    line = word(150)  # a passage shorter than a string, in texts that differ, that agree before or behind it, and that repeat it whole
    texts = [word(rng.choice((60, 120))) + line + word(90) for _ in range(30)]
    texts += [texts[0][:210] + word(60), word(30) + texts[1][40:], word(10) + texts[2] + word(8), texts[3]]
    check(docs, texts, group=2)
    check(docs, texts, group=9, sort_bytes=100)


def test_long_texts_are_searched_in_windows(spark, docs, monkeypatch):
    from tidemark.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "FIND_BYTES", 700)
    rng = random.Random(5)
    long = "".join(rng.choices("abcd ", k=9000))
    texts = [long, long[1234:1900] + "x" + long[3000:3300], long[:5000] + "y" + long[5000:], "z" * 5000]
    raws = [t.encode() for t in texts]
    for data in raws:
        whole = suffix_dedup.anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        seen = {(lo + j): p for lo, hi, p in zip(*(x.tolist() for x in whole[:3]), strict=True) for j in range(hi - lo + 1)}
        got = {}
        for shift, part, offsets in suffix_dedup._windows(np.frombuffer(data, np.uint8), np.array([0, len(data)])):
            for lo, hi, p in zip(*(x.tolist() for x in suffix_dedup.anchors(part, offsets)[:3]), strict=True):
                for j in range(hi - lo + 1):
                    assert shift + lo + j not in got
                    got[shift + lo + j] = shift + p
        assert got == seen
    check(docs, texts)


def test_suffixes_built_to_collide_are_sorted_by_their_bytes():
    """Two strings whose polynomial hashes modulo 2**64 agree."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048)).encode()
    two = one.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(one + b"x" + two + b"x", np.uint8)
    groups = np.zeros(2, np.int64)
    order = SuffixOrder(data, np.array([0, 2049]), np.array([2049, 4098]), groups)
    assert order.common(np.array([0]), np.array([1]))[0] > 0 and order.neighbours(groups).tolist() == [0]
    assert order.order.tolist() == [0, 1]


def test_few_rows(spark, docs):
    assert remove_repeats(docs("a").limit(0)).count() == 0
    check(docs, ["x y " * 49])
    check(docs, [None])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=12), st.data())
def test_suffix_order_is_that_of_the_bytes(bodies, data):
    groups = np.sort(np.array([data.draw(st.integers(0, 3)) for _ in bodies]))
    raws = [b.encode() for b in bodies]
    ends = np.cumsum([len(r) for r in raws])
    starts = ends - [len(r) for r in raws]
    order = SuffixOrder(np.frombuffer(b"".join(raws), np.uint8), starts, ends, groups)
    assert [raws[i] for i in order.order] == [r for g in range(4) for r in sorted(r for r, h in zip(raws, groups, strict=True) if h == g)]
    common = order.neighbours(groups)

    def lcp(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for i, (a, b) in enumerate(zip(order.order, order.order[1:])):
        assert common[i] == (lcp(raws[a], raws[b]) if groups[a] == groups[b] else -1)
