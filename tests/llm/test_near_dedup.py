import random
import re

import pytest

from tidemark.llm.near_dedup import connected_components, drop_near_copies, near_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Every pair of rows with ids, and union-find by smallest id."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


def corpus(seed, bases, copies, chain=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for _ in range(bases):
        base = [word() for _ in range(rng.randint(30, 250))]
        texts.append(base)
        for _ in range(rng.randint(0, copies)):
            made = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                made[rng.randrange(len(made))] = word()
            texts.append(made)
        for _ in range(chain):
            base = list(base)
            base[rng.randrange(len(base))] = word()
            base[rng.randrange(len(base))] = word()
            texts.append(base)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("texts", [corpus(1, 25, 8), corpus(2, 2, 40), corpus(3, 2, 0, 25)], ids=["groups", "large groups", "chains"])
def test_components_equal_brute_force(spark, docs, texts):
    rows = list(enumerate(texts))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs(*rows)).collect()}
    assert found == brute(rows)


def test_edges_of_the_contract(spark, docs):
    long = "w " * 3 + " ".join(f"x{i}" for i in range(30000))
    rows = [(5, "a b c"), (6, "A  b\tC"), (7, None), (8, ""), (9, " \n"), (10, "a b c d"), (11, "É b c"), (12, "é b c"), (13, long), (14, long + " end"), (5, "a b c"), (None, "a b c"), (16, "a b c")]
    made = docs(*rows).selectExpr("*", "1 AS label", "2 AS node", "3 AS digest")
    got = near_components(made).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (1, None))
    kept = drop_near_copies(made)
    assert kept.columns == made.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and want[i][1] == i)
    assert near_components(made.limit(0)).count() == drop_near_copies(made.limit(0)).count() == 0


def thue_morse(k):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))


def test_words_built_to_collide_are_told_apart(spark, docs):
    """Two words whose polynomial hashes modulo 2**64 agree, alone and within texts; sets of equal shingles in another order."""
    one, two = thue_morse(11), thue_morse(11).translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(12))
    again = "a b c d e f a b c d e f g"
    rows = list(enumerate([one, two, f"{one} {tail}", f"{two} {tail}", again, "a b c d e f a b c d e f a b c d e f g", f"{one}x" * 9, f"{one}x" * 9]))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs(*rows)).collect()}
    assert found == brute(rows) and found[1][1] == 1 and found[3][1] == 3 and found[5] == (found[5][0], 4) and found[7][1] == 6


def test_long_texts(spark, docs):
    rng = random.Random(8)
    text = " ".join(f"{rng.randrange(10**7)}" for _ in range(700_000))
    rows = [(1, text), (2, text + " end"), (3, "x" * 3_000_000), (4, "X" * 3_000_000 + " ")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs(*rows)).collect()}
    assert found == brute(rows)


def test_rows_with_one_id_share_their_links(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(90))
    rows = [(5, a), (5, b), (6, a), (7, b), (8, a + " x"), (9, b + " y")]
    assert {r.doc_id: r.component_id for r in near_components(docs(*rows)).collect()} == dict.fromkeys(range(5, 10), 5)


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == {x: find(x) for x in parent}
