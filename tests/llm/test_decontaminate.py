import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.decontaminate import SeedIndex, drop_contaminated, tokens_of, with_overlaps

ITEM = " ".join(f"word{chr(97 + i)}" for i in range(25))


def brute(items, text, window=20, share=0.8):
    """Every alignment of every item."""
    found, words = set(), tokens_of(text)
    for item_id, item in items:
        want = tokens_of(item)
        width = min(window, len(want))
        least = width if width < 8 else share * width
        for d in range(-len(want), len(words)):
            equal = [0 <= d + i < len(words) and words[d + i] == w for i, w in enumerate(want)]
            inside = [i for i in range(len(want)) if 0 <= d + i < len(words)]
            if any(i in inside and i + width - 1 in inside and sum(equal[i : i + width]) >= least for i in range(len(want) - width + 1)):
                found.add((item_id, d + inside[0]))
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 24), max_size=3), min_size=1, max_size=3), st.integers(0, 6), st.integers(0, 6))
def test_substitutions_are_found_as_by_brute_force(changes, before, after):
    words = tokens_of(ITEM)
    parts = []
    for change in changes:
        parts += ["pad"] * before + ["other" if i in change else w for i, w in enumerate(words)] + ["tail"] * after
    text = " ".join(parts)
    items = [(1, ITEM), (2, "a much too short item"), (3, "wordb wordc wordd"), (4, "tail")]
    found = {(i, start) for i, start, _, _ in SeedIndex(items, 20, 0.8).overlaps(text)}
    assert found == brute(items, text)


def test_rows_without_leaks_stay_whole(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM + " x"), (3, "short"), (1, ITEM), (4, "..."), (5, "")], "item_id bigint, text string")
    made = docs("clean text", None, "", "Lead. " + ITEM.upper().replace(" ", ", "), ITEM[:80], "long " * 50000).selectExpr("*", "'o' AS overlaps", "'w' AS __x")
    kept = drop_contaminated(made, bench)
    assert kept.columns == made.columns and {r.overlaps for r in kept.collect()} == {"o"}
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4, 5]
    hit = next(r for r in with_overlaps(made, bench).collect() if r.doc_id == 3)
    assert [(x.item_id, x.start, x.length, x.equal) for x in hit.overlaps] == [(1, 1, 25, 25)] * 2
    assert with_overlaps(made, bench.limit(0)).where("size(overlaps) > 0").count() == 0
    assert drop_contaminated(made.limit(0), bench).count() == 0


def test_a_large_benchmark_takes_several_passes(spark, docs, monkeypatch):
    from tidemark.llm import decontaminate

    monkeypatch.setattr(decontaminate, "TOKENS_PER_PASS", 30)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(12))) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = with_overlaps(docs(*[t for _, t in items], "none of them"), bench).collect()
    assert {r.doc_id: [x.item_id for x in r.overlaps] for r in rows} == {**{k: [k] for k in range(6)}, 6: []}
    plan = with_overlaps(docs("x"), bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # passes follow each other
    assert [r.doc_id for r in drop_contaminated(docs(*[t for _, t in items], "none of them"), bench).collect()] == [6]


def test_no_vocabulary():
    assert SeedIndex([], 20, 0.8).overlaps("anything at all") == []
    assert np.array_equal(SeedIndex([(1, ITEM)], 20, 0.8).items[0][1], np.arange(1, 26))


def test_short_items_are_found_however_they_are_substituted():
    from itertools import combinations

    for n in range(1, 20):
        item = " ".join(ITEM.split()[:n])
        index, words = SeedIndex([(1, item)], 20, 0.8), item.split()
        allowed = n - next(k for k in range(n + 1) if k >= 0.8 * n) if n >= 8 else 0
        for out in combinations(range(n), allowed):
            text = "pad " + " ".join("other" if i in out else w for i, w in enumerate(words)) + " tail"
            assert {(i, start) for i, start, _, _ in index.overlaps(text)} == brute([(1, item)], text) != set(), (n, out)
