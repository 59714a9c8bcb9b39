import random

from tidemark.llm.line_dedup import drop_lines, template


def sentence(rng, n=14):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_recurring_templates_go_and_the_rest_stays(spark, docs):
    rng = random.Random(1)
    own = [sentence(rng) for _ in range(60)]
    rows = []
    for i in range(20):  # one line that recurs as it is, one whose fields vary, one that varies in its second half
        half = f"please find the terms of use at this place for reader {sentence(rng, 4)}"
        rows.append((i, "\n".join([own[i], "all rights are reserved here", f"viewed {i} times on 2024-01-{i + 1:02d}", half, own[i + 20]])))
    rows += [(100 + i, own[45] + "\n" + own[46]) for i in range(30)]  # copies keep their lines
    rows += [(200, None), (201, ""), (202, "of"), (203, "all rights are reserved here"), (204, "\n\n")]
    made = docs(*rows).selectExpr("*", "7 AS n_dropped", "'k' AS lines", "'k' AS key")
    found = {r.doc_id: r for r in drop_lines(made).collect()}
    assert len(found) == len(rows)
    for i in range(20):
        assert found[i].text == own[i] + "\n" + own[i + 20] and found[i].n_dropped == 3 and found[i].key == "k"
    for i in range(30):
        assert found[100 + i].text == own[45] + "\n" + own[46] and found[100 + i].n_dropped == 0
    assert [found[k].text for k in (200, 201, 202, 203, 204)] == [None, "", "of", "", "\n\n"]
    assert drop_lines(made.limit(0)).count() == 0


def test_counts_equal_those_of_a_brute_force_version(spark, docs):
    rng = random.Random(5)
    pool = [sentence(rng, 5) for _ in range(12)]
    rows = [(i, "\n".join([sentence(rng, 30), *rng.sample(pool, rng.randint(0, 4))])) for i in range(80)]
    count = {p: sum(p in t.split("\n") for _, t in rows) for p in pool}
    found = {r.doc_id: r.text for r in drop_lines(docs(*rows)).collect()}
    for i, t in rows:
        assert found[i] == "\n".join(x for x in t.split("\n") if count.get(x, 0) < 10)


def test_template():
    assert template("a  b12 c\t7") == ["a", "<*>", "c", "<*>"]


def test_edited_copies_neither_save_a_line_nor_make_it_recur(spark, docs):
    rng = random.Random(9)
    common, lines = "please read all of our terms first", [sentence(rng, 12) for _ in range(12)]
    rows = [(i, sentence(rng, 60) + "\n" + common) for i in range(12)]
    for i in range(60):  # one text with many edited copies
        copy = [x.split() for x in lines]
        for _ in range(4):
            copy[rng.randrange(12)][rng.randrange(12)] = sentence(rng, 1)
        rows.append((100 + i, "\n".join([*map(" ".join, copy), common])))
    found = {r.doc_id: r.text for r in drop_lines(docs(*rows)).collect()}
    for i, t in rows:
        assert found[i] == t.removesuffix("\n" + common)


def test_a_long_passage_does_not_relate_its_holders(spark, docs):
    rng = random.Random(11)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, own) + "\n" + passage) for i, own in enumerate([3, 4, 12, 16, 24, 40] * 4)]
    found = {r.doc_id: r.text for r in drop_lines(docs(*rows)).collect()}
    assert all(found[i] == t.split("\n")[0] for i, t in rows)


def test_long_lines_recur_in_two_unrelated_texts(spark, docs):
    rng = random.Random(13)
    long, short = sentence(rng, 24), sentence(rng, 8)
    body = [sentence(rng, 12) for _ in range(10)]
    rows = [(i, sentence(rng, 15) + "\n" + short + "\n" + long) for i in range(2)]
    rows += [(10 + i, "\n".join([*body, sentence(rng, 3), sentence(random.Random(1), 30)])) for i in range(9)]
    found = {r.doc_id: r.text for r in drop_lines(docs(*rows)).collect()}
    assert all(found[i] == t.removesuffix("\n" + long) for i, t in rows)


def test_templates_with_words_as_fields_are_merged(spark, docs):
    rng = random.Random(17)
    word = lambda: sentence(rng, 1)
    own, rows = [sentence(rng, 9) for _ in range(12)], []
    for i in range(12):
        long = f"this page was last seen by {word()} who came here from the {word()} list"
        rows.append((i, "\n".join([own[i], f"Posted by {word() if i % 3 else i} in {word()}", long, f"key {'abcdefab'[i % 8 :] * 9} of it"])))
    rows += [(100 + i, f"Posted {word()} {word()} {word()} {word()}") for i in range(12)]  # these agree in too little
    found = {r.doc_id: r.text for r in drop_lines(docs(*rows)).collect()}
    assert [found[i] for i in range(12)] == own
    assert all(found[i] == t for i, t in rows[12:])
    assert template("key deadbeef DEADBEEF facade") == ["key", "<*>", "<*>", "facade"]
