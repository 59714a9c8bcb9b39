import hashlib
import re

from tidemark.llm.secrets_scan import scan_secrets, secret_digests

KEY = "AKIA" + "ABCDEFGH12345678"
LIVE = "Zx9Qw3Er7Ty1Ui5Op2As4Df6"


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|passwd|secret|[Tt][Oo][Kk][Ee][Nn]|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)]


def test_spans(spark, docs):
    texts = [
        f"é token = '{'a1' * 13}' {KEY}x", "Password: hunter22, secret=abc", None, "", KEY, f"live {LIVE} here", f"copied {LIVE[::-1]}", f"copied {LIVE[::-1]}",
        "deadbeef" * 3 + " " + "deadbeef" * 2, "toKen:" + "x" * 50000, f"{KEY} {KEY}",
    ]
    rows = {r.doc_id: r for r in secret_digests(scan_secrets(docs(*texts).selectExpr("*", "1 AS uid", "2 AS value", "3 AS owner"))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in rows[i].spans.split(",") if s and not s.startswith("owned")] == want
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
    assert rows[5].spans == "owned:5:29" and rows[6].spans == rows[7].spans == ""  # two owners hold the second
    assert rows[4].n_live == 0 and rows[8].n_live == 1


def test_frequency_by_owner(spark, docs):
    made = docs(*[(i, f"secret: sample{i % 2}value", f"owner{i % 6}" if i % 2 else "one") for i in range(24)])
    found = {r.doc_id: r.spans for r in scan_secrets(made).collect()}
    assert {(x.owners, x.repositories, x.occurrences, x.verdict) for i in range(0, 24, 2) for x in found[i]} == {(1, 1, 12, "live")}
    assert {(x.owners, x.repositories, x.occurrences, x.verdict) for i in range(1, 24, 2) for x in found[i]} == {(3, 3, 12, "example")}


def test_empty_and_repeated_rows(spark, docs):
    assert scan_secrets(docs("a").limit(0)).count() == 0
    rows = scan_secrets(docs((None, "token=abcdef1"), (1, "token=abcdef1"), (1, "token=abcdef1"))).collect()
    assert len(rows) == 3 and all(len(r.spans) == 1 for r in rows)
