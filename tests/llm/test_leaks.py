"""Secret scans: automata against `re`, spans of a table with odd rows."""

import hashlib
import random
import re

import pytest

from perfloom.llm import automaton, leaks

PIECES = ["token", "Secret", "api_key", "PASSWORD", "passwd", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef" * 4, "ABCDEFGH12", "é", "日", "\n", "x", ".", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "aZ9" * 13, "xoxb-", "eyJ", "bearer ", "://u:pw@h", "sk_live_", "AIza", "token=secret: abcdefgh12", "token=password=abcdefgh", ",", "@", "-", "_"]


def brute(text, rules=leaks.RULES):
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?P<head>{r.head})(?P<value>(?:{r.value})+)", text, re.ASCII | (re.IGNORECASE if r.fold else 0)):
            if len(m["value"]) >= r.least:
                found.append((m.start(), m.end(), k))
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_scan_finds_what_re_finds():
    rng, c, n = random.Random(5), leaks.compiled(), 0
    for _ in range(600):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 3, 10, 40, 200]))) for _ in range(rng.choice([1, 6]))]
        for t, spans in zip(texts, leaks.scan(c, [t.encode() for t in texts]), strict=True):
            want = brute(t)
            assert leaks.in_characters(t.encode(), spans) == want, t
            n += len(want)
    assert n > 3000


@pytest.mark.parametrize("pattern", ["a(b|cd)*e?", "x{2,4}y", "[^a-c]z+", "(ab|a)(c|bcd)", "a{3}", "(a|b)?c", "[a-c-]{2,}", r"\.\x2a|é"])
def test_automaton_accepts_what_re_accepts(pattern):
    rng, a = random.Random(6), automaton.build([automaton.parse(pattern)])
    by_re = re.compile(pattern.encode("utf-8"), re.DOTALL)
    for _ in range(3000):
        text = "".join(rng.choice("abcdexyz-.*é") for _ in range(rng.randrange(7))).encode()
        state = a.start
        for b in text:
            state = a.move[state * a.n_classes + a.of_byte[b]]
        assert (state >= a.first_accept) == bool(text and by_re.fullmatch(text)), text


def test_automaton_is_minimal():
    """No two states accept the same continuations: refinement by pairs, written on its own."""
    a = leaks.compiled(leaks.BASE).each[0]
    n = len(a.accepts)
    apart = {(p, q) for p in range(n) for q in range(n) if a.accepts[p] != a.accepts[q]}
    grown = True
    while grown:
        more = {(p, q) for p in range(n) for q in range(n) if (p, q) not in apart and any((a.move[p * a.n_classes + k], a.move[q * a.n_classes + k]) in apart for k in range(a.n_classes))}
        grown = bool(more)
        apart |= more
    assert len(apart) == n * (n - 1)


def test_bad_rules():
    for pattern in ("(a", "a)", "[z-a]", "*a"):
        with pytest.raises(ValueError):
            automaton.parse(pattern)
    with pytest.raises(ValueError):
        automaton.build([automaton.parse("a*")])
    with pytest.raises(ValueError):
        leaks.compiled((leaks.Rule("lines", "a\n", "b", 1),))


def test_long_texts_and_lanes():
    c = leaks.compiled()
    text = "f" * 300_000 + " token = '" + "Ab1" * 50_000 + "'" + "é, " * 40_000 + "AKIA" + "Z" * 12
    assert leaks.in_characters(text.encode(), leaks.scan(c, [b"", text.encode(), b"token"])[1]) == brute(text)


def test_find_over_rows(spark):
    rng = random.Random(7)
    rows = [(1, None), (2, ""), (None, "token: 'abcdefgh'"), (3, "AKIA" + "A" * 11), (3, "AKIA" + "A" * 12), (4, "é" * 5 + " password=12345678 " + "a" * 32)]
    rows += [(10 + i, "".join(rng.choice(PIECES) for _ in range(60))) for i in range(40)] * 2
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, found string")
    names = [r.kind for r in leaks.RULES]
    want = sorted((i or -1, [(names[k], b, e) for b, e, k in brute(t or "")]) for i, t in rows)
    assert sorted((r.doc_id or -1, [tuple(s) for s in r.found]) for r in leaks.find(df).collect()) == want
    assert leaks.find(df.limit(0)).collect() == []


def test_op13_columns(spark, tmp_path):
    text = "é token = \"abcdef12\" AKIAABCDEFGHIJKL ghp_" + "a1" * 18
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in leaks.op13_secret_scans(spark, str(tmp_path)).collect()}
    base, more = "assign:2:19,access:21:37", "hex"
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1 if more in got[1].spans else 0)
    base = ",".join(x for x in got[1].spans.split(",") if x.split(":")[0] in ("assign", "access", "hex"))
    assert got[1].spans.startswith("assign:2:19,access:21:37") and "code_host:38:78" in got[1].spans
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
