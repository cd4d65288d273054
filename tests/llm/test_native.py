"""URL filters, decontamination and chat formatting on small tables."""

import itertools
import random
import re
from collections import Counter

import pytest

from perfloom.llm import chat, decontaminate, urls


def test_url_parts_and_fixed_rules(spark):
    cases = [
        (1, "http://Example.COM/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"),
        (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "https://a.www.example.com/En/", "a.www.example.com", "/En/", "com/", "allow"),
        (4, "x://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"),
        (5, "x://net/es/", "net", "/es/", "net/es/", "block"),
        (6, "x://bnet/es", "bnet", "/es", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "a://b.com", "b.com", "", None, "allow"),
        (10, "a://ÉX.org://x/\ny#z", "Éx.org:", "//x/\ny", None, "allow"),
        (10, "a://ÉX.org://x/\ny#z", "Éx.org:", "//x/\ny", None, "allow"),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "h") for c in cases], "page_id long, url string, host string")
    none = urls.mine(spark.createDataFrame([], "tokens array<string>, bad boolean"))
    got = Counter(tuple(r)[:5] for r in urls.judge(pages, none).collect())
    assert got == Counter(cases and [tuple(c[0:1]) + c[2:] for c in cases])
    assert urls.judge(pages.limit(0), none).collect() == []


def test_mined_rules_against_counting(spark):
    rng = random.Random(4)
    names = [f"t{i}" for i in range(7)]
    rows = []
    for _ in range(400):
        own = [t for t in names if rng.random() < 0.4]
        rows.append((own, rng.random() < (0.9 if {"t1", "t2"} <= set(own) else 0.8 if "t5" in own else 0.2)))
    got = {tuple(r.tokens): (r.n, r.confidence) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6, 5).collect()}
    want = {}
    for k in range(1, 8):
        for c in itertools.combinations(names, k):
            hit = [b for t, b in rows if set(c) <= set(t)]
            if sum(hit) >= 0.02 * len(rows) and sum(hit) >= 5 and sum(hit) / len(hit) >= 0.6:
                want[c] = (sum(hit), sum(hit) / len(hit))
    kept = {c: v for c, v in want.items() if not any(d in want and want[d][1] >= v[1] for d in itertools.combinations(c, len(c) - 1) if d)}
    assert got == kept and got
    pages = spark.createDataFrame([(1, "http://free-bets.org/x"), (2, "http://good.org/x")], "page_id long, url string")
    rules = spark.createDataFrame([("part:bets+host:org", ["part:bets", "host:org"], 0.9, 9)], "name string, tokens array<string>, confidence double, n long")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_tokens_of_one_template(spark):
    """Forty tokens that always stand together are one item; any of them meets the rule, with another class's token."""
    rng = random.Random(8)
    template, rows = [f"t{i:02}" for i in range(40)], []
    for i in range(300):
        own = (template if i % 3 == 0 else []) + (["x"] if rng.random() < 0.5 else [])
        rows.append((own, i % 3 == 0 and "x" in own))
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6, 5).collect()
    assert [(sorted(r.tokens), sorted(map(len, r.classes)), r.confidence) for r in got] == [(["t00", "x"], [1, 40], 1.0)]
    classes = [["path:a", "path:b", "path:c"], ["host:org"]]
    rules = spark.createDataFrame([("r", ["path:a", "host:org"], classes, 0.9, 9)], urls.RULES)
    pages = spark.createDataFrame([(1, "http://x.org/c"), (2, "http://x.org/d"), (3, "http://x.net/a"), (None, "http://org/b"), (4, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "allow", None: "block", 4: "allow"}


def brute_leaks(docs, items, t=0.8):
    def toks(x):
        return re.findall(r"[^\W_]+", (x or "").lower())

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()

    classes = {}
    for i, x in items:
        if toks(x):
            classes.setdefault(tuple(toks(x)), []).append(i)
    out = Counter()
    for d, x in docs:
        for w, ids in classes.items():
            k = min(5, len(w))
            own = grams(w, k)
            n = len(own & grams(toks(x), k))
            if n >= -(-4 * len(own) // 5):
                out[d, min(ids), len(own), n] += 1
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 20, 40, 70])))) for i in range(40)]
    items += [(99, items[7][1].upper()), (100, None), (101, "?!"), (102, "a a a a a a a a")]
    docs = [(0, None), (1, ""), (2, "..."), (None, items[5][1]), (3, items[4][1]), (3, items[4][1]), (4, "a " * 5000)]
    for d in range(5, 120):
        w = rng.choices(vocabulary, k=rng.choice([4, 60, 3000]))
        for _ in range(rng.choice([0, 1, 3])):
            x = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                x[rng.randrange(len(x))] = "odd"
            at = rng.randrange(len(w))
            w[at:at] = [", ".join(x)] if rng.random() < 0.3 else x
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, h int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contaminated(df, bench).collect())
    assert got == brute_leaks(docs, items) and len(got) > 30
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(df.limit(0), bench).collect() == []


def test_sketches_miss_nothing():
    for n in range(1, 400):
        upper = 2 ** (n.bit_length()) - 1
        may_miss = n - -(-4 * n // 5)
        assert decontaminate.sketch_size(upper) > may_miss


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello <|im_end|>"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "x"), (3, 1, " ", "y"), (None, 0, "z", "w")]
    rows += [(4, i, f"p{i % 3}", f"t{i}") for i in range(600)]
    got = chat.render(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, speaker int")).collect()
    by = {(r.conv_id, r.speaker, r.segment): r for r in got}
    a, b = by[1, "ann", 0], by[1, "bob", 0]
    assert a.text == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nHello <\u200b|im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [a.text[s.start : s.end] for s in a.mask] == ["Hi<|im_end|>", "<|im_end|>"]
    assert [b.text[s.start : s.end] for s in b.mask] == ["Hello <\u200b|im_end|><|im_end|>"]
    assert by[2, None, 0].mask == [] and by[None, "z", 0].n_turns == 1
    assert {k for k in by if k[0] == 3} == {(3, "unknown", None), (3, "unknown", 0)}
    for p in ("p0", "p1", "p2"):
        own = sorted((r for r in got if r.conv_id == 4 and r.speaker == p), key=lambda r: r.segment)
        assert [r.segment for r in own] == [0, 1, 2] and sum(r.n_turns for r in own) == 600
        at = 0
        for r in own:
            assert r.offset == at
            at += len(r.text)
        assert [r.text[s.start : s.end] for r in own for s in r.mask] == [f"t{i}<|im_end|>" for i in range(600) if f"p{i % 3}" == p]
    assert len(got) == 2 + 1 + 2 + 1 + 9


@pytest.mark.parametrize("f,ddl", [(chat.render, "conv_id long, turn long, role string, text string")])
def test_empty_tables(spark, f, ddl):
    assert f(spark.createDataFrame([], ddl)).collect() == []
