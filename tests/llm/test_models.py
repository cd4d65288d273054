"""Line dedup, language identification, lattice scoring and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfloom.llm import langid, lattice, lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, n):
    chars = list(line)
    for _ in range(n):
        at = rng.randrange(len(chars))
        match rng.randrange(3):
            case 0:
                chars[at] = rng.choice("abcé ")
            case 1:
                chars.insert(at, rng.choice("abcé "))
            case _:
                del chars[at]
    return "".join(chars)


def test_banded_distance(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("a", ""), ("ab", "ba"), ("abc", ""), ("é𝄞x", "e𝄞x")]
    for _ in range(300):
        a = "".join(rng.choices("abcé", k=rng.choice([3, 8, 40])))
        pairs.append((a, edited(rng, a, rng.randrange(5))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for t in (1, 2, 3):
        got = {r.i: r.w for r in df.select("i", lines.within(F.col("a"), F.col("b"), t).alias("w")).collect()}
        assert got == {i: edits(a, b) <= t for i, (a, b) in enumerate(pairs)}


def test_line_dedup_against_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefgh é", k=rng.choice([26, 40, 90]))).strip() for _ in range(40)] + ["short", ""]
    docs = [(None, "x" * 30), (0, None), (1, ""), (2, " \n\t"), (2, " \n\t"), (90, "z" * 30_000), (91, "z" * 29_999)]
    for d in range(3, 80):
        own = [rng.choice(base) for _ in range(rng.randrange(1, 6))]
        docs.append((d, "\n".join(f" {edited(rng, x, rng.choice([0, 1, 2, 3])) if len(x) > 9 else x} " for x in own)))
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, line int")
    first, found = {}, set(docs)
    for d, t in sorted(found, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\r\x0b\f"):
                first.setdefault(x.strip(" \t\n\r\x0b\f"), (d, i))
    order = {x: k for k, x in enumerate(first)}
    near = {x for x in first for y in first if order[y] < order[x] and min(len(x), len(y)) >= 24 and abs(len(x) - len(y)) <= 2 and len(x) < 1000 and edits(x, y) <= 2}
    near |= {"z" * 29_999 if order["z" * 29_999] > order["z" * 30_000] else "z" * 30_000}
    want = {}
    for d, t in found:
        for i, x in enumerate((t or "").split("\n")):
            x = x.strip(" \t\n\r\x0b\f")
            if x and ((d, i) != first[x] or x in near):
                want[d, i] = "exact" if (d, i) != first[x] else "near"
    got = {(r.doc_id, r.line_no): r.why for r in lines.removals(df).collect()}
    assert got == want and {"exact", "near"} <= set(want.values())
    clean = {r.doc_id: r.text for r in lines.dedupe(df).collect()}
    for d, t in found:
        assert clean[d] == (t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want))
    per = {r.doc_id: (r.n_exact, r.n_near) for r in lines.counts(df, lines.removals(df)).collect()}
    assert {d: c for d, c in per.items() if any(c)} == {d: (sum(w == "exact" for (x, _), w in want.items() if x == d), sum(w == "near" for (x, _), w in want.items() if x == d)) for d in {x for x, _ in want}}
    assert lines.removals(df.limit(0)).collect() == []


def speech(rng, lang, n):
    parts = {"en": ["th", "er", "ing", "on", "the"], "de": ["sch", "ung", "ein", "der", "ö"], "fr": ["eau", "oi", "que", "le", "ç"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def test_language_mixtures(spark):
    rng = random.Random(6)
    rows = [(i, speech(rng, x, rng.choice([6, 40, 300])), x) for i in range(300) for x in [rng.choice(["en", "de", "fr"])]]
    rows += [(400, None, "en"), (401, "", None), (402, "12 34 !?", "de"), (403, speech(rng, "fr", 50), None), (404, speech(rng, "en", 300) + " " + speech(rng, "fr", 100), "en"), (405, speech(rng, "de", 30_000), "de"), (None, speech(rng, "de", 40), None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.train_and_predict(df).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (400, 401, 402))
    held = [(i, x) for i, _, x in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == x for i, x in held) >= 0.98 * len(held)
    assert got[403].lang_pred == "fr" and got[405].lang_pred == "de" and got[None].lang_pred == "de"
    assert got[404].lang_pred == "en" and got[404].n_languages == 2 and abs(got[404].score - 0.75) < 0.08
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = df.filter("doc_id = 400")
    assert [r.lang_pred for r in langid.train_and_predict(nothing).collect()] == ["und"]
    assert langid.train_and_predict(df.limit(0)).collect() == []


def test_language_sets_against_all_subsets(spark):
    """The chosen set's penalised likelihood is that of the best of all subsets, or within half a language's penalty of it."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    logp = np.log(rng.dirichlet(np.full(langid.BUCKETS, 0.05), 4).T + 1e-9).astype(np.float32)
    missed = 0
    for trial in range(30):
        mix = rng.dirichlet(np.full(4, 0.4))
        found = np.concatenate([rng.choice(langid.BUCKETS, int(400 * m), p=np.exp(logp[:, k].astype(float)) / np.exp(logp[:, k].astype(float)).sum()) for k, m in enumerate(mix)])
        k, share, mean, n = langid.infer(found, logp)
        cost = langid.PENALTY * np.log(len(found))
        counts = np.bincount(found, minlength=langid.BUCKETS)
        at = np.flatnonzero(counts)
        weight = counts[at].astype(np.float32)
        best = max(langid.mixture(logp[at][:, list(c)], weight, float(len(found)))[1] - cost * len(c) for r in range(1, 5) for c in itertools.combinations(range(4), r))
        missed += mean * len(found) - cost * n < best - 0.5 * cost
    assert missed <= 1


def test_many_languages_are_learnt(spark):
    rows = [(i * 10 + j, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in ("ona", "ter", "lis") * 8), f"l{i:02}") for i in range(70) for j in range(4)]
    got = langid.train_and_predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 10:02}" for r in got) >= 0.95 * len(got)


def brute_word(word, logp):
    s = lattice.START + word
    p = [1.0] + [0.0] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(j):
            if s[i:j] in logp:
                p[j] += p[i] * math.exp(logp[s[i:j]])
        if s[j - 1] not in logp:
            p[j] += p[j - 1] * math.exp(sum(logp[bytes([b])] for b in s[j - 1].encode()))
    return math.log(p[-1])


def test_lattice_sums_all_segmentations():
    pieces, logp = lattice.vocabulary()
    by = dict(zip(pieces, logp))
    own = lattice.Lattice(pieces, logp)
    words = ["the", "thering", "öß", "a", "日本語", "\U0001f600x", "zq#!", "internationalisation", "x" * 60]
    assert np.allclose(own.score(words), [brute_word(w, by) for w in words])
    weight = np.array([2.0, 1, 1, 5, 1, 1, 1, 3, 1])
    expected, h = own.expect(words, weight), 1e-5
    for piece in ("the", "▁", "er", "x", b"\xe6", "ation"):
        i = pieces.index(piece)
        more, less = logp.copy(), logp.copy()
        more[i] += h
        less[i] -= h
        slope = ((lattice.Lattice(pieces, more).score(words) - lattice.Lattice(pieces, less).score(words)) * weight).sum() / 2 / h
        assert expected[i] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_lm_scoring(spark):
    rng = random.Random(8)
    rows = [(i, speech(rng, "en", rng.choice([1, 30, 200]))) for i in range(120)] + [(200, None), (201, ""), (202, "THE The\tthe\n"), (203, "y" * 3000 + " é日\x85本"), (None, "lost"), (5, "again")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n long")
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lattice.score(df, block=2000).collect())

    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert got == Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    pieces, logp, end = lattice.fit(lattice.word_counts(df.withColumn("held_out", lattice.held_out(F.col("doc_id")))))
    assert np.exp(logp).sum() + math.exp(end) == pytest.approx(1)
    by = dict(zip(pieces, logp))
    for r in lattice.score(df.filter("doc_id in (1, 2, 3, 203)"), rounds=0).collect():
        assert r.score < 0
    whole = {r.doc_id: r.score for r in lattice.score(df).collect() if r.doc_id not in (5, None)}
    for i, t in rows:
        if i not in (5, 203, None):
            assert whole[i] == pytest.approx((sum(brute_word(w, by) for w in tokens(t)[:-1]) + end) / math.log(10), rel=1e-5)
    assert lattice.score(df.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = speech(rng, "en", 30)
    prose = [speech(rng, "en", 80) for _ in range(60)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    docs += [(100, prose[7], "en", "s1", 1), (101, "12 34", None, "s1", 5), (102, f"{speech(rng, 'en', 40)} {item} {speech(rng, 'en', 40)}", "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        assert k == 4 or out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in df.collect()})
    everything = {d[0] for d in docs}
    assert kept[0] == everything - {101} and kept[1] == kept[0] - {100} and kept[2] == kept[1] - {102}
    assert kept[3] <= kept[2] and kept[4] == kept[3] and {"shard", "slot"} <= set(df.columns)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == kept[4]


def test_lm_scoring_with_whole_words(spark):
    """A word's probability is its discounted count, and the freed mass times the sum over its segmentations; pieces learn from distinct words."""
    rng = random.Random(9)
    rows = [(i, speech(rng, "en", 40)) for i in range(80)] + [(200, None), (203, "unheard words"), (204, "unheard here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def tokens(t):
        return (t or "").lower().split() + [None]

    def held(i):
        return zlib.crc32(str(i).encode()) % 7 == 2

    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v, once, twice = sum(c.values()), len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    discount = once / (once + 2 * twice) if once else 0.5
    counts = lattice.word_counts(df.withColumn("held_out", lattice.held_out(F.col("doc_id"))))
    pieces, logp, end = lattice.fit(counts.withColumn("n", F.when(F.length("word") > 0, F.least("n", F.lit(1))).otherwise(F.col("n"))))
    by = dict(zip(pieces, logp))

    def p(w):
        return max(c[w] - discount, 0) / n + discount * v / n * math.exp(end if w is None else brute_word(w, by))

    for r in lattice.score(df, whole=True).collect():
        assert r.score == pytest.approx(sum(math.log10(p(w)) for w in tokens(dict(rows)[r.doc_id])), rel=1e-5)
    assert sum(p(w) for w in c) < 1
