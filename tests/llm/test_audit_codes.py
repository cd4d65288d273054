"""The filter audit and the vector codes against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from perfloom.llm import audit, codes
from perfloom.llm.common import match_counted, sum_arrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[s or ""].append((fails, i in good, i in toxic))
    out = set()
    for part, docs in parts.items():
        removed_of, rows_of = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                here = [d for d in left if d[0][f]]
                gone = [d for d in docs if any(d[0][g] for g in order[:k])]
                left = [d for d in left if not d[0][f]]
                removed_of[f] += len(here)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                rows_of.append((part, "".join(order), k + 1, len(left), len(here), sum(d[0][f] for d in gone), alone, sum(d[1] for d in here), sum(d[2] for d in here), f))
        out |= {(*r[:-1], removed_of[r[-1]]) for r in rows_of}
    return out


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD_PARTS", 2)
    monkeypatch.setattr(audit, "BLOCK", 7)
    rng = random.Random(3)
    texts = [None, "", "short", "A B C", "x " * 300, "# " + " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(220)), "Ünï\x85 " * 90, "$" * 5]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts) if rng.random() < 0.7 else " ".join(rng.choice(["a", "B", "c%", "é"]) + str(rng.randrange(400)) for _ in range(rng.choice([5, 210]))), rng.choice([None, "", "s1", "s2", "s3"])) for _ in range(300)]
    labels = [(rng.choice([None, *range(70)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, source string, key string, fails int")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in audit.audit(audit.flagged(docs, told)).collect()]
    assert len(got) == len({r[2] or "" for r in rows}) * 600 and set(got) == brute_audit(rows, labels)
    assert audit.audit(audit.flagged(docs.limit(0), told)).collect() == []
    assert len(audit.audit(audit.flagged(docs, told.limit(0))).collect()) == len(got)


def test_first_failures():
    steps = audit.first_failures()
    assert steps.shape == (32, 120) and (steps[0] == 5).all() and (steps[31] == 0).all()
    for mask in range(32):
        for o, order in enumerate(audit.orders()):
            assert steps[mask, o] == next((k for k, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)


def test_hot_keys_are_matched_by_broadcast(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(200)] + [("none", 1)], "key string, i int")
    found = rows.filter("key <> 'none'").groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "n * 2 AS twice")
    got = sorted((r.key, r.i, r.twice) for r in match_counted(rows, found, "key", least=100, share=3).collect())
    assert got == sorted([("hot", i, 1000) for i in range(500)] + [(f"k{i}", i, 2) for i in range(200)] + [("none", 1, None)], key=lambda x: (x[0], x[1]))


def test_sums_of_arrays(spark):
    rows = spark.createDataFrame([("a", [i, 0, 1]) for i in range(50)] + [("b", [5, 5, 0])], "g string, x array<bigint>").repartition(7)
    assert {(r.g, r.pos): r.n for r in sum_arrays(rows, ["g"], "x", fan=2).collect()} == {("a", 0): 1225, ("a", 2): 50, ("b", 0): 5, ("b", 1): 5}


def test_nearest_is_the_full_search():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k, d = rng.integers(1, 60), rng.integers(1, 70), rng.integers(1, 7)
        width = rng.choice([2, 5, 300])
        x, book = rng.integers(-width, width, (n, d)), rng.integers(-width, width, (k, d))
        full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        j, e = codes.nearest(x, book)
        assert (j == full.argmin(axis=1)).all() and (e == full.min(axis=1)).all()
    j, e = codes.nearest(np.full((3, 2), codes.LIMIT), np.array([[-codes.LIMIT] * 2, [codes.LIMIT, 0]]))
    assert (j == 1).all() and (e == codes.LIMIT**2).all()


def brute_codes(rows, parts, entries, rounds):
    kept = sorted(((i if i is not None else math.inf, v, lab, i) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)), key=lambda r: r[:2])
    width = max(len(v) for _, v, _, _ in kept)
    step = max(1, -(-width // parts))
    xs = [[max(-codes.LIMIT, min(codes.LIMIT, math.floor(256 * c))) for c in [*v, *[0] * (parts * step - len(v))]] for _, v, _, _ in kept]
    cut = [[x[p * step : (p + 1) * step] for p in range(parts)] for x in xs]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g[p][1] == j]
                if own:
                    books[p][j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(e for e, _ in g) for g in assign()]
    by_label = defaultdict(int)
    for (_, _, lab, _), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    return sorted((str(i), "".join(f"{j:02x}" for _, j in g), e, by_label[lab], digest) for (_, _, lab, i), g, e in zip(kept, assign(), errors, strict=True))


def test_compress(spark):
    rng = random.Random(4)

    def vector(n=8):
        return [rng.choice([rng.gauss(0, 1), 0.5, -0.25, 3e30, -1e-9]) if rng.random() < 0.2 else rng.gauss(0, 0.2) for _ in range(n)]

    rows = [(i, vector(), rng.choice([None, 1, 2, 3])) for i in range(90)]
    rows += [(5, vector(), 1), (None, vector(), None), (7, rows[7][1], 2), (91, None, 1), (92, [1.0, None] * 4, 1), (93, [math.nan] * 8, 1), (94, [math.inf] * 8, 1), (95, vector(5), 1), (96, vector(9), None), (97, [], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    for parts, entries in ((4, 16), (3, 200)):
        got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df, parts, entries).collect())
        assert got == brute_codes(rows, parts, entries, 2)
    assert codes.compress(df.limit(0)).collect() == [] and codes.compress(df.filter("vec_id = 91")).collect() == []
    assert codes.compress(df.filter("vec_id = 3"), 4, 16).count() == 1
