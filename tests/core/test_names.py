"""Similar names against brute force over all pairs."""

import random
import time
from itertools import combinations

from perfloom.operators import changes, names as N


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_that_differ_at_the_start_or_by_five_edits(spark):
    rng = random.Random(6)
    names = {"", "ab", "b" * 9, "c" + "b" * 9}
    for k in (9, 18, 19, 30, 47, 60):
        base = "".join(rng.choices("abcdef ", k=k))
        for n in (0, 1, 1, 2, 3, 4, 5, 6):
            c = list(base)
            for _ in range(n):
                at = rng.choice([0, 1, 2, rng.randrange(len(c))])
                c[at : at + rng.randrange(2)] = rng.choice(["x", "y", ""])
            names.add("".join(c))
    want = {(a, b) for a, b in combinations(sorted(names), 2) if 1000 * edits(a, b) <= 55 * (len(a) + len(b))}
    got = {(r.a, r.b) for r in N.near_names(spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    assert got == want and any(a[:5] != b[:5] for a, b in want) and any(edits(a, b) > 4 for a, b in want)


def test_long_names_and_their_plan(spark):
    """Names of some hundred characters, with edits anywhere, all lengths together; the plan does not grow with them."""
    rng = random.Random(7)
    names = set()
    for k in (55, 64, 75, 120, 121, 260):
        base = "".join(rng.choices("abcdefghij ", k=k))
        for n in (0, 1, k // 40, k // 20, k // 18, k // 16, k // 12):
            for _ in range(2):
                c = list(base)
                for _ in range(n):
                    at = rng.randrange(len(c))
                    c[at : at + rng.randrange(2)] = rng.choice(["x", "y", ""])
                names.add("".join(c))
    want = {(a, b) for a, b in combinations(sorted(names), 2) if 1000 * edits(a, b) <= 55 * (len(a) + len(b))}
    df = spark.createDataFrame([(x,) for x in names] + [(None,)], "name string")
    got = {(r.a, r.b) for r in N.near_names(df).collect()}
    assert got == want and any(edits(a, b) > N.FEW for a, b in want)
    huge = spark.createDataFrame([("z" * 4000 + "".join(rng.choices("abc", k=6000)),), ("short name here",)], "name string")
    began = time.time()
    N.near_names(huge)._jdf.queryExecution().executedPlan()
    assert time.time() - began < 20 and N.near_names(huge).collect() == []


def test_overlap_of_running_shingles(spark):
    rng = random.Random(8)
    texts = [(g, i, " ".join(rng.choices("abc", k=rng.randrange(6)))) for g in ("g1", "g2", "g3") for i in range(5)] + [("g4", 0, "a")]
    tokens = [(g, i, k, t) for g, i, x in texts for k, t in enumerate(x.split())]
    joined = {g: [t for h, i, k, t in sorted(tokens) if h == g] for g in ("g1", "g2", "g3", "g4")}
    sets = {g: {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} for g, w in joined.items()}
    pairs = [("g1", "g2"), ("g2", "g3"), ("g3", "g4"), ("g4", "g5")]
    df = spark.createDataFrame(tokens, "g string, i int, k int, token string")
    got = {(r.a, r.b): r.jaccard for r in changes.shingle_overlap(changes.running_shingles(df, ["i", "k"]), spark.createDataFrame(pairs, "a string, b string")).collect()}
    for a, b in pairs:
        x, y = sets.get(a, set()), sets.get(b, set())
        assert abs(got[a, b] - (len(x & y) / len(x | y) if x | y else 0)) < 1e-12


def test_missing_in_blocks(spark):
    rng = random.Random(9)
    rows = {(f"g{rng.randrange(6)}", rng.randrange(40)) for _ in range(90)}
    df = spark.createDataFrame([*rows, ("g1", None), (None, 3)], "g string, i int")
    want = {(g, i) for g in {g for g, _ in rows} for i in {i for _, i in rows}} - rows
    assert {(r.g, r.i) for r in changes.missing(df, "g", "i", block=7).collect()} == want
