"""Call trees of a budget against a plain walk, and how much of the graph is fetched for them."""

import random

from perfloom.operators import trees


def walked(root, below, depth, budget):
    out, met = [], set()

    def visit(node, level, above):
        seq, again = len(out), node in met
        met.add(node)
        out.append([root, seq, above, node, level, "cycle" if again else "max-depth" if level >= depth else None])
        for child in () if again or level >= depth else sorted(below.get(node, ())):
            if len(out) >= budget:
                out[seq][5] = "node-budget"
                return
            visit(child, level + 1, seq)

    visit(root, 0, -1)
    return [tuple(x) for x in out]


def test_budget_bounds_what_is_fetched(spark, monkeypatch):
    rng = random.Random(4)
    edges = {(f"a{i:02}", f"a{rng.randrange(30):02}") for i in range(30) for _ in range(rng.randrange(4))}
    edges |= {("wide", f"x{i:03}") for i in range(200)} | {("some", f"x{i:03}") for i in range(20)} | {("exact", f"x{i:03}") for i in range(19)} | {("both", f"x{i:03}") for i in range(11)} | {("both", "y"), ("x004", "wide"), ("y", "z")}
    below = {}
    for a, b in edges:
        below.setdefault(a, []).append(b)
    roots = ["wide", "some", "exact", "both", "none", *(f"a{i:02}" for i in range(0, 30, 3))]
    pairs, reach = [], trees.reach

    def counted(*args):
        out = reach(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(trees, "reach", counted)
    at = spark.createDataFrame([(r,) for r in roots], "id string")
    table = spark.createDataFrame([(a, b, 0) for a, b in edges], "src string, dst string, ord int")
    symbols = spark.createDataFrame([], "id string, name string")
    got = sorted(tuple(r) for r in trees.expand(at, symbols, table, depth=3, budget=20).collect())
    assert got == sorted(x for r in roots for x in walked(r, below, 3, 20))
    assert max(pairs) <= len(roots) * 31
    whole = sorted(tuple(r) for r in trees.expand(at, symbols, table, depth=3).collect())
    assert whole == sorted(x for r in roots for x in walked(r, below, 3, 1 << 30))
