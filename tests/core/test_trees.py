"""Call trees against a recursive walk; components, covers and distances against brute force."""

import random

from perfloom.operators import graph as G
from perfloom.operators import trees as T


def walk(below, root, depth, budget):
    out, met = [], set()

    def visit(node, level, parent):
        again, seq = node in met, len(out)
        met.add(node)
        out.append([seq, parent, node, level, None])
        if again or level >= depth:
            out[seq][4] = "cycle" if again else "max-depth"
            return
        for child in below.get(node, []):
            if len(out) >= budget:
                out[seq][4] = "node-budget"
                break
            visit(child, level + 1, seq)

    visit(root, 0, -1)
    return [tuple(x) for x in out]


def test_trees_follow_the_walk(spark):
    rng = random.Random(4)
    nodes = [f"n{i:02}" for i in range(25)]
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)}
    pairs = [(a, b, rng.randrange(3)) for a, b in pairs if a != b]
    below = {}
    for a, b, o in sorted(pairs, key=lambda e: (e[0], e[2], e[1])):
        below.setdefault(a, []).append(b)
    edges = spark.createDataFrame(pairs, "src string, dst string, ord int")
    symbols = spark.createDataFrame([(n, n) for n in nodes], "id string, name string")
    roots = spark.createDataFrame([(n,) for n in nodes[:6]], "id string")
    for depth, budget in ((12, 1 << 30), (3, 1 << 30), (12, 9), (1, 2)):
        tree = T.expand(roots, symbols, edges, depth, budget)
        got = {}
        for r in sorted(tree.collect(), key=lambda r: r.seq):
            got.setdefault(r.root, []).append((r.seq, r.parent, r.id, r.depth, r.truncated))
        assert got == {n: walk(below, n, depth, budget) for n in nodes[:6]}
    tree = T.expand(roots, symbols, edges)
    sizes = {(r.root, r.seq): r.subtree_size for r in T.subtree(T.paths(tree)).collect()}
    assert all(sizes[n, 0] == len(walk(below, n, 12, 1 << 30)) for n in nodes[:6])


def test_components_and_covers(spark):
    rng = random.Random(6)
    for n, m in ((8, 10), (16, 24)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)

        def reached(x):
            seen, todo = set(), [x]
            while todo:
                for y in near.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        want = {a for a in near for b in reached(a) if b != a and a in reached(b)}
        df = spark.createDataFrame(edges, "src string, dst string")
        assert {r.id for r in G.recursive(df).collect()} == want
    sets = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "y", 5), ("b", "z", 5), ("c", "z", 9), ("d", "x", 2)], "root string, file string, nodes long")
    assert sorted(map(tuple, G.cover(sets).collect())) == [(0, "b", 2), (1, "a", 1), (2, "c", 0), (3, "d", 0)]


def test_cover_is_greedy(spark):
    rng = random.Random(14)
    for n_roots, n_files in ((25, 40), (60, 30)):
        rows = sorted({(f"r{rng.randrange(n_roots):02d}", f"f{int(rng.paretovariate(0.7)) % n_files}") for _ in range(300)})
        nodes = {r: rng.randrange(1, 4) for r, _ in rows}
        files, weight = {}, {}
        for r, f in rows:
            files.setdefault(r, set()).add(f)
            weight[r] = weight.get(r, 0) + nodes[r]
        want, done = [], set()
        while True:
            gain = {r: len(f - done) for r, f in files.items()}
            best = min(gain, key=lambda r: (-gain[r], -weight[r], r))
            if not gain[best]:
                break
            want.append((best, gain[best]))
            done |= files[best]
        rest = sorted(set(files) - {r for r, _ in want}, key=lambda r: (-weight[r], r))[:2]
        got = sorted(map(tuple, G.cover(spark.createDataFrame([(r, f, nodes[r]) for r, f in rows], "root string, file string, nodes long")).collect()))
        assert got == [(i, *x) for i, x in enumerate([*want, *((r, 0) for r in rest)])]
    some = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("b", "y", 1), ("c", "z", 1)], "root string, file string, nodes long")
    assert sorted(map(tuple, G.cover(some, 1, 0).collect())) == [(0, "b", 2)]


def test_budget_and_empty(spark):
    assert T.node_budget(10_000, 5) == 2000 and T.node_budget(100, 5) == 300 and T.node_budget(100, 0) == 300
    none = spark.createDataFrame([], "src string, dst string, ord int")
    one = spark.createDataFrame([("a",)], "id string")
    symbols = spark.createDataFrame([("a", "a")], "id string, name string")
    assert [tuple(r) for r in T.expand(one, symbols, none).collect()] == [("a", 0, -1, "a", 0, None)]
    assert G.recursive(none).collect() == []
