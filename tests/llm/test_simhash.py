import random

import numpy as np
import xxhash

from perfloom.llm import simhash


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints, radius=4):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(zip(ids, prints)):
        for b, q in zip(ids[:i], prints[:i]):
            if (p ^ q).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    out = ["", None, " \n\t ", "One", "one", "A\x1cb c d", "Ünï Ünï", "x" * 50_000, "a b c d", "a b c"]
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 5, 40, 400]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 2, 5])):
            edit = list(base)
            edit[rng.randrange(len(edit))] = "edit"
            out.append(" ".join(edit))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    t = texts(rng, 500)
    ids = list(range(1000, 1000 + len(t)))
    rng.shuffle(ids)
    docs = spark.createDataFrame([(i, x, 7, "k") for i, x in zip(ids, t)], "doc_id long, text string, fp int, component_id string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(x) for x in t]
    assert {i: p for i, (p, _) in got.items()} == dict(zip(ids, prints))
    assert {i: c for i, (_, c) in got.items()} == brute_components(ids, prints)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (5, 5)]


def near(rng, base, bits):
    for b in rng.choice(64, bits, replace=False):
        base ^= 1 << int(b)
    return base


def test_long_and_short_runs_agree_with_pairs():
    rng = np.random.default_rng(3)
    for n, spread in ((700, 3), (700, 40), (1500, 5)):
        base = int(rng.integers(0, 1 << 63))
        prints = np.array(sorted({near(rng, base, int(rng.integers(0, spread + 1))) for _ in range(n)}), np.uint64)
        want = brute_components(list(range(len(prints))), [int(x) for x in prints])
        got = simhash.block_labels(prints, 4)
        groups = {}
        for i, g in enumerate(got):
            groups.setdefault(int(g), []).append(i)
        assert {i: min(m) for m in groups.values() for i in m} == want
        runs = np.sort(rng.integers(0, 4, len(prints)))
        a, b = simhash.shifted_links(prints, runs, 4)
        pairs = {(int(i), int(j)) for i, j in zip(a, b)}
        assert pairs == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if runs[i] == runs[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 4}


def test_tables_find_every_pair_in_the_radius():
    rng = random.Random(1)
    for n in (10, 10**6, 10**9, 10**11):
        masks = simhash.tables_for(n)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
            assert any(not x & m for m in masks)


def test_hot_buckets_are_split(spark):
    rng = random.Random(21)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(400):  # a chain of neighbours and loners that share a bucket
        x = base
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 9, 20])):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(prints)]
    df = spark.createDataFrame(rows, "fp long, rep long")
    masks = simhash.tables_for(len(rows))

    def parts(links):
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(rows))]

    want = parts((i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4)
    for hot in (16, simhash.HOT):
        assert parts((r.a, r.b) for r in simhash.link_stars(df, masks, hot=hot).collect()) == want
