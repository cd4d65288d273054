"""Steps whose cost must not grow with what they can share."""

from pyspark.sql import functions as F

from perfloom.functions import classify
from perfloom.operators import orm


def test_source_stats_work_out_a_line_once(spark):
    text = "/* open 9\nstill 8 // x */\nx = 217 // 77\n\nLIMIT = 55\ny = \"# 33 // 44\" + 1\na(); /* b */ c(7) /* on\n12 */ d = 5 // TODO 6"
    stats = classify.source_stats(spark.createDataFrame([("a.ts", text), ("b.py", "# TODO x\nx = 3 # 4\n\nNAME = 9")], "path string, text string"))
    got = {r.path: tuple(r)[1:] for r in stats.collect()}
    assert got == {"a.ts": (5, 2, 1, 3, 5, 1), "b.py": (2, 1, 1, 1, 2, 1)}
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4
    # the files of one small table are worked out by many tasks
    assert stats.select(F.spark_partition_id()).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_chains_of_a_source_and_path_walk_once(spark, monkeypatch):
    chains = spark.createDataFrame([(i, i % 2, ["customer", "orders"] if i % 3 else ["lines"]) for i in range(300)], "chain long, source long, path array<string>")
    # a source listed twice tells each of its chains twice
    sources = spark.createDataFrame([(0, "Order", False), (1, "Order", False), (1, "Order", False)], "source long, model string, values_only boolean")
    loaded = spark.createDataFrame([(0, "prefetched", "customer")], "source long, tree string, path string")
    fields = spark.createDataFrame([("Order", "customer", "Customer", False), ("Customer", "orders", "Order", False), ("Order", "lines", "Line", False)], "model string, field string, target string, scalar boolean")
    most, settle = [], orm.settle

    def counted(df):
        out = settle(df)
        most.append(out.count())
        return out

    monkeypatch.setattr(orm, "settle", counted)
    got = sorted(tuple(r) for r in orm.prefetch_verdicts(chains, sources, loaded, fields).collect())
    said = {(i, p): ((0, "lines") if i % 3 == 0 else (0, "customer") if i % 2 else (1, "orders")) for i in range(300) for p in range(1 + i % 2)}
    assert got == sorted((i, *v) for (i, _), v in said.items())
    assert max(most) <= 6


def test_edges_out_of_mere_roots_are_in_no_cycle(spark, monkeypatch):
    from perfloom.operators import reaching

    edges = [(f"S{i}", f"P{j}") for i in range(9) for j in range(0, 20, 2)] + [(f"P{j}", f"P{(j * 7 + 3) % 20}") for j in range(20)]
    seen, components = [], reaching.strong_components

    def counted(e):
        seen.append(e.count())
        return components(e)

    monkeypatch.setattr(reaching, "strong_components", counted)
    table = spark.createDataFrame(edges, "src string, dst string").cache()
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    want = {}
    for root in [f"S{i}" for i in range(9)]:
        met, front = {root}, [root]
        while front:
            front = [x for n in front for x in below.get(n, ()) if x not in met and not met.add(x)]
        want[root] = len(met)
    seeds = spark.createDataFrame([(r,) for r in want], "id string")
    for tidy in (False, True):
        assert {r.root: r.reach for r in reaching.reach_sizes(seeds, table, tidy=tidy).collect()} == want
    assert max(seen) <= 20


def test_neighbours_are_found_across_blocks(spark, monkeypatch):
    from perfloom.operators import changes

    monkeypatch.setattr(changes, "BLOCK", 4)
    rows = [(g, i, f"t{(i * i + len(g)) % 7}") for g, n in (("a", 1), ("b", 2), ("bb", 3), ("c", 23), ("d", 8), ("ee", 4)) for i in range(n)]
    got = {tuple(r) for r in changes.running_shingles(spark.createDataFrame(rows, "g string, at int, token string"), ["at"]).collect()}
    want = {(g, " ".join(w[i : i + 3])) for g in {r[0] for r in rows} for w in [[t for x, _, t in rows if x == g]] for i in range(len(w) - 2)}
    assert got == want


def test_pairs_of_few_rows_are_told_by_many_tasks(spark, monkeypatch):
    from perfloom.operators import reaching

    monkeypatch.setattr(reaching, "LOT", 8)
    monkeypatch.setattr(reaching, "PAIRS", 64)
    # one ring that 70 roots reach, more than one word, and a node apart that none reaches
    edges = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [(f"s{i}", f"r{i % 40}") for i in range(70)] + [("u", "v")]
    seeds = spark.createDataFrame([(f"s{i}", f"s{i}") for i in range(70)], "root string, id string")
    nodes = spark.createDataFrame([(f"r{i}",) for i in range(40)] * 2 + [("s3",), ("v",), (None,)], "id string")
    for bound in (50_000, 1):  # names of roots by broadcast, and by a shuffle
        monkeypatch.setattr(reaching, "BROADCAST_ROOTS", bound)
        told = reaching.Reached(seeds, spark.createDataFrame(edges, "src string, dst string")).at(nodes)
        rows = told.withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.root, r.id) for r in rows) == sorted([(f"s{i}", f"r{k}") for i in range(70) for k in range(40)] + [("s3", "s3")])
        assert len({r.task for r in rows}) > 2


def test_what_roots_reach_is_joined_without_the_driver(spark, monkeypatch):
    from perfloom.operators import graph, reaching

    plans, checkpoint = [], graph.settle

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df)

    monkeypatch.setattr(graph, "settle", seen)
    # a ring of 5, a tail into it, a loop of two that colouring finds, and chains
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("t0", "t1"), ("t1", "t2"), ("t2", "r0")]
    edges = ring + [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("s1", "a"), ("s2", "t0"), ("s2", "b"), ("c", "d0"), ("d0", "d1"), ("d1", "d2")]
    seeds = spark.createDataFrame([("s1",), ("s2",)], "id string")
    sizes = reaching.reach_sizes(seeds, spark.createDataFrame(edges, "src string, dst string"))
    assert {r.root: r.reach for r in sizes.collect()} == {"s1": 7, "s2": 15}
    joins = [p for p in [*plans, sizes._jdf.queryExecution().executedPlan().toString()] if "Join" in p]
    assert len(joins) > 10
    # the numbers of the ranges that roots are ranked in are the only broadcast: a row for each range
    assert [p for p in joins if "BroadcastHashJoin" in p and "_p#" not in p] == []


def test_pointers_are_doubled_no_further_than_the_longest_cycle(spark, monkeypatch):
    from perfloom.operators import graph

    kept, checkpoint = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: kept.append(1) or checkpoint(df))
    # 300 cycles of three, a long tail into one of them, and a chain that ends
    edges = [(f"c{i}_{k}", f"c{i}_{(k + 1) % 3}") for i in range(300) for k in range(3)]
    edges += [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(9)] + [("t09", "c7_2")] + [(f"e{i}", f"e{i + 1}") for i in range(5)]
    got = {}
    for r in graph.functional_cycles(spark.createDataFrame(edges, "src string, dst string")).collect():
        got.setdefault(r.component, set()).add(r.id)
    assert got == {f"c{i}_0": {f"c{i}_{k}" for k in range(3)} for i in range(300)}
    assert len(kept) <= 8
