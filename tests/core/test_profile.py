import json

import pytest

from perfloom.operators import graph, joins, profile
from perfloom.sources import events


def lines(spark, rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "seq long, raw string")


def f(*names):
    return [{"name": n} for n in names]


TRACE = {"type": "wall_trace", "period_ns": 10_000_000, "count": 3, "frames": f("leaf", "mid", "main"), "time": "2026-05-20T10:00:00.000001Z", "cpu": 2.0, "memory_bytes": 100, "memory_peak_bytes": 150}
RECURSIVE = {"type": "cpu_trace", "period_ns": 1_000_000, "count": 2, "frames": f("a", "a", "main"), "time": 1779271216000000000}
BUNDLE = {"type": "wall_profile", "period_ns": 1000, "samples": [{"count": 5, "frames": f("x")}, {"count": 0, "frames": f("y")}, {"count": 1, "frames": []}]}
CALL = {"type": "function_call", "duration_ns": 4500, "qualname": "Cls.go", "file": "m.py", "line": 3}
BAD = ["", "   ", "not json", '{"type": "wall_trace", "count": "many"}', {"type": "wall_trace", "period_ns": 1, "count": 1, "frames": [{"file": "x"}]}, {"type": "other"}, {**TRACE, "count": 0}, {**CALL, "qualname": ""}]


@pytest.fixture(scope="module")
def samples(spark):
    return events.stack_samples(events.parse(lines(spark, [TRACE, *BAD, RECURSIVE, BUNDLE, CALL]))).cache()


def test_normalisation(samples):
    got = sorted((r.frames[0].name, r.weight_us, r.tick_count) for r in samples.collect())
    assert got == [("a", 2000, 2), ("go", 4, 1), ("leaf", 30000, 3), ("x", 5, 5)]
    at = {r.frames[0].name: r.time_us for r in samples.collect()}
    assert at["leaf"] == 1779271200000001 and at["a"] == 1779271216000000 and at["x"] is None


def test_rollup_counts_recursion_once(samples):
    got = {r.name: r for r in profile.function_rollup(samples).collect()}
    assert (got["a"].cumulative_us, got["a"].self_us, got["a"].ncalls) == (2000, 2000, 2)
    assert got["main"].cumulative_us == 32000 and got["main"].self_us == 0 and got["main"].percall_us == 0
    assert got["leaf"].memory_mean_bytes == 100 and got["leaf"].memory_peak_bytes == 150 and got["leaf"].cpu == 2.0
    assert got["a"].recent_ncalls == 2 and got["leaf"].recent_ncalls == 0
    assert sum(r.self_us for r in got.values()) == 32009


def test_tree_keeps_recursion(samples):
    got = {r.path: (r.depth, r.value_us, r.self_us, r.ncalls) for r in profile.call_tree(samples).collect()}
    assert got["main;a;a"] == (3, 2000, 2000, 1) and got["main;a"] == (2, 2000, 0, 0) and got["main"] == (1, 32000, 0, 0)
    near = {(r.side, r.name): r.total_us for r in profile.neighbours(samples, "a").collect()}
    assert near == {("caller", "a"): 2000, ("caller", "main"): 2000, ("callee", "a"): 2000}


def test_empty_log(spark):
    none = events.stack_samples(events.parse(lines(spark, []).limit(0)))
    assert profile.function_rollup(none).collect() == [] and profile.call_tree(none).collect() == []


def test_right_now_ties_go_to_the_later_row(spark):
    rows = [{**TRACE, "frames": f("old")}, {**TRACE, "frames": f("new")}, {**TRACE, "frames": f("late"), "time": "2026-05-20T09:00:00Z"}]
    assert profile.right_now(events.stack_samples(events.parse(lines(spark, rows)))).first().stack == "new"


def test_folded_and_speedscope(spark, tmp_path):
    got = {(r.stack, r.n) for r in events.folded(lines(spark, ["a;b 3", "a b;c 10", "nothing", "x y"])).collect()}
    assert got == {("a;b", 3), ("a b;c", 10)}
    doc = {"shared": {"frames": [{"name": "m"}, {"name": "k"}]}, "profiles": [{"samples": [[0, 1], [0], [0, 1]], "weights": [2, 5]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    assert {(r.stack, r.n) for r in events.speedscope(spark, str(tmp_path / "s.json")).collect()} == {("m;k", 3), ("m", 5)}


def test_downsample_bounds(spark):
    for n in (1, 120, 121, 345):
        df = spark.range(n).selectExpr("id as seq", "id as time_us", "id as memory_bytes", "0L as memory_peak_bytes", "1.0D as cpu")
        got = sorted(profile.runtime_downsample(df).collect(), key=lambda r: r.bucket)
        want = [(b * n // 120, (b + 1) * n // 120) for b in range(120)] if n > 120 else [(i, i + 1) for i in range(n)]
        assert [(r.time_us, r.memory_bytes) for r in got] == [(e - 1, sum(range(s, e)) // (e - s)) for s, e in want]


NODE = "node_id string, name string, file string, qualified_name string, parent_class string"


def test_fuzzy_tiers(spark):
    static = spark.createDataFrame([(0, "/h/a.py::C::go", "go", "/h/a.py", "C.go", "C"), (1, "/h/b.py::go", "go", "/h/b.py", None, None)], "ord long, " + NODE)
    cases = {1: ("/h/a.py::C::go", "go", "z", None, None, 1.0), 2: ("x", "go", "/h/a.py", "C.go", None, 0.95), 3: ("x", "go", "/q/a.py", "C.go", None, 0.85), 4: ("x", "go", "/h/a.py", None, "C", 0.85), 5: ("x", "go", "/h/a.py", None, None, 0.7), 6: ("x", "go", "/q/a.py", None, "C", 0.65), 7: ("x", "go", "/q/a.py", None, None, 0.5), 8: ("x", "go", "/q/z.py", None, None, None), 9: ("x", "no", "/h/a.py", "C.go", "C", None)}
    sampled = spark.createDataFrame([(k, *v[:5]) for k, v in cases.items()], "sid long, " + NODE)
    got = {r.sid: (r.best_id, r.score) for r in joins.fuzzy_join(sampled, static).collect()}
    assert got == {k: (None if v[5] is None else "/h/a.py::C::go", v[5]) for k, v in cases.items()}


def test_path_alias(spark):
    static = spark.createDataFrame([(0, "/u/me/p/a/x.py"), (1, "/u/me/p/b/y.py"), (2, "/u/me/q/x.py")], "ord long, file string")
    hit = spark.createDataFrame([("/app/a/x.py",), ("/app/b/y.py",), ("/lib/z.py",)], "file string")
    assert [tuple(r) for r in joins.path_alias(hit, static).collect()] == [("/app/", "/u/me/p/", 2, 2)]
    few = spark.createDataFrame([("/app/a/x.py",), ("/app/n.py",)], "file string")
    assert joins.path_alias(few, static).collect() == []


def test_page_rank_and_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    rank = {r.id: r.rank for r in graph.page_rank(nodes, edges).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-6)
    base = 0.15 / 5 + 0.85 * rank["d"] / 5
    assert rank["b"] == pytest.approx(base + 0.85 * rank["a"], abs=1e-5) and rank["d"] == pytest.approx(base + 0.85 * rank["c"] / 2, abs=1e-5)
    assert {r.id for r in graph.recursive(edges).collect()} == {"a", "b", "c"}
    assert {r.id for r in graph.reach(nodes.filter("id = 'b'"), edges).collect()} == {"a", "b", "c", "d"}
