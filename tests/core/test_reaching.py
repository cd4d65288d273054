"""Reach 64 roots to a word, strong components and the package on executors, against walks of small graphs."""

import os
import random
import subprocess
import sys

import pytest

from perfloom.operators import graph
from perfloom.operators.reaching import Reached, reach_sizes


def walked(edges, start, most=None):
    seen, front, step = set(start), set(start), 0
    while front and (most is None or step < most):
        front = {b for a, b in edges if a in front} - seen
        seen |= front
        step += 1
    return seen


def frame(spark, edges):
    return spark.createDataFrame([(a, b) for a, b in edges], "src string, dst string")


def graphs():
    rng = random.Random(8)
    names = [f"n{i:03d}" for i in range(70)]
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(25)]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 17:02d}") for i in range(17)] + [("c025", "r05"), ("r05", "r05")]
    yield "sparse", [(rng.choice(names), rng.choice(names)) for _ in range(60)]
    yield "dense", [(rng.choice(names[:30]), rng.choice(names[:30])) for _ in range(60)]
    yield "chains and rings", chain + ring + [("c010", "c015"), ("x", "c000"), ("x", "r00")]
    yield "two rings joined", [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("s", "a"), ("s", "a")]


@pytest.mark.parametrize("edges", [e for _, e in graphs()], ids=[n for n, _ in graphs()])
def test_reach_is_a_walk(spark, edges):
    df = frame(spark, edges)
    nodes = sorted({x for e in edges for x in e})
    roots = [*nodes, "alone"]  # more than one word of roots
    found = {r: walked(edges, [r]) for r in roots}
    seeds = spark.createDataFrame([(r,) for r in roots] + [(None,)], "id string")
    assert {r.root: r.reach for r in reach_sizes(seeds, df).collect()} == {r: len(w) for r, w in found.items()}
    some = nodes[::3]
    got = {(r.root, r.id) for r in Reached(seeds.selectExpr("id AS root", "id"), df).at(spark.createDataFrame([(x,) for x in some], "id string")).collect()}
    assert got == {(r, x) for r in roots for x in found[r] if x in some}


def test_reach_within_steps_and_of_groups(spark):
    edges = dict(graphs())["chains and rings"]
    df, targets = frame(spark, edges), spark.createDataFrame([(x,) for x in {x for e in edges for x in e}], "id string")
    seeds = spark.createDataFrame([(1, "x"), (1, "r03"), (2, "c020"), (2, None)], "root long, id string")
    for most in (0, 1, 5, None):
        got = {(r.root, r.id) for r in Reached(seeds, df, most).at(targets).collect()}
        assert got == {(1, n) for n in walked(edges, ["x", "r03"], most)} | {(2, n) for n in walked(edges, ["c020"], most)}


def test_no_edges(spark):
    none = frame(spark, [("a", "a")])
    assert [tuple(r) for r in reach_sizes(spark.createDataFrame([("a",)], "id string"), none).collect()] == [("a", 1)]
    assert reach_sizes(spark.createDataFrame([], "id string"), none).collect() == []


@pytest.mark.parametrize("edges", [e for n, e in graphs() if n != "sparse"], ids=[n for n, _ in graphs() if n != "sparse"])
def test_strong_components(spark, edges):
    nodes = {x for e in edges for x in e}
    reach = {n: walked(edges, [n]) for n in nodes}
    want = {frozenset(m for m in reach[n] if n in reach[m]) for n in nodes}
    got = {}
    for r in graph.strong_components(frame(spark, edges)).collect():
        got.setdefault(r.component, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == {w for w in want if len(w) > 1}


def test_executors_get_the_package(tmp_path):
    """A query of Arrow functions, from a folder where the workers can't find the package by themselves."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
q = __spark_entry__.queries()
name = "op13_secret_scans" if "op13_secret_scans" in q else "call_tree_walk" if "call_tree_walk" in q else "function_rollup"
print("rows", q[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]
