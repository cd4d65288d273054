"""Extension points: tracing, layers, pickers, samplers, backoff, custom rules and resolvers."""

import random

import pytest
from pyspark.sql import functions as F

from perfloom.functions import sqltext
from perfloom.operators import extend


def test_trace_and_layers():
    told = []

    @extend.traced(told.append)
    def half(x):
        return 1 / x

    assert half(2) == 0.5
    with pytest.raises(ZeroDivisionError):
        half(0)
    assert [e["status"] for e in told] == ["ok", "error"] and all(e["duration_ns"] > 0 and e["qualname"].endswith("half") for e in told)
    order = []
    sink = extend.wrapped(lambda b, n: order.append("sink"), lambda f: lambda b, n: (order.append("in"), f(b, n)), lambda f: lambda b, n: (order.append("out"), f(b, n)))
    sink(None, 0)
    assert order == ["out", "in", "sink"]
    waits = [extend.backoff(k, rng=random.Random(1)) for k in (1, 3, 40)]
    assert 0.5 <= waits[0] <= 1 and waits[1] > waits[0] and 30 <= waits[2] <= 60


def one_stack(window):
    yield f"main;w{window}", window + 1


def test_sampler_table(spark):
    class Own(extend.SamplerSource):
        sampler = staticmethod(lambda window: [(f"main;w{window}", window + 1)])

    spark.dataSource.register(Own)
    got = spark.read.format("sampler").option("windows", "3").load()
    assert sorted(map(tuple, got.collect())) == [(0, "main;w0", 1), (1, "main;w1", 2), (2, "main;w2", 3)]


def test_own_rules_resolvers_and_pickers(spark):
    texts = spark.createDataFrame([(1, "TRUNCATE t"), (2, "SELECT a FROM t")], "id int, sql string")
    got = sqltext.lint(texts, [("OWN1", "high", lambda q, s: q.startswith("truncate"))]).collect()
    assert [(r.id, r.rule, r.severity) for r in got] == [(1, "OWN1", "high")]
    refs = spark.createDataFrame([(1, 10, "f", "a", "py", 3), (2, 11, "g", "a", "py", 4)], "ref int, src int, name string, file string, lang string, line int")
    symbols = spark.createDataFrame([(20, "f", "b", "py")], "id int, name string, file string, lang string")
    edges, outside = extend.build(refs, symbols, resolver=lambda r, s: r.join(s, "name").select("ref", "src", F.col("id").alias("dst")))
    assert [tuple(r) for r in edges.collect()] == [(10, 20)] and [tuple(r) for r in outside.collect()] == [(11, "g", 4, 1)]
    nodes = extend.adapted(symbols, {"id": "concat('n', id)", "label": "upper(name)"})
    assert [tuple(r) for r in nodes.collect()] == [("n20", "F")]
    assert extend.picked(nodes, lambda rows: 0) == "n20" and extend.picked(nodes, lambda rows: None) is None


def test_fuzzy_join_of_common_names(spark):
    """A name that all files have: the best and the alternatives are those of the product, and few rows are made."""
    import random

    from perfloom.operators import joins

    rng = random.Random(15)
    static = [(f"s{i:04d}", rng.choice(["__init__", "go"]), f"/r/p{rng.randrange(9)}/{rng.choice(['__init__.py', 'm.py'])}", rng.choice(["__init__", "C.__init__", None]), rng.choice(["C", "D", None]), i) for i in range(300)]
    sampled = [(i, f"x{i}", rng.choice(["__init__", "go", "lost"]), f"{rng.choice(['/r', '/app'])}/p{rng.randrange(12)}/{rng.choice(['__init__.py', 'm.py', 'n.py'])}", rng.choice(["__init__", "C.__init__", None]), rng.choice(["C", "D", None])) for i in range(80)] + [(99, "s0001", "a", "b", None, None)]

    def score(a, b):
        same = lambda x, y: x is not None and x == y
        base = a[3].rsplit("/", 1)[-1] == b[2].rsplit("/", 1)[-1]
        q, c, f = same(a[4], b[3]), same(a[5], b[4]), a[3] == b[2]
        return 0.95 if f and q else 0.85 if base and q or f and c else 0.7 if f else 0.65 if base and c else 0.5 if base else 0

    want = {}
    for a in sampled:
        found = sorted(((-score(a, b), b[0]) for b in static if a[2] == b[1] and score(a, b) >= 0.5))[:4]
        want[a[0]] = (found[0][1], -found[0][0], ",".join(i for _, i in found[1:])) if found else (None, None, "")
    want[99] = ("s0001", 1.0, "")
    st = spark.createDataFrame(static, "node_id string, name string, file string, qualified_name string, parent_class string, ord long")
    sa = spark.createDataFrame(sampled, "sid long, node_id string, name string, file string, qualified_name string, parent_class string")
    assert {r.sid: (r.best_id, r.score, r.alternatives) for r in joins.fuzzy_join(sa, st).collect()} == want
