"""Symbol ids, predicates and relations on small tables."""

from pyspark.sql import functions as F

from perfloom.operators import symbols as Y


def test_node_ids(spark):
    rows = [(0, "/x.py", "foo", None), (1, "/a.py", "f", ""), (2, "/o.py", "create", "Order.create"), (3, "/x.py", "inner", "outer.<locals>.inner"), (4, None, "f", "a.b.f"), (5, "/x.py", "g", ".g"), (6, "/x.py", "h", "A.")]
    df = spark.createDataFrame(rows, "i int, file string, name string, q string")
    got = [r.v for r in df.orderBy("i").select(Y.node_id(F.col("file"), F.col("name"), F.col("q")).alias("v")).collect()]
    assert got == ["/x.py::foo", "/a.py::f", "/o.py::Order::create", "/x.py::inner", "::a.b::f", "/x.py::g", "/x.py::h"]


def test_accessors_and_shares(spark):
    df = spark.createDataFrame([("getX",), ("isOk",), ("isO",), ("get_x",), ("setting",), ("setA1",), (None,)], "name string")
    assert {r.name for r in df.filter(Y.is_accessor(F.col("name"))).collect()} == {"getX", "isOk", "setA1"}
    assert [r.v for r in spark.range(1).select(Y.share(F.lit(3), F.lit(0)).alias("v")).collect()] == [0.0]


def test_scope(spark):
    df = spark.createDataFrame([(1, "./a/b.py"), (1, "./a/b.py"), (2, "x/ab.py"), (3, None), (4, "b.py"), (5, "q/./b.py"), (6, "")], "id int, file string")
    changed = spark.createDataFrame([("b.py",), ("./b.py",), ("",)], "path string")
    assert sorted(r.id for r in Y.in_scope(df, changed).collect()) == [1, 1, 4, 5]
    assert Y.in_scope(df, None).count() == 7 and Y.in_scope(df, changed.limit(0)).count() == 0


def test_merge_and_levels(spark):
    a = spark.createDataFrame([("f", 1, "x"), ("f", 1, "y")], "file string, line int, why string")
    b = spark.createDataFrame([("f", 1, "no"), ("f", 2, "z"), ("f", 2, "z")], "file string, line int, why string")
    assert sorted(r.why for r in Y.merge_suggestions(a, b).collect()) == ["x", "y", "z", "z"]
    nodes, edges = Y.level_view(spark.createDataFrame([(["m", "a", "b"],), (["m", "b"],), (["m"],)], "path array<string>"))
    assert {tuple(r) for r in nodes.collect()} == {("m", 0), ("a", 1), ("b", 1)}
    assert sorted(tuple(r) for r in edges.collect()) == [("a", "b"), ("m", "a"), ("m", "b")]


def test_windows(spark):
    df = spark.createDataFrame([(5, "a", 2), (7, "a", 1), (12, "b", 9), (None, "c", 1)], "time_us long, stack string, n long")
    assert {tuple(r) for r in Y.windowed_stacks(df, 10, 4).collect()} == {(0, "a", 3), (0, "unknown", 1), (10, "b", 9)}
