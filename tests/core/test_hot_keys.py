"""Keys that very many rows share: what is told stays whole, and no step makes their product."""

from pyspark.sql import functions as F

from perfloom.operators import joins, ranges
from perfloom.plans import review
from perfloom.plans.joins import rows
from perfloom.sources import store

N = 600


def most_rows(df) -> int:
    """The most rows that a step of the plan gave, once the rows are there."""

    def below(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from below(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from below(node.plan())
        else:
            made = node.metrics().get("numOutputRows")
            yield made.get().value() if made.isDefined() else 0
            for i in range(node.children().size()):
                yield from below(node.children().apply(i))

    return max(below(df._jdf.queryExecution().executedPlan()))


def ends(df):
    got = [tuple(r) for r in df.collect()]
    assert most_rows(df) <= 8 * N
    return sorted(got)


def many(spark, *columns):
    return spark.range(N).select(*[F.expr(c) for c in columns])


def test_equal_ranges_share_their_parent(spark):
    inner = many(spark, "id AS range", "'f' AS file", "10 AS s", "20 AS e")
    outer = many(spark, f"id + {N} AS range", "'f' AS file", "5 AS s", "30 AS e")
    assert ends(joins.containment(inner.union(outer))) == [(i, N) for i in range(N)]


def test_points_of_one_place_share_their_range(spark):
    points = many(spark, "id AS point", "'f' AS file", "15 AS pos")
    own = many(spark, "id + 7 AS range", "'f' AS file", "10 AS s", "20 AS e")
    assert ends(joins.innermost(points, own)) == [(i, 7) for i in range(N)]


def test_findings_of_one_place_share_their_node(spark):
    findings = many(spark, "id AS fid", "'f' AS file", "15L AS line")
    nodes = many(spark, "id AS node", "'f' AS file", "10L AS line", "9L AS loc", "IF(id IN (5, 9), 3, 1) AS depth")
    assert ends(ranges.deepest(findings, nodes)) == [(i, 5) for i in range(N)]


def test_findings_of_one_span_have_one_owner(spark):
    orm = many(spark, "id + 3 AS ord", "'f' AS file", "10L AS ls", "20L AS le", "0.5D AS confidence", "1 AS severity")
    sql = many(spark, "id AS sid", "'f' AS file", "15L AS rs", "25L AS re", "0.0D AS sql_confidence", "2 AS sql_severity")
    got = ends(ranges.fuse(orm, sql))
    assert got[0] == (3, 0.5, 2, N) and all(r[1:] == (0.5, 1, 0) for r in got[1:]) and len(got) == N


def test_symbols_of_one_extent_are_covered_alike(spark):
    symbols = many(spark, "id", "'f' AS file", "10L AS ls", "20L AS le")
    hunks = many(spark, "'f' AS file", "id % 30 AS rs", "id % 30 AS re")
    files = spark.createDataFrame([("f", "modified")], "file string, status string")
    assert ends(ranges.change_status(symbols, files, hunks)) == [(i, "added") for i in range(N)]


def test_an_import_of_a_name_with_many_symbols(spark):
    refs = many(spark, "id AS ref", "id AS src", "'n' AS name", "'w/a.ts' AS file")
    imports = spark.createDataFrame([("w/a.ts", "n", "./lib")], "file string, name string, module string")
    symbols = many(spark, "id", "'n' AS name", "'w/lib.ts' AS file")
    # symbol 0 is the first; reference 0 is that symbol itself and gets the next
    assert ends(joins.resolve_imports(refs, imports, symbols)) == [(0, 0, 1)] + [(i, i, 0) for i in range(1, N)]


def test_the_next_way_is_taken_where_the_first_is_the_reference_itself(spark):
    refs = spark.createDataFrame([(1, 9, "n", "w/a.ts"), (2, 8, "n", "w/a.ts")], "ref long, src long, name string, file string")
    imports = spark.createDataFrame([("w/a.ts", "n", "./lib")], "file string, name string, module string")
    symbols = spark.createDataFrame([(9, "n", "w/lib.ts"), (4, "n", "w/lib.js"), (3, "other", "w/lib.ts")], "id long, name string, file string")
    assert ends(joins.resolve_imports(refs, imports, symbols)) == [(1, 9, 4), (2, 8, 9)]


def test_names_whose_only_symbol_of_the_file_is_the_reference(spark):
    refs = spark.createDataFrame([(1, 1, "n", "f", "py"), (2, 2, "m", "f", "py")], "ref long, src long, name string, file string, lang string")
    symbols = spark.createDataFrame([(1, "n", "f", "py"), (5, "n", "g", "py"), (2, "m", "f", "py"), (6, "m", "f", "py"), (7, "m", "g", "py")], "id long, name string, file string, lang string")
    assert ends(joins.resolve_names(refs, symbols)) == [(1, 1, 5), (2, 2, 6)]


def test_entries_that_name_a_file_with_many_symbols(spark):
    entries = many(spark, "concat('e', id) AS entry", "IF(id % 2 = 0, array('pkg.m:go'), array('python', './pkg/m.py')) AS argv")
    symbols = many(spark, "id", "CASE id WHEN 7 THEN 'main' WHEN 9 THEN 'go' ELSE 'x' END AS name", "'r/pkg/m.py' AS file", "id AS line", "1L AS loc")
    assert ends(store.match_entries(entries, symbols)) == sorted((f"e{i}", 9, 3) if i % 2 == 0 else (f"e{i}", 7, 1) for i in range(N))


def test_the_next_part_of_a_group_without_its_pairs(spark, tmp_path):
    many(spark, "id AS p_partkey", "IF(id % 50 = 0, NULL, 'B') AS p_brand", "CAST(id % 3 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = ends(rows(spark, str(tmp_path), review.NEXT))
    assert got == sorted(tuple(r) for r in rows(spark, str(tmp_path), review.PAIRS).collect())


def test_joins_of_rounds_go_by_no_broadcast(spark):
    from perfloom.operators import graph

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], "src string, dst string")
    met = graph.dealt(edges).join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst")
    assert len(met.collect()) == 19
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_the_first_symbols_of_a_file_leave_few_rows_to_sort(spark):
    symbols = spark.range(50_000).selectExpr("id", "'src/a.py' AS file", "CAST(50000 - id AS INT) AS line", "1 AS line_end")
    got = store.symbol_spans(symbols, spark.createDataFrame([("a.py",)], "path string"))
    assert sorted(r.line for r in got.collect()) == list(range(1, 121))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_last" in plan


def test_affected_roots_tell_each_part(spark, tmp_path):
    from perfloom.plans import registry

    spark.range(10).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1), (2, 2), (2, 5)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.QUERIES["affected_roots"](spark, str(tmp_path)).collect()}
    # calls: P1 -> P0, P2 -> P7, P5 -> P8
    assert got == {("P1", "S1"), ("P0", "S1"), ("P2", "S2"), ("P7", "S2"), ("P5", "S2"), ("P8", "S2")}


def test_nodes_come_from_edges_made_once(spark, tmp_path):
    from perfloom.plans.joins import linked

    spark.range(10).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1), (2, 2)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes, edges = linked(spark, str(tmp_path))
    assert sorted(r.id for r in nodes.collect()) == ["P0", "P1", "P2", "P7", "S1", "S2"] and edges.count() == 4
    assert "lineitem" not in nodes._jdf.queryExecution().executedPlan().toString()
