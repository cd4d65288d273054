"""Ranges, change sets, texts and streams on small tables."""

from pyspark.sql import functions as F

from perfloom.operators import graph, ranges, review
from perfloom.sources import texts
from perfloom.streaming import live

TRACE = '{"type":"wall_trace","time":"%d","period_ns":1000000,"count":2,"frames":[{"name":"%s"},{"name":"main"}]}'


def test_overlaps_tell_a_pair_once(spark):
    left = spark.createDataFrame([("f", 0, 5000), ("f", 10, 9), (None, 1, 2)], "file string, ls long, le long")
    right = spark.createDataFrame([("f", 5000, 9000), ("f", 5001, 6000), ("f", -3, 0), ("g", 1, 2)], "file string, rs long, re long")
    got = {(r.rs, r.re) for r in ranges.overlaps(left, right, ["file"]).collect()}
    assert got == {(5000, 9000), (-3, 0)} and ranges.overlaps(left, right, ["file"]).count() == 2


def test_change_status(spark):
    symbols = spark.createDataFrame([(1, "a", 1, 10), (2, "a", 20, 30), (3, "a", 40, 41), (4, "b", 1, 2), (5, "c", 1, 2), (6, "d", 1, 2)], "id int, file string, ls long, le long")
    files = spark.createDataFrame([("a", "modified"), ("b", "removed"), ("d", "modified")], "file string, status string")
    hunks = spark.createDataFrame([("a", 1, 4), ("a", 3, 6), ("a", 7, 10), ("a", 30, 31), ("b", 1, 1)], "file string, rs long, re long")
    got = {r.id: r.change for r in ranges.change_status(symbols, files, hunks).collect()}
    assert got == {1: "added", 2: "modified", 3: "unchanged", 4: "removed", 5: "unchanged", 6: "modified"}


def test_fusion_takes_a_sql_finding_once(spark):
    orm = spark.createDataFrame([(1, "f", 0, 10, 0.5, 0), (2, "f", 5, 20, 0.5, 2), (3, "g", 0, 1, 0.2, 1)], "ord int, file string, ls long, le long, confidence double, severity int")
    sql = spark.createDataFrame([(7, "f", 8, 9, 0.8, 1)], "sid int, file string, rs long, re long, sql_confidence double, sql_severity int")
    got = {r.ord: (round(r.confidence, 6), r.severity, r.fused) for r in ranges.fuse(orm, sql).collect()}
    assert got == {1: (0.9, 1, 1), 2: (0.5, 2, 0), 3: (0.2, 1, 0)}


def test_clusters(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.clusters(pairs).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 90, 90: 90}
    assert graph.clusters(pairs.limit(0)).count() == 0


def test_trend(spark):
    rows = [("up", k, float(v)) for k, v in enumerate([1, 1, 1, 2])] + [("few", k, 1.0) for k in range(3)] + [("zero", k, 0.0) for k in range(5)] + [("down", k, 9.0 - k) for k in range(8)]
    df = spark.createDataFrame(rows, "s string, k int, v double")
    assert {r.s: r.trend for r in review.trend(df, "s", ["k"], "v").collect()} == {"up": "up", "few": "unknown", "zero": "unknown", "down": "down"}


def test_diffs(spark):
    diff = "--- a/x\n+++ b/x.py\n@@ -1,2 +5,3 @@\n a\n-b\n+c\n--- not a header\n+++ nor this\n\\ No newline\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-z"
    df = spark.createDataFrame([(1, diff), (2, ""), (3, None)], "id int, diff string")
    got = sorted((r.path, r.line, r.added) for r in texts.diff_lines(df).collect())
    assert got == [("x.py", 5, False), ("x.py", 6, True), ("x.py", 7, True)]
    names = spark.createDataFrame([("A\ta",), ("R090\told\tnew",), ("M\tm",), ("bad",)], "raw string")
    assert sorted((r.path, r.status, r.old_path) for r in texts.name_status(names).collect() if r.path != "") == [("a", "added", None), ("m", "modified", None), ("new", "renamed", "old")]


def test_bodies_and_units(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '[{"a":1}, {"b":2}]'), (3, '{"a":1}\n{"b":2}\nno\n'), (4, " "), (5, None), (6, "[")], "id int, body string")
    got = sorted((r.id, r.pos) for r in texts.body_events(df).collect())
    assert got == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1)]
    units = spark.createDataFrame([("1.5GiB",), ("20kB",), ("7B",), ("--",), (None,)], "u string")
    assert [r.v for r in units.select(texts.byte_count(F.col("u")).alias("v")).collect()] == [1610612736, 20000, 7, None, None]


def test_files_and_appends(spark, tmp_path):
    (tmp_path / "app").mkdir()
    for name in ("a.LOG", "b.jsonl", "c.txt"):
        (tmp_path / "app" / name).write_text("x")
    assert {(r.path.rsplit("/")[-1], r.source, r.size) for r in texts.log_files(spark, str(tmp_path)).collect()} == {("a.LOG", "app", 1), ("b.jsonl", "app", 1)}
    lines = spark.createDataFrame([(' {"a":1} ',), ("",), ("{",), (None,)], "raw string")
    assert texts.append_lines(lines, str(tmp_path / "out")) == 3
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1}']


def test_running_rollup_equals_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.jsonl").write_text("\n".join([TRACE % (10 - k, f"f{k % 2}"), "", "bad"]))
    query = live.running_rollup(live.tail(spark, str(folder), 1)).writeStream.format("memory").queryName("rollup").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = live.running_rollup(spark.read.text(str(folder)).withColumnRenamed("value", "raw"))
    assert sorted(map(tuple, spark.table("rollup").collect())) == sorted(map(tuple, batch.collect())) == [("f0", 4000, 4000, 4), ("f1", 2000, 2000, 2), ("main", 6000, 0, 0)]


def test_tee_isolates_failures(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("x\ny")
    seen, told = [], []

    def bad(batch, number):
        raise ValueError("no")

    live.tee(live.tail(spark, str(folder)), lambda b, n: seen.append(b.count()), [bad, lambda b, n: seen.append(b.count())], str(tmp_path / "cp"), lambda k, e: told.append(k)).awaitTermination()
    assert seen == [2, 2] and told == [0]


def test_overlaps_of_all_lengths(spark):
    """Points, short ranges and some over whole files, at negative places too, against all pairs."""
    import random

    rng = random.Random(16)

    def some(n):
        out = []
        for i in range(n):
            s = rng.randrange(-3000, 200_000)
            out.append((i, rng.choice("ab"), s, s + rng.choice([0, 0, rng.randrange(50), rng.randrange(5000), rng.randrange(300_000), -1])))
        return out

    left, right = some(150) + [(900, "a", None, 3)], some(120) + [(901, "b", 3, None)]
    want = {(i, j) for i, f, a, b in left for j, g, c, d in right if None not in (a, b, c, d) and f == g and a <= b and c <= d and a <= d and c <= b}
    for width in (8, ranges.BIN):
        met = ranges.overlaps(spark.createDataFrame(left, "i long, file string, ls long, le long"), spark.createDataFrame(right, "j long, file string, rs long, re long"), ["file"], width)
        got = [(r.i, r.j) for r in met.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    huge = spark.createDataFrame([(1, "a", 0, 10**12)], "j long, file string, rs long, re long")
    assert ranges.overlaps(spark.createDataFrame([(1, "a", 5, 5)], "i long, file string, ls long, le long"), huge, ["file"], 64).count() == 1
