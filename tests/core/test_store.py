"""Stores, compact reports and channels: round trips, versions, guards and rings."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from perfloom.operators import changes
from perfloom.sources import store
from perfloom.streaming import channels


def test_scans(spark, tmp_path):
    root = str(tmp_path)
    nodes = spark.createDataFrame([("a", "n1", 3, ["x"]), ("a", "n2", 1, []), ("b", "n3", 2, [])], "entry string, id string, size int, children array<string>")
    for scan, at in (("s1", 5), ("s2", 9)):
        store.save_scan(scan, nodes, spark.createDataFrame([(at,)], "saved_at int"), root)
    os.makedirs(f"{root}/bad/meta")
    with open(f"{root}/bad/meta/x.json", "w") as f:
        f.write("{not json\n")
    assert [r.scan for r in store.list_scans(spark, root, "scan string, saved_at int").collect()] == ["s2", "s1"]
    assert sorted(r.id for r in store.load_entry(spark, root, "s1", "a").collect()) == ["n1", "n2"]
    told = []
    store.save_scan("s3", nodes.drop("entry").withColumn("other", F.lit(1)), spark.createDataFrame([(1,)], "saved_at int"), root, lambda name, error: told.append(name))
    assert told == ["entries", "summary"] and spark.read.parquet(f"{root}/s3/nodes").count() == 3
    for bad in ("", "../x", "a/b", ".x", "a..b", None):
        with pytest.raises(ValueError):
            store.scan_id(bad)


def test_compact_and_plain(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "z"), (2, "", "a"), (3, "é", "z"), (4, "a", "a")], "id int, x string, y string")
    store.write_compact(rows, ["x", "y"], f"{tmp_path}/c")
    rows.write.parquet(f"{tmp_path}/p")
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, store.read_report(spark, f"{tmp_path}/c", ["x", "y"]).collect())) == want
    assert sorted(map(tuple, store.read_report(spark, f"{tmp_path}/p", ["x", "y"]).collect())) == want
    assert {r.value: r.code for r in spark.read.parquet(f"{tmp_path}/c/strings").collect()} == {"": 0, "a": 1, "z": 2, "é": 3}


def test_stacks_by_ending(spark, tmp_path):
    with open(f"{tmp_path}/a.folded", "w") as f:
        f.write("m;f 3\nm;g x\nm 2\n")
    with open(f"{tmp_path}/a.json", "w") as f:
        json.dump({"shared": {"frames": [{"name": "m"}, {"name": "f"}]}, "profiles": [{"samples": [[0, 1], [0], [0, 1]], "weights": [2, 5]}]}, f)
    assert sorted(map(tuple, store.read_stacks(spark, f"{tmp_path}/a.folded").collect())) == [("m", 2), ("m;f", 3)]
    assert sorted(map(tuple, store.read_stacks(spark, f"{tmp_path}/a.json").collect())) == [("m", 5), ("m;f", 3)]


def test_walk(spark, tmp_path):
    for p in ("src/a.py", "node_modules/x.js", "src/gen/b.go", "src/c.min.js", "q.sql"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{p}"), exist_ok=True)
        with open(f"{tmp_path}/{p}", "w") as f:
            f.write("x")
    files = store.walk(spark, str(tmp_path))
    assert sorted(map(tuple, store.source_files(files, ["gen/"]).collect())) == [("q.sql", 1, "SQL"), ("src/a.py", 1, "Python")]
    assert [r.path for r in store.sql_files(files).collect()] == ["q.sql"]


def write_lines(path, rows):
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


FRAME = "topic string, seq long, payload string"


def test_rings_and_history(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    os.makedirs(feed)
    write_lines(f"{feed}/1.json", [{"topic": "a", "seq": i, "payload": f"p{i}"} for i in range(7)] + [{"topic": "b", "seq": 100, "payload": "q"}])
    got = {}

    def last(batch, number):
        for r in sorted(batch.collect(), key=lambda r: r.place):
            got.setdefault(r.topic, []).append((r.place, r.seq, r.payload))

    for k in range(2):
        got.clear()
        stream = channels.rings(spark.readStream.schema(FRAME).json(feed), 3)
        stream.writeStream.foreachBatch(last).outputMode("update").option("checkpointLocation", f"{tmp_path}/ring").trigger(availableNow=True).start().awaitTermination()
        if not k:
            assert got == {"a": [(1, 4, "p4"), (2, 5, "p5"), (3, 6, "p6")], "b": [(1, 100, "q")]}
            write_lines(f"{feed}/2.json", [{"topic": "a", "seq": 8, "payload": "p8"}, {"topic": "a", "seq": 2, "payload": "late"}])
    assert got == {"a": [(1, 5, "p5"), (2, 6, "p6"), (3, 8, "p8")]}


def test_protocol(spark):
    raw = ['["1","1","room","phx_join",{}]', '["1","2","room","say",{"a":1}]', '[null,"3","phoenix","heartbeat",{}]', '["1","4","room","phx_leave",{}]', "no", '["1","5","","x",{}]', '["2","1","room","phx_join",{}]']
    rows = channels.envelopes(spark.createDataFrame([(f"c{r[2:3]}" if r.startswith('["') else "c0", i, r) for i, r in enumerate(raw)], "client string, seq int, raw string"))
    assert [r.verb for r in rows.orderBy("seq").collect() if r.ok] == ["join", "broadcast", "heartbeat", "leave", "join"]
    assert sorted((r.seq, r.status) for r in channels.replies(rows).collect()) == [(0, "ok"), (2, "ok"), (3, "ok"), (4, "error"), (5, "error"), (6, "ok")]
    assert [(r.seq, r.payload) for r in channels.broadcasts(rows, "room").collect()] == [(1, '{"a":1}')] and channels.broadcasts(rows, "room", "other").count() == 0
    assert [tuple(r) for r in changes.subscribers(channels.by_clients(rows)).collect()] == [("room", 1)]


def test_sinks(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    os.makedirs(feed)
    write_lines(f"{feed}/1.json", [{"topic": "a", "seq": i, "payload": "p"} for i in range(10)])
    stream = spark.readStream.schema(FRAME).json(feed)
    kept, gate = [], threading.Event()

    def slow(batch, number):
        rows = [r.seq for r in batch.collect()]
        gate.wait(120)
        if 100 in rows:
            raise OSError("full")
        kept.extend(rows)

    sink = channels.QueueSink(slow, 12, "seq", f"{tmp_path}/spool")
    query = channels.publish(stream, [sink], f"{tmp_path}/pub", f"{tmp_path}/kept", 100)
    query.processAllAvailable()
    write_lines(f"{feed}/2.json", [{"topic": "a", "seq": i, "payload": "p"} for i in range(20, 30)])
    query.processAllAvailable()  # the writer still holds the first batch: the stream doesn't wait for it
    assert query.isActive and (sink.taken, sink.dropped, sink.queued) == (0, 8, 12) and not sink.flush(0.2)
    gate.set()
    assert sink.flush(60) and (sink.taken, sink.dropped, kept) == (12, 8, [*range(10), 20, 21])
    write_lines(f"{feed}/3.json", [{"topic": "a", "seq": 100, "payload": "p"}])
    query.processAllAvailable()
    assert sink.flush(60) and (sink.taken, sink.dropped, [n for n, _ in sink.failed]) == (12, 9, [2])
    query.stop()
    assert spark.read.json(f"{tmp_path}/kept").count() == 21
    given = []
    channels.debounced(stream.groupBy("topic").agg(F.count(F.lit(1)).alias("n")), lambda rows, number: given.append(rows.first().n), f"{tmp_path}/deb", None).awaitTermination()
    assert given == [21]
    folder = channels.run_folder(str(tmp_path), 0)
    assert folder.endswith("/realtime-19700101T000000Z.jsonl")
    channels.write_run(channels.bridge(stream.select(F.col("payload").alias("raw"))).select(F.col("payload").alias("raw")), folder, f"{tmp_path}/run").awaitTermination()
    assert spark.read.text(folder).count() == 21


def test_delete_and_import(spark, tmp_path):
    root = f"{tmp_path}/store"
    nodes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "x")], "entry string, id long, name string")
    store.write_compact(nodes, ["name"], f"{tmp_path}/compact")
    nodes.write.parquet(f"{tmp_path}/plain")
    assert store.import_scan(spark, f"{tmp_path}/compact", root, "one", ["entry", "id", "name"], ["name"]) == 3
    assert store.import_scan(spark, f"{tmp_path}/plain", root, "two", ["entry", "id"], ["name"]) == 3
    schema = "scan string, saved_at long, nodes long"
    assert [r.scan for r in store.list_scans(spark, root, schema).collect()] == ["two", "one"]
    with pytest.raises(FileExistsError):
        store.import_scan(spark, f"{tmp_path}/plain", root, "two", ["id"], [])
    with pytest.raises(ValueError):
        store.import_scan(spark, f"{tmp_path}/plain", root, "three", ["id", "colour"], [])
    assert store.import_scan(spark, f"{tmp_path}/plain", root, "two", ["id"], [], replace=True) == 3
    assert store.delete_scan(spark, root, "two") and not store.delete_scan(spark, root, "two")
    with pytest.raises(ValueError):
        store.delete_scan(spark, root, "../one")
    assert [r.scan for r in store.list_scans(spark, root, schema).collect()] == ["one"]
    assert sorted((r.id, r["name"]) for r in store.load_entry(spark, root, "one", "a").collect()) == [(1, "x"), (2, "y")]
