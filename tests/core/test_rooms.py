"""Streams with keyed state: history then live, late frames, restarts; the rollup's recent window in any order of files."""

import json
import random
import time

from perfloom.operators import profile
from perfloom.streaming import live, recent, rooms


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (folder / f".{name}").rename(folder / name)


def frame(seq, topic="a"):
    return {"topic": topic, "kind": "frame", "seq": seq, "payload": f"{topic}{seq}"}


def client(name, kind="subscribe", topic="a", **more):
    return {"topic": topic, "kind": kind, "client": name, "seq": 0, **more}


def opened(spark, folder, checkpoint, got, cap=4):
    stream = rooms.rooms(spark.readStream.schema(rooms.SIGNALS).json(str(folder)), cap)
    return stream.writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(checkpoint)).trigger(processingTime="100 milliseconds").start()


def until(query, test, seconds=90):
    end = time.time() + seconds
    while not test() and time.time() < end and query.isActive:
        time.sleep(0.1)
    if query.exception():
        raise query.exception()
    assert test()


def test_history_then_live_late_frames_and_restart(spark, tmp_path):
    feed, got = tmp_path / "feed", []
    put(feed, "1", [frame(i) for i in range(10, 17)] + [frame(1, "b")])
    query = opened(spark, feed, tmp_path / "c", got)
    query.processAllAvailable()
    assert got == []  # nobody listens yet
    put(feed, "2", [client("x"), frame(17)])
    until(query, lambda: len(got) >= 5)
    assert [(r[2], r[4]) for r in got] == [("history", 13), ("history", 14), ("history", 15), ("history", 16), ("live", 17)]
    # late: smaller than all that was given, and one of them sent again
    put(feed, "3", [frame(2), frame(17)])
    until(query, lambda: len(got) >= 6)
    query.processAllAvailable()
    assert [(r[1], r[2], r[3], r[4]) for r in got[5:]] == [("x", "live", 9, 2)] and query.isActive
    query.stop()
    # while it is down: more frames, another client, one that comes back with a number it has
    put(feed, "4", [frame(18), client("y"), client("z", after=8)])
    query = opened(spark, feed, tmp_path / "c", got)
    until(query, lambda: len(got) >= 14)
    query.processAllAvailable()
    more = sorted((r[1], r[2], r[4]) for r in got[6:])
    assert more == sorted([("x", "live", 18), ("y", "live", 18), ("z", "live", 18), ("y", "history", 15), ("y", "history", 16), ("y", "history", 17), ("y", "history", 2), ("z", "history", 2)])
    put(feed, "5", [client("x", "leave"), client("y", "leave"), {"topic": None, "kind": "frame", "seq": 1}, {"topic": "a", "kind": "frame"}, frame(19)])
    until(query, lambda: len(got) >= 15)
    query.processAllAvailable()
    query.stop()
    assert [(r[1], r[4]) for r in got[14:]] == [("z", 19)]


def event(rng, second):
    frames = [{"name": rng.choice("fghk")} for _ in range(rng.randrange(1, 5))]
    e = {"type": "wall_trace", "period_ns": 1_000_000, "count": rng.randrange(1, 4), "frames": frames, "time": str(second * 1_000_000_000 + rng.randrange(10**9))}
    if rng.random() < 0.5:
        e |= {"memory_bytes": rng.randrange(1000), "memory_peak_bytes": rng.choice([None, 700])}
    if rng.random() < 0.5:
        e["cpu"] = rng.randrange(64) / 64
    if rng.random() < 0.1:
        e["time"] = "never"
    return e


def test_recent_window_in_state(spark, tmp_path):
    rng = random.Random(9)
    files = [[event(rng, s) for s in range(a, a + 12)] for a in (0, 10, 33, 52, 25)]  # out of order, the last is late
    files[2] = [{**e, "frames": [{"name": "only"}]} for e in files[2]]
    feed, want = tmp_path / "feed", None
    for k, rows in enumerate(files):
        put(feed, f"{k}.jsonl", rows)
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(feed)).withColumnRenamed("value", "raw")
        recent.keep(recent.functions(lines), str(tmp_path / "kept"), str(tmp_path / "c"), None).awaitTermination()
        got = {r.name: r for r in recent.as_of(recent.latest(spark, str(tmp_path / "kept"))).collect()}
        table = spark.read.text(str(feed)).withColumnRenamed("value", "raw")
        want = {r.name: r for r in profile.function_rollup(live.samples_of(table)).collect()}
        assert got.keys() == want.keys()
        for name, r in want.items():
            assert [x for x in got[name] if not isinstance(x, float)] == [x for x in r if not isinstance(x, float)], (k, name)
            assert abs((got[name].cpu or 0) - (r.cpu or 0)) < 1e-9 and got[name].percall_us == r.percall_us
    assert any(r.recent_cumulative_us == 0 for r in want.values()) and any(r.recent_cumulative_us for r in want.values())
    assert all(s.time_us >= r.last_us - profile.RECENT_US for r in recent.latest(spark, str(tmp_path / "kept")).collect() for s in r.slices)


def test_debounced_while_it_goes_on(spark, tmp_path):
    """A running aggregate is given again only when rows came, and its last state always; the stream goes on between."""
    from pyspark.sql import functions as F

    from perfloom.streaming import channels

    feed, given = tmp_path / "feed", []
    put(feed, "1", [frame(i) for i in range(3)])
    rows = spark.readStream.schema(rooms.SIGNALS).json(str(feed))
    query = channels.debounced(rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n")), lambda b, n: given.append(sorted((r.topic, r.n) for r in b.collect())), str(tmp_path / "c"), 100)
    query.processAllAvailable()
    time.sleep(1)
    assert given == [[("a", 3)]] and query.isActive
    put(feed, "2", [])  # a file without rows changes nothing
    query.processAllAvailable()
    assert len(given) == 1
    put(feed, "3", [frame(5, "b"), frame(9)])
    query.processAllAvailable()
    query.stop()
    assert given == [[("a", 3)], [("a", 4), ("b", 1)]]


def test_teed_while_it_goes_on(spark, tmp_path):
    feed, first, second, told = tmp_path / "feed", [], [], []

    def fails(batch, number):
        second.append(batch.count())
        raise ValueError("no")

    put(feed, "1", [frame(1)])
    query = live.tee(spark.readStream.schema(rooms.SIGNALS).json(str(feed)), lambda b, n: first.append(b.count()), [fails], str(tmp_path / "c"), lambda k, e: told.append((k, str(e))), 100)
    query.processAllAvailable()
    put(feed, "2", [frame(2), frame(3)])
    query.processAllAvailable()
    assert query.isActive and first == second == [1, 2] and told == [(0, "no")] * 2
    query.stop()
