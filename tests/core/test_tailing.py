"""The tail keeps part of a line back until it ends, reads each line once, and notices files that were replaced, on more than one file system."""

import json
import os
import time

from perfloom.streaming import tailing


def lines(reader, start, end):
    return [r[2] for span in reader.partitions(start, end) for r in reader.read(span)]


def test_whole_lines(tmp_path):
    path = str(tmp_path / "a.jsonl")
    with open(path, "wb") as f:
        f.write(b"one\ntwo\r\nthr")
    system = tailing.file_system(path)[0]
    assert tailing.whole_until(system, path, 12, 0) == 9 and tailing.whole_until(system, path, 12, 9) == 9
    with open(path, "ab") as f:
        f.write(b"ee\n" + b"x" * (3 * tailing.STEP))
    assert tailing.whole_until(system, path, os.path.getsize(path), 9) == 15
    reader = tailing.TailReader(str(tmp_path / "*.jsonl"))
    end = reader.latestOffset()
    assert lines(reader, {}, end) == ["one", "two", "three"] and reader.partitions(end, end)[0].path == ""


def test_places_and_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tailing, "PART", 5)
    text = "a\n\nbcdefghijklm\nünï\n" * 3
    (tmp_path / "a.log").write_bytes(text.encode() + b"rest")
    reader = tailing.TailReader(f"file://{tmp_path}/*.log")
    got = [(r[1], r[2]) for s in reader.partitions({}, reader.latestOffset()) for r in reader.read(s)]
    raw = text.encode()
    assert got == [(at, x) for at, x in ((len(b"\n".join(raw.split(b"\n")[:i])) + (i > 0), x.decode()) for i, x in enumerate(raw.split(b"\n"))) if x]


def test_replaced_files_begin_anew(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("old one\nold two\n")
    reader = tailing.TailReader(str(tmp_path / "*.log"))
    first = json.loads(json.dumps(reader.latestOffset()))  # as a checkpoint keeps it
    assert lines(reader, {}, first) == ["old one", "old two"]
    path.write_text("new one that is longer\nnew two\nnew three\n")
    second = json.loads(json.dumps(reader.latestOffset()))
    assert lines(reader, first, second) == ["new one that is longer", "new two", "new three"]
    path.write_text("x\n")
    third = reader.latestOffset()
    assert lines(reader, second, third) == ["x"]
    # a new reader goes on where the checkpoint is
    again = tailing.TailReader(str(tmp_path / "*.log"))
    assert again.partitions(first, second)[0].end == second[str(path)][0]
    with open(path, "a") as f:
        f.write("y\n")
    again.seen = json.loads(json.dumps(third))
    assert lines(again, third, again.latestOffset()) == ["y"]
    os.remove(path)
    gone = again.latestOffset()
    assert gone == {} and lines(again, third, gone) == []


def test_a_second_scheme(tmp_path, monkeypatch):
    """A store of a user's own: the authority names a folder below the test's."""
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "a.log").write_text("in the store\n")
    (tmp_path / "own_store.py").write_text(f"from pyarrow import fs\n\ndef opened(scheme, authority):\n    assert scheme == 'own'\n    return fs.SubTreeFileSystem({str(tmp_path)!r} + '/' + authority, fs.LocalFileSystem())\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    reader = tailing.TailReader("own://bucket/*.log", "own_store:opened")
    end = reader.latestOffset()
    assert [r for s in reader.partitions({}, end) for r in reader.read(s)] == [("own://bucket/a.log", 0, "in the store")] or lines(reader, {}, end) == ["in the store"]


def test_stream(spark, tmp_path):
    spark.dataSource.register(tailing.TailSource)
    path, got = str(tmp_path / "a.jsonl"), []
    with open(path, "w") as f:
        f.write("a\n\nb\npart")

    def start():
        return spark.readStream.format("line_tail").option("path", f"file://{tmp_path}/*.jsonl").load().writeStream.foreachBatch(lambda df, n: got.extend(r.raw for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def wait(n):
        end = time.time() + 60
        while len(got) < n and time.time() < end:
            time.sleep(0.1)

    query = start()
    wait(2)
    assert got == ["a", "b"]
    with open(path, "a") as f:
        f.write("ial\nc\n")
    wait(4)
    query.stop()
    assert got == ["a", "b", "partial", "c"]
    with open(path, "a") as f:
        f.write("d\n")
    query = start()  # from the checkpoint: nothing comes twice
    wait(5)
    query.stop()
    assert got == ["a", "b", "partial", "c", "d"]
