"""Queries that write to a fresh folder of the shared ones and read back: logs, scans and their projections, caches, compact reports, imports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import settle, shared_folder
from ..sources import events, store, texts
from .joins import add, rows


def fresh(spark) -> str:
    return f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"


def gone(df, folder: str):
    """The rows, when the folder is read no more and removed."""
    out = settle(df)
    at, fs = store._path(df.sparkSession, folder)
    fs.delete(at, True)
    return out


# ---- logs: a line for each event, some of them no JSON or blank
LINES = """SELECT event_id, CASE event_id % 11 WHEN 0 THEN '  ' WHEN 1 THEN concat('{"cut": ', CAST(event_id AS VARCHAR(20))) WHEN 2 THEN 'plain text' ELSE concat(' {"id":', CAST(event_id AS VARCHAR(20)), ',"type":"', event_type, '"} ') END AS raw FROM events"""
GOOD = "SELECT event_id, trim(raw) AS raw FROM ({}) WHERE event_id % 11 > 2".format(LINES)


def appended(s, d):
    folder = fresh(s)
    lines = rows(s, d, LINES)
    for half in (0, 1):  # two appends to one log
        texts.append_lines(lines.filter(F.col("event_id") % 2 == half).select("raw"), folder)
    return gone(events.read_lines(s, folder).select("raw"), folder)


def replayed(s, d):
    folder = fresh(s)
    rows(s, d, LINES).select(F.col("raw").alias("value")).write.text(folder)
    return gone(store.replay(events.read_lines(s, folder), "seq"), folder)


add("appended_lines", appended, f"SELECT raw FROM ({GOOD})")
add("log_replay", replayed, f"SELECT raw FROM ({GOOD})")


def skipped(s, d):
    folder = fresh(s)
    left = [texts.append_lines(rows(s, d, LINES).filter(F.col("event_id") % 5 == k).select("raw"), folder) for k in range(5)]
    return gone(s.createDataFrame(list(enumerate(left)), "part int, left_out long"), folder)


add("append_left_out", skipped, "SELECT (event_id % 5)::INT AS part, count(*) FILTER (event_id % 11 < 3) AS left_out FROM events GROUP BY 1")

# ---- folded stacks and listings
STACKS = "SELECT event_type AS stack, event_id % 4 AS n, event_id FROM events"


def stacks(s, d):
    folder = fresh(s)
    text = F.when(F.col("event_id") % 9 == 0, F.concat("stack", F.lit(" many"))).otherwise(F.concat(F.lit("main;"), "stack", F.lit(" "), F.col("n").cast("string")))
    rows(s, d, STACKS).select(text.alias("value")).write.text(f"{folder}/a.folded")
    return gone(store.read_stacks(s, f"{folder}/a.folded").groupBy("stack").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lines")), folder)


add("stack_files", stacks, f"SELECT 'main;' || stack AS stack, sum(n)::BIGINT AS n, count(*) AS lines FROM ({STACKS}) WHERE event_id % 9 > 0 GROUP BY 1")


def listed(s, d):
    """A folder of logs for each type of event, and one that is no log; sizes are summed, as writers choose the number of files."""
    folder = fresh(s)
    kinds = rows(s, d, "SELECT event_type, CAST(event_id AS VARCHAR(20)) AS raw FROM events")
    kinds.write.partitionBy("event_type").option("compression", "none").text(folder)
    path = s._jvm.org.apache.hadoop.fs.Path
    _, fs = store._path(s, folder)
    for at in fs.listStatus(path(folder)):
        if at.isDirectory():
            for k, f in enumerate(x for x in fs.listStatus(at.getPath()) if x.getPath().getName().startswith("part-")):
                name = f.getPath().getName()
                fs.rename(f.getPath(), path(at.getPath(), f"{k}-{name.removesuffix('.txt')}.{'LOG' if k % 2 else 'jsonl'}"))
    _, own = store._path(s, folder)
    own.create(path(f"{folder}/event_type=none/notes.txt")).close()
    found = texts.log_files(s, folder)
    return gone(found.groupBy("source").agg(F.sum("size").alias("bytes")).select(F.regexp_replace("source", "^event_type=", "").alias("event_type"), "bytes"), folder)


add("log_listing", listed, "SELECT event_type, sum(length(event_id::VARCHAR) + 1)::BIGINT AS bytes FROM events GROUP BY 1")

# ---- scans: the nodes of two scans are the parts of either size; one is deleted, one taken from elsewhere
NODES = "SELECT p_brand AS entry, p_partkey AS id, p_name AS name, p_type AS kind, p_size % 2 AS half FROM part"


def scans(s, d, folder):
    nodes = rows(s, d, NODES)
    for k, name in enumerate(("even", "odd", "doomed")):
        meta = s.createDataFrame([(k, f"t{k}")], "saved_at long, title string")
        store.save_scan(name, nodes.filter(F.col("half") == k % 2).drop("half"), meta, folder)
    store.delete_scan(s, folder, "doomed")
    return folder


def scan_list(s, d):
    folder = scans(s, d, fresh(s))
    return gone(store.list_scans(s, folder, "scan string, saved_at long, title string"), folder)


def scan_summary(s, d):
    folder = scans(s, d, fresh(s))
    found = None
    for name in ("even", "odd"):
        own = s.read.parquet(f"{folder}/{name}/summary").withColumn("scan", F.lit(name))
        found = own if found is None else found.unionByName(own)
    return gone(store.scan_index(found, "entry"), folder)


def scan_entry(s, d):
    folder = scans(s, d, fresh(s))
    return gone(store.load_entry(s, folder, "odd", "Brand#13").select("entry", "id", "name", "kind"), folder)


def scan_imported(s, d):
    folder = fresh(s)
    store.write_compact(rows(s, d, NODES).drop("half"), ["name", "kind"], f"{folder}/elsewhere")
    store.import_scan(s, f"{folder}/elsewhere", f"{folder}/store", "taken", ["entry", "id", "name", "kind"], ["name", "kind"])
    found = s.read.parquet(f"{folder}/store/taken/entries").groupBy("entry", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    return gone(found, folder)


add("scan_list", scan_list, "SELECT * FROM (VALUES ('even', 0::BIGINT, 't0'), ('odd', 1::BIGINT, 't1')) v(scan, saved_at, title)")
add("scan_summary", scan_summary, f"SELECT CASE WHEN half = 0 THEN 'even' ELSE 'odd' END AS scan, entry, count(*) AS nodes FROM ({NODES}) GROUP BY 1, 2")
add("scan_entry", scan_entry, f"SELECT entry, id, name, kind FROM ({NODES}) WHERE half = 1 AND entry = 'Brand#13'")
add("scan_imported", scan_imported, f"SELECT entry, kind, count(*) AS n, min(name) AS first FROM ({NODES}) GROUP BY 1, 2")


def runtime_cache(s, d):
    folder = fresh(s)
    store.save_table(rows(s, d, "SELECT p_partkey AS id, p_type AS name FROM part"), folder)
    return gone(s.read.parquet(folder).groupBy("name").agg(F.count(F.lit(1)).alias("n")), folder)


add("runtime_cache", runtime_cache, "SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1")
