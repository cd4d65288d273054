"""Texts as rows: ingest bodies, unified diffs, change lists, container statistics, log listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def log_files(spark: SparkSession, *folders: str) -> DataFrame:
    """Rows (path, source, size, modified) of *.log and *.jsonl files in the folders, newest first; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders)).select("path", "length", "modificationTime")
    source = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return found.filter(F.lower("path").rlike(r"\.(log|jsonl)$")).select("path", source.alias("source"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def metadata_header(lines: DataFrame) -> DataFrame:
    """The first line (seq, raw) that is a profile_metadata event; no row without one."""
    return lines.filter(F.get_json_object("raw", "$.type") == "profile_metadata").orderBy("seq").limit(1)


def body_events(bodies: DataFrame) -> DataFrame:
    """Rows (id, pos, raw) of request bodies (id, body): an object, an array of objects, or lines of objects.

    Parts that are no JSON object go; a null or blank body has no row.
    """
    body = F.trim("body")
    array = F.from_json(body, "array<string>")
    parts = F.when(body.startswith("["), F.coalesce(array, F.array().cast("array<string>"))).when(F.get_json_object(body, "$").isNotNull() & ~body.rlike(r"\n\s*\{"), F.array(body)).otherwise(F.split(body, "\n"))
    rows = bodies.filter(F.length(body) > 0).select("id", F.posexplode(parts).alias("pos", "raw")).withColumn("raw", F.trim("raw"))
    return rows.filter(F.col("raw").startswith("{") & F.try_parse_json("raw").isNotNull())


def accepted(lines: DataFrame) -> DataFrame:
    """Lines (raw) fit to be appended: trimmed, neither empty nor invalid JSON."""
    return lines.withColumn("raw", F.trim("raw")).filter((F.length("raw") > 0) & F.try_parse_json("raw").isNotNull())


#: Fixed value: bytes of a line that may be appended.
LINE_BYTES = 4 << 20


def append_lines(lines: DataFrame, path: str) -> int:
    """Appends the accepted lines as text; returns how many were left out: invalid, empty or over LINE_BYTES. The write itself counts them."""
    from pyspark.sql import Observation

    seen = Observation()
    text = F.trim("raw")
    good = F.coalesce((F.length(text) > 0) & F.try_parse_json(text).isNotNull() & (F.octet_length(text) <= LINE_BYTES), F.lit(False))
    told = lines.select(text.alias("raw"), good.alias("ok")).observe(seen, F.count(F.when(~F.col("ok"), 1)).alias("left_out"))
    told.filter("ok").select("raw").write.mode("append").text(path)
    return seen.get["left_out"]


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Commentable lines (id, path, line, added) of unified diffs (id, diff): those of the new side, context included.

    Line numbers are the hunk's start plus the new-side lines since; a task holds one diff's lines.
    """
    rows = diffs.select("id", F.posexplode(F.split("diff", "\n")).alias("pos", "text"))
    till = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("text").startswith("@@ ")
    rows = rows.withColumn("cut", F.sum(F.when(head | F.col("text").startswith("diff "), 1).otherwise(0)).over(till))
    start = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1).try_cast("long")
    in_cut = Window.partitionBy("id", "cut").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(head, start)).over(in_cut)
    name = F.when(~F.coalesce(begun.isNotNull(), F.lit(False)) & F.col("text").startswith("+++ "), F.regexp_replace(F.substring("text", 5, 1 << 20), r"^b/|\t.*$", ""))
    rows = rows.withColumn("begun", begun).withColumn("path", name).withColumn("path", F.last("path", ignorenulls=True).over(till))
    new = F.col("begun").isNotNull() & ~head & F.col("text").rlike(r"^[+ ]")
    line = F.col("begun") + F.sum(F.when(new, 1).otherwise(0)).over(in_cut) - 1
    return rows.withColumn("line", line).filter(new).filter("path is not null and path <> '/dev/null'").select("id", "path", "line", F.col("text").startswith("+").alias("added"))


def name_status(lines: DataFrame) -> DataFrame:
    """Rows (path, status, old_path) of tab-separated change lists; renames carry a score and two paths."""
    f = F.split("raw", "\t")
    code = F.substring(F.get(f, F.lit(0)), 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "removed").when(code == "R", "renamed").when(code == "C", "copied").otherwise("modified")
    moved = code.isin("R", "C")
    return lines.filter(F.size(f) >= 2).select(F.when(moved, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"), status.alias("status"), F.when(moved, F.get(f, F.lit(1))).alias("old_path"))


def byte_count(text: Column) -> Column:
    """Bytes of "1.5GiB", "20kB" or "7B": SI and IEC units; null for anything else."""
    number, unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]+)\s*$", 1).try_cast("double"), F.lower(F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]+)\s*$", 2))
    scale = F.when(unit == "b", 1.0)
    for k, c in enumerate("kmgt", start=1):
        scale = scale.when(unit == f"{c}b", float(1000**k)).when(unit == f"{c}ib", float(1024**k))
    return F.round(number * scale).cast("long")


def container_stats(lines: DataFrame) -> DataFrame:
    """Rows (name, cpu_percent, memory, memory_limit, rx, tx, block_read, block_write) of JSON statistics lines (raw)."""

    def half(key: str, i: int) -> Column:
        return byte_count(F.get(F.split(F.get_json_object("raw", f"$.{key}"), "/"), F.lit(i)))

    cpu = F.regexp_replace(F.get_json_object("raw", "$.CPUPerc"), "%", "").try_cast("double")
    pairs = [("MemUsage", "memory", "memory_limit"), ("NetIO", "rx", "tx"), ("BlockIO", "block_read", "block_write")]
    return lines.select(F.get_json_object("raw", "$.Name").alias("name"), cpu.alias("cpu_percent"), *[half(k, i).alias(n) for k, *names in pairs for i, n in enumerate(names)]).filter("name is not null")
