"""Profiler events: JSON lines, folded stacks and speedscope documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "struct<name:string,file:string,line:int,qualified_name:string,module:string,is_system:boolean>"
EVENT = (
    "type string, time string, service string, pod string, period_ns bigint, duration_ns bigint, cpu double, memory_bytes bigint, memory_peak_bytes bigint, "
    f"count bigint, frames array<{FRAME}>, samples array<struct<count:bigint,frames:array<{FRAME}>>>, qualname string, file string, line int, status string, _corrupt_record string"
)
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (seq, raw): seq orders lines within and across files."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("raw"))


def parse(lines: DataFrame) -> DataFrame:
    """Parsed events; blank lines, malformed lines and lines with a bad frame or sample go as a whole."""
    e = F.from_json("raw", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.filter(F.length(F.trim("raw")) > 0).select("seq", e.alias("e")).filter("e._corrupt_record is null").select("seq", "e.*")
    nameless = F.exists("frames", lambda f: f["name"].isNull()) | F.exists("samples", lambda s: s["count"].isNull() | F.exists(s["frames"], lambda f: f["name"].isNull()))
    return rows.filter(~F.coalesce(nameless, F.lit(False))).withColumn("time_us", time_us(F.col("time"))).drop("_corrupt_record")


def time_us(time: Column) -> Column:
    """Microseconds of an integer of nanoseconds or an RFC 3339 string; else null."""
    return F.when(time.rlike(r"^-?\d+$"), F.call_function("div", time.try_cast("bigint"), F.lit(1000))).when(time.rlike(RFC3339), F.unix_micros(F.try_to_timestamp(time)))


def valid(events: DataFrame) -> DataFrame:
    """Events that yield samples."""
    trace = F.col("type").isin("wall_trace", "cpu_trace") & (F.col("period_ns") > 0) & (F.col("count") > 0) & (F.size("frames") > 0)
    bundle = F.col("type").isin("wall_profile", "cpu_profile") & (F.col("period_ns") > 0) & (F.size("samples") > 0)
    call = (F.col("type") == "function_call") & (F.col("duration_ns") > 0) & (F.length("qualname") > 0)
    return events.filter(F.coalesce(trace, F.lit(False)) | F.coalesce(bundle, F.lit(False)) | F.coalesce(call, F.lit(False)))


def stack_samples(events: DataFrame) -> DataFrame:
    """Normalised samples (seq, ord, frames leaf first, weight_us, tick_count, cpu, time_us, memory_bytes, memory_peak_bytes, service, pod)."""
    shared = ["seq", "cpu", "time_us", "memory_bytes", "memory_peak_bytes", "service", "pod"]

    def weight(count: Column) -> Column:
        return F.call_function("div", F.coalesce(F.try_multiply(count, F.col("period_ns")), F.lit((1 << 63) - 1)), F.lit(1000))

    ok = valid(events)
    traces = ok.filter(F.col("type").endswith("_trace")).select(*shared, F.lit(0).alias("ord"), "frames", weight(F.col("count")).alias("weight_us"), F.col("count").alias("tick_count"))
    spread = ok.filter(F.col("type").endswith("_profile")).select(*shared, "period_ns", F.posexplode("samples").alias("ord", "s")).filter("s.count > 0 and size(s.frames) > 0")
    bundles = spread.select(*shared, "ord", F.col("s.frames").alias("frames"), weight(F.col("s.count")).alias("weight_us"), F.col("s.count").alias("tick_count"))
    bare = F.element_at(F.split("qualname", r"\."), -1)
    frame = F.struct(bare.alias("name"), F.col("file").alias("file"), F.col("line").alias("line"), F.col("qualname").alias("qualified_name"), F.lit(None).cast("string").alias("module"), F.lit(None).cast("boolean").alias("is_system"))
    calls = ok.filter("type = 'function_call'").select(*shared, F.lit(0).alias("ord"), F.array(frame).alias("frames"), F.call_function("div", F.col("duration_ns"), F.lit(1000)).alias("weight_us"), F.lit(1).cast("long").alias("tick_count"))
    return traces.unionByName(bundles).unionByName(calls)


def folded(lines: DataFrame) -> DataFrame:
    """Rows (stack, n) of folded text, "a;b;c n"; lines without a numeric count are skipped."""
    m = F.regexp_extract(F.trim("raw"), r"^(.*\S)\s+(\d+)$", 1)
    return lines.select(m.alias("stack"), F.regexp_extract(F.trim("raw"), r"^(.*\S)\s+(\d+)$", 2).try_cast("long").alias("n")).filter("n is not null and stack <> ''")


def speedscope(spark: SparkSession, path: str) -> DataFrame:
    """Rows (stack, n) of the first profile of a speedscope document; a missing weight is 1."""
    schema = "shared struct<frames:array<struct<name:string>>>, profiles array<struct<samples:array<array<int>>,weights:array<bigint>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True).select(F.col("shared.frames").alias("f"), F.get("profiles", F.lit(0)).alias("p"))
    rows = doc.select("f", "p.weights", F.posexplode("p.samples").alias("i", "ids"))
    names = F.transform("ids", lambda k: F.get("f", k)["name"])
    return rows.select(F.array_join(names, ";").alias("stack"), F.coalesce(F.get("weights", F.col("i")), F.lit(1)).alias("n")).groupBy("stack").agg(F.sum("n").alias("n"))
