"""Profile queries over samples derived from `events`, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from .registry import ORACLES, QUERIES


def samples(spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")

    def frame(name, file, line):
        return F.struct(name.alias("name"), file.alias("file"), line.cast("int").alias("line"))

    none = F.lit(None).cast("string")
    frames = F.array(
        frame(F.col("event_type"), F.concat(F.col("event_type"), F.lit(".py")), F.length("event_type")),
        frame(F.concat(F.lit("user_"), F.col("user_id") % 20), none, F.lit(None)),
        frame(F.concat(F.lit("session_"), F.col("user_id") % 5), none, F.lit(None)),
        frame(F.lit("main"), F.lit("main.py"), F.lit(1)),
    )
    tick = 1 + F.col("event_id") % 5
    return e.select(F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), tick.alias("tick_count"), (tick * 10000).alias("weight_us"), frames.alias("frames"), F.floor(F.col("value") * 1000).cast("long").alias("memory_bytes"), F.lit(0).cast("long").alias("memory_peak_bytes"), (F.col("value") / 10).alias("cpu"), "event_type")


S = """WITH s AS (SELECT event_id AS seq, epoch_us(ts) AS time_us, 1 + event_id % 5 AS tick, (1 + event_id % 5) * 10000 AS w, event_type, [event_type, 'user_' || (user_id % 20), 'session_' || (user_id % 5), 'main'] AS names, CAST(floor(value * 1000) AS BIGINT) AS mem, value / 10 AS cpu FROM events)"""
ROLL = S + """, r AS (SELECT s.*, time_us >= (SELECT max(time_us) FROM s) - 15000000 AS recent, unnest(list_distinct(names)) AS name FROM s),
f AS (SELECT name, CAST(sum(w) AS BIGINT) AS cumulative_us, CAST(coalesce(sum(w) FILTER (name = names[1]), 0) AS BIGINT) AS self_us, CAST(coalesce(sum(tick) FILTER (name = names[1]), 0) AS BIGINT) AS ncalls,
CAST(coalesce(sum(w) FILTER (recent), 0) AS BIGINT) AS recent_cumulative_us, CAST(coalesce(sum(w) FILTER (recent AND name = names[1]), 0) AS BIGINT) AS recent_self_us, CAST(coalesce(sum(tick) FILTER (recent AND name = names[1]), 0) AS BIGINT) AS recent_ncalls,
CAST(coalesce(sum(mem) FILTER (mem > 0) // count(*) FILTER (mem > 0), 0) AS BIGINT) AS memory_mean_bytes, CAST(coalesce(max(mem) FILTER (mem > 0), 0) AS BIGINT) AS memory_peak_bytes, round(avg(cpu) FILTER (name = names[1]), 6) AS cpu FROM r GROUP BY name)"""


def add(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


add("hottest_leaf_frames", lambda s, d: P.hottest_leaves(samples(s, d)), S + " SELECT event_type || ' @ ' || event_type || '.py:' || length(event_type) AS leaf, CAST(sum(tick) AS BIGINT) AS n FROM s GROUP BY 1 ORDER BY n DESC, leaf LIMIT 10")
add("function_rollup", lambda s, d: P.function_rollup(samples(s, d)).select("name", "cumulative_us", "self_us", "ncalls", F.round("percall_us", 6).alias("percall_us"), "memory_mean_bytes", "memory_peak_bytes", F.round("cpu", 6).alias("cpu")), ROLL + " SELECT name, cumulative_us, self_us, ncalls, round(CASE WHEN ncalls > 0 THEN self_us / ncalls ELSE 0.0 END, 6) AS percall_us, memory_mean_bytes, memory_peak_bytes, cpu FROM f")
add("function_recent", lambda s, d: P.function_rollup(samples(s, d)).select("name", "recent_cumulative_us", "recent_self_us", "recent_ncalls"), ROLL + " SELECT name, recent_cumulative_us, recent_self_us, recent_ncalls FROM f")
add("call_tree_paths", lambda s, d: P.call_tree(samples(s, d)), S + ", p AS (SELECT w, unnest(generate_series(1, 4)) AS k, list_reverse(names) AS path FROM s) SELECT array_to_string(path[1:k], ';') AS path, CAST(k AS INT) AS depth, CAST(sum(w) AS BIGINT) AS value_us, CAST(coalesce(sum(w) FILTER (k = 4), 0) AS BIGINT) AS self_us, CAST(count(*) FILTER (k = 4) AS BIGINT) AS ncalls FROM p GROUP BY 1, 2")
add("caller_callee_pivot", lambda s, d: P.neighbours(samples(s, d), "session_3"), S + ", e AS (SELECT w, names[i] AS callee, names[i + 1] AS caller FROM s, (SELECT unnest([1, 2, 3]) AS i)) SELECT 'caller' AS side, caller AS name, CAST(sum(w) AS BIGINT) AS total_us FROM e WHERE callee = 'session_3' GROUP BY 2 UNION ALL SELECT 'callee', callee, CAST(sum(w) AS BIGINT) FROM e WHERE caller = 'session_3' GROUP BY 2")
add("runtime_summary", lambda s, d: P.runtime_summary(samples(s, d)), S + " SELECT max(mem) AS peak_memory_bytes, max(cpu) AS peak_cpu, arg_max(mem, (time_us, seq)) AS current_memory_bytes, arg_max(cpu, (time_us, seq)) AS current_cpu, count(*) AS n_points FROM s")
add("runtime_spikes", lambda s, d: P.runtime_spikes(samples(s, d)).select(F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"), "low", "high", "spikes"), S + ", w AS (SELECT mem FROM s WHERE mem > 0 AND time_us >= (SELECT max(time_us) FROM s) - 60000000), t AS (SELECT avg(mem) m, stddev_pop(mem) sd, min(mem) low, max(mem) high FROM w) SELECT round(m, 4) AS mean, round(sd, 4) AS sigma, low, high, (SELECT count(*) FROM w WHERE sd > 1 AND mem > m + 2 * sd) AS spikes FROM t")
add("runtime_downsample", lambda s, d: P.runtime_downsample(samples(s, d)).withColumn("cpu", F.round("cpu", 6)), S + ", r AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM s), b AS (SELECT *, CASE WHEN n <= 120 THEN i ELSE ((i + 1) * 120 - 1) // n END AS bucket FROM r) SELECT CAST(bucket AS BIGINT) AS bucket, arg_max(time_us, i) AS time_us, CAST(sum(mem) // count(*) AS BIGINT) AS memory_bytes, max(mem) AS peak_bytes, round(avg(cpu), 6) AS cpu FROM b GROUP BY bucket")
add("right_now", lambda s, d: P.right_now(samples(s, d)), S + " SELECT array_to_string(names, ';') AS stack, time_us, seq FROM s ORDER BY time_us DESC, seq DESC LIMIT 1")
add("topic_last_n", lambda s, d: P.last_n(s.read.parquet(f"{d}/events.parquet").select("event_type", "event_id"), "event_type", "event_id", 200), "SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INT) AS place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) r FROM events) WHERE r <= 200")
add("recent_rank_delta", lambda s, d: P.rank_delta(P.function_rollup(samples(s, d))), ROLL + ", a AS (SELECT name, row_number() OVER (ORDER BY recent_cumulative_us DESC, name) AS r FROM f), b AS (SELECT name, row_number() OVER (ORDER BY cumulative_us DESC, name) AS r FROM f) SELECT a.name, CAST(a.r AS INT) AS recent_rank, CAST(coalesce(b.r, 0) AS INT) AS all_rank, CASE WHEN b.r IS NULL THEN 'new' WHEN a.r < b.r THEN 'up' WHEN a.r > b.r THEN 'down' ELSE 'same' END AS arrow FROM a LEFT JOIN (SELECT * FROM b WHERE r <= 5) b USING (name) WHERE a.r <= 5")
