"""Aggregations of stack samples: function rollup, call tree, runtime series, what runs now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import settle

RECENT_US, SPIKE_US, MAX_POINTS = 15_000_000, 60_000_000, 120


def _recent_from(samples: DataFrame, span: int) -> DataFrame:
    """One row: the earliest time of the window that ends with the last sample."""
    return samples.agg((F.max("time_us") - span).alias("since"))


def function_rollup(samples: DataFrame) -> DataFrame:
    """One row for each function: inclusive weight once a stack, self weight and ticks of leaves, memory and CPU.

    A stack's repeated names are collapsed inside the row, before anything is
    shuffled, so one partial aggregation by name is the only exchange.
    """
    since = F.broadcast(_recent_from(samples, RECENT_US))
    names = F.transform("frames", lambda f: f["name"])
    once = F.array_distinct(names)
    leaf = F.get(names, F.lit(0))
    rows = samples.crossJoin(since).select("weight_us", "tick_count", "cpu", "memory_bytes", F.greatest("memory_bytes", "memory_peak_bytes").alias("peak"), (F.col("time_us") >= F.col("since")).alias("recent"), leaf.alias("leaf"), F.explode(once).alias("name"))
    own, has = F.col("name") == F.col("leaf"), F.col("memory_bytes") > 0
    out = rows.groupBy("name").agg(
        F.sum("weight_us").alias("cumulative_us"),
        F.coalesce(F.sum(F.when(own, F.col("weight_us"))), F.lit(0)).alias("self_us"),
        F.coalesce(F.sum(F.when(own, F.col("tick_count"))), F.lit(0)).alias("ncalls"),
        F.coalesce(F.sum(F.when(F.col("recent"), F.col("weight_us"))), F.lit(0)).alias("recent_cumulative_us"),
        F.coalesce(F.sum(F.when(F.col("recent") & own, F.col("weight_us"))), F.lit(0)).alias("recent_self_us"),
        F.coalesce(F.sum(F.when(F.col("recent") & own, F.col("tick_count"))), F.lit(0)).alias("recent_ncalls"),
        F.sum(F.when(has, F.col("memory_bytes"))).alias("mem"),
        F.count(F.when(has, 1)).alias("mem_n"),
        F.coalesce(F.max(F.when(has, F.col("peak"))), F.lit(0)).alias("memory_peak_bytes"),
        F.avg(F.when(own, F.col("cpu"))).alias("cpu"),
    )
    mean = F.when(F.col("mem_n") > 0, F.expr("mem div mem_n")).otherwise(F.lit(0))
    percall = F.when(F.col("ncalls") > 0, F.col("self_us") / F.col("ncalls")).otherwise(F.lit(0.0))
    return out.select("name", "cumulative_us", "self_us", "ncalls", percall.alias("percall_us"), "recent_cumulative_us", "recent_self_us", "recent_ncalls", mean.cast("long").alias("memory_mean_bytes"), F.col("memory_peak_bytes").cast("long").alias("memory_peak_bytes"), "cpu")


def call_tree(samples: DataFrame) -> DataFrame:
    """One row for each root-first path prefix: inclusive weight, and self weight and samples of whole paths."""
    path = F.reverse(F.transform("frames", lambda f: f["name"]))
    # equal stacks are summed before their prefixes fan out
    stacks = samples.groupBy(path.alias("path")).agg(F.sum("weight_us").alias("w"), F.count(F.lit(1)).alias("n"))
    spread = stacks.select("w", "n", F.size("path").alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("path"))
    whole = F.size("path") == F.col("len")
    return spread.groupBy("path").agg(F.sum("w").alias("value_us"), F.coalesce(F.sum(F.when(whole, F.col("w"))), F.lit(0)).alias("self_us"), F.coalesce(F.sum(F.when(whole, F.col("n"))), F.lit(0)).alias("ncalls")).select(F.array_join("path", ";").alias("path"), F.size("path").alias("depth"), "value_us", "self_us", "ncalls")


def neighbours(samples: DataFrame, focus: str) -> DataFrame:
    """Callers and callees of a function with the weight of the edges, from adjacent frames."""
    names = F.transform("frames", lambda f: f["name"])
    stacks = samples.groupBy(names.alias("names")).agg(F.sum("weight_us").alias("w"))
    edges = stacks.filter(F.size("names") > 1).select("w", F.explode(F.transform(F.sequence(F.lit(0), F.size("names") - 2), lambda i: F.struct(F.get("names", i).alias("callee"), F.get("names", i + 1).alias("caller")))).alias("e"))
    callers = edges.filter(F.col("e.callee") == focus).select(F.lit("caller").alias("side"), F.col("e.caller").alias("name"), "w")
    callees = edges.filter(F.col("e.caller") == focus).select(F.lit("callee").alias("side"), F.col("e.callee").alias("name"), "w")
    return callers.union(callees).groupBy("side", "name").agg(F.sum("w").alias("total_us"))


def runtime_points(samples: DataFrame) -> DataFrame:
    return samples.filter("time_us is not null").select("seq", "time_us", "memory_bytes", F.greatest("memory_bytes", "memory_peak_bytes").alias("peak"), "cpu")


def runtime_summary(samples: DataFrame) -> DataFrame:
    """One row: peaks, and the reading with the latest time (ties: the later row)."""
    p = runtime_points(samples)
    last = F.max_by(F.struct("memory_bytes", "cpu"), F.struct("time_us", "seq")).alias("l")
    return p.agg(F.max("peak").alias("peak_memory_bytes"), F.max("cpu").alias("peak_cpu"), last, F.count(F.lit(1)).alias("n_points")).select("peak_memory_bytes", "peak_cpu", F.col("l.memory_bytes").alias("current_memory_bytes"), F.col("l.cpu").alias("current_cpu"), "n_points")


def runtime_spikes(samples: DataFrame) -> DataFrame:
    """One row: mean, deviation and band of the last minute, and how many readings exceed mean + 2 deviations."""
    p = runtime_points(samples)
    w = p.crossJoin(F.broadcast(_recent_from(p, SPIKE_US))).filter("time_us >= since and memory_bytes > 0").select("memory_bytes")
    stats = w.agg(F.avg("memory_bytes").alias("mean"), F.stddev_pop("memory_bytes").alias("sigma"), F.min("memory_bytes").alias("low"), F.max("memory_bytes").alias("high"))
    hits = w.crossJoin(F.broadcast(stats)).agg(F.count(F.when((F.col("sigma") > 1) & (F.col("memory_bytes") > F.col("mean") + 2 * F.col("sigma")), 1)).alias("spikes"))
    return stats.crossJoin(F.broadcast(hits))


def runtime_downsample(samples: DataFrame, points: int = MAX_POINTS) -> DataFrame:
    """At most `points` buckets of equal numbers of readings in arrival order.

    Ranks come from range-dealt partitions: only partition totals meet in one place.
    """
    p = runtime_points(samples)
    ranked = global_rank(p, ["seq"])
    n = p.agg(F.count(F.lit(1)).alias("n"))
    b = F.when(F.col("n") <= points, F.col("rank")).otherwise(F.expr(f"((rank + 1) * {points} - 1) div n"))
    rows = ranked.crossJoin(F.broadcast(n)).withColumn("bucket", b.cast("long"))
    return rows.groupBy("bucket").agg(F.max_by("time_us", "rank").alias("time_us"), F.expr("sum(memory_bytes) div count(1)").alias("memory_bytes"), F.max("peak").alias("peak_bytes"), F.avg("cpu").alias("cpu"))


def global_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `rank` from 0 in the order of unique columns, without one window over all rows.

    Rows and the numbers of their ranges are written once, so that sizes and ranks read the same ranges.
    """
    dealt = settle(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    local = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(starts), "_p").withColumn("rank", F.col("_i") + F.col("_s")).drop("_p", "_i", "_s", "_n")


def right_now(samples: DataFrame) -> DataFrame:
    """One row: the stack with the latest event time; equal times: the later arrival."""
    last = F.max_by(F.struct(F.array_join(F.transform("frames", lambda f: f["name"]), ";").alias("stack"), "time_us", "seq"), F.struct("time_us", "seq"))
    return samples.filter("time_us is not null").agg(last.alias("l")).select("l.*")


def hottest_leaves(samples: DataFrame, n: int = 10) -> DataFrame:
    leaf = F.get("frames", F.lit(0))
    label = F.format_string("%s @ %s:%d", leaf["name"], F.coalesce(leaf["file"], F.lit("?")), F.coalesce(leaf["line"], F.lit(0)))
    return samples.groupBy(label.alias("leaf")).agg(F.sum("tick_count").alias("n")).orderBy(F.desc("n"), "leaf").limit(n)


def last_n(rows: DataFrame, topic: str, seq: str, n: int) -> DataFrame:
    """The last n rows of each topic, with their places oldest first (the ring's snapshot)."""
    w = Window.partitionBy(topic)
    kept = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(seq)))).filter(F.col("_r") <= n)
    return kept.withColumn("place", F.row_number().over(w.orderBy(seq))).drop("_r")


def rank_delta(rollup: DataFrame, n: int = 5) -> DataFrame:
    """The top functions of late, and whether they are new, up, down or the same against all time."""
    def top(column: str, name: str) -> DataFrame:
        # a top-n sort first, so that the window ranks n rows only
        few = rollup.select("name", F.col(column).alias("v")).orderBy(F.desc("v"), "name").limit(n)
        return few.select("name", F.row_number().over(Window.orderBy(F.desc("v"), "name")).alias(name))

    j = top("recent_cumulative_us", "recent_rank").join(top("cumulative_us", "all_rank"), "name", "left")
    arrow = F.when(F.col("all_rank").isNull(), "new").when(F.col("recent_rank") < F.col("all_rank"), "up").when(F.col("recent_rank") > F.col("all_rank"), "down").otherwise("same")
    return j.select("name", "recent_rank", F.coalesce("all_rank", F.lit(0)).alias("all_rank"), arrow.alias("arrow"))


def hotspots(stacks: DataFrame, n: int = 20) -> DataFrame:
    """The n names with the most self samples of leaf-first stacks (names, tick_count); a name counts once in a stack."""
    one = stacks.select("tick_count", F.get("names", F.lit(0)).alias("leaf"), F.explode(F.array_distinct("names")).alias("name"))
    sums = one.groupBy("name").agg(F.sum(F.when(F.col("name") == F.col("leaf"), F.col("tick_count")).otherwise(0)).alias("self_samples"), F.sum("tick_count").alias("total_samples"))
    total = stacks.agg(F.sum("tick_count").alias("_all"))
    top = sums.orderBy(F.desc("self_samples"), "name").limit(n)
    return top.crossJoin(F.broadcast(total)).select("name", "self_samples", "total_samples", F.round(F.col("self_samples") * 100.0 / F.col("_all"), 6).alias("percent"))


def share_shift(rollup: DataFrame) -> DataFrame:
    """The name with the most recent inclusive weight, with its percent of recent and of all summed inclusive weight."""
    total = rollup.agg(F.sum("recent_cumulative_us").alias("_r"), F.sum("cumulative_us").alias("_c"))
    top = rollup.orderBy(F.desc("recent_cumulative_us"), "name").limit(1)
    return top.crossJoin(F.broadcast(total)).select("name", F.round(F.col("recent_cumulative_us") * 100.0 / F.col("_r"), 6).alias("recent_percent"), F.round(F.col("cumulative_us") * 100.0 / F.col("_c"), 6).alias("all_percent"))
