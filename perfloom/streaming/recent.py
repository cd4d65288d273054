"""The function rollup as a stream, with its recent slice: the same columns as the batch rollup over the same lines.

State is a row for each function: sums for all time, and the sums of its last 15 seconds by event time. The recent window ends
with the latest event of any function, which is never before that of the function itself: what a function's own window
has dropped, no later window can ask for. So the state is bounded by the distinct event times of a window, late
events go where they belong, and the order of files changes nothing. `as_of` reads the window off the rows of
all functions.

Defined cases: a sample without a time counts for all time only; lines that don't parse go; a function that gets nothing new keeps its row
and its recent columns fall to zero as the window moves on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.profile import RECENT_US
from .channels import every
from .live import samples_of
from .rooms import keyed_state

SUMS = "cumulative_us long, self_us long, ncalls long, mem long, mem_n long, peak long, cpu_sum double, cpu_n long, last_us long"
SLICES = "array<struct<time_us:bigint,cumulative_us:bigint,self_us:bigint,ncalls:bigint>>"


class Functions(StatefulProcessor):
    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", SUMS)
        self.slices = handle.getListState("slices", "time_us long, cumulative_us long, self_us long, ncalls long")

    def handleInputRows(self, key: tuple, rows: Iterator, timers) -> Iterator:  # noqa: N802
        import pandas as pd

        total = list(self.sums.get()) if self.sums.exists() else [0, 0, 0, 0, 0, 0, 0.0, 0, None]
        times = {r[0]: list(r[1:]) for r in self.slices.get()}
        for b in rows:
            for i, c in enumerate(("weight_us", "own_us", "own_ticks", "mem", "mem_n", "cpu_sum", "cpu_n")):
                at = i if i < 5 else i + 1
                total[at] += b[c].sum().item()
            total[5] = max(total[5], int(b["peak"].max()))
            timed = b[b["time_us"].notna()]
            if len(timed):
                total[8] = max(total[8] if total[8] is not None else -(1 << 62), int(timed["time_us"].max()))
                for t, *x in timed.groupby("time_us")[["weight_us", "own_us", "own_ticks"]].sum().itertuples():
                    have = times.setdefault(int(t), [0, 0, 0])
                    for k in range(3):
                        have[k] += int(x[k])
            if total[8] is not None:
                times = {t: x for t, x in times.items() if t >= total[8] - self.span}
        self.sums.update(tuple(total))
        kept = [(t, *x) for t, x in sorted(times.items())]
        if kept:
            self.slices.put(kept)
        out = pd.DataFrame([[key[0], *total]], columns=["name", *[c.split()[0] for c in SUMS.split(", ")]])
        out["slices"] = [[{"time_us": t, "cumulative_us": c, "self_us": s, "ncalls": n} for t, c, s, n in kept]]
        yield out


def functions(lines: DataFrame, span: int = RECENT_US) -> DataFrame:
    """A stream of the changed functions' rows: all sums so far, and `slices` of the function's last `span` microseconds."""
    keyed_state(lines.sparkSession)
    s = samples_of(lines).select("weight_us", "tick_count", "cpu", "memory_bytes", F.greatest("memory_bytes", "memory_peak_bytes").alias("top"), "time_us", F.transform("frames", lambda f: f["name"]).alias("names"))
    rows = s.select("*", F.get("names", F.lit(0)).alias("leaf"), F.explode(F.array_distinct("names")).alias("name"))
    own, has = F.col("name") == F.col("leaf"), F.coalesce(F.col("memory_bytes") > 0, F.lit(False))

    def where(test, value):
        return F.coalesce(F.when(test, value), F.lit(0))

    narrow = rows.select(
        "name",
        "weight_us",
        where(own, F.col("weight_us")).alias("own_us"),
        where(own, F.col("tick_count")).alias("own_ticks"),
        where(has, F.col("memory_bytes")).alias("mem"),
        has.cast("long").alias("mem_n"),
        where(has, F.col("top")).alias("peak"),
        where(own, F.col("cpu")).cast("double").alias("cpu_sum"),
        (own & F.col("cpu").isNotNull()).cast("long").alias("cpu_n"),
        "time_us",
    )
    return narrow.groupBy("name").transformWithStateInPandas(Functions(span), f"name string, {SUMS}, slices {SLICES}", "Update", "None")


def as_of(rows: DataFrame, span: int = RECENT_US) -> DataFrame:
    """The columns of the batch rollup for the latest row of each function."""
    since = F.broadcast(rows.agg((F.max("last_us") - span).alias("since")))

    def recent(field: str):
        return F.aggregate(F.filter("slices", lambda s: s["time_us"] >= F.col("since")), F.lit(0).cast("long"), lambda a, s: a + s[field]).alias(f"recent_{field}")

    return rows.crossJoin(since).select(
        "name",
        "cumulative_us",
        "self_us",
        "ncalls",
        F.when(F.col("ncalls") > 0, F.col("self_us") / F.col("ncalls")).otherwise(F.lit(0.0)).alias("percall_us"),
        recent("cumulative_us"),
        recent("self_us"),
        recent("ncalls"),
        F.when(F.col("mem_n") > 0, F.expr("mem div mem_n")).otherwise(F.lit(0)).cast("long").alias("memory_mean_bytes"),
        F.col("peak").alias("memory_peak_bytes"),
        F.when(F.col("cpu_n") > 0, F.col("cpu_sum") / F.col("cpu_n")).alias("cpu"),
    )


def keep(stream: DataFrame, folder: str, checkpoint: str, every_ms: int | None = 1000) -> StreamingQuery:
    """Keeps the latest row of each function as a table, a version for each batch: folder/<batch>; `latest` reads the last whole one.

    A batch that runs again writes its version again from the one before, so nothing counts twice. Without `every_ms` the stream ends with what is there.
    """

    def give(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = versions(spark, folder, number)
        rows = batch
        if before:
            old = spark.read.parquet(f"{folder}/{before[-1]}")
            rows = old.join(batch.select("name"), "name", "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{folder}/{number}")
        for old in before[:-1]:  # readers of the version before may still be at work
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    writer = stream.writeStream.outputMode("update").foreachBatch(give).option("checkpointLocation", checkpoint)
    return writer.trigger(**every(every_ms)).start()


def versions(spark, folder: str, below: int | None = None) -> list[int]:
    """The numbers of whole versions, in order."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [f.getPath() for f in fs.listStatus(top)]
    numbers = sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return [n for n in numbers if below is None or n < below]


def latest(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{versions(spark, folder)[-1]}")
