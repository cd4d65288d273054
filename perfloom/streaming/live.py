"""Streams of profiler lines: subscription by topic, a running rollup, tees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import profile
from ..sources import events
from .channels import every


def subscribe(frames: DataFrame, topic: str, event: str = "") -> DataFrame:
    """Frames (topic, event, ...) of a topic; an empty event takes all."""
    return frames.filter((F.col("topic") == topic) & (F.lit(event == "") | (F.col("event") == event)))


def tail(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of lines (raw) of new files in a folder; blank lines go."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.rtrim("value").alias("raw")).filter("raw <> ''")


def samples_of(lines: DataFrame) -> DataFrame:
    """Stack samples of a stream or table of lines (raw)."""
    return events.stack_samples(events.parse(lines.withColumn("seq", F.lit(0).cast("long"))))


def running_rollup(lines: DataFrame) -> DataFrame:
    """Inclusive and self weight of each frame name so far, as a streaming aggregate for complete or update mode.

    Late events count: there is no watermark. State is one row a name. A name counts once in a stack.
    """
    s = samples_of(lines).select("weight_us", "tick_count", F.transform("frames", lambda f: f["name"]).alias("names"))
    rows = s.select("weight_us", "tick_count", F.get("names", F.lit(0)).alias("leaf"), F.explode(F.array_distinct("names")).alias("name"))
    own = F.col("name") == F.col("leaf")
    return rows.groupBy("name").agg(F.sum("weight_us").alias("cumulative_us"), F.sum(F.when(own, F.col("weight_us")).otherwise(0)).alias("self_us"), F.sum(F.when(own, F.col("tick_count")).otherwise(0)).alias("ncalls"))


def tee(stream: DataFrame, first: Callable[[DataFrame, int], None], others: list[Callable[[DataFrame, int], None]], checkpoint: str, failed: Callable[[int, Exception], None] | None = None, every_ms: int | None = None) -> StreamingQuery:
    """Gives every batch to `first`, then to the others in order.

    Without `failed` any error stops the stream; with it, an error of the others is told to it and the rest go on.
    A batch may come again after a lost driver: sinks are to be idempotent by the batch's number.
    """

    def give(batch: DataFrame, number: int) -> None:
        first(batch, number)
        for k, sink in enumerate(others):
            try:
                sink(batch, number)
            except Exception as error:
                if failed is None:
                    raise
                failed(k, error)

    return stream.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).trigger(**every(every_ms)).start()


def right_now(lines: DataFrame) -> DataFrame:
    """Of a table of lines: the latest sample by event time; at equal time the later line."""
    return profile.right_now(events.stack_samples(events.parse(lines)))
