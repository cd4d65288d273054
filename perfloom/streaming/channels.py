"""Channels over streams: rings of the last frames, protocol verbs, bounded sinks, run files. History before live frames is in `rooms`.

A stream here is a streaming DataFrame; with `every_ms` it goes on, without it ends with what is there.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.profile import last_n

#: Frames that a ring keeps by kind of feed, and the default channel of the old feed.
RING, CHANNEL_RING, FEED_RING, DEFAULT_TOPIC = 200, 500, 1000, "default"
#: Verbs of the channel protocol.
VERBS = ("join", "leave", "heartbeat", "broadcast")


def rings(frames: DataFrame, cap: int = RING) -> DataFrame:
    """A stream of the last `cap` frames of each topic (topic, place, seq, payload), oldest first, whenever a topic gets new ones.

    frames: a stream of (topic, seq, payload). State is the ring itself, so it is bounded whatever the topic's length;
    frames that come late by seq take their place if the ring still reaches that far.
    """

    def keep(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held += list(zip(b["seq"].tolist(), b["payload"].tolist(), strict=True))
        held = sorted(held, key=lambda r: r[0])[-cap:]
        state.update(([r[0] for r in held], [r[1] for r in held]))
        yield pd.DataFrame({"topic": key[0], "place": range(1, len(held) + 1), "seq": [r[0] for r in held], "payload": [r[1] for r in held]})

    return frames.select("topic", "seq", "payload").groupBy("topic").applyInPandasWithState(keep, "topic string, place int, seq long, payload string", "seq array<long>, payload array<string>", "update", GroupStateTimeout.NoTimeout)


def snapshot(history: DataFrame, topic: str, cap: int = RING) -> DataFrame:
    """The ring of one topic from a table of frames, oldest first."""
    return last_n(history.filter(F.col("topic") == topic), "topic", "seq", cap).orderBy("place")


def bridge(lines: DataFrame, topic: str = DEFAULT_TOPIC) -> DataFrame:
    """Lines of the old feed as frames of a channel."""
    return lines.select(F.lit(topic).alias("topic"), F.lit("event").alias("event"), F.col("raw").alias("payload"))


def envelopes(messages: DataFrame) -> DataFrame:
    """Messages (client, seq, raw) of the channel protocol as rows (client, seq, verb, topic, event, payload, ok).

    A message is [join_ref, ref, topic, event, payload]. Verbs: phx_join and phx_leave by event, heartbeat on the topic `phoenix`, else broadcast.
    What doesn't parse, or has no topic, is not ok.
    """
    m = F.from_json("raw", "array<string>")
    topic, event, payload = (F.get(m, F.lit(i)) for i in (2, 3, 4))
    verb = F.when(event == "phx_join", "join").when(event == "phx_leave", "leave").when(event == "heartbeat", "heartbeat").otherwise("broadcast")
    ok = F.coalesce((F.size(m) == 5) & (F.length(topic) > 0) & (F.length(event) > 0), F.lit(False))
    return messages.select("client", "seq", verb.alias("verb"), topic.alias("topic"), event.alias("event"), payload.alias("payload"), ok.alias("ok"))


def replies(rows: DataFrame) -> DataFrame:
    """The answers (client, seq, topic, status) to joins, leaves and heartbeats; what isn't ok is refused."""
    return rows.filter(~F.col("ok") | (F.col("verb") != "broadcast")).select("client", "seq", "topic", F.when(F.col("ok"), "ok").otherwise("error").alias("status"))


def broadcasts(rows: DataFrame, topic: str, event: str = "") -> DataFrame:
    """Payloads of a topic's broadcasts, of one event or of all."""
    return rows.filter("ok and verb = 'broadcast'").filter((F.col("topic") == topic) & (F.lit(event == "") | (F.col("event") == event))).select("client", "seq", "event", "payload")


def captured(frames: DataFrame, topic: str = "", direction: str = "") -> DataFrame:
    """Frames (topic, event, direction, payload) that a listener of a channel sees; empty filters take all."""
    def holds(c: str, v: str) -> Column:
        return F.lit(v == "") | (F.col(c) == v)

    return frames.filter(holds("topic", topic) & holds("direction", direction))


def by_clients(rows: DataFrame) -> DataFrame:
    """Rows (topic, client, joined, seq) for the count of subscribers."""
    return rows.filter("ok and verb in ('join', 'leave')").select("topic", "client", (F.col("verb") == "join").alias("joined"), "seq")


def debounced(stream: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, every_ms: int | None = 250) -> StreamingQuery:
    """Gives a running aggregate (with column `n`, rows so far) at most once in `every_ms`, and only if it has changed; the last state is always given.

    Without `every_ms` what is there is given and the stream ends.
    """
    seen: dict[str, int] = {}

    def give(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        n = rows.agg(F.sum("n")).first()[0] or 0
        if seen.get("n") != n:
            seen["n"] = n
            emit(rows, number)
        rows.unpersist()

    writer = stream.writeStream.outputMode("complete").foreachBatch(give).option("checkpointLocation", checkpoint)
    return writer.trigger(**every(every_ms)).start()


class QueueSink:
    """A bounded queue of rows before a slow writer, which has a thread of its own; what does not fit when it comes is dropped and counted.

    A batch is written once, to the spool folder that driver and executors share, and counted by the same job; of its rows the first by `order`
    that the queue has room for are queued, the newer ones are dropped. The stream never waits for the writer. The writer gets (rows, number of the
    batch), in order; an error of it is told by `failed`, its rows count as dropped, and the next batch goes on.
    """

    def __init__(self, write: Callable[[DataFrame, int], None], cap: int, order: str, spool: str):
        self.write, self.cap, self.order, self.spool = write, cap, order, spool
        self.taken = self.dropped = self.queued = 0
        self.failed: list[tuple[int, Exception]] = []
        self._lock, self._idle = threading.Condition(), True
        self._waiting: deque = deque()
        threading.Thread(target=self._work, daemon=True).start()

    def __call__(self, batch: DataFrame, number: int) -> None:
        seen = Observation()
        path = f"{self.spool}/{number}"
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        n = seen.get["n"]
        with self._lock:
            fit = max(0, min(n, self.cap - self.queued))
            self.dropped += n - fit
            if fit:
                rows = batch.sparkSession.read.parquet(path)
                self._waiting.append((rows if fit == n else rows.orderBy(self.order).limit(fit), number, fit))
                self.queued += fit
                self._idle = False
                self._lock.notify_all()

    def _work(self) -> None:
        while True:
            with self._lock:
                while not self._waiting:
                    self._idle = True
                    self._lock.notify_all()
                    self._lock.wait()
                rows, number, n = self._waiting[0]
            try:
                self.write(rows, number)
                told = None
            except Exception as error:  # the writer's own errors never reach the stream
                told = error
            with self._lock:
                self._waiting.popleft()
                self.queued -= n
                if told is None:
                    self.taken += n
                else:
                    self.dropped += n
                    self.failed.append((number, told))

    def flush(self, seconds: float) -> bool:
        """Waits until all that is queued is written, up to a deadline; whether it is."""
        with self._lock:
            return self._lock.wait_for(lambda: self._idle and not self._waiting, seconds)


def every(milliseconds: int | None) -> dict:
    """The trigger of a stream that goes on, or of one that ends with what is there."""
    return {"processingTime": f"{milliseconds} milliseconds"} if milliseconds else {"availableNow": True}


def run_folder(root: str, now: float | None = None) -> str:
    """The folder of a run's lines, named by its start in UTC."""
    return f"{root}/realtime-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime(now))}.jsonl"


def write_run(lines: DataFrame, folder: str, checkpoint: str, every_ms: int | None = None) -> StreamingQuery:
    """Appends a stream of lines (raw) to the run's folder, each once."""
    return lines.select("raw").writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(**every(every_ms)).start()


def publish(frames: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, persist: str | None = None, every_ms: int | None = None) -> StreamingQuery:
    """Gives frames to all sinks, and appends them to a table if they are to be kept."""

    def give(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        if persist:
            rows.withColumn("batch", F.lit(number)).write.mode("append").json(persist)
        for sink in sinks:
            sink(rows, number)
        rows.unpersist()

    return frames.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).trigger(**every(every_ms)).start()
