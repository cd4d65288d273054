"""History, then live, in one stateful stream that goes on.

A topic's state is a ring of its last frames, the number of frames so far, and for each subscriber the number
of the last frame given to it. Subscriptions are rows of the same stream: a client that
subscribes gets the ring first and from then on every frame as it comes, whatever its `seq`; one that
comes back with the last number it has gets what the ring still holds after it. Both happen in one step of the
topic's state, so no frame falls between history and live and none is given twice, also after a
restart from the checkpoint. A frame whose seq the ring already holds is one sent again, and is left out.

Defined cases: within a batch subscriptions and leaves come first, by `seq`, then frames by `seq`; null topics, clients or sequence numbers go
nowhere; a client that subscribes again without a number gets the ring again; other topics are not affected.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .channels import RING

#: What a row of the stream is: kind frame, subscribe or leave; `after`: the last number a client has, if it comes back.
SIGNALS = "topic string, kind string, client string, seq long, payload string, after long"
GIVEN = "topic string, client string, phase string, number long, seq long, payload string"
#: Frames that are given out at once to all subscribers.
CHUNK = 256


def keyed_state(spark: SparkSession) -> None:
    """Keyed state of the kinds used here needs the store that Spark brings with RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Room(StatefulProcessor):
    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "number long, seq long, payload string")
        self.count = handle.getValueState("count", "n long")
        self.clients = handle.getMapState("clients", "client string", "number long")

    def handleInputRows(self, key: tuple, rows: Iterator, timers) -> Iterator:  # noqa: N802
        import pandas as pd

        def given(out: list):
            return pd.DataFrame(out, columns=["topic", "client", "phase", "number", "seq", "payload"])

        batch = pd.concat(list(rows))
        held = [tuple(r) for r in self.ring.get()]
        n = self.count.get()[0] if self.count.exists() else 0
        who = batch[(batch["kind"] != "frame") & batch["client"].notna()].sort_values(["seq", "client"], kind="stable")
        for kind, client, after in who[["kind", "client", "after"]].itertuples(index=False):
            if kind == "leave":
                if self.clients.containsKey((client,)):
                    self.clients.removeKey((client,))
                continue
            first = -1 if pd.isna(after) else int(after)
            missed = [r for r in held if r[0] > first]
            self.clients.updateValue((client,), (n,))
            if missed:
                yield given([(key[0], client, "history", *r) for r in missed])
        frames = batch[(batch["kind"] == "frame") & batch["seq"].notna()].sort_values(["seq"], kind="stable")
        known, new = {r[1] for r in held}, []
        for seq, payload in frames[["seq", "payload"]].itertuples(index=False):
            if seq not in known:
                known.add(seq)
                n += 1
                new.append((n, int(seq), None if pd.isna(payload) else payload))
        if not new:
            return
        self.ring.put((held + new)[-self.cap :])
        self.count.update((n,))
        clients = sorted(c[0] for c in self.clients.keys())
        for c in clients:
            self.clients.updateValue((c,), (n,))
        for a in range(0, len(new), CHUNK):
            for b in range(0, len(clients), CHUNK):
                yield given([(key[0], c, "live", *r) for c in clients[b : b + CHUNK] for r in new[a : a + CHUNK]])


def rooms(signals: DataFrame, cap: int = RING) -> DataFrame:
    """A stream of rows (topic, client, phase, number, seq, payload) for a stream of SIGNALS; `number` counts a topic's frames as they came.

    The ring holds the last `cap` frames as they came. A topic is one state, as its order is; topics are dealt over tasks.
    """
    keyed_state(signals.sparkSession)
    rows = signals.selectExpr("topic", "kind", "client", "seq", "payload", "after").filter(F.col("topic").isNotNull())
    return rows.groupBy("topic").transformWithStateInPandas(Room(cap), GIVEN, "Append", "None")
