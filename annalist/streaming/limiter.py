"""A rate limiter on streams: trailing sums of a key's events, by arbitrary state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that this kind of state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrailingSums(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, and for a window more.

    An event's sum is given out by a timer once the watermark passes its time:
    by then every event up to that time has arrived that will ever count, so
    the sum is the one a batch over the same rows gives.
    """

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # by time: how many events there are, their sum, and the ids that still wait for it
        self.held = handle.getMapState("held", "at bigint", "n bigint, total double, ids array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, tuple[int, float, list[int]]] = {}
        for batch in rows:
            for i, at, size in zip(batch["event_id"], batch["micros"], batch["size"]):
                n, total, ids = new.get(at, (0, 0.0, []))
                new[at] = (n + 1, total + float(size), [*ids, int(i)])
        for at, (n, total, ids) in new.items():
            if self.held.containsKey((int(at),)):
                old = self.held.getValue((int(at),))
                n, total, ids = n + old[0], total + old[1], [*old[2], *ids]
            self.held.updateValue((int(at),), (n, total, ids))
            self.handle.registerTimer(-(-int(at) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted((k[0], v) for k, v in self.held.iterator())
        out = []
        for at, (n, total, ids) in rows:
            if at <= due and ids:
                within = sum(t for other, (_, t, _) in rows if at - self.micros <= other <= at)
                out += [(int(key[0]), i, at, within) for i in ids]
                self.held.updateValue((at,), (n, total, []))
        for at, _ in rows:
            if at < due - self.micros - 1_000_000:
                self.held.removeKey((at,))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "micros", "in_window"])

    def close(self) -> None:
        pass


def trailing_sums(events: DataFrame, at: str, size: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """``events(user_id, event_id, ...)`` of a stream to ``(user_id, event_id, micros, in_window)``: the sum of ``size`` over the ``seconds`` up to each event, inclusive.

    Rows later than the watermark are left out, as in every windowed query; an
    event is given out when the watermark has passed it.  The session needs
    PROVIDER as its state store, so a restart goes on from the checkpoint.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = events.withWatermark(at, late).select("user_id", "event_id", at, F.unix_micros(F.col(at)).alias("micros"), F.col(size).cast("double").alias("size"))
    return rows.groupBy("user_id").transformWithStateInPandas(TrailingSums(seconds * 1_000_000), "user_id bigint, event_id bigint, micros bigint, in_window double", "append", "eventTime")
