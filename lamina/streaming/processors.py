"""Interaction events as stateful streams: the adaptive delay of scrolling, and what a user tracks.

Both keep a small state for each user and let it go when the user has been idle, by a timer in event time;
give a stream a watermark on ts. Rows of a micro-batch are put in order of ts and event_id, later ones follow as they come.
State is kept in RocksDB (``rocksdb`` sets it for a session), as transformWithState asks for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lamina.streaming.replay import track

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def delay_step(gap: float, count: int) -> tuple[int, int]:
    """(count, delay in milliseconds) after an event that follows the one before by gap milliseconds."""
    if gap < 50:
        count += 2
        return count, min(200, 100 + 10 * count)
    if gap < 100:
        count += 1
        return count, min(150, 50 + 5 * count)
    count = max(0, count - 3)
    return count, max(16, 30 - 2 * count)


class _Timed(StatefulProcessor):
    """A state with one row for each user, that goes ``idle`` milliseconds of event time after the last event."""

    schema = ""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def _renew(self, last: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ms", "event_id"])


class Delays(_Timed):
    schema = "last long, count long"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, count = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for event, ms in _ordered(rows)[["event_id", "ms"]].itertuples(index=False):
            if last is not None and ms - last >= self.idle:
                count = 0  # as if the timer had already run
            count, delay = delay_step(1000 if last is None else ms - last, count)
            last = int(ms)
            out.append((event, count, delay))
        self.state.update((last, count))
        self._renew(last)
        yield pd.DataFrame(out, columns=["event_id", "scroll_count", "delay_ms"])


def delays_stream(events: DataFrame, idle: int) -> DataFrame:
    """(event_id, scroll_count, delay_ms) of a stream of events (event_id, user_id, ts) with a watermark on ts."""
    rows = events.select("user_id", "event_id", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(Delays(idle), "event_id long, scroll_count int, delay_ms int", "append", "EventTime")


class Tracking(_Timed):
    """What a user tracks: the slice, the label and the labels of the path, which the volume's depth bounds."""

    schema = "last long, z int, label_id int, path string"

    def __init__(self, idle: int, f: int):
        super().__init__(idle)
        self.f = f

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, tracked = None, None
        if self.state.exists():
            last, z, label, path = self.state.get()
            tracked = z, label, {int(k): v for k, v in json.loads(path).items()}
        out = []
        for row in _ordered(rows).to_dict("records"):
            if last is not None and row["ms"] - last >= self.idle:
                tracked = None
            step, tracked = track(tracked, row, self.f)
            last = int(row["ms"])
            out.append((row["event_id"], step))
        if tracked is not None:
            self.state.update((last, tracked[0], tracked[1], json.dumps(tracked[2])))
            self._renew(last)
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=["event_id", "step"])


def tracking_stream(events: DataFrame, idle: int, f: int = 4) -> DataFrame:
    """(event_id, step) of a stream of events (event_id, user_id, ts, z_l0, z, path) with a watermark on ts.

    path, the (z, label_id) of the slices of a clicked contour's path, makes a row a click.
    """
    rows = events.select("user_id", "event_id", "z_l0", "z", "path", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(Tracking(idle, f), "event_id long, step string", "append", "EventTime")
