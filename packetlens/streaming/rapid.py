"""The exact rapid-scan alert on a stream: the rule of the batch detector, with the last window of instants kept per source.

A window that starts at an event is decided when the watermark has passed its end: no event in it can come any more.
Until then the source's events are held in state (one window and the watermark's delay of them); a timer wakes the
source when its earliest event can be decided. Events are decided in order of time, however shuffled or late they came within
the watermark. A source that was reported keeps one flag and no events.

The state lives in RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` as ``packetlens.session`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERT = "src_ip string, window_start double, events_in_window long"


def first_window(times: list[float], seconds: float, min_events: int, until: float) -> tuple[tuple[float, int] | None, int]:
    """The first of the sorted ``times`` with enough events in the window after it, of those whose window ends before ``until``.

    Also how many times were decided.
    """
    end = 0
    for i, t in enumerate(times):
        if t + seconds >= until:
            return None, i
        while end < len(times) and times[end] <= t + seconds:
            end += 1
        if end - i >= min_events:
            return (t, end - i), i + 1
    return None, len(times)


class RapidScans(StatefulProcessor):
    """One alert per source. ``seconds`` and ``min_events`` are the batch rule's."""

    def __init__(self, seconds: float, min_events: int):
        self.seconds, self.min_events = seconds, min_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "t double")
        self.wake = handle.getValueState("wake", "at long")
        self.reported = handle.getValueState("reported", "yes boolean")

    def _await(self, first: float) -> None:
        """Wakes this source when the window after ``first`` has passed, unless it wakes earlier anyway."""
        at = int((first + self.seconds) * 1000) + 2
        if not self.wake.exists() or self.wake.get()[0] > at:
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batches = list(rows)
        if not self.reported.exists():
            times = [float(t) for part in batches for t in part["t"]]
            self.events.appendList([(t,) for t in times])
            self._await(min(times))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.reported.exists():
            return
        self.wake.clear()
        times = sorted(r[0] for r in self.events.get())
        found, decided = first_window(times, self.seconds, self.min_events, timerValues.getCurrentWatermarkInMs() / 1000)
        if found:
            self.reported.update((True,))
            self.events.clear()
            yield pd.DataFrame({"src_ip": [key[0]], "window_start": [found[0]], "events_in_window": [found[1]]})
        elif decided < len(times):
            self.events.put([(t,) for t in times[decided:]])
            self._await(times[decided])
        else:
            self.events.clear()

    def close(self) -> None:
        pass


def stream_first_busy_window(
    events: DataFrame, key: str = "src_ip", time: str = "start_time", seconds: int = 60, min_events: int = 50, watermark: str = "2 minutes"
) -> DataFrame:
    """Per key, once: the earliest event with ``min_events`` events in the ``seconds`` after it, both ends included.

    Equals ``operators.timing.first_busy_window`` on all events that the watermark lets in. Rows with a null key or
    time are left out. ``time`` is in seconds since 1970.
    """
    micros = F.round(F.col(time) * 1_000_000).cast("long")
    named = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).cast("string").alias("src_ip"), F.col(time).cast("double").alias("t"), F.timestamp_micros(micros).alias("event_time")
    )
    found = named.withWatermark("event_time", watermark).groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=RapidScans(seconds, min_events), outputStructType=ALERT, outputMode="Append", timeMode="EventTime"
    )
    return found.withColumnRenamed("src_ip", key)


def stream_rapid_scan_alerts(flows: DataFrame, time: str = "start_time", seconds: int = 60, min_connections: int = 50, watermark: str = "2 minutes") -> DataFrame:
    """The port-scan detector's rapid rule on a stream of flows."""
    tcp = flows.where(F.col("protocol") == "TCP")
    found = stream_first_busy_window(tcp, "src_ip", time, seconds, min_connections, watermark)
    n = F.col("events_in_window")
    return found.withColumns({"rate_per_second": n / seconds, "confidence": F.least(F.lit(0.85), F.lit(0.5) + n / 200)})
