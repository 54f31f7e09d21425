"""Count windows over event-time streams whose samples come late or out of order, with timers that release and end state.

A key's samples wait in state until the watermark has passed the end of their time bucket; then they are final, are
sorted, and join the samples of windows not yet full. A key that stays silent for `idle` gives up its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keeps lists and timers outside the heap (a fixed value of Spark's settings).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Windows(StatefulProcessor):
    """Windows of `length` samples, `step` apart, over each key's samples by time (ties by order and value)."""

    def __init__(self, key: str, ts: str, order: str, value: str, length: int, step: int, bucket_ms: int, idle_ms: int):
        self.key, self.ts, self.order, self.value = key, ts, order, value
        self.length, self.step, self.bucket, self.idle = length, step, bucket_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, ord long, value double")
        self.kept = handle.getListState("kept", "value double")
        self.place = handle.getValueState("place", "next_id long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            ms = f[self.ts].to_numpy("datetime64[ms]").astype("int64")
            self.waiting.appendList(list(zip(ms.tolist(), f[self.order].astype("int64").tolist(), f[self.value].astype(float).tolist(), strict=True)))
            first = int(ms.min()) if first is None else min(first, int(ms.min()))
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        final = [r for r in waiting if (r[0] // self.bucket + 1) * self.bucket <= now]
        number, last = self.place.get() if self.place.exists() else (0, None)
        out = []
        if final:
            rest = waiting[len(final) :]
            if rest:
                self.waiting.put(rest)
                self._wake(rest[0][0], now)
            else:
                self.waiting.clear()
            x = np.array([v for (v,) in self.kept.get()] if self.kept.exists() else [], float)
            x, at = np.concatenate([x, [r[2] for r in final]]), 0
            while at + self.length <= len(x):
                w = x[at : at + self.length]
                out.append((number, float(w.mean()), float(np.sqrt((w * w).mean())), float(np.abs(w).max())))
                at, number = at + self.step, number + 1
            if at < len(x):
                self.kept.put([(float(v),) for v in x[at:]])
            else:
                self.kept.clear()
            last = final[-1][0]
            self.place.update((number, last))
            self.handle.registerTimer(max(last + self.idle, now + 1))
        elif last is not None and not waiting and last + self.idle <= now:
            for state in (self.waiting, self.kept, self.place):
                state.clear()
        yield self._rows(key, out)

    def _wake(self, ms: int, now: int) -> None:
        """One timer for the earliest sample that waits: it releases all that is final, and leaves one for the next."""
        self.handle.registerTimer(max((ms // self.bucket + 1) * self.bucket, now + 1))

    def _rows(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(out), dtype=object), **{c: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate((("window_id", "int64"), ("mean", float), ("rms", float), ("peak", float)))}})

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def late_windows(df: DataFrame, key: str, ts: str, order: str, value: str, length: int, step: int, bucket_s: float = 60.0, idle_s: float = 86_400.0) -> DataFrame:
    """key, window_id, mean, rms, peak of a stream with a watermark on `ts` (see windows.timed), in append mode. Rows later
    than the watermark are dropped by Spark, as everywhere. step is at most length, or samples would be skipped before they come."""
    if not 0 < step <= length:
        raise ValueError("step is between 1 and length")
    use_store(df.sparkSession)
    kind = dict(df.dtypes)[key]
    return df.groupBy(key).transformWithStateInPandas(Windows(key, ts, order, value, length, step, int(bucket_s * 1000), int(idle_s * 1000)), f"{key} {kind}, window_id long, mean double, rms double, peak double", "Append", "EventTime")
