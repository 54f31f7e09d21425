"""Streams of feature rows and recordings: event-time windows, sessions, scoring, and window overlap across batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 10) -> DataFrame:
    """New files of a folder; the checkpoint remembers which were read, in place of a ledger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def timed(df: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sliding(df: DataFrame, ts: str, by: list[str], value: str, length: str, step: str | None = None) -> DataFrame:
    """Count, sum, mean, root mean square and largest magnitude per event-time window."""
    v = F.col(value)
    t = df.groupBy(F.window(ts, length, step) if step else F.window(ts, length), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"))
    return t.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total", "mean", "rms", "peak")


def sessions(df: DataFrame, ts: str, by: list[str], gap: str) -> DataFrame:
    t = df.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def alarms(df: DataFrame, weights: dict[str, float], bias: float, threshold: float) -> DataFrame:
    """The stored linear model on a stream: stateless, the same expressions as in batch."""
    return M.scored(df, weights, bias, threshold)


def overlapped_windows(df: DataFrame, key: str, order: str, value: str, length: int, step: int) -> DataFrame:
    """Count windows over each key's samples that continue across batches: the state holds at most one window's samples.

    Samples of a key must arrive in order over batches; within a batch they are sorted.
    """

    def run(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, next_id = state.get if state.exists else ([], 0)
        fresh = pd.concat(list(frames)).sort_values(order)[value].to_numpy(float)
        x = np.concatenate([np.asarray(kept, float), fresh])
        rows, at = [], 0
        while at + length <= len(x):
            w = x[at : at + length]
            rows.append((name[0], next_id, float(w.mean()), float(np.sqrt((w * w).mean())), float(np.abs(w).max())))
            at += step
            next_id += 1
        state.update((x[at:].tolist(), next_id))
        yield pd.DataFrame(rows, columns=[key, "window_id", "mean", "rms", "peak"])

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, window_id long, mean double, rms double, peak double", "kept array<double>, next_id long", "append", "NoTimeout")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the result is the in-memory table `name` (for tests and small results)."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def end_row(df: DataFrame, ts: str, later: str) -> DataFrame:
    """One row of df's schema, NULL but for `ts`, which is `later` than all others: what a finished stream needs for its
    watermark to pass all that came before, so that append mode gives everything and writes it from the tasks."""
    last = df.agg((F.max(ts) + F.expr(f"INTERVAL {later}")).alias(ts)).where(F.col(ts).isNotNull())
    return last.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])


def write_once(df: DataFrame, path: str, checkpoint: str) -> None:
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
