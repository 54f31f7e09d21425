"""Feature extraction over records and recordings: one Arrow pass from signal to wide feature rows.

The plan (bands, families) fixes the output schema before anything runs and travels in the closure; families that no band
requests are never computed. Windows are cut inside the worker, so overlapping slices are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import features as K
from .kernels import filters
from .operators.windows import window_ranges, windows_between
from .session import broadcast_within, materialize


def schema_of(plans: dict[str, K.BandPlan], head: str) -> str:
    return head + ", " + ", ".join(f"`{c}` double" for c in K.output_columns(plans))


def record_features(records: DataFrame, plans: dict[str, K.BandPlan], key: str, signal: str, rate: str) -> DataFrame:
    """One row per record (single events): key and the features."""
    columns = K.output_columns(plans)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = K.stacked_records(list(f[signal]), list(f[rate]), plans)
            for e in rows:
                if isinstance(e, Exception):
                    raise e
            yield pd.concat([f[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)

    return records.select(key, signal, rate).mapInPandas(run, schema_of(plans, f"{key} {dict(records.dtypes)[key]}"))


def recording_features(records: DataFrame, bands: dict[str, tuple[float, float]], rate: float, seconds: float, overlap: float, key: str = "path", signal: str = "signal", families: dict | None = None, target_rate: float | None = None, chunks: int = 1) -> DataFrame:
    """One row per window of each recording: key, window geometry, features, status and message.

    A recording that fails gives one failed row. A row's memory is one recording, its bands and one window at a time.
    With chunks, a recording is cut to that many pieces, each the samples of a run of windows and as many around them as
    the filters remember: values are the same up to rounding, and a long recording's work is shared by many tasks.
    """
    effective = target_rate if target_rate and target_rate > rate else rate
    plans = K.plan_bands(bands, effective, families)
    around = K.memory(plans, effective)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of recordings: the samples that a run of windows and its filters need, and where they lie."""
        for f in frames:
            for name, x in zip(f[key], f[signal], strict=True):
                try:
                    wave, r = filters.upsample_to(x, rate, effective) if effective > rate else (np.asarray(x, float), rate)
                    every = window_ranges(len(wave), r, seconds, overlap)
                    mean = float(wave.mean()) if len(wave) else 0.0
                    for part in range(chunks):
                        first, end = len(every) * part // chunks, len(every) * (part + 1) // chunks
                        if first < end:
                            a, b = max(0, every[first][1] - around), min(len(wave), every[end - 1][2] + around)
                            yield pd.DataFrame({key: [name], "_from": every[first][1], "_to": every[end - 1][1] + 1, "_at": a, "_length": len(wave), "_rate": r, "_mean": mean, "_wave": [wave[a:b]], "_failed": None})
                except Exception as e:  # the row carries it
                    yield pd.DataFrame([[name, *[None] * (len(piece_columns) - 2), f"{type(e).__name__}: {e}"]], columns=piece_columns)

    piece = f"{key} {dict(records.dtypes)[key]}, {_PIECE}"
    piece_columns = [c.split()[0] for c in piece.split(", ")]
    pieces = records.select(key, signal).mapInPandas(cut, piece)
    if chunks > 1:
        # a number keeps small pieces from being merged into few tasks; rows are dealt in turn
        pieces = pieces.repartition(max(chunks, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return _piece_features(pieces, plans, [key], seconds, overlap)


#: Recordings (a mean each) of which the table may be broadcast.
MAX_BROADCAST = 200_000
_PIECE = "_from long, _to long, _at long, _length long, _rate double, _mean double, _wave array<double>, _failed string"


def _piece_features(pieces: DataFrame, plans: dict[str, K.BandPlan], keys: list[str], seconds: float, overlap: float) -> DataFrame:
    """Windows that begin at samples `_from` to `_to` of recordings of which a piece, from sample `_at` on, is at hand."""
    columns = K.output_columns(plans)
    kinds = dict(pieces.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", window_id long, window_start_index long, window_end_index long, sample_rate_hz double, status string, message string"
    fixed = [c.split()[0] for c in head.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f.to_dict("records"):
                name, start, at = {k: p[k] for k in keys}, p["_from"], p["_at"]
                try:
                    if p["_failed"] is not None:
                        rows = [{**name, "status": "failed", "message": p["_failed"]}]
                    else:
                        geometry = windows_between(int(p["_length"]), p["_rate"], seconds, overlap, int(start), int(p["_to"]))
                        made = K.recording_windows(p["_wave"], p["_rate"], plans, [(g[1] - int(at), g[2] - int(at)) for g in geometry], p["_mean"]) if geometry else []
                        rows = [{**name, "window_id": g[0], "window_start_index": g[1], "window_end_index": g[2], "sample_rate_hz": p["_rate"], "status": "ok", "message": None, **row} for g, row in zip(geometry, made, strict=True)]
                except Exception as e:  # the row carries it
                    rows = [{**name, "status": "failed", "message": f"{type(e).__name__}: {e}"}] if start == 0 else []
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=[*fixed, *columns]).astype({"window_id": "Int64", "window_start_index": "Int64", "window_end_index": "Int64"})

    return pieces.mapInPandas(run, schema_of(plans, head))


def range_margins(bands: dict[str, tuple[float, float]], rate: float, seconds: float, families: dict | None = None) -> tuple[int, int]:
    """Samples before and after a range that the windows beginning in it and their filters need: options of the range reader."""
    around = K.memory(K.plan_bands(bands, rate, families), rate)
    return around, around + int(round(seconds * rate))


def range_features(ranges: DataFrame, bands: dict[str, tuple[float, float]], rate: float, seconds: float, overlap: float, families: dict | None = None) -> DataFrame:
    """recording_features of recordings read by ranges (with range_margins): path, channel_index and the same rows.

    A task holds a range, never a recording. The mean that filters take off first is that of the whole recording, so the
    ranges are read once for their sums and once for their windows; the means are a row a recording. Recordings of another rate give a failed row.
    """
    plans = K.plan_bands(bands, rate, families)
    keys = ["path", "channel_index"]
    own = F.slice("signal", F.col("lead") + 1, (F.col("last") - F.col("first")).cast("int"))
    sums = ranges.where("status = 'ok'").select(*keys, F.aggregate(own, F.lit(0.0), lambda s, x: s + x).alias("_sum"), (F.col("last") - F.col("first")).alias("_n"))
    means = broadcast_within(materialize(sums.groupBy(*keys).agg((F.sum("_sum") / F.sum("_n")).alias("_mean")), "recording-means"), MAX_BROADCAST)
    failed = F.when(F.col("status") != "ok", F.col("message")).when(F.col("sample_rate") != rate, F.concat(F.lit("sample_rate is "), F.col("sample_rate").cast("string")))
    t = ranges.where((F.col("status") != "ok") | (F.col("sample_rate") == rate) | (F.col("first") == 0))
    pieces = t.select(*keys, F.col("first").alias("_from"), F.col("last").alias("_to"), (F.col("first") - F.col("lead")).alias("_at"), F.col("total").alias("_length"), F.col("sample_rate").alias("_rate"), F.col("signal").alias("_wave"), failed.alias("_failed"))
    return _piece_features(pieces.join(means, keys, "left"), plans, keys, seconds, overlap)


def with_window_time(rows: DataFrame, start: str) -> DataFrame:
    """Start time of each window from the recording's start time."""
    from .functions.labels import add_seconds

    return rows.withColumn("window_start_datetime", add_seconds(F.col(start), F.col("window_start_index") / F.col("sample_rate_hz")))


def event_features(events: DataFrame, plans: dict[str, K.BandPlan], modes_ms: dict[str, tuple[float, float]], key: str, signal: str, rate: str, arrival: str, complete_only: bool = False) -> DataFrame:
    """Windows about each record's arrival sample: key, mode, bounds, features; a failing record gives one failed row."""
    columns = K.output_columns(plans)
    head = f"{key} {dict(events.dtypes)[key]}, window_mode string, window_start_ms double, window_end_ms double, window_n_samples int, status string, message string"
    fixed = [c.split()[0] for c in head.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cuts, failed = [], {}  # record, mode and window; failures of records
            for k, (x, r, a) in enumerate(zip(f[signal], f[rate], f[arrival], strict=True)):
                try:
                    for mode, (lo, hi) in modes_ms.items():
                        i, j = int(a) + round(lo * r / 1000), int(a) + round(hi * r / 1000)
                        i0, i1 = max(0, i), min(len(x), j)
                        if i1 > i0 and (not complete_only or (i0, i1) == (i, j)):
                            cuts.append((k, mode, x[i0:i1]))
                except Exception as e:  # the row carries it
                    failed[k] = e
            names, rates, rows = list(f[key]), list(f[rate]), []
            made = K.stacked_records([x for _, _, x in cuts], [rates[k] for k, _, _ in cuts], plans)
            for (k, _, _), row in zip(cuts, made, strict=True):
                if isinstance(row, Exception):
                    failed.setdefault(k, row)
            for (k, mode, x), row in zip(cuts, made, strict=True):
                if k not in failed:
                    rows.append({key: names[k], "window_mode": mode, "window_start_ms": modes_ms[mode][0], "window_end_ms": modes_ms[mode][1], "window_n_samples": len(x), "status": "ok", "message": None, **row})
            rows += [{key: names[k], "status": "failed", "message": f"{type(e).__name__}: {e}"} for k, e in failed.items()]
            if rows:
                yield pd.DataFrame(rows).reindex(columns=[*fixed, *columns]).astype({"window_n_samples": "Int32"})

    return events.select(key, signal, rate, arrival).mapInPandas(run, schema_of(plans, head))
