"""Windows, segments, runs and anchors over ordered tables and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal as S


def window_geometry(rate: float, seconds: float, overlap: float) -> tuple[int, int]:
    """Samples of a window and from one to the next; both round half to even."""
    length = int(round(seconds * rate))
    if length <= 0:
        raise ValueError("the window has no samples")
    return length, max(1, int(round(length * (1 - overlap))))


def window_ranges(n: int, rate: float, seconds: float, overlap: float) -> list[tuple[int, int, int, int, int]]:
    """(id, start, end, length, step) of the full windows."""
    length, step = window_geometry(rate, seconds, overlap)
    return [(k, s, s + length, length, step) for k, s in enumerate(range(0, n - length + 1, step))]


def windows_between(n: int, rate: float, seconds: float, overlap: float, first: int, last: int) -> list[tuple[int, int, int, int, int]]:
    """Those of window_ranges() that start at samples first to last, without making the others."""
    length, step = window_geometry(rate, seconds, overlap)
    return [(s // step, s, s + length, length, step) for s in range(-(-max(0, first) // step) * step, min(last, n - length + 1), step)]


def frame_windows(n: Column, length: int, step: int) -> Column:
    """Starts of windows over frames; a recording no longer than a window is one whole window."""
    if length <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    return F.when(n <= length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - length, F.lit(step)))


def shift_grid(low: float, high: float, step: float) -> list[float]:
    return [round(low + k * step, 10) for k in range(int(math.floor((high - low) / step + 1e-9)) + 1)]


def draw_window(df: DataFrame, key: str, offset: Column, duration: Column, candidates: list[float], window: float, seed: int = 42) -> DataFrame:
    """One valid start per row: among the shifts that keep the window inside the recording, the first by seeded order.

    A row without a valid shift raises. One narrow pass: candidates are an array, not rows.
    """
    starts = F.filter(F.transform(F.array(*[F.lit(c) for c in candidates]), lambda t: offset - t), lambda s: (s >= 0) & (s + window <= duration))
    ranked = F.array_sort(F.transform(starts, lambda s: F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), s.cast("string"), F.lit(str(seed)))).alias("h"), s.alias("start"))))
    return df.withColumn("window_start", F.when(F.size(starts) > 0, F.get(ranked, F.lit(0))["start"]).otherwise(F.raise_error("no valid window start").cast("double")))


def gap_segments(df: DataFrame, by: list[str], ts: str, gap_seconds: float, ties: list[str] = ()) -> DataFrame:
    """df with `segment`, counted from 0 within `by`: a gap longer than the limit starts a new one."""
    w = W.partitionBy(*by).orderBy(ts, *ties)
    far = F.coalesce((F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w)) > gap_seconds * 1e6).cast("int"), F.lit(0))
    return df.withColumn("_far", far).withColumn("segment", F.sum("_far").over(w)).drop("_far")


def true_runs(df: DataFrame, by: list[str], order: list[str], condition: Column) -> DataFrame:
    """Longest run and number of rows that meet the condition, by gaps and islands."""
    t = df.withColumn("_ok", condition)
    island = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - F.row_number().over(W.partitionBy(*by, "_ok").orderBy(*order))
    runs = t.withColumn("_island", island).where("_ok").groupBy(*by, "_island").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(*by).agg(F.max("run").alias("longest_run"), F.sum("run").alias("total_true"))


def anchored(anchors: DataFrame, rows: DataFrame, key: str, modes: dict[str, tuple[float, float]], ts: str = "ts") -> DataFrame:
    """Rows within named windows (seconds) about each key's anchor time t0: an equi-join on the key, then the bounds."""
    listed = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for m, (a, b) in modes.items()])
    wide = anchors.select(key, "t0", F.explode(listed).alias("m")).select(key, "t0", "m.*")
    offset = F.unix_micros(ts) - F.unix_micros("t0")
    joined = wide.join(rows, key, "left").withColumn("_in", (offset >= F.col("lo") * 1e6) & (offset < F.col("hi") * 1e6))
    return joined.groupBy(key, "mode").agg(F.count(F.when(F.col("_in"), 1)).alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("_in"), F.col("value"))), F.lit(0.0)), 4).alias("total"))


def arrival_windows(arrival: Column, n: Column, rate: Column, modes_ms: dict[str, tuple[float, float]], complete_only: bool = False) -> Column:
    """Array of (mode, i0, i1) about the arrival sample, clamped to the signal; optionally only uncut ones."""
    def one(mode: str, lo: float, hi: float) -> Column:
        a = arrival + F.rint(F.lit(lo) * rate / 1000).cast("long")
        b = arrival + F.rint(F.lit(hi) * rate / 1000).cast("long")
        i0, i1 = F.greatest(F.lit(0).cast("long"), a), F.least(n.cast("long"), b)
        keep = (i1 > i0) & ((i0 == a) & (i1 == b) if complete_only else F.lit(True))
        return F.when(keep, F.struct(F.lit(mode).alias("mode"), i0.alias("i0"), i1.alias("i1")))

    return F.filter(F.array(*[one(m, a, b) for m, (a, b) in modes_ms.items()]), lambda x: x.isNotNull())


def prefix_errors(df: DataFrame, by: str, value: str, order: list[str], sizes: list[int]) -> DataFrame:
    """Relative error of the mean of the first `size` rows, for each size a group reaches.

    One running mean per group; sizes pick rows of it, so nothing is repeated per size.
    """
    w = W.partitionBy(by).orderBy(*order)
    t = df.select(by, value, F.row_number().over(w).alias("_n"), F.avg(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_m"), F.avg(value).over(W.partitionBy(by)).alias("_all"), F.count(F.lit(1)).over(W.partitionBy(by)).alias("_rows"))
    # a size beyond the group stands for the whole group
    at = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: (s == F.col("_n")) | ((F.col("_n") == F.col("_rows")) & (s > F.col("_rows"))))
    return t.select(by, F.explode(at).alias("size"), (F.abs(F.col("_m") - F.col("_all")) / F.col("_all")).alias("err")).withColumn("size", F.col("size").cast("long"))


def first_stable(df: DataFrame, by: list[str], size: str, err: str, limit: float, run: int) -> DataFrame:
    """First size from which `run` sizes in a row stay within the limit; NULL if none."""
    w = W.partitionBy(*by).orderBy(size).rowsBetween(0, run - 1)
    t = df.select(*by, size, F.max(err).over(w).alias("_worst"), F.count(F.lit(1)).over(w).alias("_n"))
    return t.groupBy(*by).agg(F.min(F.when((F.col("_worst") <= limit) & (F.col("_n") == run), F.col(size))).alias("stable_size"))


def sample_size_grid(total: int, dense_to: int = 100, dense_step: int = 10, points: int = 12) -> list[int]:
    """Even steps at first, then growing geometrically to the whole."""
    dense = list(range(dense_step, min(dense_to, total) + 1, dense_step))
    wide = [int(round(dense_to * (total / dense_to) ** (k / points))) for k in range(1, points + 1)] if total > dense_to else []
    return sorted({*dense, *wide, total} - {0})


def onsets(df: DataFrame, key: str, x: str, baseline: int, deviations: float) -> DataFrame:
    """First sample after the baseline whose energy reaches mean + k deviations of the baseline's; else the peak."""
    e = F.transform(x, lambda v: v * v)
    t = df.select(key, e.alias("e")).withColumn("m", S.moments(F.slice("e", 1, baseline)))
    t = t.withColumn("_limit", F.col("m.mean") + deviations * F.sqrt("m.m2"))
    limit = F.col("_limit")
    found = F.array_min(F.filter(F.transform("e", lambda v, i: F.when((v >= limit) & (i >= baseline), i)), lambda i: i.isNotNull()))
    peak = F.array_position("e", F.array_max("e")).cast("int") - 1
    return t.select(key, F.coalesce(found, peak).alias("onset"))


def decay_ends(df: DataFrame, key: str, x: str) -> DataFrame:
    t = df.select(key, F.transform(x, lambda v: v * v).alias("e")).withColumn("peak", F.array_position("e", F.array_max("e")).cast("int") - 1)
    t = t.withColumn("_limit", F.array_max("e") / math.e)
    after = F.array_min(F.filter(F.transform("e", lambda v, i: F.when((i > F.col("peak")) & (v <= F.col("_limit")), i)), lambda i: i.isNotNull()))
    return t.select(key, F.coalesce(after, F.size("e") - 1).alias("decay_end"))


def canonical_windows(rows: DataFrame, event: str, start_ms: float = 0.0, end_ms: float = 30.0, tolerance: float = 1e-6) -> DataFrame:
    """Rows of one window mode with exact bounds; an event with two of them raises."""
    t = rows.where((F.col("window_mode") == f"{start_ms:g}_{end_ms:g}") & (F.abs(F.col("window_start_ms") - start_ms) <= tolerance) & (F.abs(F.col("window_end_ms") - end_ms) <= tolerance))
    n = F.count(F.lit(1)).over(W.partitionBy(event))
    return t.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two canonical windows of one event: "), F.col(event).cast("string"))).cast("boolean")).otherwise(True)).drop("_n")


def window_audit(rows: DataFrame, selected: DataFrame, label: str, event: str) -> DataFrame:
    """Rows and events of each label before and after the selection."""
    a = rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(event).alias("events"))
    b = selected.groupBy(label).agg(F.count(F.lit(1)).alias("selected_rows"), F.countDistinct(event).alias("selected_events"))
    return a.join(b, label, "left").na.fill(0, ["selected_rows", "selected_events"])


def time_axis(df: DataFrame, columns: list[str], offset: str | None = None, order: str = "window_id") -> DataFrame:
    """df with time_axis: the first of the columns that holds most values, plus the offset in seconds if given; else row numbers."""
    from ..functions.labels import add_seconds

    there = [c for c in columns if c in df.columns]
    if there:
        counts = df.agg(*[F.count(c).alias(c) for c in there], F.count(F.lit(1)).alias("_all")).first()
        best = max(there, key=lambda c: (counts[c] > 0, counts[c] == counts["_all"], -there.index(c)))
        if counts[best]:
            t = F.col(best).cast("timestamp")
            return df.withColumn("time_axis", add_seconds(t, F.col(offset)) if offset else t)
    return df.withColumn("time_axis", F.col(order))
