"""Per-record ridge analysis and comparison of event methods: band peaks, decay, spectra, aligned curves and their quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import filters, spectra
from ..kernels.features import EPS, slope
from .ordered import group_quantiles

#: Bands of the peak-to-peak comparison in Hz.
PEAK_BANDS = {"b1_5k": (1e3, 5e3), "b5_10k": (5e3, 1e4), "b10_20k": (1e4, 2e4), "b20_40k": (2e4, 4e4), "b40_60k": (4e4, 6e4), "b60_100k": (6e4, 1e5)}
RIDGE_FIELDS = (
    "support_start_s", "support_end_s", "support_s", "f0_mean", "f0_std", "f0_min", "f0_max", "f0_span", "f0_start", "f0_end", "f0_median", "f0_slope", "f0_quad", "f0_r2", "f0_peak_time_s", "f0_peaks", "f0_smoothness",
    "h2_total_s", "h2_longest_s", "h2_share", "h2_ratio_error", "h2_corr", "h3_total_s", "h3_longest_s", "h3_share", "h3_ratio_error", "h3_corr", "energy", "peak_amplitude", "rms", "crest", "centroid", "bandwidth", "rise_s", "decay_s", "duration_s",
)


def ridge_row(x: np.ndarray, rate: float, band: tuple[float, float] = (1e3, 1e5), search: tuple[float, float] = (5e3, 3e4), window_ms: float = 2.048, overlap: float = 0.9, jump_hz: float = 1500.0) -> dict[str, float]:
    """Fundamental ridge, second and third harmonic and shape of one event."""
    band = (band[0], min(band[1], 0.49 * rate))
    y = filters.band_filter(filters.detrend(np.asarray(x, float)), rate, band)
    env = spectra.envelope(y, rate, 0.2)
    c = np.cumsum(env**2)
    i0, i1 = (int(v) for v in np.searchsorted(c, [0.05 * c[-1], 0.95 * c[-1]])) if c[-1] > 0 else (0, len(y) - 1)
    f, t, s = spectra.stft(y, rate, window_ms, overlap)
    p = np.abs(s) ** 2
    inside = (t >= i0 / rate) & (t <= i1 / rate)
    inside = inside if inside.sum() >= 3 else np.ones(len(t), bool)
    p, t = p[:, inside], t[inside]
    f0 = spectra.moving_average(np.pad(spectra.harmonic_sum_ridge(f, p, (search[0], min(search[1], 0.45 * rate)), jump_hz), 1, mode="edge"), 3)[1:-1]
    out = {"support_start_s": i0 / rate, "support_end_s": i1 / rate, "support_s": (i1 - i0) / rate, "f0_mean": f0.mean(), "f0_std": f0.std(), "f0_min": f0.min(), "f0_max": f0.max(), "f0_span": np.ptp(f0), "f0_start": f0[0], "f0_end": f0[-1], "f0_median": np.median(f0), "f0_slope": slope(t, f0)}
    quad = np.polyfit(t - t[0], f0, 2) if len(t) >= 3 else np.zeros(3)
    left, around = f0 - np.polyval(quad, t - t[0]), f0 - f0.mean()
    peaks = spectra.find_peaks(f0, prominence=0.1 * np.ptp(f0)) if np.ptp(f0) > 0 else np.zeros(0, int)
    out |= {"f0_quad": quad[0], "f0_r2": 1 - left @ left / (around @ around) if around @ around > 0 else 0.0, "f0_peak_time_s": t[int(np.argmax(f0))], "f0_peaks": float(len(peaks)), "f0_smoothness": np.abs(np.diff(f0)).mean() if len(f0) > 1 else 0.0}
    for k, least in ((2, 0.08), (3, 0.05)):
        h = spectra.track_harmonic(f, t, p, f0, k, least, jump_hz)
        valid = h["valid"]
        err = np.median(np.abs(h["track"] / np.maximum(f0, EPS) - k))
        both = np.corrcoef(h["track"][valid], f0[valid])[0, 1] if valid.sum() > 2 and h["track"][valid].std() > 0 and f0[valid].std() > 0 else 0.0
        out |= {f"h{k}_total_s": h["total_s"], f"h{k}_longest_s": h["longest_s"], f"h{k}_share": h["median_share"], f"h{k}_ratio_error": err, f"h{k}_corr": both}
    top, mean = int(np.argmax(env)), p.mean(axis=1)
    centre = float(f @ mean / (mean.sum() + EPS))
    rms = float(np.sqrt((y * y).mean()))
    return {k: float(v) for k, v in (out | {"energy": y @ y, "peak_amplitude": np.abs(y).max(), "rms": rms, "crest": np.abs(y).max() / (rms + EPS), "centroid": centre, "bandwidth": np.sqrt(((f - centre) ** 2) @ mean / (mean.sum() + EPS)), "rise_s": max(0, top - i0) / rate, "decay_s": max(0, i1 - top) / rate, "duration_s": len(x) / rate}).items()}


def ridge_features(records: DataFrame, key: str, signal: str, rate: str, **options) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{key: k, **ridge_row(x, r, **options)} for k, x, r in zip(f[key], f[signal], f[rate], strict=True)], columns=[key, *RIDGE_FIELDS])

    return records.select(key, signal, rate).mapInPandas(run, f"{key} {dict(records.dtypes)[key]}, " + ", ".join(f"{c} double" for c in RIDGE_FIELDS))


def onset(x: np.ndarray, rate: float, baseline_s: float = 0.002, deviations: float = 6.0) -> int:
    """First sample whose smoothed energy passes mean + k deviations of the leading baseline; else the peak."""
    e = spectra.envelope(np.asarray(x, float) - np.mean(x), rate, 0.5) ** 2
    n = max(8, min(len(e) // 4, int(round(baseline_s * rate))))
    above = np.flatnonzero(e[n:] >= e[:n].mean() + deviations * e[:n].std())
    return int(n + above[0]) if len(above) else int(np.argmax(e))


def band_peaks(x: np.ndarray, rate: float, bands: dict[str, tuple[float, float]] = PEAK_BANDS) -> dict[str, float]:
    """Peak-to-peak of each band after a 1 kHz high-pass; a band beyond the rate is NaN."""
    y = filters.high_pass(np.asarray(x, float), rate, 1e3) if rate > 2100 else np.asarray(x, float)
    return {n: float(np.ptp(filters.band_filter(y, rate, b))) if b[0] < 0.49 * rate else float("nan") for n, b in bands.items()}


def event_row(x: np.ndarray, rate: float, arrival: int | None) -> dict:
    """Times and spectrum of one event from its arrival on: duration to 1/e, early energy, band peaks, 20 ms spectrum."""
    i = onset(x, rate) if arrival is None or arrival < 0 else int(arrival)
    e = spectra.envelope(np.asarray(x, float) - np.mean(x), rate, 0.5) ** 2
    seg = e[i:] if i < len(e) else e[-1:]
    top = int(np.argmax(seg))
    fell = np.flatnonzero(seg[top:] <= seg[top] / np.e)
    part = np.asarray(x, float)[i : i + int(round(0.02 * rate))]
    f, p = spectra.welch(np.pad(part, (0, max(0, int(round(0.02 * rate)) - len(part)))), rate)
    return {"arrival_index": i, "arrival_source": "estimated" if arrival is None or arrival < 0 else "labelled", "decay_s": float((top + fell[0]) / rate) if len(fell) else float(len(seg) / rate), "early_energy": float(seg[: int(round(0.01 * rate))].sum()), "freq": f, "psd": p, "cumulative": np.cumsum(p) / max(p.sum(), EPS), **band_peaks(x, rate)}


def event_table(records: DataFrame, key: str, method: str, signal: str, rate: str, arrival: str, grid: list[float]) -> DataFrame:
    """One row per event; its spectrum is put on the common grid in the same pass."""
    names = list(PEAK_BANDS)
    head = f"{key} {dict(records.dtypes)[key]}, {method} {dict(records.dtypes)[method]}, arrival_index long, arrival_source string, decay_s double, early_energy double, " + ", ".join(f"{b} double" for b in names) + ", psd array<double>, cumulative array<double>"
    cols = [c.split()[0] for c in head.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, m, x, r, a in zip(f[key], f[method], f[signal], f[rate], f[arrival], strict=True):
                row = event_row(x, r, None if pd.isna(a) else int(a))
                at = row.pop("freq")
                rows.append({key: k, method: m, **row, "psd": np.interp(grid, at, row["psd"]), "cumulative": np.interp(grid, at, row["cumulative"])})
            yield pd.DataFrame(rows, columns=cols)

    return records.select(key, method, signal, rate, arrival).mapInPandas(run, head)


def curve_summary(events: DataFrame, by: str, curve: str, grid: list[float]) -> DataFrame:
    """Median, 10 and 90 % and mean per grid point and group."""
    x = F.array(*[F.lit(float(v)) for v in grid])
    long = events.select(by, F.posexplode(curve).alias("i", "v"))
    s = long.groupBy(by, "i").agg(F.avg("v").alias("mean")).join(group_quantiles(long, [by, "i"], (0.5, 0.1, 0.9), "v"), [by, "i"], "left")
    return s.select(by, F.get(x, F.col("i")).alias("x"), *[F.col("quantiles")[k].alias(n) for k, n in enumerate(("median", "p10", "p90"))], "mean")


def method_summary(events: DataFrame, by: str, features: list[str]) -> DataFrame:
    """Mean, median, deviation, range of each feature by method, long."""
    long = events.select(by, *features).unpivot([by], features, "feature", "value").where(~F.isnan("value"))
    s = long.groupBy(by, "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    medians = group_quantiles(long, [by, "feature"], (0.5,)).select(by, "feature", F.col("quantiles")[0].alias("median"))
    return s.join(medians, [by, "feature"], "left").select(by, "feature", "mean", "median", "std", "min", "max")
