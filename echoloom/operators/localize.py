"""Source location from arrays: a row per frame of all channels -> delays, fit, confidence and status per event or window."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..kernels import arrays as A
from ..kernels import filters


@dataclass(frozen=True)
class LocateConfig:
    """The defaults of the method."""

    spacing: float = 1.0
    velocity: float = 1500.0
    method: str = "gcc_phat"
    max_tau: float | None = 0.05
    least_psr: float = 6.0
    reference: int | None = None
    least_valid: int = 4
    x_bounds: tuple[float, float] | None = None
    z_bounds: tuple[float, float] = (0.1, 50.0)
    use_ransac: bool = True
    ransac_rounds: int = 200
    ransac_limit: float = 8e-4
    loss: str = "linear"
    model: str = "hyperbola"
    highpass: float | None = None
    band: tuple[float, float] | None = None
    normalize: bool = True
    low_confidence: float = 0.5
    most_rmse: float = 5e-3


def preprocess(data: np.ndarray, rate: float, c: LocateConfig) -> np.ndarray:
    """Means removed, optionally high-passed and band-passed, channels scaled to unit deviation. Columns are channels."""
    x = (data - data.mean(axis=0)).T
    if c.highpass:
        x = filters.high_pass(x, rate, c.highpass)
    if c.band:
        x = filters.band_filter(x, rate, c.band)
    if c.normalize:
        x = x / np.maximum(x.std(axis=1, keepdims=True), 1e-12)
    return x.T


def locate(data: np.ndarray, rate: float, c: LocateConfig) -> dict:
    """One window (frames, channels) -> source, fit error, confidence, status, reason."""
    n = data.shape[1]
    empty = {"source_x": None, "source_z": None, "valid_channels": 0, "rmse_tdoa": float("inf"), "confidence": 0.0, "status": "rejected", "fit_model": c.model, "ref_idx": -1}
    if data.shape[0] < 8 or n < c.least_valid:
        return empty | {"reason": "too_little_data"}
    x = preprocess(data, rate, c)
    ref = c.reference if c.reference is not None else int(np.argmax(A.snr_proxy(x)))
    d = A.estimate_delays(x, rate, ref, c.method, c.max_tau, c.least_psr)
    ok = d["valid"] & (np.abs(d["delay"]) <= c.max_tau if c.max_tau else True)
    valid = int(ok.sum())
    base = empty | {"valid_channels": valid, "ref_idx": ref}
    if valid < c.least_valid:
        return base | {"reason": "few_valid_channels"}
    at = np.arange(n) * c.spacing
    xb = c.x_bounds or (float(at[0]), float(at[-1]))
    px, pt = at[ok], d["delay"][ok]
    if c.model == "parabola":
        f = A.fit_parabola(px, pt)
        a, b, _ = f["coef"]
        f |= {"xs": float(-b / (2 * a)) if abs(a) > 1e-15 else None, "z": None}
    elif c.use_ransac:
        f = A.fit_consensus(px, pt, at[ref], c.velocity, xb, c.z_bounds, c.ransac_rounds, c.ransac_limit, c.loss)
    else:
        f = A.fit_hyperbola(px, pt, at[ref], c.velocity, xb, c.z_bounds, c.loss)
    others = np.arange(n) != ref
    psr = float(np.median(d["psr"][ok & others])) if (ok & others).any() else 0.0
    quality = 0.45 * min(1.0, max(0.0, psr / 20)) + 0.35 * float(np.exp(-f["rmse"] / 1e-3)) + 0.20 * valid / n
    quality = min(1.0, max(0.0, quality))
    status = "rejected" if f["rmse"] > c.most_rmse else "low_confidence" if quality < c.low_confidence else "ok"
    return base | {"source_x": f["xs"], "source_z": f["z"], "rmse_tdoa": f["rmse"], "confidence": quality, "status": status, "reason": "fit_error" if status == "rejected" else "", "fit_model": f["model"]}


RESULT = "source_x double, source_z double, valid_channels int, rmse_tdoa double, confidence double, status string, reason string, fit_model string, ref_idx int"
_FIELDS = [x.split()[0] for x in RESULT.split(", ")]


def locate_windows(frames: DataFrame, window: str, order: str, channels: str, rate: float, config: LocateConfig = LocateConfig()) -> DataFrame:
    """frames: window key, frame order, array of channel values -> one result per window. A window is one task's group,
    bounded by the window's length; a failing window gives a rejected row with its reason."""
    return sweep(frames, window, order, channels, rate, {"": config}).drop("config")


def grid_errors(points: DataFrame, key: str, x: Column, t: Column, xr: Column, velocity: float, xs: list[float], zs: list[float]) -> DataFrame:
    """Best grid source of each event as expressions: the grid is a literal, so an event's rows fan out by it and fold back
    in a partial aggregation."""
    grid = F.array(*[F.struct(F.lit(a).alias("xs"), F.lit(b).alias("z")) for a in xs for b in zs])
    rows = points.select(key, x.alias("_x"), t.alias("_t"), xr.alias("_r"), F.explode(grid).alias("g"))
    pred = (F.sqrt(F.pow(F.col("_x") - F.col("g.xs"), 2) + F.pow("g.z", F.lit(2))) - F.sqrt(F.pow(F.col("_r") - F.col("g.xs"), 2) + F.pow("g.z", F.lit(2)))) / velocity
    e = rows.groupBy(key, "g").agg(F.avg(F.pow(pred - F.col("_t"), 2)).alias("_e"))
    best = e.groupBy(key).agg(F.min(F.struct(F.col("_e"), F.col("g.xs").alias("xs"), F.col("g.z").alias("z"))).alias("b"))
    return best.select(key, "b.xs", "b.z", F.sqrt("b._e").alias("rmse"))


def sweep(frames: DataFrame, window: str, order: str, channels: str, rate: float, configs: dict[str, LocateConfig]) -> DataFrame:
    """The same windows under several configurations (method, model, loss, thresholds, velocity): a window's frames are made
    and brought together once, for all of them."""

    def run(f: pa.Table) -> pa.Table:
        f = f.sort_by(order)
        key, rows = f.column(window)[0].as_py(), []
        for name, config in configs.items():
            try:
                r = locate(np.array(f.column(channels).to_pylist(), float), rate, config)
            except Exception as e:  # the row carries it
                r = {"valid_channels": 0, "rmse_tdoa": float("inf"), "confidence": 0.0, "status": "rejected", "reason": f"{type(e).__name__}: {e}", "fit_model": config.model, "ref_idx": -1}
            rows.append({window: key, **{c: None if r.get(c) != r.get(c) else r.get(c) for c in _FIELDS}, "config": name})
        return pa.Table.from_pylist(rows, schema=schema)

    result = T.StructType([T.StructField(window, frames.schema[window].dataType), *T._parse_datatype_string(RESULT).fields, T.StructField("config", T.StringType())])
    schema = to_arrow_schema(result)
    return frames.select(window, order, channels).groupBy(window).applyInArrow(run, result)
