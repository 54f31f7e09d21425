"""Queries of the window features that rest on spectra and envelopes, beside the same formulas in SQL.

embeddings.embedding stands for a band signal of 64 samples at 64 kHz; frames of 16 samples, half overlapped, give nine
bins of 4 kHz and nine frames. The SQL writes out transform, envelope and features sum by sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..kernels import features as K
from ..kernels.spectra import DB4, welch_map
from ..sources.records import with_arrivals
from .wave import LONG, _waves

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RATE = 64_000.0
SIZE, HOP = 16, 8
PLAN = replace(
    K.plan_band((4_000.0, 28_000.0), RATE), main=(4_000.0, 28_000.0), low=(4_000.0, 12_000.0), high=(16_000.0, 28_000.0), window_ms=0.25, overlap=0.5, nfft=SIZE, short_ms=0.25, short_overlap=0.5, short_nfft=SIZE,
    smooth_ms=5 / 64, bulge_gap_ms=1 / 64, ridge_main=(4_000.0, 12_000.0), ridge_second=(12_000.0, 28_000.0), jump_hz=1e15, families=("time", "spectral", "entropy", "background", "ridge", "harmonic", "residual", "wavelet"), wavelet_level=2, harmonic=(16_000.0, 28_000.0),
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _features(spark, sf_dir, scales: dict[str, float]):
    """vec_id and the named features over their scale, six places; one Arrow pass. A value that isn't defined is null. Scale
    0: v / (1 + v), for ratios that grow without bound where there is nothing to divide by."""
    needed = tuple(n for n in PLAN.families if set(K.FAMILIES[n]) & set(scales))
    plan = replace(PLAN, families=needed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [K.window_features(x, RATE, plan) for x in f["x"]]
            yield pd.concat([f[["vec_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=list(scales))], axis=1)

    t = _waves(spark, sf_dir).select("vec_id", "x").mapInPandas(run, "vec_id long, " + ", ".join(f"{c} double" for c in scales))
    known = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in scales}
    return t.select("vec_id", *[F.round(known[c] / s if s else known[c] / (1 + known[c]), 6).alias(c) for c, s in scales.items()])


def _rounded(scales: dict[str, float]) -> str:
    return ", ".join(f"round({c} / {s or f'(1 + {c})'}, 6) AS {c}" for c, s in scales.items())


_POWER = f"""w AS ({LONG}),
 d AS (SELECT vec_id, t, k, sum(x * (0.5 - 0.5 * cos(2 * pi() * (i + {HOP} - {HOP} * t) / {SIZE})) * cos(2 * pi() * k * (i + {HOP} - {HOP} * t) / {SIZE})) / {SIZE // 2} AS re,
  sum(x * (0.5 - 0.5 * cos(2 * pi() * (i + {HOP} - {HOP} * t) / {SIZE})) * sin(2 * pi() * k * (i + {HOP} - {HOP} * t) / {SIZE})) / {SIZE // 2} AS im
  FROM w, (SELECT unnest(range(0, 9)) AS t), (SELECT unnest(range(0, 9)) AS k) WHERE i + {HOP} - {HOP} * t BETWEEN 0 AND {SIZE - 1} GROUP BY ALL),
 p AS (SELECT vec_id, t, k, 4000.0::DOUBLE * k AS f, re * re + im * im AS p, t * {HOP} / {RATE} AS s FROM d)"""
_ENVELOPE = f"""h AS (SELECT a.vec_id, a.i, any_value(a.x) AS x, sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.x * 2 / 64 / tan(pi() * (a.i - b.i) / 64) ELSE 0 END) AS q FROM w a JOIN w b USING (vec_id) GROUP BY a.vec_id, a.i),
 e AS (SELECT vec_id, i, x, coalesce(sum(sqrt(x * x + q * q)) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5 AS v FROM h),
 c AS (SELECT *, sum(v * v) OVER (PARTITION BY vec_id ORDER BY i) AS c, sum(v * v) OVER (PARTITION BY vec_id) AS total FROM e),
 b AS (SELECT vec_id, arg_max(i, v) AS peak, max(v) AS top, count(*) FILTER (WHERE c < {PLAN.onset} * total) AS a0, count(*) FILTER (WHERE c < {PLAN.offset} * total) AS b0, count(*) FILTER (WHERE c < 0.05 * total) AS i05, count(*) FILTER (WHERE c < 0.95 * total) AS i95 FROM c GROUP BY vec_id),
 g AS (SELECT *, a0 AS st, least(greatest(a0 + 1, b0), 63) AS en FROM b)"""

_SPECTRAL = {"SC_mean": 1.0, "k_sc": 1e6, "R_hl_mean": 1.0, "k_hl": 1e4, "H_tf": 1.0, "SF": 1.0, "H_alpha": 1.0, "F_peak": 1.0, "SK_max": 1.0, "spectral_spread": 1.0, "power_spectral_entropy": 1.0}


@query(f"""WITH {_POWER}, m AS (SELECT *, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-12) AS share FROM p WHERE k BETWEEN 1 AND 7),
 fr AS (SELECT vec_id, t, s, sum(f * p) / (sum(p) + 1e-12) AS sc, (sum(p) FILTER (WHERE k >= 4)) / ((sum(p) FILTER (WHERE k <= 3)) + 1e-12) AS hl FROM m GROUP BY ALL),
 a AS (SELECT vec_id, avg(sc) AS SC_mean, regr_slope(sc, s) AS k_sc, avg(hl) AS R_hl_mean, regr_slope(hl, s) AS k_hl FROM fr GROUP BY 1),
 bins AS (SELECT vec_id, k, avg(p) AS mp, avg(p * p) / (power(avg(p), 2) + 1e-12) - 2 AS sk FROM m GROUP BY ALL),
 q AS (SELECT vec_id, exp(avg(ln(mp + 1e-12))) / (avg(mp) + 1e-12) AS SF, max(sk) AS SK_max FROM bins GROUP BY 1),
 pe AS (SELECT vec_id, -sum(r * ln(r + 1e-12)) / ln(7) AS power_spectral_entropy FROM (SELECT vec_id, mp / (sum(mp) OVER (PARTITION BY vec_id) + 1e-12) AS r FROM bins) GROUP BY 1),
 z AS (SELECT vec_id, -sum(share * ln(share + 1e-12)) AS H_tf, -ln(sum(share * share) + 1e-12) AS H_alpha FROM m GROUP BY 1),
 ce AS (SELECT vec_id, sum(f * p) / (sum(p) + 1e-12) AS centre FROM m GROUP BY 1), sp AS (SELECT vec_id, sqrt(sum(power(f - centre, 2) * p) / (sum(p) + 1e-12)) AS spectral_spread FROM m JOIN ce USING (vec_id) GROUP BY 1),
 fl AS (SELECT vec_id, max(up) AS F_peak FROM (SELECT vec_id, t, sum(greatest(coalesce(p - before, 0), 0)) AS up FROM (SELECT *, lag(p) OVER (PARTITION BY vec_id, k ORDER BY t) AS before FROM p) GROUP BY ALL) GROUP BY 1)
 SELECT vec_id, {_rounded(_SPECTRAL)} FROM a JOIN q USING (vec_id) JOIN pe USING (vec_id) JOIN z USING (vec_id) JOIN sp USING (vec_id) JOIN fl USING (vec_id)""")
def wave_spectral_features(spark, sf_dir):
    """#70, F18, F19, F21, F22, F24, F34, F36: spectra of each waveform."""
    return _features(spark, sf_dir, _SPECTRAL)


_TIME = {"r_p": 1.0, "A_env": 1.0, "R_td": 1.0, "C_E": 1e-3, "S_env": 1.0, "Sk_env": 1.0, "R_fb": 0.0, "C_bulge": 1.0, "N_bulge": 1.0, "epsilon_env": 1.0, "eta_bw": 1.0}


@query(f"""WITH w AS ({LONG}), {_ENVELOPE},
 j AS (SELECT e.vec_id, i, v, peak, top, st, en, i05, i95, i - peak AS dd, greatest(v, 1e-12) AS wt, lag(v) OVER o AS before, lead(v) OVER o AS after, avg(v) OVER (PARTITION BY e.vec_id) AS mv FROM e JOIN g USING (vec_id) WINDOW o AS (PARTITION BY e.vec_id ORDER BY i)),
 sg AS (SELECT vec_id, greatest(1, sqrt((sum(dd * dd * wt) FILTER (WHERE dd <= 0)) / (sum(wt) FILTER (WHERE dd <= 0)))) AS s0, greatest(1, sqrt((sum(dd * dd * wt) FILTER (WHERE dd >= 0)) / (sum(wt) FILTER (WHERE dd >= 0)))) AS s1 FROM j GROUP BY 1),
 sy AS (SELECT x.vec_id, sum((x.v - x.mv) * (y.v - y.mv)) / sum(power(x.v - x.mv, 2)) AS S_env FROM j x JOIN j y ON x.vec_id = y.vec_id AND x.i + y.i = 63 GROUP BY 1),
 r AS (SELECT vec_id, ((any_value(peak) - any_value(st))::DOUBLE) / (any_value(en) - any_value(st)) AS r_p, ((any_value(en) - any_value(peak)) - (any_value(peak) - any_value(st)))::DOUBLE / (any_value(en) - any_value(st)) AS A_env,
  greatest((any_value(en) - any_value(peak)) / {RATE}, 1e-12) / greatest((any_value(peak) - any_value(st)) / {RATE}, 1e-12) AS R_td, sum(i / {RATE} * v * v) / (sum(v * v) + 1e-12) AS C_E, skewness(v) AS Sk_env,
  coalesce(sum(v * v) FILTER (WHERE i BETWEEN st AND peak), 0) / (coalesce(sum(v * v) FILTER (WHERE i BETWEEN peak + 1 AND en), 0) + 1e-12) AS R_fb, avg((v >= {PLAN.bulge_level} * (top + 1e-12))::INT) AS C_bulge,
  count(*) FILTER (WHERE v > before AND v > after AND v >= {PLAN.bulge_level} * (top + 1e-12)) AS N_bulge, sqrt(sum(power(v - top * exp(-0.5 * power(dd / CASE WHEN dd < 0 THEN s0 ELSE s1 END, 2)), 2))) / (sqrt(sum(v * v)) + 1e-12) AS epsilon_env,
  (any_value(i95) - any_value(peak) + 1)::DOUBLE / greatest(1, any_value(peak) - any_value(i05) + 1) AS eta_bw FROM j JOIN sg USING (vec_id) GROUP BY vec_id)
 SELECT vec_id, {_rounded(_TIME)} FROM r JOIN sy USING (vec_id)""")
def wave_envelope_features(spark, sf_dir):
    """#65, #77, #80, #89, F4-F12: the smoothed envelope of each waveform, its support, flanks and bulges."""
    return _features(spark, sf_dir, _TIME)


_GROUND = {"SNR_band_db": 1.0, "E_excess": 1.0, "SNR_high_db": 1.0, "beta_H": 1e3}


@query(f"""WITH {_POWER}, {_ENVELOPE}, fe AS (SELECT vec_id, t, s, sum(p) AS al, sum(p) FILTER (WHERE k BETWEEN 4 AND 7) AS hi FROM p GROUP BY ALL),
 o AS (SELECT fe.*, peak, en, {HOP} * t BETWEEN st AND en AS ev0, count(*) FILTER (WHERE NOT ({HOP} * t BETWEEN st AND en)) OVER (PARTITION BY vec_id) AS out FROM fe JOIN g USING (vec_id)), x AS (SELECT *, CASE WHEN out < 2 THEN t >= 2 ELSE ev0 END AS ev FROM o),
 r AS (SELECT vec_id, 10 * log10((coalesce(avg(al) FILTER (WHERE ev), 0) + 1e-12) / (coalesce(avg(al) FILTER (WHERE NOT ev), 0) + 1e-12)) AS SNR_band_db, greatest(coalesce(sum(al) FILTER (WHERE ev), 0) - coalesce(avg(al) FILTER (WHERE NOT ev), 0) * count(*) FILTER (WHERE ev), 0) AS E_excess,
  10 * log10((coalesce(avg(hi) FILTER (WHERE ev), 0) + 1e-12) / (coalesce(avg(hi) FILTER (WHERE NOT ev), 0) + 1e-12)) AS SNR_high_db, CASE WHEN count(*) FILTER (WHERE {HOP} * t BETWEEN peak AND en) >= 2 THEN regr_slope(ln(hi + 1e-12), s) FILTER (WHERE {HOP} * t BETWEEN peak AND en) END AS beta_H FROM x GROUP BY vec_id)
 SELECT vec_id, {_rounded(_GROUND)} FROM r""")
def wave_background_features(spark, sf_dir):
    """what rises above the frames outside the event, and how high frequencies fall after the peak."""
    return _features(spark, sf_dir, _GROUND)


_RIDGE = {"rho_r": 1.0, "G_gap": 1.0, "rho_up": 1.0, "rho_down": 1.0, "N_turn": 1.0, "Delta_f_span": 1.0, "C_f": 1e9, "H2_ratio": 1.0, "R_2_1": 1.0, "H_stack": 1.0, "R_h": 1.0, "epsilon_2x": 1.0, "C_h": 1.0, "R_harm": 1.0, "E_harm": 1.0,
          "E_res": 1.0, "rho_res": 1.0, "R_high_res": 1.0, "N_abn": 1.0, "SC_res_mean": 1.0, "k_res_sc": 1e6, "R_res_hl_mean": 0.0}


@query(f"""WITH {_POWER}, r0 AS (SELECT vec_id, t, any_value(s) AS s, sum(p) AS al, arg_max(k, p) FILTER (WHERE k BETWEEN 1 AND 3) AS k1, arg_max(k, p) FILTER (WHERE k BETWEEN 3 AND 7) AS k2 FROM p GROUP BY ALL),
 r1 AS (SELECT *, al > 0.2 * median(al) OVER (PARTITION BY vec_id) AS act, k2 = 2 * k1 AS two, 4000.0::DOUBLE * k1 AS f1, 4000.0::DOUBLE * k2 AS f2 FROM r0),
 r2 AS (SELECT *, lag(act) OVER o AS act0, (f1 - lag(f1) OVER o) / {HOP / RATE} AS sl, CASE WHEN t = 0 THEN (lead(f1) OVER o - f1) / {HOP / RATE} WHEN t = 8 THEN (f1 - lag(f1) OVER o) / {HOP / RATE} ELSE (lead(f1) OVER o - lag(f1) OVER o) / {2 * HOP / RATE} END AS g1 FROM r1 WINDOW o AS (PARTITION BY vec_id ORDER BY t)),
 r3 AS (SELECT *, CASE WHEN t = 0 THEN (lead(g1) OVER o - g1) / {HOP / RATE} WHEN t = 8 THEN (g1 - lag(g1) OVER o) / {HOP / RATE} ELSE (lead(g1) OVER o - lag(g1) OVER o) / {2 * HOP / RATE} END AS g2 FROM r2 WINDOW o AS (PARTITION BY vec_id ORDER BY t)),
 tn AS (SELECT vec_id, count(*) FILTER (WHERE sg <> before) AS n FROM (SELECT vec_id, t, sign(sl) AS sg, lag(sign(sl)) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM r2 WHERE act AND act0 AND sl <> 0) GROUP BY 1),
 fr AS (SELECT r3.vec_id, avg(act::INT) AS rho_r, avg((NOT act OR coalesce(act0 AND act AND abs(sl) * {HOP / RATE} > 8000, false))::INT) AS G_gap, coalesce(avg((sl > 2e6)::INT) FILTER (WHERE act AND act0), 0) AS rho_up, coalesce(avg((sl < -2e6)::INT) FILTER (WHERE act AND act0), 0) AS rho_down,
  coalesce(any_value(tn.n), 0) AS N_turn, max(f1) FILTER (WHERE act) - min(f1) FILTER (WHERE act) AS Delta_f_span, avg(abs(g2)) FILTER (WHERE act) / (avg(f1) FILTER (WHERE act) + 1e-12) AS C_f, avg(two::INT) FILTER (WHERE act) AS H2_ratio,
  median(abs(f2 - 2 * f1) / (f1 + 1e-12)) FILTER (WHERE act) AS epsilon_2x, avg(abs(f2 - 2 * f1)) FILTER (WHERE act) AS C_h FROM r3 LEFT JOIN tn USING (vec_id) GROUP BY r3.vec_id),
 m AS (SELECT p.vec_id, p.t, p.k, p.f, p.s, p.p, al, act AND abs(k - k1) <= 2 AS n1, act AND two AND abs(k - k2) <= 2 AS n2, act AND k = k1 AS x1, act AND two AND k = k2 AS x2, act AND (abs(k - k1) <= 2 OR abs(k - 2 * k1) <= 2 OR abs(k - 3 * k1) <= 2) AS st FROM p JOIN r1 USING (vec_id, t)),
 u AS (SELECT *, CASE WHEN n1 OR n2 THEN 0 ELSE p END AS rp FROM m),
 po AS (SELECT vec_id, coalesce(sum(p) FILTER (WHERE n2), 0) / ((sum(p) FILTER (WHERE n1)) + 1e-12) AS R_2_1, (sum(p) FILTER (WHERE st)) / (sum(p) + 1e-12) AS H_stack, coalesce(sum(p) FILTER (WHERE x2), 0) / ((sum(p) FILTER (WHERE x1)) + 1e-12) AS R_h,
  (sum(p) FILTER (WHERE n1 OR n2)) / (sum(p) + 1e-12) AS R_harm, sum(p) FILTER (WHERE n1 OR n2) AS E_harm, sum(rp) AS E_res, sum(rp) / (sum(p) + 1e-12) AS rho_res, (sum(rp) FILTER (WHERE k BETWEEN 4 AND 7)) / (sum(p) + 1e-12) AS R_high_res FROM u GROUP BY 1),
 rf AS (SELECT vec_id, t, s, sum(rp) / (any_value(al) + 1e-12) AS share, sum(f * rp) / (sum(rp) + 1e-12) AS sc, (sum(rp) FILTER (WHERE k BETWEEN 4 AND 7)) / ((sum(rp) FILTER (WHERE k BETWEEN 1 AND 3)) + 1e-12) AS hl FROM u GROUP BY ALL),
 re AS (SELECT vec_id, count(*) FILTER (WHERE share > {PLAN.abnormal}) AS N_abn, avg(sc) AS SC_res_mean, regr_slope(sc, s) AS k_res_sc, avg(hl) AS R_res_hl_mean FROM rf GROUP BY 1)
 SELECT vec_id, {_rounded(_RIDGE)} FROM fr JOIN po USING (vec_id) JOIN re USING (vec_id)""")
def wave_ridge_features(spark, sf_dir):
    """#76, F26, F28-F33, F38: the ridge that may jump freely (the strongest bin of each frame), its harmonics and what is
    left without both. The ridge with a cost of jumps is tested against the full search."""
    return _features(spark, sf_dir, _RIDGE)


_NODES = ("aa", "ad", "dd", "da")
_PACKET = {f"R_wp_{n}": 1.0 for n in _NODES} | {"H_wp": 1.0, "I_burst": 1.0, "D_WPT": 1.0}
_TAPS = "(SELECT * FROM (VALUES {}) v(j, a, d))".format(", ".join(f"({j}, {a!r}::DOUBLE, {float(DB4[7 - j]) * (1 if j % 2 else -1)!r}::DOUBLE)" for j, a in enumerate(map(float, DB4))))


def _halved(source: str, value: str, n: int) -> str:
    """vec_id, i, and both halves of a signal of n samples that is mirrored at its ends."""
    at = f"(((2 * q + 1 - j) % {2 * n} + {2 * n}) % {2 * n})"
    return f"SELECT vec_id, q AS i, sum(a * {value}) AS lo, sum(d * {value}) AS hi FROM {source}, {_TAPS}, (SELECT unnest(range(0, {(n + 7) // 2})) AS q) WHERE i = CASE WHEN {at} < {n} THEN {at} ELSE {2 * n - 1} - {at} END GROUP BY ALL"


@query(f"""WITH w AS ({LONG}), one AS ({_halved("w", "x", 64)}), a2 AS ({_halved("one", "lo", 35)}), d2 AS ({_halved("one", "hi", 35)}),
 e AS (SELECT vec_id, sum(lo * lo) AS aa, sum(hi * hi) AS ad FROM a2 GROUP BY 1), f AS (SELECT vec_id, sum(lo * lo) AS da, sum(hi * hi) AS dd FROM d2 GROUP BY 1), s AS (SELECT *, aa + ad + da + dd + 1e-12 AS al FROM e JOIN f USING (vec_id)),
 n AS (SELECT vec_id, {", ".join(f"{n} / al AS R_wp_{n}" for n in _NODES)}, [aa / al, ad / al, dd / al, da / al] AS p, (ad + dd + da - greatest(al - (ad + dd + da), 0)) / al AS D_WPT FROM s),
 r AS (SELECT *, -list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))) AS H_wp, list_max(p) / (list_median(p) + 1e-12) AS I_burst FROM n)
 SELECT vec_id, {_rounded(_PACKET)} FROM r""")
def wave_packet_features(spark, sf_dir):
    """#86, F40: energy shares of the four packet nodes at level two."""
    return _features(spark, sf_dir, _PACKET)


@query(f"""WITH w AS ({LONG}), f AS (SELECT vec_id, t, j, coalesce(x, 0) AS x FROM (SELECT DISTINCT vec_id FROM w), (SELECT unnest(range(0, 4)) AS t), (SELECT unnest(range(0, 24)) AS j) LEFT JOIN (SELECT vec_id AS v, i, x FROM w) ON v = vec_id AND i = 16 * t + j),
 m AS (SELECT *, (x - avg(x) OVER (PARTITION BY vec_id, t)) * (0.5 - 0.5 * cos(2 * pi() * j / 24)) AS y FROM f),
 d AS (SELECT vec_id, t, k, sum(y * cos(2 * pi() * k * j / 24)) AS re, sum(y * sin(2 * pi() * k * j / 24)) AS im FROM m, (SELECT unnest(range(0, 13)) AS k) GROUP BY ALL)
 SELECT vec_id, t::INTEGER AS frame, k::INTEGER AS bin, round(10 * log10(greatest((CASE WHEN k BETWEEN 1 AND 11 THEN 2 ELSE 1 END) * (re * re + im * im) / (64000.0 * 9), 1e-20)), 3) AS level FROM d""")
def wave_welch_map(spark, sf_dir):
    """#84: decibel spectra of outer frames of 24 samples, 16 apart, the last one partly filled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for v, x in zip(f["vec_id"], f["x"], strict=True):
                m = welch_map(np.asarray(x, float), RATE, 24, 16)
                t, k = np.indices(m.shape)
                yield pd.DataFrame({"vec_id": v, "frame": t.ravel(), "bin": k.ravel(), "level": m.ravel()})

    return _waves(spark, sf_dir).select("vec_id", "x").mapInPandas(run, "vec_id long, frame int, bin int, level double").withColumn("level", F.round("level", 3))


@query(f"""WITH w AS ({LONG}), h AS (SELECT a.vec_id, a.i, any_value(a.x) AS x, sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.x * 2 / 64 / tan(pi() * (a.i - b.i) / 64) ELSE 0 END) AS q FROM w a JOIN w b USING (vec_id) GROUP BY a.vec_id, a.i),
 e AS (SELECT vec_id, i, sum(x * x + q * q) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) / 32 AS e FROM h),
 b AS (SELECT vec_id, avg(e) FILTER (WHERE i < 12) + 6 * stddev_pop(e) FILTER (WHERE i < 12) AS limit_, arg_max(i, e) AS peak FROM e GROUP BY vec_id)
 SELECT b.vec_id, coalesce(min(i) FILTER (WHERE e >= limit_), any_value(peak))::BIGINT AS arrival_index FROM b JOIN e USING (vec_id) GROUP BY b.vec_id""")
def wave_arrivals(spark, sf_dir):
    """#5: the estimated arrival of a record without a label."""
    t = _waves(spark, sf_dir).select("vec_id", F.col("x").alias("signal"), F.lit(RATE).alias("sample_rate"), F.lit("20260101T000000.000").alias("starttime"), F.lit(None).cast("string").alias("arrival_time"))
    return with_arrivals(t).select("vec_id", "arrival_index")
