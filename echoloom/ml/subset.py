"""Two-class discriminants in closed form, prefix and forward search over all rows; nearest hit/miss relevance of a sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.discrimination import rank_auc


def lda_auc(x: np.ndarray, y: np.ndarray, folds: int = 5) -> tuple[float, float]:
    """Cross-validated |AUC - 1/2| + 1/2 of the pooled-covariance discriminant, and the separation of its scores."""
    folds = max(2, min(folds, int(min((y == 0).sum(), (y == 1).sum()))))
    fold = np.empty(len(y), int)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        fold[at] = np.arange(len(at)) % folds
    s = np.zeros(len(y))
    for k in range(folds):
        a, b = x[(fold != k) & (y == 0)], x[(fold != k) & (y == 1)]
        cov = ((a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))) / max(1, len(a) + len(b) - 2)
        w = np.linalg.solve(cov + 1e-6 * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-12 * np.eye(len(cov)), b.mean(0) - a.mean(0))
        s[fold == k] = (x[fold == k] - (a.mean(0) + b.mean(0)) / 2) @ w
    r = pd.Series(s).rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    auc = (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    spread = np.sqrt((s[y == 1].var() + s[y == 0].var()) / 2) + 1e-12
    return float(abs(auc - 0.5) + 0.5), float(abs(s[y == 1].mean() - s[y == 0].mean()) / spread)


def relief(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean distance to the nearest other-class row less that to the nearest same-class row, per feature, on scaled columns."""
    z = (x - x.min(0)) / np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1.0)
    out = np.zeros(x.shape[1])
    for k in range(0, len(z), 256):
        part = z[k : k + 256]
        d = np.abs(part[:, None] - z[None]).sum(-1)
        d[np.arange(len(part)), k + np.arange(len(part))] = np.inf
        same = y[k : k + 256, None] == y[None]
        hit, miss = np.where(same, d, np.inf).argmin(1), np.where(same, np.inf, d).argmin(1)
        out += (np.abs(part - z[miss]) - np.abs(part - z[hit])).sum(0)
    return out / len(z)


def fold_moments(df: DataFrame, label: str, features: list[str]) -> dict:
    """(fold, class) -> rows, sums and products of the features; a row per fold and class comes to the driver."""

    def part(frames):
        for f in frames:
            for (k, c), g in f.groupby(["_fold", label]):
                x = g[features].to_numpy(float)
                yield pd.DataFrame({"k": [k], "c": [c], "n": [len(x)], "s": [x.sum(0)], "m": [(x.T @ x).ravel()]})

    def total(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": f["k"][:1], "c": f["c"][:1], "n": [f["n"].sum()], "s": [np.sum(list(f["s"]), 0)], "m": [np.sum(list(f["m"]), 0)]})

    kind = "k int, c int, n long, s array<double>, m array<double>"
    rows = df.select("_fold", label, *features).mapInPandas(part, kind).groupBy("k", "c").applyInPandas(total, kind).collect()
    return {(r["k"], r["c"]): (r["n"], np.array(r["s"]), np.array(r["m"]).reshape(len(features), -1)) for r in rows}


def discriminant(moments: dict, at: list[int], fold: int) -> tuple[np.ndarray, float]:
    """Weights and offset of the pooled-covariance discriminant of all rows outside the fold."""
    means, scatter, rows = [], 0.0, 0
    for c in (0, 1):
        held = [v for (k, d), v in moments.items() if d == c and k != fold]
        n = sum(v[0] for v in held)
        mean = sum(v[1] for v in held)[at] / n
        scatter = scatter + sum(v[2] for v in held)[np.ix_(at, at)] - n * np.outer(mean, mean)
        means.append(mean)
        rows += n
    cov = scatter / max(1, rows - 2)
    w = np.linalg.solve(cov + 1e-6 * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-12 * np.eye(len(cov)), means[1] - means[0])
    return w, float((means[0] + means[1]) / 2 @ w)


def prepared(df: DataFrame, label: str, features: list[str], folds: int = 5) -> tuple[DataFrame, dict]:
    """All rows on standard columns with a fold by hash of the row, and the moments of each fold and class."""
    far = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    fold = F.pmod(F.xxhash64(*df.columns), F.lit(folds)).cast("int")
    t = df.select(F.col(label).cast("int").alias(label), fold.alias("_fold"), *[((F.col(c) - far[f"m{i}"]) / (far[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(features)])
    return t, fold_moments(t, label, features)


def evaluate_subsets(rows: tuple[DataFrame, dict], label: str, features: list[str], subsets: list[tuple[str, list[str]]]) -> DataFrame:
    """prepared() rows and named subsets -> name, features, AUC and separation of each, of the scores of all rows, each by
    the discriminant of the other folds."""
    t, moments = rows
    folds = sorted({k for k, _ in moments})
    scores, apart = [], []
    for name, cols in subsets:
        at = [features.index(c) for c in cols]
        fits = {k: discriminant(moments, at, k) for k in folds}
        by_fold = F.coalesce(*[F.when(F.col("_fold") == k, sum((F.col(c) * float(v) for c, v in zip(cols, w, strict=True)), F.lit(-b))) for k, (w, b) in fits.items()])
        scores.append(F.struct(F.lit(name).alias("name"), by_fold.alias("value")))
        apart.append((name, cols, separation(moments, at, fits)))
    long = t.select(F.col(label).alias("side"), F.explode(F.array(*scores)).alias("s")).select("side", "s.name", "s.value")
    auc = rank_auc(long, ["name"]).select("name", (F.abs(F.col("auc") - 0.5) + 0.5).alias("auc"))
    about = t.sparkSession.createDataFrame(apart, "name string, features array<string>, separation double")
    return F.broadcast(about).join(auc, "name").select("name", "features", "auc", "separation")  # a row a subset


def separation(moments: dict, at: list[int], fits: dict[int, tuple[np.ndarray, float]]) -> float:
    """Distance of the classes' mean scores over their deviation, from the moments of each fold and its discriminant."""
    means, spread = [], []
    for c in (0, 1):
        n = total = square = 0.0
        for k, (w, b) in fits.items():
            if (k, c) in moments:
                rows, s, m = moments[k, c]
                one = s[at] @ w
                n, total, square = n + rows, total + one - rows * b, square + w @ m[np.ix_(at, at)] @ w - 2 * b * one + rows * b * b
        means.append(total / n)
        spread.append(max(0.0, square / n - (total / n) ** 2))
    return float(abs(means[1] - means[0]) / (np.sqrt(sum(spread) / 2) + 1e-12))


def forward_search(spark, rows: DataFrame | pd.DataFrame | tuple[DataFrame, dict], label: str, features: list[str], most: int = 15) -> list[tuple[str, float]]:
    """Greedy over all rows (or those prepared()): each round scores all remaining features at once and keeps the best; ties by name."""
    ready = rows if isinstance(rows, tuple) else prepared(spark.createDataFrame(rows) if isinstance(rows, pd.DataFrame) else rows, label, features)
    chosen: list[tuple[str, float]] = []
    left = sorted(features)
    while left and len(chosen) < most:
        best = evaluate_subsets(ready, label, features, [(f, [c for c, _ in chosen] + [f]) for f in left]).orderBy(F.desc("auc"), "name").first()
        if chosen and best["auc"] <= chosen[-1][1] + 1e-6:
            break
        chosen.append((best["name"], best["auc"]))
        left.remove(best["name"])
    return chosen
