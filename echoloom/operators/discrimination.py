"""How well features tell classes and domains apart. Input is long: keys, feature, a 0/1 side and a value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import EPS
from ..session import broadcast_within, materialize
from .ordered import paired, MAX_BROADCAST, group_quantiles, median_from, order_statistic, running


def folded(long: DataFrame, by: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """by, value, p, q: rows of either side per distinct value. A heavy tie is one row from here on."""
    is_one = (F.col(side) == 1).cast("long")
    return long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(is_one).alias("p"), F.sum(1 - is_one).alias("q"))


def rank_auc(long: DataFrame, by: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """by, n_pos, n_neg, auc, cliff_delta from average ranks with ties."""
    s = paired(folded(long, by, side, value), by, value).withColumnsRenamed({"all_p": "n_pos", "all_q": "n_neg"})
    auc = F.col("pairs") / (F.col("n_pos") * F.col("n_neg"))
    return s.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("distinct") > 1), auc).alias("auc")).withColumn("cliff_delta", 2 * F.col("auc") - 1)


def _apart(p: str, q: str) -> Column:
    """Distance of both distribution functions from a value to the next."""
    return F.abs(F.try_divide(F.col(f"before_{p}") + F.col(p), F.col(f"all_{p}")) - F.try_divide(F.col(f"before_{q}") + F.col(q), F.col(f"all_{q}")))


def wasserstein(long: DataFrame, by: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """Integral of the distance of the two empirical distribution functions."""
    v = running(folded(long, by, side, value), by, value, ["p", "q"])
    return v.groupBy(*by).agg(F.coalesce(F.sum((F.col("next_value") - F.col(value)) * _apart("p", "q")), F.lit(0.0)).alias("wasserstein"))


def weighted_variance(long: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """by, variance (population) of the values that are there; of rows that stand for `weight` rows each, about their mean."""
    t = long.where(F.col(value).isNotNull())
    if weight is None:
        return t.groupBy(*by).agg(F.var_pop(value).alias("variance"))
    mean = t.groupBy(*by).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("_mean"))
    d = F.col(value) - F.col("_mean")
    return t.join(mean, by).groupBy(*by).agg((F.sum(F.col(weight) * d * d) / F.sum(weight)).alias("variance"))


def domain_distances(counts: DataFrame, by: list[str], domain: str, value: str = "value") -> DataFrame:
    """by, _pair (a, b), _w: distance of the distributions of every two domains a < b, of rows per value with their number `_c`; NULL
    where one of them has no value. A row goes to its domain's pairs, of which there are few."""
    domains = counts.select(domain).distinct().agg(F.array_sort(F.collect_set(domain))).first()[0] or []
    kind = f"array<struct<a:{dict(counts.dtypes)[domain]},b:{dict(counts.dtypes)[domain]}>>"
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(domains) for b in domains[i + 1 :]]).cast(kind)
    d = F.col(domain)
    t = counts.withColumn("_pair", F.explode(F.filter(pairs, lambda x: (x["a"] == d) | (x["b"] == d))))
    v = t.groupBy(*by, "_pair", value).agg(F.sum(F.when(d == F.col("_pair.a"), F.col("_c")).otherwise(0)).alias("p"), F.sum(F.when(d == F.col("_pair.b"), F.col("_c")).otherwise(0)).alias("q"))
    r = running(v, [*by, "_pair"], value, ["p", "q"])
    return r.groupBy(*by, "_pair").agg(F.sum((F.col("next_value") - F.col(value)) * _apart("p", "q")).alias("_w"))


def domain_stability(long: DataFrame, by: list[str], domain: str, value: str = "value", weight: str | None = None) -> DataFrame:
    """1 / (1 + mean pairwise distance over the pooled deviation); domains pair up i < j among their distinct names.

    Pairs come from per-value counts. A row of `long` may stand for `weight` rows.
    """
    counts = long.where(F.col(value).isNotNull()).groupBy(*by, domain, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    pooled = weighted_variance(long, by, value, weight).select(*by, F.sqrt("variance").alias("_sd"))
    if counts.select(domain).where(F.col(domain).isNotNull()).distinct().limit(2).count() < 2:
        return pooled.select(*by, F.lit(1.0).alias("stability"))
    mean = domain_distances(counts, by, domain, value).groupBy(*by).agg(F.avg("_w").alias("_w"))
    return mean.join(pooled, by).select(*by, (1 / (1 + F.col("_w") / (F.col("_sd") + EPS))).alias("stability"))


def binned_mutual_information(long: DataFrame, by: list[str], side: str = "side", value: str = "value", most: int = 16) -> DataFrame:
    """Equal-width bins, min(16, max(2, floor(sqrt n))) of them, in nats. Joint counts are the only shuffled rows."""
    w = long.where(F.col(value).isNotNull())
    span = w.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    span = span.withColumn("_bins", F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.sqrt("_n")))).cast("int"))
    t = w.join(broadcast_within(materialize(span, "binned-spans"), MAX_BROADCAST), by).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins")), F.col("_bins") - 1)).otherwise(0))
    joint = t.groupBy(*by, "_b", side).agg(F.count(F.lit(1)).alias("_c"))
    p = joint.withColumns({"_t": F.sum("_c").over(W.partitionBy(*by)), "_x": F.sum("_c").over(W.partitionBy(*by, "_b")), "_y": F.sum("_c").over(W.partitionBy(*by, side))})
    return p.groupBy(*by).agg(F.sum(F.col("_c") / F.col("_t") * F.log(F.col("_c") * F.col("_t") / (F.col("_x") * F.col("_y")))).alias("mi"))


def f_ratio(long: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    """Population variance of the groups' means over the mean of their population variances."""
    g = long.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return g.groupBy(*by).agg((F.var_pop("_m") / (F.avg("_v") + EPS)).alias("f_ratio"))


def anova_f(long: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    g = long.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    g = g.withColumn("_g", F.sum(F.col("_n") * F.col("_m")).over(W.partitionBy(*by)) / F.sum("_n").over(W.partitionBy(*by)))
    s = g.groupBy(*by).agg(F.sum(F.col("_n") * (F.col("_m") - F.col("_g")) * (F.col("_m") - F.col("_g"))).alias("_b"), F.sum(F.col("_n") * F.col("_v")).alias("_w"), F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_n"))
    return s.select(*by, ((F.col("_b") / (F.col("_k") - 1)) / (F.col("_w") / (F.col("_n") - F.col("_k")))).alias("anova_f"))


def discrimination_table(long: DataFrame, label: str, comparisons: dict[str, tuple[list, list]], value: str = "value", most: int = 16) -> DataFrame:
    """Every comparison (name -> positive labels, negative labels) by every feature in one scan.

    A label's rows go to the comparisons that name it; the list of comparisons is a literal of the plan. Rows are folded to
    counts per distinct value, running sums of both sides give ranks, distribution functions and medians, and two
    aggregations, by bin and then by feature, all measures. No window or sketch holds a whole feature.
    """
    listed = F.array(*[F.struct(F.lit(n).alias("comparison"), F.array(*map(F.lit, p)).alias("p"), F.array(*map(F.lit, q)).alias("q")) for n, (p, q) in comparisons.items()])
    l, x = F.col(label), F.col(value)
    # folded by label first: what fans out to the comparisons is a row per label and distinct value
    t = long.where(x.isNotNull()).groupBy("feature", label, value).agg(F.count(F.lit(1)).alias("_n"))
    t = t.withColumn("_c", F.explode(F.filter(listed, lambda c: F.array_contains(c["p"], l) | F.array_contains(c["q"], l))))
    positive = F.array_contains(F.col("_c.p"), l)
    by = ["comparison", "feature"]
    v = t.groupBy(F.col("_c.comparison").alias("comparison"), "feature", value).agg(F.sum(F.when(positive, F.col("_n")).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(F.col("_n"))).alias("q"))
    v = running(v, by, value, ["p", "q"], {"_mp": F.try_divide(F.sum(F.col("p") * x), F.sum("p")), "_mq": F.try_divide(F.sum(F.col("q") * x), F.sum("q"))})
    total = F.col("all_p") + F.col("all_q")
    bins = F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.sqrt(total)))).cast("int")
    v = v.withColumn("_b", F.when(F.col("high") > F.col("low"), F.least(F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * bins), bins - 1)).otherwise(0))
    rank = F.col("before_p") + F.col("before_q") + (F.col("p") + F.col("q") + 1) / 2
    kept = ["all_p", "all_q", "distinct", "_mp", "_mq"]
    middles = {f"_{s}{e}": order_statistic(value, s, f((F.col(f"all_{s}") - 1) / 2)) for s in ("p", "q") for e, f in (("lo", F.floor), ("hi", F.ceil))}
    binned = v.groupBy(*by, "_b").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * rank).alias("_r"), F.sum((F.col("next_value") - x) * _apart("p", "q")).alias("_w"),
        F.sum(F.col("p") * (x - F.col("_mp")) * (x - F.col("_mp"))).alias("_vp"), F.sum(F.col("q") * (x - F.col("_mq")) * (x - F.col("_mq"))).alias("_vq"), *[e.alias(n) for n, e in middles.items()], *[F.first(c).alias(c) for c in kept],
    )
    inside = F.col("p") + F.col("q")

    def part(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c) / total * F.log(F.col(c) * total / (inside * F.col(f"all_{c}")))).otherwise(F.lit(0.0))

    s = binned.groupBy(*by).agg(
        F.sum("_r").alias("_r"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("wasserstein"), F.sum("_vp").alias("_vp"), F.sum("_vq").alias("_vq"), F.sum(part("p") + part("q")).alias("mi"), *[F.max(n).alias(n) for n in middles], *[F.first(c).alias(c) for c in kept],
    )
    auc = (F.col("_r") - F.col("all_p") * (F.col("all_p") + 1) / 2) / (F.col("all_p") * F.col("all_q"))
    out = s.select(
        *by, F.col("all_p").alias("n_pos"), F.col("all_q").alias("n_neg"), F.col("_mp").alias("mean_pos"), F.col("_mq").alias("mean_neg"), F.sqrt(F.try_divide("_vp", "all_p")).alias("std_pos"), F.sqrt(F.try_divide("_vq", "all_q")).alias("std_neg"),
        median_from("_plo", "_phi").alias("median_pos"), median_from("_qlo", "_qhi").alias("median_neg"), F.when((F.col("all_p") > 0) & (F.col("all_q") > 0) & (F.col("distinct") > 1), auc).alias("auc"), "wasserstein", "mi",
    ).withColumn("cliff_delta", 2 * F.col("auc") - 1)
    return out.withColumn("score", 0.55 * 2 * F.abs(F.col("auc") - 0.5) + 0.30 * F.abs("cliff_delta") + 0.15 * F.col("mi") / (1 + F.col("mi")))


def coverage(real: DataFrame, other: DataFrame, by: list[str], value: str = "value", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Share of `other` within the real data's quantile range, and below and above it."""
    q = group_quantiles(real, by, (low, high), value).select(*by, F.col("quantiles").alias("_q"))
    t = other.where(F.col(value).isNotNull()).join(q, by)
    below, above = F.col(value) < F.col("_q")[0], F.col(value) > F.col("_q")[1]
    return t.groupBy(*by).agg(F.avg((~below & ~above).cast("double")).alias("coverage"), F.avg(below.cast("double")).alias("lower_ratio"), F.avg(above.cast("double")).alias("upper_ratio"))


def ood_ratio(real: DataFrame, other: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    q = group_quantiles(real, by, (0.01, 0.99), value).select(*by, F.col("quantiles").alias("_q"), F.col("low").alias("_lo"), F.col("high").alias("_hi"))
    t = other.where(F.col(value).isNotNull()).join(q, by)
    out = (F.col(value) < F.col("_q")[0]) | (F.col(value) > F.col("_q")[1])
    extreme = (F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(out.cast("long")).alias("n_ood"), F.avg(out.cast("double")).alias("ood_ratio"), F.avg(extreme.cast("double")).alias("extreme_ratio"))


def mmd_counts(v, p, q) -> float:
    """Unbiased squared MMD with a Gaussian kernel of two sides given as counts p and q of the distinct values v; its width
    is the median gap of the sorted values. Pairs so far apart that the kernel is 0 in floating point are not visited."""
    import numpy as np

    order = np.argsort(v)
    v, p, q = np.asarray(v, float)[order], np.asarray(p, float)[order], np.asarray(q, float)[order]
    gaps = np.diff(v)
    s = float(np.median(gaps)) if len(gaps) else 1.0
    xx, yy, xy = (p * p).sum(), (q * q).sum(), (p * q).sum()
    at, k = np.arange(len(v)), 1
    while len(at := at[at + k < len(v)]):
        d = v[at + k] - v[at]
        near = d <= 38.7 * s  # exp(-38.7 ** 2 / 2) is 0
        at, e = at[near], np.exp(-(d[near] ** 2) / (2 * s * s))
        xx, yy = xx + 2 * (p[at] * p[at + k] * e).sum(), yy + 2 * (q[at] * q[at + k] * e).sum()
        xy += ((p[at] * q[at + k] + q[at] * p[at + k]) * e).sum()
        k += 1
    n, m = p.sum(), q.sum()
    if n < 2 or m < 2:
        return float("nan")
    return max(0.0, float((xx - n) / (n * (n - 1)) + (yy - m) / (m * (m - 1)) - 2 * xy / (n * m)))


def mmd_by_feature(long: DataFrame, by: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """mmd_counts per group of all rows; a group's distinct values meet in one task."""
    kinds = dict(long.dtypes)

    def run(f):
        import pandas as pd

        return pd.DataFrame([{**{c: f[c].iloc[0] for c in by}, "mmd2": mmd_counts(f[value], f["p"], f["q"])}])

    t = folded(long.withColumn(value, F.col(value).cast("double")), by, side, value)
    return t.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", mmd2 double")


def rff_mmd(x, y, features: int = 512, seed: int = 42) -> float:
    """MMD by random Fourier features after robust scaling, width by the median heuristic. x, y: (rows, columns)."""
    import numpy as np

    both = np.vstack([x, y])
    med = np.median(both, axis=0)
    iqr = np.subtract(*np.percentile(both, [75, 25], axis=0))
    z = (both - med) / np.where(iqr > 0, iqr, 1.0)
    rng = np.random.default_rng(seed)
    pick = z[rng.permutation(len(z))[:500]]
    d = np.sqrt(((pick[:, None] - pick[None]) ** 2).sum(-1))
    s = np.median(d[d > 0]) if (d > 0).any() else 1.0
    w = rng.normal(0, 1 / s, (z.shape[1], features))
    b = rng.uniform(0, 2 * math.pi, features)
    phi = np.sqrt(2 / features) * np.cos(z @ w + b)
    return float(((phi[: len(x)].mean(0) - phi[len(x) :].mean(0)) ** 2).sum())


def kde_overlap(x, y, grid: int = 256) -> float:
    """Area under the smaller of two Gaussian density estimates (Scott's width) on the pooled 0.5 to 99.5 % range."""
    import numpy as np

    a, b = np.asarray(x, float), np.asarray(y, float)
    lo, hi = np.percentile(np.concatenate([a, b]), [0.5, 99.5])
    if len(a) < 2 or len(b) < 2 or a.std() == 0 or b.std() == 0 or hi <= lo:
        return float("nan")
    g = np.linspace(lo, hi, grid)

    def density(v):
        h = v.std(ddof=1) * len(v) ** -0.2
        return np.exp(-0.5 * ((g[:, None] - v[None, :]) / h) ** 2).mean(1) / (h * math.sqrt(2 * math.pi))

    m = np.minimum(density(a), density(b))
    return float(((m[1:] + m[:-1]) / 2 * np.diff(g)).sum())


def kde_overlap_table(long: DataFrame, by: list[str], side: str = "side", value: str = "value", grid: int = 256) -> DataFrame:
    """kde_overlap per group over all of its rows: rows are folded to counts per distinct value, each batch of values gives
    its share of both densities on the grid, and the shares are summed. No task holds a whole group."""
    x, n = F.col(value), F.col("p") + F.col("q")
    v = folded(long, by, side, value).withColumns({value: x.cast("double"), "n": n})
    v = running(v, by, value, ["p", "q", "n"], {f"_m{c}": F.try_divide(F.sum(F.col(c) * x), F.sum(c)) for c in "pq"})
    ends = {"lo": 0.005 * (F.col("all_n") - 1), "hi": 0.995 * (F.col("all_n") - 1)}
    near = {f"_{e}{k}": order_statistic(value, "n", f(h)) for e, h in ends.items() for k, f in (("a", F.floor), ("b", F.ceil))}
    spread = {f"_v{c}": F.sum(F.col(c) * (x - F.col(f"_m{c}")) * (x - F.col(f"_m{c}"))) for c in "pq"}
    g = v.groupBy(*by).agg(*[F.first(f"all_{c}").alias(f"all_{c}") for c in "pqn"], *[e.alias(k) for k, e in {**near, **spread}.items()])
    g = g.withColumns({f"_{e}": F.col(f"_{e}a") + (h - F.floor(h)) * (F.col(f"_{e}b") - F.col(f"_{e}a")) for e, h in ends.items()})
    g = g.withColumns({f"_h{c}": F.when(F.col(f"all_{c}") > 1, F.sqrt(F.try_divide(F.col(f"_v{c}"), F.col(f"all_{c}") - 1)) * F.pow(f"all_{c}", F.lit(-0.2))) for c in "pq"})
    g = g.withColumn("_any", (F.col("_hp") > 0) & (F.col("_hq") > 0) & (F.col("_hi") > F.col("_lo"))).select(*by, "all_p", "all_q", "_lo", "_hi", "_hp", "_hq", "_any")
    t = v.select(*by, value, "p", "q").join(F.broadcast(g.where("_any")).drop("_any"), by)

    def shares(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for _, one in f.groupby(by, dropna=False, sort=False):
                r = one.iloc[0]
                points, out = np.linspace(r["_lo"], r["_hi"], grid), {}
                for c in "pq":
                    h, held = r[f"_h{c}"], one[one[c] > 0]
                    out[c] = np.zeros(grid)
                    for k in range(0, len(held), 2048):
                        z, w = held[value].to_numpy(float)[k : k + 2048], held[c].to_numpy(float)[k : k + 2048]
                        out[c] += np.exp(-0.5 * ((points[:, None] - z[None, :]) / h) ** 2) @ w
                    out[c] /= r[f"all_{c}"] * h * math.sqrt(2 * math.pi)
                yield pd.DataFrame({**{c: [r[c]] * grid for c in by}, "_at": np.arange(grid), **{f"_d{c}": out[c] for c in "pq"}})

    kinds = dict(long.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    at = t.select(*by, value, "p", "q", "all_p", "all_q", "_lo", "_hi", "_hp", "_hq").mapInPandas(shares, f"{keys}, _at int, _dp double, _dq double").groupBy(*by, "_at").agg(F.sum("_dp").alias("_dp"), F.sum("_dq").alias("_dq"))
    area = at.groupBy(*by).agg(F.sum(F.least("_dp", "_dq") * F.when(F.col("_at").isin(0, grid - 1), 0.5).otherwise(1.0)).alias("_area"))
    return g.join(area, by, "left").select(*by, F.coalesce(F.col("_area") * (F.col("_hi") - F.col("_lo")) / (grid - 1), F.lit(float("nan"))).alias("overlap"))


def cross_flow(long: DataFrame, label: str, pairs: dict[str, tuple[str, str]], value: str = "value") -> DataFrame:
    """Two comparisons of one kind under two conditions: lifts, whether they point one way, and a score that falls with
    the shift of the medians. pairs: condition -> (positive label, negative label), two of them."""
    table = discrimination_table(long, label, {k: ([p], [q]) for k, (p, q) in pairs.items()}, value)
    a, b = pairs
    # both conditions of a feature meet in one aggregation, not in a join of the table with itself
    picked = {f"{n}_{k}": F.max(F.when(F.col("comparison") == c, F.col(f))) for k, c in (("a", a), ("b", b)) for n, f in (("auc", "auc"), ("_m", "median_pos"), ("_s", "std_pos"))}
    j = table.groupBy("feature").agg(*[e.alias(n) for n, e in picked.items()]).where(F.col("auc_a").isNotNull() & F.col("auc_b").isNotNull())
    same = (F.col("auc_a") - 0.5) * (F.col("auc_b") - 0.5) > 0
    shift = F.abs(F.col("_m_a") - F.col("_m_b")) / ((F.col("_s_a") + F.col("_s_b")) / 2 + EPS)
    lift = F.least(F.abs(F.col("auc_a") - 0.5), F.abs(F.col("auc_b") - 0.5))
    return j.select("feature", "auc_a", "auc_b", same.alias("same_direction"), shift.alias("shift"), (F.when(same, 2 * lift).otherwise(0.0) / (1 + shift)).alias("score"))
