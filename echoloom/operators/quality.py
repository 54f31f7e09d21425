"""Summaries and quality of feature tables. Wide tables are unpivoted once; every statistic is one grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import clean
from ..session import materialize
from .ordered import order_statistic, running

#: Columns that are never features.
META_COLUMNS = frozenset(
    "source_file_name source_file_path source_format source_group_name source_channel_name source_detail sample_rate_hz original_sample_rate_hz source_n_samples "
    "source_duration_s starttime_raw arrival_time_raw sample_type feature_schema_version stft_backend power_dtype harmonic_context_band window_id window_start_index "
    "window_end_index window_length_samples window_step_samples window_duration_s window_start_offset_s window_start_datetime label source_label target_label "
    "signal_family flow_condition event_id row_uid sampling_group_id split base_domain channel_index window_mode window_start_ms window_end_ms window_n_samples".split()
)


def long_features(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """ids, feature, value with missing values as NULL."""
    typed = df.select(*ids, *[clean(F.col(c)).alias(c) for c in features])
    return typed.unpivot(ids, features, "feature", "value")


def infer_features(df: DataFrame, meta: frozenset[str] = META_COLUMNS, least: int = 3) -> list[str]:
    """Numeric columns outside meta with enough finite and more than one distinct value; one pass over all of them."""
    numeric = [c for c, k in df.dtypes if c not in meta and (k in ("double", "float", "int", "bigint", "smallint", "tinyint") or k.startswith("decimal"))]
    if not numeric:
        return []
    row = df.agg(*[F.struct(F.count(clean(F.col(c))).alias("n"), F.min(clean(F.col(c))).alias("lo"), F.max(clean(F.col(c))).alias("hi")).alias(c) for c in numeric]).first()
    return [c for c in numeric if row[c]["n"] >= least and row[c]["lo"] != row[c]["hi"]]


def quantiles_from(shares: tuple[float, ...], weight: str = "n", value: str = "value") -> dict:
    """For running() rows: each share's two neighbouring order statistics as aggregates, q<k>_lo and q<k>_hi."""
    last = F.col(f"all_{weight}") - 1
    return {f"q{k}_{e}": order_statistic(value, weight, f(last * F.lit(s))) for k, s in enumerate(shares) for e, f in (("lo", F.floor), ("hi", F.ceil))}


def interpolated(k: int, share: float, count: str = "_n") -> Column:
    """The share's quantile between its neighbours q<k>_lo and q<k>_hi of quantiles_from()."""
    h = (F.col(count) - 1) * F.lit(share)
    return F.col(f"q{k}_lo") + (F.col(f"q{k}_hi") - F.col(f"q{k}_lo")) * (h - F.floor(h))


def folded(long: DataFrame) -> DataFrame:
    """feature, value, n of the values that are there."""
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def feature_quality(long: DataFrame) -> DataFrame:
    """Missing rate, distinct values, mean, population deviation, median, quartile range, range and the rate beyond
    three quartile ranges.

    Values are folded to counts; quartiles are order statistics of running sums, exact and interpolated, so no task holds
    a feature's values. The outlier rate reads the folded values once more, joined to a row per feature.
    """
    shares = (0.25, 0.5, 0.75)
    missing = long.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))
    v = materialize(folded(long), "quality-values")
    x = F.col("value")
    r = running(v, ["feature"], "value", ["n"], {"_mean": F.sum(F.col("n") * x) / F.sum("n")})
    s = r.groupBy("feature").agg(
        F.first("distinct").alias("n_unique"), F.first("_mean").alias("mean"), F.sqrt(F.sum(F.col("n") * (x - F.col("_mean")) * (x - F.col("_mean"))) / F.first("all_n")).alias("std"),
        F.first("low").alias("min"), F.first("high").alias("max"), F.first("all_n").alias("_n"), *[e.alias(c) for c, e in quantiles_from(shares).items()],
    )
    for k, share in enumerate(shares):
        s = s.withColumn(f"_q{k}", interpolated(k, share))
    s = materialize(s.select("feature", "n_unique", "mean", "std", F.col("_q1").alias("median"), "_q0", "_q2", (F.col("_q2") - F.col("_q0")).alias("iqr"), "min", "max", "_n"), "quality-features")
    far = (x < F.col("_q0") - 3 * F.col("iqr")) | (x > F.col("_q2") + 3 * F.col("iqr"))
    rates = v.join(s.select("feature", "_q0", "_q2", "iqr"), "feature").groupBy("feature").agg((F.sum(F.when(far, F.col("n")).otherwise(0)) / F.sum("n")).alias("outlier_rate"))
    return missing.join(s, "feature", "left").join(rates, "feature", "left").drop("_q0", "_q2", "_n").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))


def validate_features(long_raw: DataFrame) -> DataFrame:
    """Counts and ranges of raw values (feature, value double): NaN and infinite values are reported, not skipped in silence."""
    v = clean(F.col("value"))
    return long_raw.groupBy("feature").agg(
        F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.log10(F.max(F.abs(v)) + 1e-12).alias("log10_max_abs"), F.max((F.col("value").isNull() | F.isnan("value")).cast("int")).alias("has_nan"), F.max((F.abs("value") == float("inf")).cast("int")).alias("has_inf"),
    )


def describe(long: DataFrame, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact interpolated quantiles from folded values; a feature without values
    keeps its row with count 0."""
    x, n = F.col("value"), F.col("n")
    r = running(folded(long), ["feature"], "value", ["n"], {"_mean": F.sum(n * x) / F.sum("n")})
    s = r.groupBy("feature").agg(
        F.first("all_n").alias("_n"), F.first("_mean").alias("mean"), F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean"))).alias("_ss"),
        F.first("low").alias("min"), F.first("high").alias("max"), *[e.alias(c) for c, e in quantiles_from(shares).items()],
    )
    s = s.select("feature", "mean", F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / (F.col("_n") - 1))).alias("std"), "min", *[interpolated(k, q).alias(f"p{int(q * 100)}") for k, q in enumerate(shares)], "max")
    return long.groupBy("feature").agg(F.count("value").alias("count")).join(s, "feature", "left")


def median_impute(df: DataFrame, features: list[str]) -> DataFrame:
    """Exact column medians of all features from running sums over folded values; an all-missing column becomes 0."""
    r = running(folded(long_features(df, [], features)), ["feature"], "value", ["n"])
    s = r.groupBy("feature").agg(F.first("all_n").alias("_n"), *[e.alias(c) for c, e in quantiles_from((0.5,)).items()])
    medians = {m["feature"]: float(m["median"]) for m in s.select("feature", interpolated(0, 0.5).alias("median")).collect()}  # a row per feature
    return df.withColumns({c: F.coalesce(clean(F.col(c)), F.lit(medians.get(c, 0.0))) for c in features})


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins; the last is closed on the right."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    b = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_by_deviation(long: DataFrame, k: int) -> DataFrame:
    """The k features of largest sample deviation, missing values counted as 0."""
    return long.groupBy("feature").agg(F.stddev_samp(F.coalesce("value", F.lit(0.0))).alias("std")).orderBy(F.desc("std"), "feature").limit(k)


def crosstab(df: DataFrame, by: list[str], column: str, values: list) -> DataFrame:
    """Counts by `by` and each listed value beside the total: known values make one aggregation, no extra pass."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.sum((F.col(column) == v).cast("long")).alias(str(v)) for v in values])


def enough_features(df: DataFrame, features: list[str], least: int) -> DataFrame:
    """Rows with at least `least` finite features."""
    return df.where(F.size(F.filter(F.array(*[clean(F.col(c)) for c in features]), lambda x: x.isNotNull())) >= least)


def union_tables(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def common_columns(frames: list[DataFrame]) -> list[str]:
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def ranked(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
