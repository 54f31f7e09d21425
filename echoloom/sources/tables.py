"""Feature tables as CSV or Parquet: guarded scans, canonical columns, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import quality as Q


def scan_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("encoding", "UTF-8").option("recursiveFileLookup", "true").option("pathGlobFilter", "features*.csv")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(paths)
    # a byte order mark sticks to the first name
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def guarded(df: DataFrame, least_columns: int = 100, least_finite: int = 100) -> tuple[DataFrame | None, str]:
    """Rows with enough finite features; a table that is too narrow is skipped. Returns the status too."""
    features = Q.infer_features(df) if len(df.columns) >= least_columns else []
    if len(features) < least_columns:
        return None, "skipped"
    return Q.enough_features(df, features, least_finite), "ok"


def load_report(df: DataFrame) -> DataFrame:
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def canonical(df: DataFrame, label: str = "label", path: str = "source_file_path", split: str | None = None) -> DataFrame:
    """label as 0 or 1, split and base_domain."""
    folder = F.element_at(F.split(path, r"[/\\]"), -2)
    return df.withColumns({label: L.normalize_label(F.col(label)), "split": L.infer_split(F.col(split) if split else F.lit(None).cast("string"), folder), "base_domain": L.base_domain(folder)})


def load_classes(frames: dict[str, DataFrame], path: str = "source_file_path", per_label: int | None = None, seed: int = 42) -> DataFrame:
    """Tables by class united by name, with label, family, condition, event and group columns; optionally capped per label."""
    parts = []
    for name, f in frames.items():
        stem = L.source_stem(F.col(path))
        t = f.withColumns({"source_label": F.lit(name), "target_label": L.binary_label(F.lit(name)), "signal_family": L.signal_family(F.lit(name)), "flow_condition": L.flow_condition(F.lit(name)), "event_id": F.concat(F.lit(name + "::"), stem)})
        key = F.concat_ws("::", F.col("event_id"), F.coalesce(F.col("window_id").cast("string"), F.lit("0")) if "window_id" in f.columns else F.lit("0"))
        t = t.withColumn("row_uid", key)
        parts.append(t.withColumn("sampling_group_id", F.when(F.col("signal_family") == "FL", F.col("row_uid")).otherwise(F.col("event_id"))))
    out = Q.union_tables(parts)
    if per_label:
        from ..operators.splits import class_cap

        out = class_cap(out, "source_label", "row_uid", per_label, seed)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Numbers with three decimals, one header per file."""
    shown = [F.format_string("%.3f", c).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]
    df.select(*shown).write.mode("errorifexists").option("header", "true").csv(path)


def write_waveforms(records: DataFrame, path: str) -> None:
    records.write.mode("errorifexists").parquet(path)


def record_index(records: DataFrame) -> DataFrame:
    """One row of derived facts per record, without its samples."""
    n = F.size("signal")
    return records.select(
        "path", "channel_index", "type", "sample_rate", n.alias("npts"), (n / F.col("sample_rate")).alias("duration_s"), L.parse_time(F.col("starttime")).alias("start"),
        F.coalesce(L.seconds_between(L.parse_time(F.col("starttime")), L.parse_time(F.col("arrival_time"))), F.lit(None).cast("double")).alias("arrival_offset_s"),
        F.when(F.col("arrival_time").isNull(), "estimated").otherwise("labelled").alias("arrival_source"), L.source_stem(F.col("path")).alias("sample_stem"),
    )


def unique_inputs(files: DataFrame) -> DataFrame:
    """Each path once, whatever root it was found under."""
    return files.withColumn("path", F.regexp_replace("path", "/+", "/")).dropDuplicates(["path"])


def data_info(specs: DataFrame, window_s: float) -> DataFrame:
    """specs with data_info, the JSON that goes beside a mixed sample; the window's length comes from the configuration."""
    fields = [c for c in specs.columns if dict(specs.dtypes)[c] not in ("array<double>",)]
    return specs.withColumn("data_info", F.to_json(F.struct(*fields, F.lit(window_s).alias("window_duration_s"))))


#: The keys of a mixed sample's description, in order, and those of one value.
INFO_KEYS = (
    "sample_type dataset_name build_mode source_noise_file source_bk_file source_noise_dataset source_bk_method target_sample_rate_hz window_duration_s window_start_offset_t_s "
    "w1 w2 noise_rms bk_rms mixed_rms resample_noise_action resample_bk_action random_seed build_time builder_version output_file_name output_starttime output_timestamp"
).split()
INFO_FIXED = {"sample_type": "BK14", "build_mode": "noise_plus_broken_wire", "window_duration_s": 0.02, "builder_version": "2026-05-05"}


def sample_info(samples: DataFrame) -> DataFrame:
    """samples with data_info, the JSON of all keys: fixed ones, the build's time, and the columns of the key's name; a key
    without column is null."""
    given = {c: F.col(c) for c in INFO_KEYS if c in samples.columns}
    fixed = {k: F.lit(v) for k, v in INFO_FIXED.items()} | {"build_time": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")}
    fields = [(given.get(k, fixed.get(k)) if k in given or k in fixed else F.lit(None).cast("string")).alias(k) for k in INFO_KEYS]
    return samples.withColumn("data_info", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def write_curves(curves: DataFrame, path: str, method: str = "method") -> None:
    """One folder of CSV files per method, so that a reader of one method lists only its own."""
    curves.repartition(method).write.mode("errorifexists").partitionBy(method).option("header", "true").csv(path)


def feature_index(features: list[str], spark: SparkSession) -> DataFrame:
    """Name to position of an exported feature table."""
    return spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, position int")


def markdown_report(counts: DataFrame, ranking: DataFrame | None = None, top: int = 30) -> str:
    """Text of a build or mining report: the counts, and the best features of grade A (a top-k report)."""
    def lines(df: DataFrame) -> list[str]:
        rows = df.collect()
        return ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]]

    out = ["# Report", "", *lines(counts)]
    if ranking is not None:
        out += ["", f"## First {top} of grade A", "", *lines(ranking.where(F.col("grade") == "A").orderBy("rank").limit(top))]
    return "\n".join(out) + "\n"


def write_manifest(spark: SparkSession, path: str, run: dict, parts: DataFrame | None = None) -> None:
    """A run's description as one JSON text: what is given, the time, the versions, and a list of its parts (a row each: an
    experiment with its features, threshold and counts). It is staged and renamed, so a reader finds all of it or nothing."""
    import json
    from datetime import UTC, datetime

    from ..operators.gates import _file_system

    listed = [r.asDict(recursive=True) for r in parts.collect()] if parts is not None else []  # a row an experiment
    body = {**run, "generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "spark_version": spark.version, "experiments": listed}
    fs, of = _file_system(spark, path)
    staged = of(f"{path}.staged")
    spark.createDataFrame([(json.dumps(body, default=str, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(staged.toString())
    fs.delete(of(path), True)
    if not fs.rename(staged, of(path)):
        raise OSError(f"could not write {path}")


def save_run(model, metrics: dict, path: str, spark: SparkSession) -> None:
    """A fitted pipeline and its metrics as a JSON table under one folder."""
    import json

    model.write().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metrics, default=str),)], "metrics string").coalesce(1).write.text(f"{path}/metrics")
