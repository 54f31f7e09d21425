"""Resume, completion gate, dead letters and audits of files and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import ordinal

#: Features that may be undefined in a complete file.
MAY_BE_NAN = frozenset({"beta_H", "alpha_hat", "H2_ratio", "epsilon_2x", "C_h", "R_2_1", "R_h", "T_half_high"})


def unprocessed(files: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Files that the ledger doesn't list; joined before anything is decoded."""
    return files.join(ledger.select(key).distinct(), key, "left_anti")


def completion_gate(rows: DataFrame, expected: DataFrame, features: list[str], file: str = "file", window: str = "window_id") -> DataFrame:
    """file, n_windows, n_expected, errors (array) and complete: all of a file or nothing of it.

    rows: one row per file and window with the features; expected: file, n_expected. One aggregation, then a join on files.
    """
    rules = []
    for c in features:
        v, base = F.col(c), c.split("__", 1)[-1]
        rules.append(F.sum(v.isNull().cast("long")).alias(f"_m_{c}"))
        bad = F.abs(v) == float("inf")
        rules.append(F.sum((bad if base in MAY_BE_NAN else bad | F.isnan(v)).cast("long")).alias(f"_b_{c}"))
    t = rows.groupBy(file).agg(F.countDistinct(window).alias("n_windows"), F.count(F.lit(1)).alias("_rows"), *rules)
    j = expected.join(t, file, "left")
    errors = [
        F.when(F.coalesce("n_windows", F.lit(0)) != F.col("n_expected"), F.lit("window_ids")),
        F.when(F.coalesce("_rows", F.lit(0)) != F.coalesce("n_windows", F.lit(0)), F.lit("duplicate_windows")),
        *[F.when(F.col(f"_m_{c}") > 0, F.lit(f"missing_features:{c}")) for c in features],
        *[F.when(F.col(f"_b_{c}") > 0, F.lit(f"invalid_values:{c}")) for c in features],
    ]
    out = j.withColumn("errors", F.array_compact(F.array(*errors)))
    return out.select(file, F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), "n_expected", "errors", (F.size("errors") == 0).alias("complete"))


def write_gated(rows: DataFrame, gate: DataFrame, path: str, ledger_path: str, retry_path: str, file: str = "file", files_per_part: int = 10) -> None:
    """Complete files go to parts of `files_per_part` files each, in order of their names; the ledger lists them with their
    parts; others are listed for a retry.

    A part is named by the digest of its files and replaces one of its name, so writing it again gives the same rows once.
    The ledger of a run is staged and published by one rename, which is when its parts count (see read_gated). Files that
    the ledger has are left out. So a run that stops anywhere and is repeated ends as if it had run once: what it
    staged without publishing is replaced, or never read.
    """
    spark = rows.sparkSession
    done = published(spark, ledger_path)
    new = gate if done is None else gate.join(done.select(F.col("path").alias(file)), file, "left_anti")
    listed = ordinal(new.where("complete").select(file, "n_windows"), [], [file]).withColumn("_part", F.floor(F.col("_ordinal") / files_per_part))
    # at most files_per_part names meet in one row
    names = listed.groupBy("_part").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.col(file).cast("string")))), 256).alias("part"))
    parts = materialize(listed.join(names, "_part").select(file, "n_windows", "part"), "gated-parts")
    run = parts.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor(F.xxhash64(file, "part")).cast("string")), 256)).first()[0]
    if parts.limit(1).count():
        rows.join(parts.select(file, "part"), file).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        publish(parts.select(F.col(file).alias("path"), "part", "n_windows"), ledger_path, run)
    failed = new.where(~F.col("complete")).select(file, F.array_join("errors", ";").alias("errors"))
    failed.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(retry_path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def publish(ledger: DataFrame, ledger_path: str, run: str) -> None:
    """A run's ledger under its digest, all or nothing: written beside it under a name that readers pass over, then renamed."""
    spark = ledger.sparkSession
    fs, of = _file_system(spark, ledger_path)
    staged, there = of(f"{ledger_path}/.staged-{run}"), of(f"{ledger_path}/run={run}")
    ledger.write.mode("overwrite").parquet(staged.toString())
    if fs.exists(there):
        fs.delete(staged, True)
    elif not fs.rename(staged, there):
        raise OSError(f"could not publish {there.toString()}")


def published(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    """path, part, n_windows, run of all published files; None before the first."""
    fs, of = _file_system(spark, ledger_path)
    if not fs.exists(of(ledger_path)) or not any(s.getPath().getName().startswith("run=") for s in fs.listStatus(of(ledger_path))):
        return None
    return spark.read.parquet(ledger_path)


def read_gated(spark: SparkSession, path: str, ledger_path: str) -> DataFrame | None:
    """Rows of the published parts; folders that no ledger lists aren't read. None before the first is published."""
    done = published(spark, ledger_path)
    if done is None:
        return None
    parts = done.select("part").distinct()
    return spark.read.parquet(path).join(parts, "part", "left_semi")


def audit_headers(headers: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """issues and issue_count of waveform headers (name, npts, comm_count, rows, rate, duration, arrival_offset, label, folder_label)."""
    rules = [
        F.when(F.col("npts").isNull() | F.col("rate").isNull(), F.lit("missing_key")),
        F.when(F.col("npts") != F.col("rows"), F.lit("npts_mismatch")),
        F.when(F.col("comm_count") != F.col("rows"), F.lit("comm_count_mismatch")),
        F.when(F.col("rate") <= 0, F.lit("bad_rate")),
        F.when(F.abs(F.col("npts") / F.col("rate") - F.col("duration")) > tolerance, F.lit("duration_mismatch")),
        F.when((F.col("arrival_offset") < 0) | (F.col("arrival_offset") > F.col("duration")), F.lit("arrival_outside")),
        F.when(F.col("label") != F.col("folder_label"), F.lit("label_mismatch")),
    ]
    t = headers.withColumn("issues", F.array_compact(F.array(*rules)))
    return t.withColumn("issue_count", F.size("issues"))


def rename_plan(files: DataFrame, name: str, old_prefix: str, new_prefix: str) -> DataFrame:
    """target names by prefix and whether two files would meet in one."""
    from pyspark.sql import Window as W

    target = F.when(F.col(name).startswith(old_prefix), F.concat(F.lit(new_prefix), F.substr(F.col(name), F.lit(len(old_prefix) + 1)))).otherwise(F.col(name))
    t = files.withColumn("target", target)
    return t.withColumn("conflict", F.count(F.lit(1)).over(W.partitionBy("target")) > 1)
