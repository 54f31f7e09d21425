"""Labelled mixtures of noise and event recordings: seeded draws, joins by drawn number, mixing, manifests and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions.values import seeded_order
from .ordered import ordinal


def _draw(name: str, n: int, seed: int) -> Column:
    """A whole number below n from the md5 of the spec's number."""
    text = F.concat_ws("|", F.col("spec").cast("string"), F.lit(name), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % n


def draw_specs(spark: SparkSession, count: int, n_noise: int, n_event: int, shifts: list[float] = (0.0,), seed: int = 42) -> DataFrame:
    """spec, noise, event (numbers from 1), shift, w1, w2 in [0.5, 1.5] with two decimals, suffix."""
    t = spark.range(count).select(F.col("id").alias("spec"))
    return t.select(
        "spec", (_draw("n", n_noise, seed) + 1).alias("noise"), (_draw("e", n_event, seed) + 1).alias("event"),
        F.element_at(F.array(*map(F.lit, shifts)), (_draw("t", len(shifts), seed) + 1).cast("int")).alias("shift"),
        F.round(0.5 + _draw("w", 101, seed) / 100.0, 2).alias("w1"), F.round(0.5 + _draw("v", 101, seed) / 100.0, 2).alias("w2"),
        F.substring(F.md5(F.concat(F.col("spec").cast("string"), F.lit(f"|s|{seed}"))), 1, 2).alias("suffix"),
    )


def numbered(records: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """records with `number` from 1 in seeded order. The order is of keys only; records join it after."""
    keys = ordinal(records.select(key).distinct().withColumn("_order", seeded_order(F.col(key), seed=seed)), [], ["_order", key])
    keys = keys.select(key, (F.col("_ordinal") + 1).cast("int").alias("number"))
    return records.join(keys, key)


def mix_samples(specs: DataFrame, noise: DataFrame, event: DataFrame) -> DataFrame:
    """specs joined to (number, signal) of both sides and mixed; unlike lengths give a failed row with a message."""
    n = noise.select(F.col("number").alias("noise"), F.col("signal").alias("_n"))
    e = event.select(F.col("number").alias("event"), F.col("signal").alias("_e"))
    j = specs.join(n, "noise").join(e, "event")
    same = F.size("_n") == F.size("_e")
    mixed = F.when(same, F.zip_with("_n", "_e", lambda x, y: F.col("w1") * x + F.col("w2") * y))
    return j.withColumns({"signal": mixed, "status": F.when(same, "ok").otherwise("failed"), "message": F.when(~same, "signals differ in length")}).drop("_n", "_e").withColumn("rms", F.when(F.col("signal").isNotNull(), S.rms(F.col("signal"))))


def manifest(mixed: DataFrame, dataset: str, split: str) -> DataFrame:
    return mixed.where(F.col("status") == "ok").select(
        F.format_string("%s_%05d_%s.npz", F.lit(dataset), "spec", "suffix").alias("source_file_name"), F.lit(dataset).alias("dataset_source"), F.concat_ws("_", F.lit(dataset), F.col("noise").cast("string")).alias("group_id"), F.lit(split).alias("split"), "w1", "w2", "shift",
    )
