"""Records of whole datasets: where each one's files lie, what their folders say, and arrivals labelled or estimated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import features_engine as E
from ..functions import labels as L
from ..kernels import features as K
from ..kernels import filters
from ..kernels.spectra import estimate_arrival
from . import decode as D

#: The dataset of single events, its folder, and the folders of its two ways of generation.
EVENT_DATASET, EVENT_FOLDER, METHODS = "BK14", "BK14-0.06S(Generation method)", ("corrosion", "cut")


def dataset_files(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """path, content, dataset, method of the containers of named datasets: the event set lies in a folder per method, any other
    in a folder of its name. A folder that isn't there has no files; files elsewhere aren't listed."""
    wanted = {f"{EVENT_FOLDER}/{m}": (EVENT_DATASET, m) for m in METHODS} if EVENT_DATASET in datasets else {}
    wanted |= {d: (d, None) for d in datasets if d != EVENT_DATASET}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root)
    # the reader names files as URIs, with spaces written out as percent signs
    inside = F.regexp_replace(F.regexp_replace("path", "%20", " "), r"^.*?\Q" + root.split(":", 1)[-1].strip("/") + r"\E/+", "")
    folder = F.regexp_extract(inside, "^(.*)/[^/]*$", 1)
    known = F.coalesce(*[F.when(folder == k, F.struct(F.lit(d).alias("dataset"), F.lit(m).cast("string").alias("method"))) for k, (d, m) in wanted.items()], F.lit(None))
    return files.withColumn("_of", known).where(F.col("_of").isNotNull()).select("path", "content", "_of.dataset", "_of.method")


def dataset_records(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """Decoded records with dataset and method, and arrivals (see with_arrivals); those of sets without events are estimated."""
    files = dataset_files(spark, root, datasets)
    names = files.select("path", "dataset", "method")
    records = D.decode(files).join(names, "path")
    return with_arrivals(records, F.col("dataset") == EVENT_DATASET)


def with_arrivals(records: DataFrame, labelled=None) -> DataFrame:
    """records with arrival_source, arrival_index and arrival_offset_s. A labelled arrival is the nearest sample to the time
    between start and arrival, within the signal; a missing one (or one outside `labelled`, a condition) is estimated from the
    signal. NULL for failed records and empty signals."""
    offset = L.seconds_between(L.parse_time(F.col("starttime")), L.parse_time(F.col("arrival_time")))
    given = F.col("arrival_time").isNotNull() & (F.lit(True) if labelled is None else labelled)
    n = F.size("signal")

    @F.pandas_udf("bigint")
    def estimate(x: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([estimate_arrival(v, r) if v is not None and len(v) else None for v, r in zip(x, rate, strict=True)], dtype="Int64")

    has = F.col("signal").isNotNull() & (n > 0)
    from_label = F.greatest(F.lit(0), F.least(n.cast("long") - 1, F.rint(offset * F.col("sample_rate")).cast("long")))
    t = records.withColumn("arrival_source", F.when(given & offset.isNotNull(), "labeled").otherwise("estimated"))
    t = t.withColumn("_guess", estimate(F.when(F.col("arrival_source") == "estimated", F.col("signal")), F.col("sample_rate")))
    index = F.when(has, F.when(F.col("arrival_source") == "labeled", from_label).otherwise(F.col("_guess")))
    return t.withColumn("arrival_index", index).withColumn("arrival_offset_s", F.when(F.col("arrival_source") == "labeled", offset).otherwise(F.col("arrival_index") / F.col("sample_rate"))).drop("_guess")


def folder_features(records: DataFrame, labels: dict[str, int], bands: dict[str, tuple[float, float]], rate: float, path: str | None = None, band: tuple[float, float] = (1_000.0, 100_000.0), families: dict | None = None) -> DataFrame:
    """Features of every record of the named folders with the folder's label: means off, band-pass, all bands. With a path,
    CSV tables in a folder for each of them. Folders without a label are left out; failed records stay with dead_letters()."""
    folder = F.element_at(F.split("path", "/"), -2)
    label = F.coalesce(*[F.when(folder == k, v) for k, v in labels.items()])
    t = records.where((F.col("status") == "ok") & (F.col("sample_rate") == rate)).withColumn("folder", folder).withColumn("label", label).where(F.col("label").isNotNull())
    t = t.withColumn("_record", F.struct("path", "channel_index"))

    def passed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(signal=[filters.band_filter(x - x.mean(), rate, band) for x in f["signal"]])

    clean = t.select("path", "channel_index", "folder", "label", "sample_rate", "signal").mapInPandas(passed, "path string, channel_index int, folder string, label int, sample_rate double, signal array<double>")
    plans = K.plan_bands(bands, rate, families)
    key = F.concat_ws("#", "path", F.col("channel_index").cast("string"))
    made = E.record_features(clean.withColumn("record", key), plans, "record", "signal", "sample_rate")
    about = t.select(key.alias("record"), "path", "channel_index", "folder", "label")
    out = about.join(made, "record").drop("record")
    if path:
        out.repartition("folder").write.mode("errorifexists").partitionBy("folder").option("header", "true").csv(path)
    return out
