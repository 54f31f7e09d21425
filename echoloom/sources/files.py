"""Discovery of waveform files. Listing is Spark's; only names and sizes are read until a decoder asks for the content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L


def discover(spark: SparkSession, roots: str | list[str], pattern: str = "*.npz", max_files: int | None = None) -> DataFrame:
    """path, content, length of the files under the roots; max_files keeps the first by path (a limit that is the feature)."""
    roots = [roots] if isinstance(roots, str) else roots
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    return df.orderBy("path").limit(max_files) if max_files else df


def with_names(files: DataFrame) -> DataFrame:
    """file_name, folder and what the name says of rate, points and time."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.withColumns({
        "file_name": name, "folder": F.element_at(parts, -2), "name_rate": L.rate_from_name(name), "name_points": L.points_per_frame(name),
        "name_time": F.regexp_extract(name, r"(\d{8}T\d{6}(?:\.\d+)?)", 1),
    })


def folder_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
