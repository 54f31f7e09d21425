"""Session construction and the few cluster settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "echoloom", cpus: int | str | None = None, shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the launcher owns these settings."""
    n = cpus or os.environ.get("BENCH_CPUS") or 8
    b = (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or the folder given to setCheckpointDir.

    With neither, a local session (tests) gets a temporary folder and a cluster an error: its executors share no disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            found = given.get()
        elif spark.sparkContext.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="echoloom-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a Parquet table to the shared folder and read it back.

    Column pruning and size statistics survive, and the files outlive a lost executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt to the session's shuffle partitions: a small file is read by one task, however much work its rows make."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only where the (materialized) table is counted and small; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
