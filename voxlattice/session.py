"""Session settings and how executors find this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession, root: str) -> None:
    """Put the repository on the import path of Python workers that start from now on."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that every executor sees, under spark.checkpoint.dir; a local one where a local session names none.
    It goes when the session's process ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="voxlattice-")
    folder = f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """The table, written and read again: computed once, and a lost executor re-reads files instead of starting over."""
    folder = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)
