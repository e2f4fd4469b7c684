"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str | int = "*", app: str = "tidemark", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder of the cluster (``spark.checkpoint.dir``).

    Only a local master may fall back to a private folder: on a cluster a
    machine-local path would vanish with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, unique per call."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(writer: DataFrameWriter, path: str) -> None:
    """Write a Parquet table; the shuffle files of the write, which nothing can read any more, are deleted."""
    conf = writer._spark.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)


def materialized(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but the columnar table keeps
    column pruning, filters and a known size for the plans that read it.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    written(df.write, path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_files(spark: SparkSession, path: str) -> list[str]:
    """Addresses of the Parquet files of a table in the shared folder, in the order of their parts."""
    target, files = _folder(spark, path)
    return sorted(str(f.getPath().toUri()) for f in files.listStatus(target) if f.getPath().getName().endswith(".parquet"))


def opened(address: str) -> BinaryIO:
    """A shared file for reading inside a task: a local (mounted) path, or any store that Arrow knows (hdfs, s3, gs, abfs)."""
    parts = urlsplit(address)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


def dropped(spark: SparkSession, *addresses: str) -> None:
    """Delete files or folders of the shared folder that nothing reads any more."""
    for address in addresses:
        target, files = _folder(spark, address)
        files.delete(target, True)
