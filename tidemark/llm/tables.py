"""Tables that operators write between their stages, and how they go away again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_path

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LAST_ID = 2**63 - 1


class Scratch:
    """Owner of one operator's intermediate tables under ``spark.checkpoint.dir``.

    ``keep`` writes a frame and reads it back, which cuts the lineage with files
    that outlive executors, and lets Spark delete the shuffle files of that write,
    which nothing can read any more.  ``drop`` removes a table once nothing reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def keep(self, df: DataFrame) -> DataFrame:
        path = work_path(self.spark, self.name)
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEAN_UP) if before is None else self.spark.conf.set(CLEAN_UP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one number that sizes the partitions of an operator."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]


def ordered_id(column: str = "doc_id") -> Column:
    """``doc_id`` as a bigint; a null id counts as larger than every other."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(LAST_ID))


def first_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About the first ``n`` rows by md5 of ``key`` (one row each): at least ``n`` if there are as many.

    The cut-off comes from the counts of the 65 536 leading digits, so no task and
    not the driver ever ranks all rows; an ``orderBy(...).limit(n)`` that follows
    gets ``n`` rows and one digit group.
    """
    digit = F.substring(F.md5(F.col(key).cast("string")), 1, 4)
    seen, last = 0, "ffff"
    for r in sorted(rows.groupBy(digit.alias("digit")).count().collect()):
        seen += r["count"]
        if seen >= n:
            last = r["digit"]
            break
    return rows.where(digit <= last)
