"""Exact dedup as a stateful stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tables
from tidemark.session import STATE_STORE, work_path

FILES_PER_BATCH = 4096
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str = "text") -> Column:
    """The text with every run of ASCII spaces as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def first_seen(arrivals: DataFrame, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Keyed state of a stream over the arrivals stored at ``path``.

    The state keeps, for every digest and without expiry, the smallest stable id,
    the content locator of that row and how many rows came.  It is on disk
    (RocksDB) with its checkpoints in the shared folder.  Every micro-batch writes
    the keys it changed to a folder of its own, so a batch that is run again
    overwrites itself; the latest count of a digest has its final state.
    """
    spark = arrivals.sparkSession
    seen = work_path(spark, "seen")
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    state = stream.groupBy("digest").agg(F.min(F.struct("id", "locator")).alias("first"), F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{seen}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", work_path(spark, "stream"))
            .trigger(availableNow=True).foreachBatch(keep).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest binary, first struct<id: bigint, locator: bigint>, n bigint, batch int"
    changed = spark.read.schema(schema).option("basePath", seen).parquet(f"{seen}/batch=*") if arrivals.take(1) else spark.createDataFrame([], schema)
    latest = changed.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))
    return latest.select("digest", F.col("first.id").alias("keep_id"), F.col("first.locator").alias("locator"), "n")


def exact_dedup(docs: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when they are the same after runs of ASCII spaces become one
    space; a null text counts as empty.  Of equal texts the row with the smallest
    doc_id stays (a null doc_id counts as the largest); of rows that share that
    doc_id one stays.  Rows come to a stream as digest, id and locator (the row's
    place in the arrivals table).  On a hit the full bytes are compared with those
    at the kept row's locator; rows that differ in spite of an equal digest are
    grouped by their whole text.  Columns besides ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    scratch = tables.Scratch(spark, "exact")
    text = normalised()
    # The locator is fixed once it is written: rows may repeat, ids too.
    arrivals = scratch.keep(docs.select(
        tables.ordered_id().alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("locator")))
    state = scratch.keep(first_seen(arrivals.select("id", "digest", "locator"), arrivals._scratch, files_per_batch))
    named = arrivals.join(state.withColumnRenamed("locator", "keep_locator"), "digest")
    # Only hits need their bytes: rows of a digest that more than one row has.
    # Dealt by id before they are made distinct, so a digest with many rows does not stay in the task of its join.
    wanted = state.where("n > 1").join(arrivals, "digest").select("id", "digest", "keep_id").repartition("id").distinct()
    hits = scratch.keep(
        docs.select(tables.ordered_id().alias("id"), text.alias("body"))
        .join(wanted, "id")
        .where(F.sha2(F.col("body").cast("binary"), 256) == F.lower(F.hex("digest"))))
    kept_bytes = scratch.keep(hits.where("id = keep_id").groupBy("digest").agg(F.min("body").alias("kept_body")))
    odd = hits.join(kept_bytes, "digest").where("body <> kept_body").select("id", "digest", "body")
    if not odd.take(1):
        found = named.select("id", "digest", "keep_id", "keep_locator", "locator", F.col("n").alias("group_size"))
    else:
        found = _told_apart(named, odd)
    return found.select(
        F.nullif("id", F.lit(tables.LAST_ID)).alias("doc_id"), F.nullif("keep_id", F.lit(tables.LAST_ID)).alias("keep_id"), "group_size",
        (F.col("locator") == F.col("keep_locator")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _told_apart(named: DataFrame, odd: DataFrame) -> DataFrame:
    """Groups after taking out rows whose text differs from the kept one of their digest."""
    mine = odd.groupBy("id", "digest").agg(F.min("body").alias("body"))
    rows = named.join(mine, ["id", "digest"], "left")
    groups = rows.groupBy("digest", "body").agg(
        F.min(F.struct("id", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    same = (F.col("r.digest") == F.col("g.digest")) & F.col("r.body").eqNullSafe(F.col("g.body"))
    return rows.alias("r").join(groups.alias("g"), same).select(
        "r.id", "r.digest", F.col("g.first.id").alias("keep_id"), F.col("g.first.locator").alias("keep_locator"), "r.locator", "g.group_size")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(tables.documents(spark, sf_dir))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
