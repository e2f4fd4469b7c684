"""Registered streaming queries; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import text as PT
from tidemark.plans.registry import ORACLES, query, steadied
from tidemark.session import work_path
from tidemark.sources import readers
from tidemark.streaming import flows as FL


@query("chat_update_stream", """SELECT event_id AS update_id, event_id + 1 AS next_offset, user_id AS chat_id,
    event_type AS text FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0""")
def chat_update_stream(spark, folder):
    """Events as updates, some unusable, in random order and a tenth of them delivered again later."""
    number = F.col("event_id")
    updates = readers.table(spark, folder, "events").select(
        number.alias("update_id"), F.when(number % 17 != 0, F.col("user_id")).alias("chat_id"),
        F.when(number % 13 == 0, F.lit("  ")).when(number % 11 != 0, F.col("event_type")).alias("text"),
    )
    log = work_path(spark, "updates")
    # In no order of ids or times, and a tenth a second time.
    shuffled = updates.repartition(8, F.xxhash64("update_id"))
    shuffled.write.parquet(log)
    shuffled.where("update_id % 10 = 0").repartition(4, F.xxhash64("update_id", F.lit(1))).write.mode("append").parquet(log)
    stream = FL.file_stream(spark, log, updates.schema, files_per_trigger=6)
    return FL.run_stateful(FL.chat_updates(stream), work_path(spark, "replies"), work_path(spark, "offsets"))


@query("dialog_memory_stream", ORACLES["dialog_compaction"])
def dialog_memory_stream(spark, folder):
    """Every line comes on its own way: late lines wait for the ones before them.

    System prompts are turns without a line to remember.
    """
    rows = readers.table(spark, folder, "conversations")
    line = F.when(F.col("role") != "system", F.concat("role", F.lit(": "), "text"))
    lines = rows.select(F.col("conv_id").alias("chat_id"), "turn", line.alias("line"))
    inbox = work_path(spark, "lines")
    lines.repartition(8, F.xxhash64("chat_id", "turn")).write.parquet(inbox)
    stream = FL.file_stream(spark, inbox, lines.schema, files_per_trigger=3)
    memory = FL.dialog_memory(stream, PT.KEEP, PT.OVER)
    return FL.run_stateful(memory, work_path(spark, "memory"), work_path(spark, "memory_offsets"))


@query("material_ingest_stream", ORACLES["material_stats"])
def material_ingest_stream(spark, folder):
    """Every material comes in two versions, mixed in the same batches: a blank first and the text."""
    rows = readers.table(spark, folder, "documents").select("doc_id", "text")
    inbox = work_path(spark, "uploads")
    versions = rows.withColumn("version", F.lit(2)).unionByName(rows.select("doc_id", F.lit(" ").alias("text"), F.lit(1).alias("version")))
    versions.repartition(6, F.xxhash64("doc_id", "version")).write.parquet(inbox)
    stream = FL.file_stream(spark, inbox, versions.schema, files_per_trigger=2)
    return steadied(FL.ingest_materials(stream, work_path(spark, "status"), work_path(spark, "status_offsets"), compact_every=2), {})
