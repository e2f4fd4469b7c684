"""From documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``docs``.  ``run`` writes each stage as Parquet and reads it again, so a lost
executor never reaches back over more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, mixing, near_dedup, packing, tables

NEAR = near_dedup.Similar(width=5)  # two words are the contract of the query op6 alone


def carried(docs: DataFrame, *used: str) -> DataFrame:
    """The columns a stage works with; all others in one column, where no working name can meet theirs."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None)).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` out of ``carried`` rows."""
    return rows.select(*[F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows without a recognised language; name the language where it is null.

    Rejected are texts without a letter, and texts whose trigrams are rarer in the
    language found than those of nearly all rows learnt from (``recognise_language``).
    """
    used = ("text", "lang")
    learn = docs.where(~language_id.held_out() & F.col("doc_id").isNotNull())
    kept = language_id.recognise_language(carried(docs, *used), learn).where("recognised")
    return unpacked(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, *used)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; of the same row repeated, one."""
    used = ("doc_id", "text")
    stays = exact_dedup.exact_dedup(docs).where("kept").select(tables.ordered_id().alias("_id"), F.col("text_sha256").alias("_sha"))
    named = carried(docs, *used).withColumn("_id", tables.ordered_id()).withColumn("_sha", F.sha2(exact_dedup.normalised().cast("binary"), 256))
    return unpacked(named.join(stays, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]), docs, *used)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the row with the smallest doc_id stays."""
    used = ("doc_id", "text")
    stays = near_dedup.near_rows(docs, NEAR).where("kept").select(tables.ordered_id().alias("_id"), F.col("digest").alias("_digest"))
    named = carried(docs, *used).withColumn("_id", tables.ordered_id()).withColumn("_digest", near_dedup.text_digest())
    return unpacked(named.join(stays, ["_id", "_digest"], "left_semi"), docs, *used)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the budget of its leaf takes it."""
    used = ("doc_id", "text")
    taken = mixing.mixed_rows(docs, mixing.Mix()).groupBy(tables.ordered_id().alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.max("copies").alias("_copies")).where("_copies > 0")
    named = carried(docs, *used).withColumn("_id", tables.ordered_id()).withColumn("_hash", F.xxhash64("text")).join(taken, ["_id", "_hash"])
    return unpacked(named.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))), docs, *used)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row for each piece of a document."""
    return packing.pack(docs, *packing.public_files())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

# Language ID, near-duplicates and packing have no SQL: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    scratch = tables.Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        done = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = done
    return docs
