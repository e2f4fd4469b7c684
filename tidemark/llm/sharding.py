"""Sharding by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tables

LIMIT = 1 << 20
BITS = 60
STEP = 6
ID_DIGITS = 10


def hash_bits(column: str = "doc_id", text: str = "text") -> Column:
    """40 bits of the id's md5 and 20 of the text's, which any engine can repeat.

    A null id takes all bits from the text, so rows without an id, like those that
    share one, can be told apart.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = F.md5(F.coalesce(F.col(column).cast("string").cast("binary"), F.unhex(F.sha2(body, 256))))
    return F.conv(F.concat(F.substring(named, 1, ID_DIGITS), F.substring(F.md5(body), 1, BITS // 4 - ID_DIGITS)), 16, 10).cast("bigint")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """``cell, cell_depth, depth, shard, shard_bytes``: the directory of extendible hashing.

    ``sizes`` has ``hash, n_bytes``, one row per hash.  A bucket whose bytes exceed
    ``limit`` splits on the next bit, and only such a bucket: a hash goes to the
    shortest prefix that fits.  Prefixes are summed a few bits deeper than the
    total asks for; cells that still do not fit are opened deeper, until they fit
    or hold one hash.
    """
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    depth = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + STEP)
    while True:
        cells = sizes.groupBy(F.shiftright("hash", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
        if depth >= BITS or not cells.where((F.col("n_bytes") > limit) & (F.col("n") > 1)).take(1):
            break
        depth = min(BITS, depth + STEP)
    d = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    levels = cells.select("cell", "n_bytes", d.alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == depth)
    chosen = levels.join(sums, ["depth", "prefix"]).where(fits).groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes")).alias("shard"))
    return chosen.select("cell", F.lit(depth).alias("cell_depth"), "shard.depth", "shard.prefix", "shard.shard_bytes")


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, depth, prefix, shard_bytes, oversize`` of every row of ``docs``.

    A shard is named by its hash prefix: ``depth`` bits with value ``prefix``.  A
    null text has no bytes.  Rows of one doc_id stay together to a depth of 40 bits,
    beyond that rows of one doc_id and text; a shard is over the limit (``oversize``)
    only if these are.  Columns besides ``doc_id``
    and ``text`` are ignored.
    """
    scratch = tables.Scratch(docs.sparkSession, "sharding")
    slim = scratch.keep(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), hash_bits().alias("hash")))
    sizes = slim.groupBy("hash").agg(F.sum("n_bytes").alias("n_bytes"))
    found = scratch.keep(directory(sizes, limit))
    depth = found.select("cell_depth").first()
    cell = F.shiftright("hash", BITS - (depth[0] if depth else 0))
    return slim.withColumn("cell", cell).join(found, "cell").select(
        "doc_id", "n_bytes", F.col("depth").cast("bigint").alias("depth"), "prefix", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write every shard to its own folder ``depth=…/prefix=…``; ``doc_id`` must be unique."""
    named = docs.join(shard(docs, limit).select("doc_id", "depth", "prefix"), "doc_id")
    named.repartition("depth", "prefix").write.partitionBy("depth", "prefix").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(tables.documents(spark, sf_dir))


OP4_SQL = f"""
WITH t AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
levels AS (SELECT t.*, d, h >> ({BITS} - d) AS prefix FROM t, (SELECT unnest(generate_series(0, 40)) AS d)),
sums AS (SELECT d, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(DISTINCT h) AS n FROM levels GROUP BY d, prefix),
fits AS (
  SELECT l.doc_id, l.n_bytes, l.d, l.prefix, s.shard_bytes,
    row_number() OVER (PARTITION BY l.doc_id ORDER BY l.d) AS k
  FROM levels l JOIN sums s ON l.d = s.d AND l.prefix = s.prefix WHERE s.shard_bytes <= {LIMIT})
SELECT doc_id, n_bytes, CAST(d AS BIGINT) AS depth, prefix, shard_bytes, false AS oversize FROM fits WHERE k = 1
"""
