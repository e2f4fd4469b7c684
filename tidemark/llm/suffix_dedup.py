"""Suffix dedup by a depth-limited radix sort, on bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tables
from tidemark.llm.repeats import Scan, cut_repeats

FIRST_DIGIT = 24


def suffix_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove bytes that stand in a ``length``-byte string of an earlier document.

    Suffixes are ordered through ``length`` bytes only.  The first digit of the
    radix sort is the gram of ``FIRST_DIGIT`` bytes at the suffix' anchor; groups
    of one document are not ordered further.  The second digit is the span around
    the anchor, the third the rest of the window.  Groups that are equal in all
    three are the repeated strings.

    Returns ``doc_id, text`` (binary: what is left), ``n_bytes, n_removed, starts,
    ends``; nulls, repeated rows and extra columns as in ``cut_repeats``.
    """
    return cut_repeats(docs, Scan("bytes", length, min(FIRST_DIGIT, length))).withColumnRenamed("n_symbols", "n_bytes")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup(tables.documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"),
                       F.sha2("text", 256).alias("kept_sha256"))
