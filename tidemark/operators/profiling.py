"""Data profiling with one pass per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordering import exact_quantiles, quantile_array
from tidemark.sources.contracts import key_counts


def missing_share(df: DataFrame) -> DataFrame:
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return shares.unpivot([], df.columns, "column", "missing_share").orderBy(F.desc("missing_share"), "column")


def table_profile(df: DataFrame, key: Sequence[str], date: str | None = None) -> DataFrame:
    """Rows, columns, repeated full rows, repeated keys, distinct keys, date range."""
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    repeats = full.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    keys = key_counts(df, key)
    if date is None:
        first = last = F.lit(None).cast("date")
    else:
        first, last = df.agg(F.min(date)).scalar(), df.agg(F.max(date)).scalar()
    return keys.select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        repeats.cast("bigint").alias("duplicate_rows"), "duplicate_keys",
        (F.col("rows") - F.col("null_keys") - F.col("duplicate_keys")).alias("distinct_keys"),
        first.alias("first_date"), last.alias("last_date"),
    )


def dtype_summary(df: DataFrame) -> DataFrame:
    """Columns per data type; metadata only."""
    kinds = [(kind,) for _, kind in df.dtypes]
    return df.sparkSession.createDataFrame(kinds, "dtype string").groupBy("dtype").agg(
        F.count(F.lit(1)).alias("columns")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe_long(long: DataFrame) -> DataFrame:
    """Summary of ``(column, value)`` rows with exact quartiles."""
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    quartiles = exact_quantiles(long, "value", list(names), ["column"]).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()]
    )
    return basic.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return describe_long(typed.unpivot([], columns, "column", "value"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each non-null value; the total comes from the counts, not the rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("share", F.col("rows") / total)


def clip_at_quantile(df: DataFrame, column: str, probability: float = 0.99, keep: str = "filter") -> DataFrame:
    """Drop (``filter``) or cut (``clip``) values above a quantile."""
    limit = F.element_at(quantile_array(df, column, [probability]), 1)
    if keep == "clip":
        return df.withColumn(column, F.when(F.col(column) > limit, limit).otherwise(F.col(column)))
    return df.where(F.col(column) <= limit)


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over the value range; the top edge is inclusive."""
    value = F.col(column).cast("double")
    known = df.where(value.isNotNull()).select(value.alias("_v"))
    edges = known.agg(F.struct(F.min("_v").alias("low"), F.max("_v").alias("high"))).scalar()
    placed = known.withColumn("_e", edges).select(
        F.col("_v"), F.col("_e.low").alias("low"), F.col("_e.high").alias("high")
    )
    position = F.floor((F.col("_v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins)
    bin_ = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int")
    return placed.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
