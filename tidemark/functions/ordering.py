"""Exact ranks, running totals and quantiles that never put one group in one task.

A plain ``row_number`` or running ``sum`` sends a whole group (or, without a
partition key, the whole table) through a single task.  Here the order is cut
into buckets that are monotone in the sort key.  Bucket totals are tiny, so a
window over *them* gives each bucket its offset, and the detail rows are only
ordered inside their bucket.  Both shuffles of the detail rows use the same
``keys + bucket`` partitioning, hence one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialized

BUCKETS_PER_OCTAVE = 1024
HASH_BUCKET_DIGITS = 4


def magnitude_bucket(value: Column) -> Column:
    """Order-preserving bucket of a double: 1024 per power of two, sign aware."""
    octave = F.floor((F.log2(F.abs(value)) + 1075) * BUCKETS_PER_OCTAVE)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(F.signum(value).cast("bigint") * octave)


def seeded_hash(seed: int | str, *columns: Column) -> Column:
    """Hex digest that any engine can repeat: md5 of ``value|…|seed``."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(seed))))


def hash_bucket(digest: Column) -> Column:
    """Leading hex digits: uniform, and monotone in the digest order."""
    return F.substring(digest, 1, HASH_BUCKET_DIGITS)


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    measures: Sequence[str],
    bucket: Column,
    keys: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive, in ``order``) and ``total_<m>`` per key.

    ``bucket`` must be monotone in ``order``; ``descending`` says which way the
    buckets run.  ``keys`` must not be null.
    """
    keys = list(keys)
    # A struct is never null: rows with an unknown order key stay, and no null
    # filter makes the two branches differ, so they can share one exchange.
    based = df.withColumn("_bucket", F.struct(bucket.alias("b")))
    sums = based.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    whole = Window.partitionBy(*keys)
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    earlier = whole.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(whole).alias(f"total_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        based.join(offsets, [*keys, "_bucket"])
        .select(
            *df.columns,
            *[(F.col(f"_before_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures],
            *[f"total_{m}" for m in measures],
        )
    )


def split_rank(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    name: str,
    keys: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Exact 1-based position per key in a total ``order``, bucket by bucket."""
    ranked = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], bucket, keys, descending)
    return ranked.select(*df.columns, F.col("cum__one").cast("bigint").alias(name))


def global_position(df: DataFrame, column: str, name: str) -> DataFrame:
    """0-based position of each distinct value in sorted order.

    Strings have no arithmetic bucket, so the range partition itself is the
    bucket.  Its boundaries come from a sample, therefore the rows are written
    with their partition number before they are read twice.
    """
    ranged = materialized(
        df.select(column).where(F.col(column).isNotNull()).distinct()
        .repartitionByRange(column)
        .withColumn("_bucket", F.spark_partition_id())
    )
    ranked = split_rank(ranged, [F.col(column)], F.col("_bucket"), "_position")
    return ranked.select(column, (F.col("_position") - 1).alias(name))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles, one row per key and probability.

    ``percentile`` keeps every distinct value of a group in one task; this keeps
    only running counts per distinct value.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cumulative = running_totals(counts, [F.col("_value")], ["_n"], magnitude_bucket(F.col("_value")), keys)

    def share(probability: float) -> Column:
        position = F.lit(float(probability)) * (F.col("total__n") - 1)
        low = F.floor(position)
        weight_high = position - low

        def holds(index: Column) -> Column:
            return (index >= F.col("cum__n") - F.col("_n")) & (index < F.col("cum__n"))

        weight = (
            F.when(holds(low) & holds(low + 1), 1.0)
            .when(holds(low), 1 - weight_high)
            .otherwise(weight_high)
        )
        touched = holds(low) | (holds(low + 1) & (weight_high > 0))
        return F.when(touched, F.struct(F.lit(float(probability)).alias("prob"), weight.alias("weight")))

    hits = cumulative.select(
        *keys, "_value", F.inline(F.filter(F.array(*[share(p) for p in probabilities]), lambda s: s.isNotNull()))
    )
    return hits.groupBy(*keys, "prob").agg(F.sum(F.col("_value") * F.col("weight")).alias("value"))


def quantile_array(df: DataFrame, value: str, probabilities: Sequence[float]) -> Column:
    """The quantiles as one array-valued scalar subquery, in ascending order."""
    rows = exact_quantiles(df, value, probabilities)
    packed = F.sort_array(F.collect_list(F.struct("prob", "value")))
    return rows.agg(F.transform(packed, lambda s: s["value"]).alias("q")).scalar()


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join whose hot keys are spread over ``salts`` tasks.

    Left rows draw their salt from their own content, so a retried task sends
    each row to the same place; right rows are repeated once per salt.
    """
    keys = list(keys)
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
