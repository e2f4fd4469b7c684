"""Temporal splits, samples and folds; every sampler is a seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import hash_bucket, seeded_hash, split_rank
from tidemark.session import materialized

# Default names of the evaluation windows, oldest first.
WINDOW_NAMES = ("history_window_1", "history_window_2", "validation_history", "final_history")


def last_day(transactions: DataFrame):
    """Latest purchase day of transactions, or of pair counts, as a scalar subquery."""
    day = "t_dat" if "t_dat" in transactions.columns else "last_purchase"
    return transactions.agg(F.max(day).alias("d")).scalar()


def temporal_split(transactions: DataFrame, future_days: int = 7) -> DataFrame:
    """All rows with ``part`` (history/future) and the cut-off date."""
    if future_days <= 0:
        raise ValueError("future_days must be positive")
    cutoff = F.date_sub(last_day(transactions), future_days - 1)
    part = F.when(F.col("t_dat") < F.col("cutoff_date"), "history").otherwise("future")
    return transactions.withColumn("cutoff_date", cutoff).withColumn("part", part)


def history_and_future(transactions: DataFrame, future_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """The two sides of a split; each filters the scan by the scalar cut-off."""
    if future_days <= 0:
        raise ValueError("future_days must be positive")
    cutoff = F.date_sub(last_day(transactions), future_days - 1)
    return transactions.where(F.col("t_dat") < cutoff), transactions.where(F.col("t_dat") >= cutoff)


def temporal_windows(
    transactions: DataFrame, target_days: int = 7, n_windows: int = 4, step_days: int = 7,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Rows tagged with every window they belong to, as history or target.

    Windows are known from one date, so each row works out its own memberships
    and explodes them; no range join is needed.
    """
    if target_days <= 0 or n_windows <= 0 or step_days < target_days:
        raise ValueError("need positive sizes and step_days of at least target_days")
    if names is None:
        few = n_windows <= len(WINDOW_NAMES)
        names = WINDOW_NAMES[-n_windows:] if few else [f"window_{i}" for i in range(1, n_windows + 1)]
    if len(names) != n_windows:
        raise ValueError("names must contain exactly n_windows values")
    dated = transactions.withColumn("_last", last_day(transactions))
    memberships = []
    for offset, name in enumerate(names):
        end = F.date_sub(F.col("_last"), (n_windows - 1 - offset) * step_days)
        cutoff = F.date_sub(end, target_days - 1)
        role = F.when(F.col("t_dat") < cutoff, "history").when(F.col("t_dat") <= end, "target")
        memberships.append(
            F.when(role.isNotNull(), F.struct(
                F.lit(name).alias("window"), role.alias("role"),
                cutoff.alias("cutoff_date"), end.alias("target_end_date"),
            ))
        )
    belongs = F.filter(F.array(*memberships), lambda m: m.isNotNull())
    return dated.select(*transactions.columns, F.inline(belongs))


def ground_truth(history: DataFrame, future: DataFrame) -> DataFrame:
    """Distinct future purchases of known users with first-seen ``position``.

    Repeats collapse before the join, and the position is split by day, so that
    a very active user is never ordered in one task.
    """
    known = history.select("customer_id").distinct()
    firsts = future.groupBy("customer_id", "article_id").agg(F.min("t_dat").alias("first_date"))
    pairs = firsts.join(known, "customer_id", "left_semi")
    return split_rank(pairs, [F.col("article_id")], F.col("first_date"), "position", ["customer_id"])


def cold_start_users(history: DataFrame, future: DataFrame) -> DataFrame:
    known = history.select("customer_id").distinct()
    return future.select("customer_id").distinct().join(known, "customer_id", "left_anti").orderBy("customer_id")


def cohort_sample(users: DataFrame, size: int = 2000, seed: int = 42) -> DataFrame:
    """``size`` distinct users in seeded hash order; the same on any cluster."""
    return (
        users.select("customer_id").distinct()
        .withColumn("_h", seeded_hash(seed, F.col("customer_id")))
        .orderBy("_h", "customer_id").limit(size).select("customer_id")
    )


def _hash_positions(df: DataFrame, key: str, strata: Sequence[str], seed: int) -> DataFrame:
    hashed = df.withColumn("_h", seeded_hash(seed, F.col(key)))
    ranked = split_rank(hashed, [F.col("_h"), F.col(key)], hash_bucket(F.col("_h")), "_position", strata)
    return ranked.drop("_h")


def client_split(
    clients: DataFrame, holdout_share: float = 0.2, seed: int = 42, key: str = "SK_ID_CURR", label: str = "TARGET"
) -> DataFrame:
    """Label-stratified holdout: per label the first share of the hash order."""
    ranked = _hash_positions(clients.select(key, label), key, [label], seed)
    sizes = clients.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    quota = F.round(F.col("_size") * holdout_share)
    # Two label rows: the right side is bounded by the label domain.
    split = F.when(F.col("_position") <= quota, "holdout").otherwise("train")
    return ranked.join(F.broadcast(sizes), label).select(key, label, split.alias("split"))


def stratified_sample(
    rows: DataFrame, size: int, seed: int = 42, key: str = "SK_ID_CURR", label: str = "TARGET"
) -> DataFrame:
    """``size`` rows with the label ratio kept (largest remainder quotas)."""
    if size < 2:
        raise ValueError("the sample needs at least 2 rows")
    ranked = _hash_positions(rows, key, [label], seed)
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    shares = sizes.withColumn("_exact", F.col("_n") * F.least(F.lit(size), total) / total)
    floors = shares.withColumn("_floor", F.floor("_exact"))
    # One entry per label value: fold the quotas inside a single small array.
    packed = floors.agg(F.sort_array(F.collect_list(F.struct(
        (F.col("_floor") - F.col("_exact")).alias("gap"), F.col(label).alias("label"), F.col("_floor").alias("base")
    ))).alias("_labels"))
    spare = F.least(F.lit(size).cast("bigint"), total) - F.aggregate(
        "_labels", F.lit(0).cast("bigint"), lambda acc, s: acc + s["base"]
    )
    quotas = packed.withColumn("_spare", spare).select(
        F.posexplode("_labels").alias("_i", "_l"), "_spare"
    ).select(
        F.col("_l.label").alias(label),
        (F.col("_l.base") + F.when(F.col("_i") < F.col("_spare"), 1).otherwise(0)).alias("_quota"),
    )
    return ranked.join(F.broadcast(quotas), label).where("_position <= _quota").select(*rows.columns)


def stratified_kfold(
    rows: DataFrame, folds: int = 3, seed: int = 42, key: str = "SK_ID_CURR", label: str = "TARGET"
) -> DataFrame:
    """Adds ``fold`` 0..k-1, dealt out in hash order within each label."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    ranked = _hash_positions(rows, key, [label], seed)
    return ranked.withColumn("fold", F.pmod(F.col("_position") - 1, F.lit(folds)).cast("int")).drop("_position")


def negative_sampling(
    pairs: DataFrame, ratio: int = 10, seed: int = 42, label: str = "target",
    key: Sequence[str] = ("customer_id", "article_id"),
) -> DataFrame:
    """All positives and at most ``ratio`` negatives per positive, hash-chosen.

    Counting, ranking and selecting each read the labelled pairs, so these are
    written once.
    """
    pairs = materialized(pairs, "labelled")
    positives = pairs.where(F.col(label) == 1)
    quota = pairs.agg(F.coalesce(F.sum(F.col(label)), F.lit(0)) * ratio).scalar()
    hashed = pairs.where(F.col(label) == 0).withColumn("_h", seeded_hash(seed, *[F.col(k) for k in key]))
    ranked = split_rank(hashed, [F.col("_h"), *[F.col(k) for k in key]], hash_bucket(F.col("_h")), "_position")
    return positives.unionByName(ranked.where(F.col("_position") <= quota).select(*pairs.columns))


def split_coverage(split: DataFrame, base: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """Ids present on one side only (with repeats counted), per direction."""
    sides = split.select(key, F.lit(1).alias("_d")).unionByName(base.select(key, F.lit(-1).alias("_d")))
    per_key = sides.groupBy(key).agg(F.sum("_d").alias("_d"))
    return per_key.agg(
        F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).cast("bigint").alias("only_in_split"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_in_base"),
    )
