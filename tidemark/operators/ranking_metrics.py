"""Offline ranking metrics over long (user, item, rank) tables.

Recommendations without a ``customer_id`` column are one list that every user gets:
the truth meets its ``k`` rows directly, so no user × list table is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import quantile_array


def _shared(recommendations: DataFrame) -> bool:
    return "customer_id" not in recommendations.columns


def _first_k(recommendations: DataFrame, k: int) -> DataFrame:
    """Distinct items per user (or of the shared list) in order, re-ranked; trimmed map-side to k."""
    if k <= 0:
        raise ValueError("k must be positive")
    if _shared(recommendations):
        distinct = recommendations.groupBy("article_id").agg(F.min("rank").alias("_rank")).orderBy("_rank", "article_id").limit(k)
        return distinct.withColumn("rank", F.row_number().over(Window.orderBy("_rank", "article_id"))).drop("_rank")
    distinct = recommendations.groupBy("customer_id", "article_id").agg(F.min("rank").alias("_rank"))
    order = Window.partitionBy("customer_id").orderBy("_rank", "article_id")
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_rank")


def per_user_metrics(truth: DataFrame, recommendations: DataFrame, k: int = 12) -> DataFrame:
    """``truth_items, hits, recall, average_precision, hit`` for each truth user."""
    pairs = truth.select("customer_id", "article_id").distinct()
    sizes = pairs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("truth_items"))
    listed = _first_k(recommendations, k)
    if _shared(recommendations):
        found = pairs.join(F.broadcast(listed), "article_id")  # k rows
    else:
        found = listed.join(pairs, ["customer_id", "article_id"])
    order = Window.partitionBy("customer_id").orderBy("rank")  # at most k rows per user
    hits = (
        found.withColumn("_precision", F.row_number().over(order) / F.col("rank"))
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("_precision").alias("_sum"))
    )
    return sizes.join(hits, "customer_id", "left").select(
        "customer_id", "truth_items",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        (F.coalesce("hits", F.lit(0)) / F.col("truth_items")).alias("recall"),
        (F.coalesce("_sum", F.lit(0.0)) / F.least(F.col("truth_items"), F.lit(k))).alias("average_precision"),
        F.coalesce((F.col("hits") > 0).cast("int"), F.lit(0)).alias("hit"),
    )


def recall_at_k(truth: DataFrame, recommendations: DataFrame, k: int = 12) -> DataFrame:
    users = per_user_metrics(truth, recommendations, k)
    return users.agg(F.count(F.lit(1)).alias("users"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


def map_at_k(truth: DataFrame, recommendations: DataFrame, k: int = 12) -> DataFrame:
    users = per_user_metrics(truth, recommendations, k)
    return users.agg(
        F.count(F.lit(1)).alias("users"), F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map")
    )


def hit_rate_at_k(truth: DataFrame, recommendations: DataFrame, k: int = 12) -> DataFrame:
    users = per_user_metrics(truth, recommendations, k)
    return users.agg(
        F.count(F.lit(1)).alias("users"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate")
    )


def ranking_report(truth: DataFrame, recommendations: DataFrame, k: int = 12) -> DataFrame:
    return per_user_metrics(truth, recommendations, k).agg(
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map"),
        F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"),
    )


def candidate_recall(truth: DataFrame, candidates: DataFrame, k: int = 100) -> DataFrame:
    return recall_at_k(truth, candidates, k).withColumnRenamed("recall", "candidate_recall")


def candidate_source_report(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per source: pairs and mean recall of its list (``source, cap`` columns given)."""
    pairs = truth.select("customer_id", "article_id").distinct()
    sizes = pairs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_size"))
    capped = (
        candidates.groupBy("source", "customer_id", "article_id").agg(F.min("rank").alias("rank"), F.max("cap").alias("cap"))
        .where(F.col("rank") <= F.col("cap"))
    )
    marked = capped.join(pairs.withColumn("_hit", F.lit(1)), ["customer_id", "article_id"], "left")
    users = marked.groupBy("source", "customer_id").agg(
        F.count(F.lit(1)).alias("_pairs"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("_hits")
    ).join(sizes, "customer_id", "left")
    n_truth = sizes.agg(F.count(F.lit(1))).scalar()
    return users.groupBy("source").agg(
        F.sum("_pairs").alias("pairs"),
        F.coalesce(F.sum(F.col("_hits") / F.col("_size")), F.lit(0.0)).alias("_recalls"),
    ).select("source", "pairs", F.try_divide("_recalls", n_truth).alias("candidate_recall"))


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """List lengths per user and the number of repeated pairs."""
    pairs = candidates.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("_n"))
    users = pairs.groupBy("customer_id").agg(
        F.sum("_n").alias("length"), F.sum(F.col("_n") - 1).alias("_repeats")
    )
    quartiles = quantile_array(users, "length", (0.25, 0.5, 0.75))
    summary = users.agg(
        F.count(F.lit(1)).alias("users"), F.avg("length").alias("mean_length"),
        F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.sum("_repeats").alias("duplicate_pairs"),
    ).withColumn("_q", quartiles)
    return summary.select(
        "users", "mean_length", "min_length", F.col("_q")[0].alias("p25_length"), F.col("_q")[1].alias("p50_length"),
        F.col("_q")[2].alias("p75_length"), "max_length", "duplicate_pairs",
    )


def model_comparison(reports: dict[str, DataFrame]) -> DataFrame:
    """Metric rows of several models; a metric a model lacks stays NULL."""
    stacked = None
    for name, report in reports.items():
        row = report.withColumn("model", F.lit(name))
        stacked = row if stacked is None else stacked.unionByName(row, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no reports given")
    return stacked.orderBy(F.desc_nulls_last("recall"), "model")
