"""Popularity and history candidates, source merging, hybrids and top-k lists."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.contracts import require_columns

# Score, rank and flag column of each candidate source.
SOURCES = {
    "als": ("als_score", "als_rank", "from_als"),
    "content_based": ("content_similarity_score", "content_rank", "from_content_based"),
    "personal_history": ("personal_history_score", "personal_history_rank", "from_personal_history"),
    "popularity": ("popularity_score", "popularity_rank", "from_popularity"),
}

# Weights of the simple hybrid.
HYBRID_WEIGHTS = {
    "als_score": 0.5, "content_similarity_score": 0.3, "personal_history_score": 0.1, "popularity_score": 0.1,
}


def _positive(limit: int) -> int:
    if limit <= 0:
        raise ValueError("limit must be positive")
    return limit


def is_paired(history: DataFrame) -> bool:
    """Whether a history is already counted per pair (see ``purchase_pairs``)."""
    return "purchases" in history.columns


def _purchases(history: DataFrame) -> Column:
    return F.sum("purchases") if is_paired(history) else F.count(F.lit(1))


def popular_items(history: DataFrame, limit: int = 100) -> DataFrame:
    """Top items by purchases, ties by id; only ``limit`` rows reach the rank."""
    top = (
        history.groupBy("article_id").agg(_purchases(history).alias("popularity_score"))
        .orderBy(F.desc("popularity_score"), "article_id").limit(_positive(limit))
    )
    order = Window.orderBy(F.desc("popularity_score"), "article_id")
    return top.withColumn("popularity_rank", F.row_number().over(order))


def packed_list(items: DataFrame, order: str, *columns: str) -> Column:
    """A short ordered list as one array-valued scalar subquery."""
    return items.agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("l")).scalar()


def popularity_candidates(users: DataFrame, popular: DataFrame, limit: int = 30) -> DataFrame:
    """Every user with the first ``limit`` popular items (at most 30 by default)."""
    top = packed_list(
        popular.where(F.col("popularity_rank") <= _positive(limit)), "popularity_rank", "article_id", "popularity_score"
    )
    listed = users.select("customer_id").withColumn("_top", top)
    return listed.select("customer_id", F.inline("_top")).select(
        "customer_id", "article_id", "popularity_score", "popularity_rank"
    )


def purchase_pairs(history: DataFrame) -> DataFrame:
    """Purchases and last day per (user, item).

    Every history operator accepts this table in place of the transactions, so
    a flow counts them once and shares the result.
    """
    if is_paired(history):
        return history
    return history.groupBy("customer_id", "article_id").agg(
        F.count(F.lit(1)).alias("purchases"), F.max("t_dat").alias("last_purchase")
    )


def _ranked(df: DataFrame, order: list[Column], name: str, limit: int) -> DataFrame:
    """Best ``limit`` rows per user; Spark trims each group before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy("customer_id").orderBy(*order)))
    return ranked.where(F.col(name) <= _positive(limit))


def personal_history(history: DataFrame, limit: int = 20) -> DataFrame:
    order = [F.desc("purchases"), F.desc("last_purchase"), F.asc("article_id")]
    return _ranked(purchase_pairs(history), order, "personal_history_rank", limit).select(
        "customer_id", "article_id", F.col("purchases").alias("personal_history_score"), "personal_history_rank"
    )


def recent_history(history: DataFrame, limit: int = 20) -> DataFrame:
    order = [F.desc("last_purchase"), F.asc("article_id")]
    return _ranked(purchase_pairs(history), order, "recent_rank", limit).select(
        "customer_id", "article_id", (1.0 / F.col("recent_rank")).alias("recent_score"), "recent_rank"
    )


def personal_history_blend(recent: DataFrame, frequent: DataFrame) -> DataFrame:
    """Union of both lists; a pair keeps its best score and best rank."""
    columns = ["customer_id", "article_id", "personal_history_score", "personal_history_rank"]
    both = recent.toDF(*columns).withColumn(columns[2], F.col(columns[2]).cast("double")).unionByName(
        frequent.select(columns).withColumn(columns[2], F.col(columns[2]).cast("double"))
    )
    return both.groupBy("customer_id", "article_id").agg(
        F.max(columns[2]).alias(columns[2]), F.min(columns[3]).alias(columns[3])
    )


def candidate_union(*sources: DataFrame) -> DataFrame:
    pairs = [s.select("customer_id", "article_id") for s in sources]
    return reduce(DataFrame.unionByName, pairs).distinct()


def merge_candidate_sources(sources: Mapping[str, DataFrame], limit_per_user: int | None = None) -> DataFrame:
    """One row per pair with score, rank and flag of every source.

    The sources are stacked and aggregated once by pair; a repeated pair keeps
    the score of its best rank.  With a per-user cap the rows go once to the place of
    their user, where pairs are merged and ranked.
    """
    if not sources or set(sources) - set(SOURCES):
        raise ValueError(f"expected one or more of {list(SOURCES)}")
    stacked = []
    for name, frame in sources.items():
        score, rank, _ = SOURCES[name]
        require_columns(frame, ("customer_id", "article_id", score, rank), f"{name} candidates")
        stacked.append(frame.select(
            F.col("customer_id").cast("string").alias("customer_id"),
            F.col("article_id").cast("string").alias("article_id"),
            F.col(score).cast("double").alias(score), F.col(rank).cast("int").alias(rank),
        ))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    if limit_per_user is not None:
        union = union.repartition("customer_id")
    best = []
    for name in sources:
        score, rank, _ = SOURCES[name]
        best += [F.min_by(score, rank).alias(score), F.min(rank).alias(rank)]
    pairs = union.groupBy("customer_id", "article_id").agg(*best)
    columns, count, priority = [], F.lit(0), F.lit(0.0)
    for name, (score, rank, flag) in SOURCES.items():
        if name not in sources:
            columns += [F.lit(0.0).alias(score), F.lit(0).alias(rank), F.lit(0).cast("tinyint").alias(flag)]
            continue
        present = F.col(rank).isNotNull()
        columns += [
            F.coalesce(score, F.lit(0.0)).alias(score), F.coalesce(rank, F.lit(0)).alias(rank),
            present.cast("tinyint").alias(flag),
        ]
        count = count + present.cast("int")
        priority = priority + F.when(F.col(rank) > 0, 1.0 / F.col(rank)).otherwise(0.0)
    wide = pairs.select(
        "customer_id", "article_id", *columns,
        count.cast("tinyint").alias("number_of_candidate_sources"), priority.alias("_priority"),
    )
    if limit_per_user is not None:
        order = [F.desc("number_of_candidate_sources"), F.desc("_priority"), F.asc("article_id")]
        wide = _ranked(wide, order, "_place", limit_per_user).drop("_place")
    return wide.drop("_priority")


def minmax_per_user(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns to 0..1 within a user; a constant column becomes 0.

    Candidate lists are capped per user, so the window stays small.
    """
    user = Window.partitionBy("customer_id")
    scaled = {}
    for name in columns:
        low, high = F.min(name).over(user), F.max(name).over(user)
        scaled[name] = F.coalesce(F.try_divide(F.col(name) - low, high - low), F.lit(0.0))
    return candidates.withColumns(scaled)


def simple_hybrid(candidates: DataFrame, weights: Mapping[str, float] = HYBRID_WEIGHTS, k: int = 12) -> DataFrame:
    """Weighted sum of the scaled scores; a cosine is on its 0..1 scale already."""
    scaled = minmax_per_user(candidates, [c for c in weights if c != "content_similarity_score"])
    score = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])
    # Scores that differ only in their last bits count as ties, so the id decides.
    scored = scaled.select("customer_id", "article_id", F.round(score, 9).alias("score"))
    return _ranked(scored, [F.desc("score"), F.asc("article_id")], "rank", k)


def top_k_with_fallback(
    scored: DataFrame, popular: DataFrame, k: int = 12, users: DataFrame | None = None
) -> DataFrame:
    """Best ``k`` distinct items per user, completed from the popular list.

    A user with m own items needs k−m others, and at most m of the list can
    repeat, so the first k popular items always suffice.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    best = scored.groupBy("customer_id", "article_id").agg(F.max("score").alias("score"))
    if users is not None:
        best = best.join(users.select("customer_id").distinct(), "customer_id", "left_semi")
    own = _ranked(best, [F.desc("score"), F.asc("article_id")], "_place", k)
    targets = (scored if users is None else users).select("customer_id").distinct()
    listed = popularity_candidates(targets, popular, k)
    stacked = own.select(
        "customer_id", "article_id", F.lit(0).alias("_tier"), "_place", F.col("score").cast("double").alias("score")
    ).unionByName(listed.select(
        "customer_id", "article_id", F.lit(1).alias("_tier"),
        F.col("popularity_rank").alias("_place"), F.lit(0.0).alias("score"),
    ))
    first = stacked.groupBy("customer_id", "article_id").agg(
        F.min(F.struct("_tier", "_place", "score")).alias("_first")
    ).select("customer_id", "article_id", "_first.*")
    ranked = _ranked(first, [F.asc("_tier"), F.asc("_place")], "rank", k)
    return ranked.select("customer_id", "article_id", "rank", "score")


def recommend_lookup(requests: DataFrame, recommendations: DataFrame, popular: DataFrame) -> DataFrame:
    """Answer ``(customer_id, k)`` requests from stored lists or popularity.

    One left join; a user without a list unfolds the popular list instead.
    """
    top = packed_list(popular.where(F.col("popularity_rank") <= 50), "popularity_rank", "article_id")
    stored = recommendations.select(
        "customer_id", F.struct(F.col("rank").cast("int").alias("rank"), "article_id").alias("_own")
    )
    joined = requests.join(stored, "customer_id", "left").withColumn("_popular", top)
    own = F.array(F.struct(F.col("_own.rank").alias("rank"), F.col("_own.article_id").alias("article_id")))
    listed = F.transform("_popular", lambda s: F.struct(
        s["popularity_rank"].alias("rank"), s["article_id"].alias("article_id")
    ))
    found = F.col("_own").isNotNull()
    answer = joined.select(
        "customer_id", "k", F.when(found, "personalized").otherwise("popularity_fallback").alias("source"),
        F.inline(F.when(found, own).otherwise(listed)),
    )
    return answer.where((F.col("rank") <= F.col("k")) & F.col("k").between(1, 50))
