"""User, item, pair and affinity features from history before a reference day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.candidates import SOURCES, is_paired, purchase_pairs
from tidemark.operators.splits import last_day
from tidemark.sources.contracts import ContractError, require_columns

# The item attributes, those ranked by popularity, and the affinity column of four of them.
ITEM_ATTRIBUTES = (
    "product_type_name", "product_group_name", "colour_group_name",
    "department_name", "section_name", "garment_group_name",
)
CHARTED_ATTRIBUTES = (
    "product_group_name", "product_type_name", "colour_group_name", "section_name", "garment_group_name",
)
AFFINITY_COLUMNS = {
    "product_type_name": "user_product_type_count",
    "colour_group_name": "user_colour_count",
    "section_name": "user_section_count",
    "garment_group_name": "user_garment_group_count",
}


def _reference(history: DataFrame, reference: Column | None) -> Column:
    return F.date_add(last_day(history), 1) if reference is None else reference


def user_features(history: DataFrame, customers: DataFrame | None = None, reference: Column | None = None) -> DataFrame:
    reference = _reference(history, reference)
    users = history.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("user_total_purchases"),
        F.count_distinct("article_id").alias("user_unique_items"),
        F.count_distinct("t_dat").alias("user_active_days"),
        F.max("t_dat").alias("_last"),
        F.avg("price").alias("user_average_price"),
        F.avg(F.coalesce((F.col("sales_channel_id") == 2).cast("double"), F.lit(0.0))).alias("user_online_share"),
    )
    users = users.withColumn("user_days_since_last_purchase", F.datediff(reference, F.col("_last"))).drop("_last")
    if customers is None:
        return users
    ages = customers.groupBy("customer_id").agg(F.min("age").alias("user_age"))
    return users.join(ages, "customer_id", "left")


def item_features(history: DataFrame, reference: Column | None = None) -> DataFrame:
    """Both recent counts are conditional sums of the one aggregation."""
    reference = _reference(history, reference)
    dated = history.withColumn("_age", F.datediff(reference, F.col("t_dat")))
    return dated.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("item_total_purchases"),
        F.count_distinct("customer_id").alias("item_unique_customers"),
        F.avg("price").alias("item_average_price"),
        F.min("_age").alias("item_days_since_last_purchase"),
        F.count_if(F.col("_age") <= 7).alias("item_popularity_7d"),
        F.count_if(F.col("_age") <= 30).alias("item_popularity_30d"),
    )


def pair_features(history: DataFrame, reference: Column | None = None) -> DataFrame:
    reference = _reference(history, reference)
    return purchase_pairs(history).select(
        "customer_id", "article_id", F.col("purchases").alias("user_item_purchase_count"),
        F.datediff(reference, F.col("last_purchase")).alias("days_since_user_bought_item"),
        F.lit(1).alias("user_bought_item_before"),
    )


def clean_attributes(articles: DataFrame) -> DataFrame:
    """One row per item, missing attributes as ``Unknown``."""
    require_columns(articles, ("article_id", *ITEM_ATTRIBUTES), "articles")
    filled = articles.select("article_id", *[
        F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in ITEM_ATTRIBUTES
    ])
    first = filled.groupBy("article_id").agg(F.min(F.struct(*ITEM_ATTRIBUTES)).alias("_a"))
    return first.select("article_id", "_a.*")


def category_affinity(history: DataFrame, articles: DataFrame) -> DataFrame:
    """``(customer_id, category, value, purchases)`` for the four categories.

    Purchases are counted per pair before the attribute join, so a best seller
    or a heavy buyer enters the join once per pair.  The four entries of a pair
    are unfolded where its customer is counted, so a pair travels as one row.
    """
    pairs = purchase_pairs(history).select("customer_id", "article_id", F.col("purchases").alias("_n"))
    attributes = clean_attributes(articles).select("article_id", *AFFINITY_COLUMNS)
    joined = pairs.join(attributes, "article_id")
    entries = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in AFFINITY_COLUMNS
    ])
    placed = by_customer(joined.select("customer_id", "_n", *AFFINITY_COLUMNS))
    return placed.select("customer_id", "_n", F.inline(entries)).groupBy("customer_id", "category", "value").agg(
        F.sum("_n").alias("purchases")
    )


def by_customer(rows: DataFrame) -> DataFrame:
    """Rows placed by customer before they unfold; small partitions are not merged, as they grow there."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "customer_id")


def candidate_features(
    candidates: DataFrame, history: DataFrame, articles: DataFrame,
    customers: DataFrame | None = None, reference: Column | None = None, pairs: DataFrame | None = None,
    of: DataFrame | None = None,
) -> DataFrame:
    """Ranking table: candidates with every feature, no NULL left.

    The four affinity lookups share one join: a user's counts travel as a map
    whose size is bounded by the attribute vocabulary.  It is joined last: no
    exchange carries a copy of it for each candidate.  ``pairs`` shares pair
    counts of the same history that already exist.  ``of`` holds the candidates' keys
    if they are few: then only the history of these users and items is counted.
    """
    require_columns(history, ("customer_id", "article_id", "t_dat"), "history")
    reference = _reference(history, reference)
    counted, own, bought = history if pairs is None else pairs, history, history
    if of is not None:
        own, counted = (t.join(of.select("customer_id").distinct(), "customer_id", "left_semi") for t in (own, counted))
        bought = history.join(of.select("article_id").distinct(), "article_id", "left_semi")
    users = user_features(own, customers, reference)
    items = item_features(bought, reference)
    pairs = pair_features(counted, reference)
    attributes = clean_attributes(articles)
    affinity = category_affinity(counted, articles).groupBy("customer_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.concat_ws("=", "category", "value").alias("key"), F.col("purchases").alias("value")
        ))).alias("_affinity")
    )
    wide = (
        candidates.join(pairs, ["customer_id", "article_id"], "left")
        .join(items, "article_id", "left").join(attributes, "article_id", "left")
        .join(users, "customer_id", "left").join(affinity, "customer_id", "left")
    ).select("article_id", "customer_id", *[
        c for table in (candidates, users, affinity, pairs, items, attributes) for c in table.columns
        if c not in ("customer_id", "article_id")
    ])
    filled = wide.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ITEM_ATTRIBUTES})
    counts = {
        out: F.coalesce(F.try_element_at("_affinity", F.concat(F.lit(f"{c}="), F.col(c))), F.lit(0))
        for c, out in AFFINITY_COLUMNS.items()
    }
    filled = filled.withColumns(counts).drop("_affinity")
    if "user_age" not in filled.columns:
        filled = filled.withColumn("user_age", F.lit(0))
    for score, rank, present in SOURCES.values():
        for name, kind in ((score, "double"), (rank, "int"), (present, "int")):
            if name not in filled.columns:
                filled = filled.withColumn(name, F.lit(0).cast(kind))
    texts = {"customer_id", "article_id", *ITEM_ATTRIBUTES}
    return filled.na.fill(0, [c for c in filled.columns if c not in texts])


def check_history(history: DataFrame, reference_date: str) -> DataFrame:
    """Reject history on or after the reference day (leakage)."""
    late = history.where(F.col("t_dat") >= F.lit(reference_date).cast("date")).limit(1).count()
    if late:
        raise ContractError("history must contain only dates before the reference date")
    return history


def label_candidates(candidates: DataFrame, future: DataFrame) -> DataFrame:
    bought = future.select("customer_id", "article_id").distinct().withColumn("target", F.lit(1))
    joined = candidates.join(bought, ["customer_id", "article_id"], "left")
    return joined.withColumn("target", F.coalesce("target", F.lit(0)))


def interaction_confidence(history: DataFrame) -> DataFrame:
    counts = purchase_pairs(history).select("customer_id", "article_id", F.col("purchases").alias("purchase_count"))
    return counts.withColumn("confidence", 1.0 + F.log1p(F.col("purchase_count").cast("double")))


def known_pairs(history: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Pair counts restricted to a saved vocabulary of users and items."""
    counts = purchase_pairs(history).select("customer_id", "article_id", F.col("purchases").alias("purchase_count"))
    return counts.join(items.select("article_id").distinct(), "article_id", "left_semi").join(
        users.select("customer_id").distinct(), "customer_id", "left_semi"
    )


def seen_items(history: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs: the set in long form, safe for heavy users."""
    pairs = history.select("customer_id", "article_id")
    return pairs if is_paired(history) else pairs.distinct()


def orphan_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct fact keys without a dimension row."""
    return facts.select(key).where(F.col(key).isNotNull()).distinct().join(
        dimension.select(key).distinct(), key, "left_anti"
    )


def profile_coverage(facts: DataFrame, dimension: DataFrame, key: str, attribute: str) -> DataFrame:
    """Share of fact rows whose attribute is unknown; facts are counted per key first."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = dimension.groupBy(key).agg(F.min(attribute).alias(attribute))
    joined = counts.join(known, key, "left")
    unknown = F.sum(F.when(F.col(attribute).isNull(), F.col("_n")).otherwise(0))
    return joined.agg(F.sum("_n").alias("rows"), F.try_divide(unknown, F.sum("_n")).alias("unknown_share"))


def popularity_by_category(transactions: DataFrame, articles: DataFrame, top: int = 12) -> DataFrame:
    """Best selling known values of five attribute columns, ties by value."""
    items = transactions.groupBy("article_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = items.join(articles.select("article_id", *CHARTED_ATTRIBUTES), "article_id")
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in CHARTED_ATTRIBUTES])
    known = joined.select("_n", F.inline(entries)).where(F.col("value").isNotNull())
    counts = known.groupBy("category", "value").agg(F.sum("_n").alias("purchases"))
    order = Window.partitionBy("category").orderBy(F.desc("purchases"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def purchases_by_month(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy(F.trunc("t_dat", "month").alias("month")).agg(F.count(F.lit(1)).alias("purchases"))


def activity_distribution(transactions: DataFrame) -> DataFrame:
    """Purchases per user and buyers per item: summary and number with exactly one."""
    from tidemark.operators.profiling import describe_long

    per_user = transactions.groupBy("customer_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    per_item = transactions.groupBy("article_id").agg(F.count_distinct("customer_id").cast("double").alias("value"))
    both = reduce(DataFrame.unionByName, [
        per_user.select(F.lit("purchases_per_user").alias("column"), "value"),
        per_item.select(F.lit("buyers_per_item").alias("column"), "value"),
    ])
    singles = both.groupBy("column").agg(F.count_if(F.col("value") == 1).alias("exactly_one"))
    return describe_long(both).join(singles, "column")
