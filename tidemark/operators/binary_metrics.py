"""Binary classification metrics, exact and tie aware, as SQL.

Ranking metrics start from counts per distinct score; running totals over those
counts come from the bucketed order, so no task sees the whole curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import magnitude_bucket, quantile_array, running_totals
from tidemark.sources.contracts import ContractError


def validate_scores(scored: DataFrame) -> DataFrame:
    """Both classes present, labels 0/1, scores finite and within 0..1."""
    bad_label = F.count_if(F.coalesce(~F.col("target").isin(0, 1), F.lit(True)))
    bad_score = F.count_if(F.coalesce(~F.col("p").between(0, 1) | F.isnan("p"), F.lit(True)))
    row = scored.agg(
        F.count_distinct("target").alias("classes"), bad_label.alias("labels"), bad_score.alias("scores")
    ).first()
    if row["classes"] != 2 or row["labels"] or row["scores"]:
        raise ContractError(f"scores are not usable: {row.asDict()}")
    return scored


def score_curve(scored: DataFrame) -> DataFrame:
    """Per distinct score, best first: counts, running and total positives/negatives."""
    counts = scored.groupBy(F.col("p").cast("double").alias("p")).agg(
        F.sum(F.col("target").cast("bigint")).alias("pos"), F.sum(1 - F.col("target").cast("bigint")).alias("neg")
    )
    return running_totals(counts, [F.desc("p")], ["pos", "neg"], magnitude_bucket(F.col("p")), descending=True)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Mann–Whitney form: positives beat all lower negatives and half of the tied."""
    below = F.col("total_neg") - F.col("cum_neg") + 0.5 * F.col("neg")
    curve = score_curve(scored)
    return curve.agg(
        F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("total_pos") * F.col("total_neg")).cast("double"))
        .alias("roc_auc")
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """Σ ΔRecall · Precision over distinct scores (step-wise)."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return score_curve(scored).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.max("total_pos").cast("double")).alias("average_precision")
    )


def ks_statistic(scored: DataFrame) -> DataFrame:
    gap = F.col("cum_pos") / F.col("total_pos") - F.col("cum_neg") / F.col("total_neg")
    return score_curve(scored).agg(F.greatest(F.max(gap), F.lit(0.0)).alias("ks_statistic"))


def select_f1_threshold(scored: DataFrame) -> DataFrame:
    """Score with the highest F1 (lowest score on ties), kept inside (0, 1)."""
    curve = score_curve(scored)
    f1 = 2 * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg") + F.col("total_pos"))
    # F1 values equal up to the last bits are ties.
    best = curve.withColumn("f1", f1).agg(F.max(F.struct(F.round("f1", 12).alias("f1"), (-F.col("p")).alias("np"))).alias("b"))
    threshold = F.least(F.greatest(-F.col("b.np"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return best.select(threshold.alias("threshold"), F.col("b.f1").alias("f1"))


def confusion_matrix(scored: DataFrame, threshold: float) -> DataFrame:
    predicted, actual = F.col("p") >= threshold, F.col("target") == 1
    return scored.agg(
        F.count_if(~predicted & ~actual).alias("true_negative"), F.count_if(predicted & ~actual).alias("false_positive"),
        F.count_if(~predicted & actual).alias("false_negative"), F.count_if(predicted & actual).alias("true_positive"),
    )


def binary_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """Threshold metrics from one aggregation; undefined ratios are 0."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie strictly between 0 and 1")
    predicted, actual = F.col("p") >= threshold, F.col("target") == 1
    sums = scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("target").cast("double")).alias("positive_rate"),
        F.avg(F.pow(F.col("p") - F.col("target"), F.lit(2.0))).alias("brier_score"),
        F.count_if(predicted == actual).alias("_right"), F.count_if(predicted & actual).alias("_tp"),
        F.count_if(predicted).alias("_pp"), F.count_if(actual).alias("_ap"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return sums.select(
        "n_rows", "positive_rate", F.lit(float(threshold)).alias("threshold"), "brier_score",
        ratio(F.col("_right"), F.col("n_rows")).alias("accuracy"),
        ratio(F.col("_tp"), F.col("_pp")).alias("precision"), ratio(F.col("_tp"), F.col("_ap")).alias("recall"),
        ratio(2 * F.col("_tp"), F.col("_pp") + F.col("_ap")).alias("f1"),
    )


def full_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Every metric in one row; the curve metrics share one curve."""
    curve = score_curve(scored)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    below = F.col("total_neg") - F.col("cum_neg") + 0.5 * F.col("neg")
    gap = F.try_divide(F.col("cum_pos"), F.col("total_pos")) - F.try_divide(F.col("cum_neg"), F.col("total_neg"))
    ranking = curve.agg(
        F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("total_pos") * F.col("total_neg")).cast("double"))
        .alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.max("total_pos").cast("double")).alias("average_precision"),
        F.greatest(F.max(gap), F.lit(0.0)).alias("ks_statistic"),
    )
    return (
        binary_metrics(scored, threshold)
        .withColumn("_ranking", ranking.select(F.struct("*")).scalar())
        .withColumn("_confusion", confusion_matrix(scored, threshold).select(F.struct("*")).scalar())
        .select("*", "_ranking.*", "_confusion.*").drop("_ranking", "_confusion")
    )


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate per non-empty quantile bin."""
    inner = quantile_array(scored, "p", [i / bins for i in range(1, bins)])
    binned = scored.withColumn("_edges", inner).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col("p")))
    )
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_score"),
        F.avg(F.col("target").cast("double")).alias("observed_rate"),
    )


def risk_cutoffs(scored: DataFrame, probabilities: Sequence[float] = (0.5, 0.8)) -> DataFrame:
    """Two quantiles kept inside (0, 1) and at least 1e-4 apart."""
    edges = scored.sparkSession.range(1).select(quantile_array(scored, "p", probabilities).alias("q"))
    low = F.least(F.greatest(F.col("q")[0], F.lit(1e-4)), F.lit(1 - 2e-4))
    return edges.select(low.alias("low"), "q").select(
        "low", F.least(F.greatest(F.col("q")[1], F.col("low") + 1e-4), F.lit(1 - 1e-4)).alias("high")
    )


def risk_segments(banded: DataFrame) -> DataFrame:
    return banded.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("clients"), F.avg(F.col("target").cast("double")).alias("observed_rate"),
        F.avg("p").alias("mean_score"),
    )


def score_histogram(scored: DataFrame, bins: int = 40) -> DataFrame:
    """Density of the score over 0..1 for each label."""
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy("target", place.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy("target").agg(F.sum("rows").alias("_total"))  # one row per label
    return counts.join(F.broadcast(totals), "target").select(
        "target", "bin", "rows", (F.col("rows") * bins / F.col("_total")).alias("density")
    )


def error_analysis(scored: DataFrame, threshold: float) -> DataFrame:
    predicted = (F.col("p") >= threshold).cast("int")
    return scored.withColumn("predicted", predicted).where(F.col("target") != F.col("predicted")).orderBy(
        F.desc("p"), "id"
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str] = ("roc_auc", "average_precision")) -> DataFrame:
    columns = []
    for name in metrics:
        columns += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    return folds.agg(*columns)


def best_iteration(curve: DataFrame, metric: str = "metric_mean") -> DataFrame:
    """Row with the highest mean metric; the earliest iteration wins ties."""
    best = curve.agg(F.max(F.struct(
        F.col(metric), (-F.col("iteration")).alias("_order"), F.col("metric_std")
    )).alias("b"))
    return best.select(
        (-F.col("b._order")).alias("iteration"), F.col(f"b.{metric}").alias(metric), F.col("b.metric_std").alias("metric_std")
    )


def segmentation_overlap(masks: DataFrame, smooth: float = 1e-6) -> DataFrame:
    """Dice and IoU per image over mask pixels ``(image, y, p)``."""
    sums = masks.groupBy("image").agg(
        F.sum(F.col("y") * F.col("p")).cast("double").alias("i"),
        F.sum("y").cast("double").alias("a"), F.sum("p").cast("double").alias("b"),
    )
    return sums.select(
        "image", ((2 * F.col("i") + smooth) / (F.col("a") + F.col("b") + smooth)).alias("dice"),
        ((F.col("i") + smooth) / (F.col("a") + F.col("b") - F.col("i") + smooth)).alias("iou"),
    )
