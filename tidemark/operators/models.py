"""MLlib pipelines, out-of-fold scoring, holdout evaluation and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import binary_metrics as B
from tidemark.operators import boosting
from tidemark.operators.credit import balanced_weights, classify_threshold, risk_bands
from tidemark.operators.splits import stratified_kfold
from tidemark.session import materialized
from tidemark.sources.contracts import ordered_features, select_model_features, validate_inference_input

KEY, LABEL = "SK_ID_CURR", "TARGET"


def column_kinds(data: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and text features by declared type."""
    kinds = {f.name: f.dataType for f in data.schema.fields}
    numeric = [c for c in features if isinstance(kinds[c], T.NumericType)]
    return numeric, [c for c in features if c not in numeric]


def _value_counts(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = data.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _levels(data: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of values of each text column: one row per column reaches the driver."""
    if not columns:
        return {}
    sizes = _value_counts(data, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return {r["column"]: r["n"] for r in sizes.collect()}


def _most_frequent(data: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Mode of each text column: one counted row per column reaches the driver."""
    if not columns:
        return {}
    best = _value_counts(data, columns).groupBy("column").agg(F.max_by("value", F.struct("n", "value")).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def _fill_stage(fills: dict[str, str], numeric: Sequence[str]) -> SQLTransformer:
    """Stage that fills text columns and widens numbers, saved with the pipeline."""
    def quoted(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    parts = [f"coalesce(cast(`{c}` AS string), {quoted(v)}) AS `{c}__text`" for c, v in fills.items()]
    parts += [f"cast(`{c}` AS double) AS `{c}__number`" for c in numeric]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def logistic_pipeline(
    data: DataFrame, features: Sequence[str], max_iter: int = 1000, label: str = LABEL, weight: str = "weight"
) -> Pipeline:
    """Median/mode imputation, scaling, one-hot, balanced logistic regression."""
    numeric, texts = column_kinds(data, features)
    modes = _most_frequent(data, texts)
    stages = [_fill_stage({c: modes.get(c, "Unknown") for c in texts}, numeric)]
    parts = []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages += [
            Imputer(strategy="median", inputCols=[f"{c}__number" for c in numeric], outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="numbers", handleInvalid="keep"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        ]
        parts.append("scaled")
    if texts:
        indexed, hot = [f"{c}__index" for c in texts], [f"{c}__hot" for c in texts]
        stages += [
            StringIndexer(inputCols=[f"{c}__text" for c in texts], outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False, handleInvalid="keep"),
        ]
        parts += hot
    stages += [
        VectorAssembler(inputCols=parts, outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, maxIter=max_iter),
    ]
    return Pipeline(stages=stages)


def boosted_trees(
    data: DataFrame, features: Sequence[str], iterations: int = 996, depth: int = 6, step: float = 0.05,
    label: str = LABEL, weight: str | None = "weight", seed: int = 42, max_bins: int = 64,
    validation: str | None = None,
) -> Pipeline:
    """MLlib's gradient-boosted trees, for pipelines that must stay MLlib (see ``boosted_model``).

    Text columns are indexed, ``Unknown`` fills gaps.

    With a ``validation`` indicator column, boosting stops when the loss on those
    rows no longer falls, however small the last gain was.  ``max_bins`` grows to
    the number of values of the widest text column.
    """
    numeric, texts = column_kinds(data, features)
    widest = max(_levels(data, texts).values(), default=0)
    fills = {c: "Unknown" for c in texts}
    stages = [_fill_stage(fills, numeric)]
    parts = []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages.append(Imputer(strategy="median", inputCols=[f"{c}__number" for c in numeric], outputCols=filled))
        parts += filled
    if texts:
        indexed = [f"{c}__index" for c in texts]
        stages.append(StringIndexer(inputCols=[f"{c}__text" for c in texts], outputCols=indexed, handleInvalid="keep"))
        parts += indexed
    options = {"weightCol": weight} if weight else {}
    if validation:
        options |= {"validationIndicatorCol": validation, "validationTol": 0.0}
    stages += [
        VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"),
        GBTClassifier(featuresCol="features", labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=step,
                      seed=seed, maxBins=max(max_bins, widest + 2), **options),
    ]
    return Pipeline(stages=stages)


def boosted_model(data: DataFrame, features: Sequence[str], spec: boosting.Boosting = boosting.Boosting()) -> boosting.BoostedEstimator:
    """The full boosting schedule on balanced clients, as ``cv_out_of_fold`` and ``train_and_holdout`` take it."""
    return boosting.BoostedEstimator(tuple(features), (KEY,), LABEL, "weight", None, spec)


Model = PipelineModel | boosting.Boosted


def score(model: Model, data: DataFrame, keep: Sequence[str], name: str = "p") -> DataFrame:
    """Positive-class probability next to the kept columns."""
    if isinstance(model, boosting.Boosted):
        return model.score(data, keep, name)
    return model.transform(data).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def ranker_score(model: Model, candidates: DataFrame) -> DataFrame:
    return score(model, candidates, ["customer_id", "article_id"], "score")


Builder = Callable[[DataFrame, Sequence[str]], Pipeline | boosting.BoostedEstimator]


def cv_out_of_fold(data: DataFrame, build: Builder, folds: int = 3, seed: int = 42) -> DataFrame:
    """One prediction per row, made by a model that did not see its fold."""
    features = select_model_features(data)
    dealt = stratified_kfold(data.select(KEY, LABEL), folds, seed)
    folded = materialized(data.join(dealt.select(KEY, "fold"), KEY))
    parts = []
    for fold in range(folds):
        fit = balanced_weights(folded.where(F.col("fold") != fold))
        model = build(fit, features).fit(fit)
        parts.append(score(model, folded.where(F.col("fold") == fold), [KEY, F.col(LABEL).alias("target"), "fold"]))
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(oof: DataFrame) -> DataFrame:
    """AUC and average precision of each fold; one short row per fold."""
    folds = [r["fold"] for r in oof.select("fold").distinct().orderBy("fold").collect()]
    rows = []
    for fold in folds:
        part = oof.where(F.col("fold") == fold)
        auc = B.roc_auc(part).withColumn("fold", F.lit(fold))
        rows.append(auc.withColumn("average_precision", B.average_precision(part).scalar()))
    return reduce(DataFrame.unionByName, rows)


def train_and_holdout(
    data: DataFrame, build: Builder, folds: int = 3, seed: int = 42
) -> tuple[PipelineModel, dict, DataFrame]:
    """OOF threshold and cut-offs, final fit, one holdout evaluation.

    ``data`` carries ``split``.  Returns the model, its bundle details and the
    one-row holdout report.
    """
    features = select_model_features(data)
    train = materialized(data.where("split = 'train'").drop("split"))
    oof = materialized(cv_out_of_fold(train, build, folds, seed))
    threshold = B.select_f1_threshold(oof).first()["threshold"]
    cutoffs = B.risk_cutoffs(oof).first()
    summary = B.fold_summary(fold_metrics(oof)).first().asDict()
    weighted = balanced_weights(train)
    model = build(weighted, features).fit(weighted)
    details = {
        "features": features, "threshold": threshold, "low_cutoff": cutoffs["low"], "high_cutoff": cutoffs["high"],
        "cv": summary,
    }
    held = evaluate_holdout(model, data, details)
    report = B.full_report(held.select(F.col(LABEL).alias("target"), "p"), threshold).withColumns(
        {f"cv_{k}": F.lit(v) for k, v in summary.items()})
    return model, details, report


def evaluate_holdout(model: PipelineModel, data: DataFrame, details: dict) -> DataFrame:
    held = score(model, data.where("split = 'holdout'"), [KEY, LABEL])
    return risk_bands(classify_threshold(held, details["threshold"]), details["low_cutoff"], details["high_cutoff"])


def predict_batch(
    model: PipelineModel, rows: DataFrame, details: dict, assemble: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Probability, class and band for unlabelled rows; assembles features only if some are missing."""
    validate_inference_input(rows)
    if set(details["features"]) - set(rows.columns) and assemble is not None:
        rows = assemble(rows)
    ready = ordered_features(rows, [KEY, *details["features"]])
    scored = score(model, ready, [KEY])
    return risk_bands(classify_threshold(scored, details["threshold"]), details["low_cutoff"], details["high_cutoff"])


def feature_importance(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Absolute coefficient or gain per encoded feature, largest first.

    Names come from the metadata of the assembled vector; rows are as many as
    the model has inputs.
    """
    final = model.stages[-1]
    values = final.coefficients if hasattr(final, "coefficients") else final.featureImportances
    attributes = model.transform(scored.limit(0)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    rows = [(names.get(i, f"feature_{i}"), abs(float(v))) for i, v in enumerate(values.toArray())]
    return scored.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
