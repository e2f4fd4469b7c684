"""Table contracts: metadata checks without a job, data checks in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table does not satisfy its contract."""


def require_columns(df: DataFrame, required: Sequence[str], table: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"{table} is missing required columns: {missing}")
    return df


def select_model_features(df: DataFrame, excluded: Sequence[str] = ("TARGET", "SK_ID_CURR", "split")) -> list[str]:
    names = [c for c in df.columns if c not in set(excluded)]
    if not names:
        raise ContractError("no feature columns remain")
    return names


def ordered_features(df: DataFrame, saved_order: Sequence[str]) -> DataFrame:
    """Project to the feature order a model was trained with."""
    if not saved_order or len(saved_order) != len(set(saved_order)):
        raise ContractError("the saved feature list is empty or has duplicates")
    return require_columns(df, saved_order, "scoring input").select(*saved_order)


def _numeric(df: DataFrame, skip: Sequence[str]) -> list[str]:
    kinds = (T.DoubleType, T.FloatType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def key_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows, null_keys, duplicate_keys`` without gathering a key's rows.

    Counting per key first keeps a hot key to one partial row per task.
    """
    null_key = F.lit(False)
    for name in key:
        null_key = null_key | F.col(name).isNull()
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", null_key)
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).cast("bigint").alias("null_keys"),
        F.coalesce(F.sum(F.when(~F.col("_null"), F.col("_n") - 1)), F.lit(0)).cast("bigint").alias("duplicate_keys"),
    )


def feature_table_violations(
    df: DataFrame,
    key: str | Sequence[str] = "SK_ID_CURR",
    forbidden: Sequence[str] = ("TARGET", "split"),
    prefixes: Sequence[str] | None = None,
    reject_null: bool = False,
) -> DataFrame:
    """``(check, violations)`` rows, all counts from a single pass."""
    key = [key] if isinstance(key, str) else list(key)
    require_columns(df, key, "feature table")
    features = [c for c in df.columns if c not in key]
    infinite = F.lit(0)
    for name in _numeric(df, key):
        infinite = infinite + (F.coalesce(F.abs(F.col(name)) == float("inf"), F.lit(False))).cast("int")
    missing = F.lit(0)
    for name in features if reject_null else []:
        missing = missing + F.col(name).isNull().cast("int")
    reduced = df.select(*key, infinite.alias("_inf"), missing.alias("_missing"))
    per_key = reduced.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_inf").alias("_inf"), F.sum("_missing").alias("_missing")
    )
    null_key = F.lit(False)
    for name in key:
        null_key = null_key | F.col(name).isNull()

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    badly_named = [c for c in features if prefixes and not c.startswith(tuple(prefixes))]
    counted = per_key.withColumn("_null", null_key).agg(
        F.when(total(F.col("_n")) == 0, 1).otherwise(0).cast("bigint").alias("empty_table"),
        total(F.when(F.col("_null"), F.col("_n"))).alias("null_key"),
        total(F.when(~F.col("_null"), F.col("_n") - 1)).alias("duplicate_key"),
        total(F.col("_inf")).alias("infinite_value"),
        total(F.col("_missing")).alias("missing_value"),
        F.lit(len(set(forbidden) & set(df.columns))).cast("bigint").alias("forbidden_column"),
        F.lit(len(badly_named)).cast("bigint").alias("unexpected_name"),
    )
    return counted.unpivot([], counted.columns, "check", "violations")


def enforce(violations: DataFrame, table: str = "feature table") -> None:
    """Raise if any check counted something (at most seven rows are read)."""
    failed = {r["check"]: r["violations"] for r in violations.where("violations > 0").collect()}
    if failed:
        raise ContractError(f"{table} breaks its contract: {failed}")


def application_violations(df: DataFrame, label: str | None = "TARGET", key: str = "SK_ID_CURR") -> DataFrame:
    """Key present, non-null, unique; label (if asked for) non-null and 0/1."""
    require_columns(df, [key] + ([label] if label else []), "application")
    bad_label = F.lit(0) if label is None else F.coalesce(~F.col(label).isin(0, 1), F.lit(True)).cast("int")
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(bad_label).alias("_bad"))

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    counted = per_key.agg(
        F.when(total(F.col("_n")) == 0, 1).otherwise(0).cast("bigint").alias("empty_table"),
        total(F.when(F.col(key).isNull(), F.col("_n"))).alias("null_key"),
        total(F.when(F.col(key).isNotNull(), F.col("_n") - 1)).alias("duplicate_key"),
        total(F.col("_bad")).alias("bad_label"),
    )
    return counted.unpivot([], counted.columns, "check", "violations")


def validate_inference_input(df: DataFrame, label: str = "TARGET", key: str = "SK_ID_CURR") -> DataFrame:
    if label in df.columns:
        raise ContractError(f"{label} must not be present in scoring input")
    enforce(application_violations(df, label=None, key=key), "scoring input")
    return df
