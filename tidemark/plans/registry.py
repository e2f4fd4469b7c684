"""Registry of runnable queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import canonical

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def with_tables(*names: str, _as: str = "AS", **extra: str) -> str:
    """``WITH`` clause of canonical tables followed by local definitions."""
    parts = [f"{n} {_as} ({canonical.SQL[n]})" for n in names]
    parts += [f"{n} {_as} ({body})" for n, body in extra.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def steady(value: Column, digits: int = 6) -> Column:
    """Round for comparison; the boundary sits off the ties of short decimals.

    Sums of doubles differ in their last bits with the order of addition, and
    means of two-decimal amounts fall exactly on half steps, so ordinary
    half-up rounding would flip digits between engines.
    """
    scale = float(10**digits)
    return F.floor(value * scale + 0.3) / scale


def steady_sql(value: str, digits: int = 6) -> str:
    return f"floor(({value}) * 1e{digits} + CAST(0.3 AS DOUBLE)) / 1e{digits}"


def steadied(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Comparison form of a result: doubles steadied, whole numbers as bigint."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("double", "float"):
            columns.append(steady(F.col(field.name).cast("double"), digits.get(field.name, 6)).alias(field.name))
        elif kind in ("integer", "short", "byte"):
            columns.append(F.col(field.name).cast("bigint").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)
