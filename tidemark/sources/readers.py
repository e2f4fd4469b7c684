"""Readers: transactions, dimensions, credit base table, text files, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sources.contracts import application_violations, enforce, require_columns

TRANSACTION_COLUMNS = ("t_dat", "customer_id", "article_id")

# Image suffixes the batch job accepts.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV (all columns as text, so ids keep their zeros) or Parquet."""
    try:
        if path.rstrip("/").endswith((".csv", ".csv.gz")):
            return spark.read.option("header", True).csv(path)
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise


def as_transactions(df: DataFrame) -> DataFrame:
    """Canonical types: text ids, normalised article ids, ``t_dat`` as a date."""
    require_columns(df, TRANSACTION_COLUMNS, "transactions")
    typed = df.withColumns({
        "customer_id": F.col("customer_id").cast("string"),
        "article_id": S.normalize_article_id("article_id"),
        "t_dat": F.to_date(F.col("t_dat")),
    })
    extra = {"price": "double", "sales_channel_id": "int"}
    return typed.withColumns({c: F.col(c).cast(t) for c, t in extra.items() if c in df.columns})


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    return as_transactions(read_any(spark, path))


def as_dimension(df: DataFrame, key: str) -> DataFrame:
    require_columns(df, [key], "dimension")
    clean = S.normalize_article_id(key) if key == "article_id" else F.col(key).cast("string")
    return df.withColumn(key, clean)


def load_dimension(spark: SparkSession, path: str, key: str) -> DataFrame:
    return as_dimension(read_any(spark, path), key)


def as_application(df: DataFrame, label: str | None = "TARGET", check: bool = False) -> DataFrame:
    """Unknown employment days become NULL; ``check`` runs the key/label contract."""
    require_columns(df, ["SK_ID_CURR"] + ([label] if label else []), "application")
    if check:
        enforce(application_violations(df, label), "application")
    if "DAYS_EMPLOYED" not in df.columns:
        return df
    return df.withColumn("DAYS_EMPLOYED", S.known_day(F.col("DAYS_EMPLOYED").cast("int")))


def read_application(spark: SparkSession, path: str, label: str | None = "TARGET") -> DataFrame:
    raw = read_any(spark, path)
    typed = raw.withColumn("SK_ID_CURR", F.col("SK_ID_CURR").cast("bigint")) if "SK_ID_CURR" in raw.columns else raw
    if label and label in raw.columns:
        typed = typed.withColumn(label, F.col(label).cast("int"))
    return as_application(typed, label, check=True)


def read_text_materials(spark: SparkSession, path: str) -> DataFrame:
    """Each ``.txt``/``.md`` below ``path`` is one segment; blank files are dropped."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{txt,md}")
        .option("ignoreCorruptFiles", True)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), S.trimmed("value").alias("text"))
    )
    return files.where(F.length("text") > 0).select("path", F.lit(0).alias("pos"), "text", F.lit("text").alias("source"))


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Names below a folder, without reading any content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))


def pair_files(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Image and mask paths that share a file name, in name order."""
    left = images.select("file_name", F.col("path").alias("image_path"))
    right = masks.select("file_name", F.col("path").alias("mask_path"))
    return left.join(right, "file_name").orderBy("file_name", "image_path", "mask_path")


def batch_inventory(
    listing: DataFrame,
    outputs: DataFrame,
    overwrite: bool = False,
    suffixes: Sequence[str] = IMAGE_SUFFIXES,
) -> DataFrame:
    """Classify a listing: ignored, skipped (output exists) or todo, with output name."""
    name = F.col("file_name")
    hidden = name.startswith(".")
    supported = ~hidden & S.suffix(name).isin(*suffixes)
    dotted = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(dotted))
    target = F.when(supported, F.concat(stem, F.lit("_face"), dotted))
    existing = outputs.select(F.col("file_name").alias("output_file"), F.lit(True).alias("_exists")).distinct()
    joined = listing.withColumn("output_file", target).join(existing, "output_file", "left")
    status = (
        F.when(F.col("output_file").isNull(), "ignored")
        .when(F.coalesce(F.col("_exists"), F.lit(False)) & F.lit(not overwrite), "skipped")
        .otherwise("todo")
    )
    return joined.select(*listing.columns, "output_file", status.alias("status"))
