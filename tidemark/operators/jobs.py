"""Batch-job reporting: listings, timetables, boxes and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

LISTING_SCHEMA = (
    "struct<items:array<struct<name:string,alternate_url:string,employer:struct<name:string>,"
    "salary:struct<from:bigint,to:bigint,currency:string>,snippet:struct<requirement:string,responsibility:string>>>>"
)
# Excluded title words, the default currency and its sign, display texts.
EXCLUDED_WORDS = ("графический дизайнер", "дизайнер", "менеджер")
ROUBLE, ROUBLE_SIGN = "RUR", "₽"
NO_SALARY, FROM_WORD, TO_WORD, GAP, UNNAMED = "не указана", "от ", "до ", "окно", "Без названия"
LABELS = {"employer": "Работодатель", "salary_text": "Зарплата", "url": "Ссылка", "snippet": "Кратко"}
HIGHLIGHT = "</?highlighttext>"
PRACTICE, LAB, LECTURE = "[Пр]", "[Лаб]", "[Лек]"


def short_snippet(text: Column, length: int = 180) -> Column:
    """Snippet without highlight marks, cut with an ellipsis."""
    clean = S.trimmed(F.regexp_replace(text, HIGHLIGHT, ""))
    return F.when(F.length(clean) > length, F.concat(F.substring(clean, 1, length), F.lit("…"))).otherwise(clean)


def explode_listings(payloads: DataFrame, key: str = "payload_id", body: str = "body") -> DataFrame:
    """One flat row per listing item; missing nested parts become NULL."""
    items = F.from_json(body, LISTING_SCHEMA)["items"]
    rows = payloads.select(key, F.posexplode(items).alias("item_no", "i"))
    return rows.select(
        key, "item_no", S.trimmed(F.col("i.name")).alias("name"), F.col("i.employer.name").alias("employer"),
        F.col("i.salary.from").alias("salary_from"), F.col("i.salary.to").alias("salary_to"),
        F.upper(F.coalesce("i.salary.currency", F.lit(ROUBLE))).alias("currency"),
        short_snippet(F.coalesce(F.nullif("i.snippet.requirement", F.lit("")), "i.snippet.responsibility")).alias("snippet"),
        F.col("i.alternate_url").alias("url"),
    )


def salary_text(low: Column, high: Column, currency: Column) -> Column:
    def spaced(value: Column) -> Column:
        return F.replace(F.format_number(value, 0), F.lit(","), F.lit(" "))

    sign = F.when(currency == ROUBLE, ROUBLE_SIGN).otherwise(currency)
    both = low.isNotNull() & high.isNotNull()
    return (
        F.when(both, F.concat(spaced(low), F.lit(" – "), spaced(high), F.lit(" "), sign))
        .when(low.isNotNull(), F.concat(F.lit(FROM_WORD), spaced(low), F.lit(" "), sign))
        .when(high.isNotNull(), F.concat(F.lit(TO_WORD), spaced(high), F.lit(" "), sign))
        .otherwise(F.lit(NO_SALARY))
    )


def rank_listings(
    listings: DataFrame, count: int = 10, excluded: Sequence[str] = EXCLUDED_WORDS, tie: Sequence[str] = ("payload_id", "item_no")
) -> DataFrame:
    """Best paid listings without excluded title words; a top-n, so no full sort."""
    title = F.lower("name")
    banned = F.lit(False)
    for word in excluded:
        banned = banned | title.contains(word)
    best = F.coalesce(F.greatest("salary_from", "salary_to"), F.lit(0))
    top = listings.where(~F.coalesce(banned, F.lit(False))).withColumn("best_salary", best)
    best_paid = top.orderBy(F.desc("best_salary"), *tie).limit(count).withColumn(
        "salary_text", salary_text(F.col("salary_from"), F.col("salary_to"), F.col("currency")))
    order = Window.orderBy(F.desc("best_salary"), *tie)  # ``count`` rows
    return best_paid.withColumn("place", F.row_number().over(order)).withColumn("display", display_text())


def display_text() -> Column:
    """Text block of a listing; the snippet line only when there is one."""
    def line(column: str) -> Column:
        return F.concat(F.lit(f"   {LABELS[column]}: "), F.coalesce(column, F.lit("")))

    head = F.concat(F.col("place").cast("string"), F.lit(". "), F.coalesce("name", F.lit("")))
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", line("snippet"))
    return F.concat_ws("\n", head, line("employer"), line("salary_text"), line("url"), snippet)


def schedule_with_gaps(lessons: DataFrame, slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lessons in slot order with ``окно`` rows for unused slots in between; a lesson without a name is no gap."""
    keys = list(keys)
    named = lessons.join(slots, "code", "left").select(
        *keys, "code", F.coalesce("time_from", F.lit("")).alias("time_from"), F.coalesce("time_to", F.lit("")).alias("time_to"),
        F.coalesce("subject", F.lit(UNNAMED)).alias("subject"), "teacher",
    )
    unique = named.groupBy(*keys, "time_from", "time_to", "subject", "teacher").agg(F.min("code").alias("code"))
    span = unique.groupBy(*keys).agg(F.min("code").alias("_low"), F.max("code").alias("_high"))
    inside = span.select(*keys, F.explode(F.sequence("_low", "_high")).alias("code")).join(slots, "code")
    taken = unique.select(*keys, "code", "subject", "teacher", F.lit(True).alias("_taken"))
    return inside.join(taken, [*keys, "code"], "left").select(
        *keys, "code", "time_from", "time_to", F.when(F.col("_taken"), F.col("subject")).otherwise(F.lit(GAP)).alias("subject"), "teacher",
        F.col("_taken").isNull().alias("is_gap"),
    )


def base_subject(name: Column) -> Column:
    marks = "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in (PRACTICE, LAB, LECTURE))
    return S.trimmed(F.regexp_replace(name, f"(?s) ({marks}).*$", ""))


def parity_variant(lessons: DataFrame, parity: Column, keys: Sequence[str]) -> DataFrame:
    """Where a subject has practice and lab rows, keep the one of the week's parity."""
    keys = list(keys)
    marked = lessons.withColumn("_base", base_subject(F.col("subject"))).withColumn("_parity", parity)
    flags = marked.groupBy(*keys, "_base").agg(
        F.max(F.col("subject").contains(PRACTICE)).alias("_p"), F.max(F.col("subject").contains(LAB)).alias("_l"))
    wanted = F.when(F.col("_parity") == 1, F.col("subject").contains(LAB)).otherwise(F.col("subject").contains(PRACTICE))
    return marked.join(flags, [*keys, "_base"]).where(~(F.col("_p") & F.col("_l")) | wanted).select(*lessons.columns)


def largest_box(boxes: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Largest box per image; the first one wins ties."""
    area = F.col("width") * F.col("height")
    best = F.max_by(F.struct("x", "y", "width", "height"), F.struct(area, -F.col("pos")))
    return boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("boxes"), best.alias("_b")).select(*keys, "boxes", "_b.*")


def best_orientation(detections: DataFrame) -> DataFrame:
    """Per image the angle with the relatively largest box; all angles' time adds up.

    ``detections`` holds one row per image, angle and box; ``time_ms`` is the
    detection time of that angle.
    """
    relative = F.col("width") * F.col("height") / (F.col("image_width") * F.col("image_height"))
    per_angle = detections.groupBy("image", "angle").agg(
        F.max(relative).alias("relative_area"), F.count("width").alias("faces"), F.max("time_ms").alias("time_ms"))
    order = F.struct(F.round("relative_area", 12), -F.col("angle"))
    return per_angle.groupBy("image").agg(
        F.max_by(F.struct("angle", "relative_area", "faces"), F.when(F.col("faces") > 0, order)).alias("_b"),
        F.sum("time_ms").alias("total_time_ms"),
    ).select("image", "_b.*", "total_time_ms")


def batch_run_summary(items: DataFrame) -> DataFrame:
    """Counts by status and the detection time of the successful items."""
    status = F.col("status")
    return items.agg(
        F.count_if(status != "ignored").alias("total_supported"), F.count_if(status == "success").alias("successful"),
        F.count_if(status == "failed").alias("failed"), F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "ignored").alias("ignored"),
        F.coalesce(F.sum(F.when(status == "success", F.col("detection_time_ms"))), F.lit(0.0)).alias("total_detection_time_ms"),
    )
