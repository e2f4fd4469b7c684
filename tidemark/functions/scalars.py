"""Scalar column functions; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point the text functions treat as white space.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# File suffixes by kind of material.
DOCUMENT_SUFFIXES = (".pdf", ".docx", ".txt", ".md")
AUDIO_SUFFIXES = (".mp3", ".wav")
VIDEO_SUFFIXES = (".mp4", ".mov")

# Hosts whose links carry a video id.
WATCH_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com")
SHORT_HOST = "youtu.be"

# Fixed value: notice appended to a text that was cut.
CUT_NOTICE = "\n\n[Примечание: текст был усечён для текущей MVP-версии обработки.]"

UNKNOWN_DAY = 365243  # fixed value: the date sentinel of the credit tables


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient with NULL for a zero denominator or an infinite result."""
    quotient = F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))
    return F.when(F.abs(quotient) != float("inf"), quotient)


def at_least(value: Column | str, low: float) -> Column:
    """``greatest`` that keeps NULL."""
    value = _col(value)
    return F.when(value < low, F.lit(low)).otherwise(value)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false *or unknown*."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def past_share(condition: Column) -> Column:
    """Share of rows satisfying a condition; unknown counts as not satisfied."""
    return F.avg(flag(condition).cast("double"))


def sum_or_zero(value: Column | str) -> Column:
    return F.coalesce(F.sum(_col(value)), F.lit(0.0))


def known_day(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(UNKNOWN_DAY))


def recency_weight(days: Column | str, decay_days: float = 30.0) -> Column:
    if decay_days <= 0:
        raise ValueError("decay_days must be positive")
    return F.exp(-at_least(_col(days).cast("double"), 0.0) / F.lit(float(decay_days)))


def frequency_weight(count: Column | str) -> Column:
    return 1.0 + F.log1p(_col(count).cast("double"))


def status_code(status: Column | str) -> Column:
    """Month status: digits 0–5 as is, closed ``C`` is 0, unknown ``X`` is NULL."""
    status = _col(status)
    return F.when(status.rlike("^[0-5]$"), status.try_cast("int")).when(status == "C", F.lit(0))


def normalize_article_id(value: Column | str, width: int = 10) -> Column:
    """Trim, drop a trailing ``.0``, pad with zeros; never shortens an id."""
    text = F.regexp_replace(trimmed(_col(value).cast("string")), r"\.0$", "")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def right_trimmed(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"{SPACE}+$", "")


def single_spaced(text: Column | str) -> Column:
    return F.regexp_replace(trimmed(text), f"{SPACE}+", " ")


def format_seconds(seconds: Column | str) -> Column:
    """``HH:MM:SS``; hours keep growing past 24, negatives count as zero."""
    total = F.greatest(_col(seconds).cast("bigint"), F.lit(0).cast("bigint"))
    hours, rest = F.floor(total / 3600), F.pmod(total, F.lit(3600))
    return F.format_string("%02d:%02d:%02d", hours, F.floor(rest / 60), F.pmod(total, F.lit(60)))


def suffix(name: Column | str) -> Column:
    """Lower-cased last suffix of a file name, empty when there is none."""
    return F.lower(F.regexp_extract(_col(name), r"^(?:.*/)?[^/]+(\.[^./]+)$", 1))


def source_type(name: Column | str) -> Column:
    ext = suffix(name)
    return (
        F.when(ext.isin(*DOCUMENT_SUFFIXES), "document")
        .when(ext.isin(*AUDIO_SUFFIXES), "audio")
        .when(ext.isin(*VIDEO_SUFFIXES), "video")
        .otherwise("invalid")
    )


def video_id(url: Column | str) -> Column:
    """Id behind a watch, shorts or short-host link; NULL for anything else."""
    clean = trimmed(url)
    host = F.lower(F.try_parse_url(clean, F.lit("HOST")))
    path = F.try_parse_url(clean, F.lit("PATH"))
    found = (
        F.when(host.isin(*WATCH_HOSTS) & (path == "/watch"), F.try_parse_url(clean, F.lit("QUERY"), F.lit("v")))
        .when(host.isin(*WATCH_HOSTS) & path.startswith("/shorts/"), F.split_part(path, F.lit("/"), F.lit(3)))
        .when(host == SHORT_HOST, F.split_part(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit(1)))
    )
    return F.nullif(found, F.lit(""))


def compact_text(text: Column | str, max_length: int = 220) -> Column:
    compact = single_spaced(text)
    short = F.concat(right_trimmed(F.substring(compact, 1, max_length - 1)), F.lit("..."))
    return F.when(F.length(compact) <= max_length, compact).otherwise(short)


def truncate_for_model(text: Column | str, max_chars: int = 25000, notice: str = CUT_NOTICE) -> Column:
    text = _col(text)
    short = F.concat(right_trimmed(F.substring(text, 1, max_chars)), F.lit(notice))
    return F.when(F.length(text) <= max_chars, text).otherwise(short)


def week_parity(day: Column | str, offset: int = 0) -> Column:
    """1 or 2: parity of the week counted from 1 September of the study year."""
    day = _col(day).cast("date")
    this_year = F.make_date(F.year(day), F.lit(9), F.lit(1))
    start = F.when(day < this_year, F.add_months(this_year, -12)).otherwise(this_year)
    weeks = F.floor(F.datediff(day, start) / 7) + offset
    return F.when(F.pmod(weeks, F.lit(2)) == 0, 1).otherwise(2)


def parse_count(text: Column | str, default: int = 10, maximum: int = 20) -> Column:
    """Whole text as an integer, else its first digits, clamped to 1..maximum."""
    clean = trimmed(text)
    digits = F.when(clean.rlike(r"^[+-]?\d+$"), clean).otherwise(F.regexp_extract(clean, r"\d+", 0))
    # More digits than a decimal holds can only mean "over the maximum" (or, with a minus, below 1).
    beyond = F.when(digits.startswith("-"), F.lit(1)).otherwise(F.lit(maximum))
    number = F.coalesce(digits.try_cast("decimal(38,0)"), beyond.cast("decimal(38,0)"))
    clamped = F.least(F.greatest(number, F.lit(1)), F.lit(maximum)).cast("int")
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit(default)).otherwise(clamped)


def expand_box(
    x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column,
    left: float = 0.30, right: float = 0.30, top: float = 0.40, bottom: float = 0.50,
) -> Column:
    """Box grown by relative padding and clamped; NULL if it misses the image."""
    for padding in (left, right, top, bottom):
        if not padding >= 0 or padding == float("inf"):
            raise ValueError("padding must be finite and non-negative")

    def pixels(share: float, size: Column) -> Column:
        return F.floor(F.lit(float(share)) * size + 0.5)

    x1 = F.greatest(x - pixels(left, width), F.lit(0))
    y1 = F.greatest(y - pixels(top, height), F.lit(0))
    x2 = F.least(x + width + pixels(right, width), image_width)
    y2 = F.least(y + height + pixels(bottom, height), image_height)
    meets = (
        (width > 0) & (height > 0) & (x < image_width) & (y < image_height) & (x + width > 0) & (y + height > 0)
    )
    box = F.struct(
        x1.cast("int").alias("x"), y1.cast("int").alias("y"),
        (x2 - x1).cast("int").alias("width"), (y2 - y1).cast("int").alias("height"),
    )
    return F.when(meets, box)


def json_array_rows(text: Column | str, element_schema: str) -> Column:
    """Array of structs from a reply: the whole text, else first ``[`` to last ``]``."""
    text = _col(text)
    schema = f"array<{element_schema}>"
    whole = F.when(trimmed(text).startswith("["), F.from_json(text, schema))
    inner = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), schema)
    return F.coalesce(whole, inner)


def tokens(text: Column | str) -> Column:
    """Lower-cased words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
