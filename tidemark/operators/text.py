"""Segments, topics, key terms, prompt budget and statistics, document by document.

A document is one row and its segments one array, so none of this shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

# Words that are never key terms.
TERM_STOP_WORDS = (
    "about", "after", "before", "lecture", "material", "notes", "this", "with",
    "и", "или", "как", "для", "что", "это", "они", "при", "над", "под", "без", "материал", "лекция", "тема",
)
# Fixed value: a term has five or more Latin or Cyrillic letters, hyphens allowed after the first.
TERM_PATTERN = "[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё-]{4,}"
# Texts of the default topic and term.
TOPIC_TITLE = "Тема "
DEFAULT_TOPIC = "Материал"
DEFAULT_TERM = "Материал"
DEFAULT_DEFINITION = "Общее понятие из загруженного текста."
TERM_DEFINITION = ("Термин встречается в материале; уточните значение по источнику ", ".")
EMPTY_MESSAGE = "No extractable text found"


def segments_of(documents: DataFrame, *keep: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(material_id, segments)``: non-blank lines with position and source."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        i.cast("bigint").alias("pos"), S.trimmed(line).alias("text"),
        F.concat(F.lit("paragraph "), (i + 1).cast("string")).alias("source"),
    ))
    return documents.select(
        F.col(key).alias("material_id"), F.filter(lines, lambda s: F.length(s["text"]) > 0).alias("segments"), *keep
    )


def chunk_segments(materials: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Greedy packing into chunks of at most ``size`` characters.

    Short segments join with a blank line while they fit; a longer segment is
    cut into overlapping windows.  The fold only records where chunks start.
    """
    step = max(1, size - overlap)
    lengths = F.transform("segments", lambda s, i: F.struct(i.alias("i"), F.length(s["text"]).alias("n")))
    start = F.struct(F.lit(-1).alias("size"), F.array().cast("array<int>").alias("starts"))

    def pack(state: Column, segment: Column) -> Column:
        long = segment["n"] > size
        opens = long | (state["size"] < 0) | (state["size"] + 2 + segment["n"] > size)
        filled = F.when(long, F.lit(-1)).when(opens, segment["n"]).otherwise(state["size"] + 2 + segment["n"])
        starts = F.when(opens, F.array_append(state["starts"], segment["i"])).otherwise(state["starts"])
        return F.struct(filled.alias("size"), starts.alias("starts"))

    packed = materials.withColumn("_starts", F.aggregate(lengths, start, pack)["starts"])

    def group(first: Column, order: Column) -> Column:
        """Chunks of the segments from one start up to the next."""
        following = F.coalesce(F.get("_starts", order + 1), F.size("segments"))
        members = F.slice("segments", first + 1, following - first)
        text = F.get("segments", first)["text"]
        last_window = F.greatest(F.ceil((F.length(text) - size) / step).cast("int"), F.lit(0))
        windows = F.transform(
            F.sequence(F.lit(0), last_window), lambda w: S.trimmed(F.substring(text, w * step + 1, F.lit(size)))
        )
        joined = F.array(F.array_join(F.transform(members, lambda m: m["text"]), "\n\n"))
        return F.transform(F.when(F.length(text) > size, windows).otherwise(joined), lambda t: F.struct(
            t.alias("text"), F.get("segments", first)["source"].alias("source_start"),
            F.get("segments", following - 1)["source"].alias("source_end"),
        ))

    # Numbers count kept texts only.
    chunks = F.filter(F.flatten(F.transform("_starts", group)), lambda c: F.length(c["text"]) > 0)
    rows = packed.select("material_id", F.posexplode(chunks).alias("_i", "_c"))
    number = (F.col("_i") + 1).cast("bigint")
    return rows.select(
        "material_id", number.alias("chunk_no"), F.format_string("chunk_%04d", number).alias("chunk_id"),
        "_c.text", "_c.source_start", "_c.source_end",
    )


def topics_fallback(materials: DataFrame, count: int = 3) -> DataFrame:
    """The first segments as topics; a document without any gets the default topic."""
    default = F.array(F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit(DEFAULT_TOPIC).alias("text"), F.lit("text").alias("source")))
    chosen = F.when(F.size("segments") > 0, F.slice("segments", 1, count)).otherwise(default)
    rows = materials.select("material_id", F.posexplode(chosen).alias("_i", "_s"))
    return rows.select(
        "material_id", (F.col("_i") + 1).alias("topic_no"),
        F.concat(F.lit(TOPIC_TITLE), (F.col("_i") + 1).cast("string")).alias("title"),
        S.compact_text(F.col("_s.text")).alias("summary"),
        F.col("_s.source").alias("source_start"), F.col("_s.source").alias("source_end"),
    )


def key_terms(materials: DataFrame, count: int = 5) -> DataFrame:
    """First distinct long words outside the stop list, in reading order and casing."""
    words = F.flatten(F.transform("segments", lambda s: F.transform(
        F.regexp_extract_all(s["text"], F.lit(TERM_PATTERN), F.lit(0)),
        lambda w: F.struct(w.alias("term"), s["source"].alias("source")),
    )))
    found = materials.select("material_id", words.alias("_words")).withColumn(
        "_keys", F.slice(F.array_except(
            F.transform("_words", lambda w: F.lower(w["term"])), F.array(*[F.lit(w) for w in TERM_STOP_WORDS])
        ), 1, count)
    )
    firsts = F.transform("_keys", lambda k: F.element_at(F.filter("_words", lambda w: F.lower(w["term"]) == k), 1))
    default = F.array(F.struct(F.lit(DEFAULT_TERM).alias("term"), F.lit("text").alias("source")))
    rows = found.select("material_id", F.size("_keys").alias("_n"), F.posexplode(
        F.when(F.size("_keys") > 0, firsts).otherwise(default)).alias("_i", "_t"))
    definition = F.concat(F.lit(TERM_DEFINITION[0]), F.col("_t.source"), F.lit(TERM_DEFINITION[1]))
    return rows.select(
        "material_id", (F.col("_i") + 1).alias("term_no"), F.col("_t.term").alias("term"),
        F.when(F.col("_n") > 0, definition).otherwise(F.lit(DEFAULT_DEFINITION)).alias("definition"),
        F.col("_t.source").alias("source"),
    )


def prompt_budget(materials: DataFrame, max_chars: int = 8000, per_segment: int = 500) -> DataFrame:
    """Leading ``- source: text`` lines whose summed length stays within the budget."""
    lines = F.transform("segments", lambda s: F.concat(
        F.lit("- "), s["source"], F.lit(": "), F.substring(F.regexp_replace(s["text"], "\n", " "), 1, per_segment)))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def take(state: Column, line: Column) -> Column:
        over = state["full"] | (state["used"] + F.length(line) > max_chars)
        return F.struct(
            F.when(over, state["used"]).otherwise(state["used"] + F.length(line)).alias("used"),
            F.when(over, state["kept"]).otherwise(state["kept"] + 1).alias("kept"), over.alias("full"),
        )

    counted = materials.select("material_id", lines.alias("_lines")).withColumn("_state", F.aggregate("_lines", start, take))
    return counted.select(
        "material_id", F.col("_state.kept").alias("segments_kept"), F.col("_state.used").alias("used_chars"),
        F.array_join(F.slice("_lines", F.lit(1), F.col("_state.kept")), "\n").alias("prompt"),
    )


def material_stats(materials: DataFrame, *keep: str) -> DataFrame:
    """Counts of the stored text and the processing status."""
    count = F.size("segments")
    chars = F.aggregate("segments", F.lit(0), lambda acc, s: acc + F.length(s["text"])) + F.greatest(2 * (count - 1), F.lit(0))
    failed = chars == 0
    return materials.select(
        "material_id", F.when(failed, "failed").otherwise("processed").alias("status"),
        count.alias("segments_count"), chars.alias("characters_count"),
        F.when(failed, F.lit(EMPTY_MESSAGE)).alias("error_message"), *keep,
    )


def json_array_records(replies: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Topic records inside model replies; rows without title or summary are dropped."""
    schema = "struct<title:string,summary:string,source_start:string,source_end:string>"
    rows = replies.select(key, F.inline(S.json_array_rows(text, schema)))
    clean = {c: S.trimmed(F.coalesce(c, F.lit(""))) for c in ("title", "summary", "source_start", "source_end")}
    filled = rows.withColumns(clean).withColumns({
        c: F.when(F.col(c) == "", F.lit("text")).otherwise(F.col(c)) for c in ("source_start", "source_end")})
    return filled.where((F.col("title") != "") & (F.col("summary") != ""))
