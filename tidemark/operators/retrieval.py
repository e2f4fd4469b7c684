"""TF-IDF index and search, extractive answers, vector search, recursive splitting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.session import materialized
from tidemark.operators.balls import Balls
from tidemark.operators.tiles import dense_scores, ranked, sparse_scores, tile_top_k

# Wording of the extractive answer.
ANSWER_HEAD = "Ниже приведены наиболее релевантные фрагменты материала:\n\n"
ANSWER_SOURCES = "\n\nИсточники:\n"

CHUNK = ("material_id", "chunk_no")


FREQUENT = 1 << 16  # at most so many terms of one corpus hold a 65536th of its entries each


def term_counts(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return chunks.select(*keys, F.explode(S.tokens("text")).alias("term")).groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("tf"))


def counted_terms(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, entries``: each chunk's terms with their counts, inside its row."""
    ordered = chunks.select(*keys, F.sort_array(S.tokens("text")).alias("_t")).withColumn("_n", F.size("_t"))
    first = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    starts = ordered.withColumn("_s", F.when(F.col("_n") > 0, first).otherwise(F.array().cast("array<int>")))
    return starts.select(*keys, F.transform("_s", lambda i, k: F.struct(
        F.get("_t", i).alias("term"), (F.coalesce(F.get("_s", k + 1), F.col("_n")) - i).cast("bigint").alias("tf"),
    )).alias("entries"))


def _corpus_terms(chunks: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All chunk keys, and ``keys, term, tf``; chunks with one and the same key are counted together."""
    counted = materialized(counted_terms(chunks, keys), "counted")
    entries = counted.select(*keys, F.inline("entries"))
    if counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).take(1):
        entries = materialized(entries.groupBy(*keys, "term").agg(F.sum("tf").alias("tf")), "merged")
    return counted.select(*keys), entries


def _idf(size: Column | str, frequency: Column | str) -> Column:
    return F.log((1.0 + F.col(size)) / (1.0 + F.col(frequency))) + 1.0


def corpus_frequencies(entries: DataFrame, chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``term, idf, frequent`` of one corpus, and ``asked`` if a table of asked terms is given."""
    counts = entries.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    if asked is not None:
        flags = asked.select("term").distinct().withColumn("asked", F.lit(True))
        counts = counts.join(flags, "term", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    counts = materialized(counts, "frequencies")
    size, total = chunks.agg(F.count(F.lit(1))).scalar(), counts.agg(F.sum("_df")).scalar()
    marked = counts.withColumn("_n", size).withColumn("_total", total)
    extra = [] if asked is None else ["asked"]
    return marked.select("term", _idf("_n", "_df").alias("idf"), (F.col("_df") * FREQUENT >= F.col("_total")).alias("frequent"), *extra)


def _weighed(entries: DataFrame, idf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with ``idf``, frequent terms and rare ones apart.

    The frequent ones are ``FREQUENT`` at most and go to the entries; the rare ones meet
    theirs by term, and none of them holds more than a 65536th of the entries.
    """
    found = idf.where("frequent").drop("frequent")
    marked = entries.join(F.broadcast(found.withColumn("_found", F.lit(True))), "term", "left")
    frequent, others = marked.where("_found").drop("_found"), marked.where(F.col("_found").isNull()).select(*entries.columns)
    return frequent, others.join(idf.where(~F.col("frequent")).drop("frequent"), "term")


def _unit(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys)))
    return weights.withColumn("weight", F.col("_w") / norm)


def _material_weights(chunks: DataFrame, collection: Sequence[str], keys: Sequence[str], asked: DataFrame | None = None) -> DataFrame:
    """``keys, term, idf, weight``: chunks go once to the place of their material, as texts.

    Counts, document frequencies and norms are then taken there.  With ``asked``
    (``collection, term``) only the asked terms are returned.
    """
    # Words take ten times the memory of their texts, so partitions of texts are not to be merged.
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = chunks.select(*keys, "text").dropna(subset=collection).repartition(parts, *collection)
    wanted = F.lit(True)
    if asked is not None:
        terms = asked.groupBy(*collection).agg(F.collect_set("term").alias("_asked"))
        texts, wanted = texts.join(terms.hint("shuffle_hash"), collection), F.array_contains("_asked", F.col("term"))
    placed = texts.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*collection)))
    words = placed.withColumn("term", F.explode(S.tokens("text"))).select(*keys, "term", "_n", wanted.alias("_wanted"))
    counts = words.groupBy(*keys, "term", "_n", "_wanted").agg(F.count(F.lit(1)).alias("tf"))
    spread = counts.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy(*collection, "term")))
    weighed = spread.withColumn("idf", _idf("_n", "_df")).withColumn("_w", F.col("tf") * F.col("idf"))
    return _unit(weighed, keys).where("_wanted").select(*keys, "term", "idf", "weight")


def tfidf_index(
    chunks: DataFrame, collection: Sequence[str] = ("material_id",), keys: Sequence[str] = CHUNK,
) -> DataFrame:
    """``keys, term, weight`` with unit length per chunk.

    Weights are those of each ``collection`` (a material, a part of ``keys``), or of the whole
    corpus if it is empty.  A chunk's own terms are few, so its norm is a window.
    """
    keys, collection = list(keys), list(collection)
    if collection:
        return _material_weights(chunks, collection, keys).select(*keys, "term", "weight")
    everything, entries = _corpus_terms(chunks, keys)
    frequent, rare = _weighed(entries, materialized(corpus_frequencies(entries, everything), "idf"))
    weights = frequent.unionByName(rare).withColumn("_w", F.col("tf") * F.col("idf"))
    return _unit(weights, keys).select(*keys, "term", "weight")


def _vectors(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long weights to one row per key; a chunk or question holds few terms."""
    packed = weights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("_e"))
    return packed.select(*keys, F.col("_e.term").alias("terms"), F.col("_e.weight").alias("weights"))


def tfidf_search(
    chunks: DataFrame, questions: DataFrame, top_k: int = 4, keys: Sequence[str] = CHUNK,
    queries_per_bucket: int = 256, items_per_block: int = 20_000,
) -> DataFrame:
    """Best chunks of the corpus for each ``(question_id, text)``.

    Chunks that share no word score 0 and may fill the list; ties follow the
    chunk order.  Of a chunk's terms only those that are asked travel; the others
    are in its norm.
    """
    keys = list(keys)
    everything, entries = _corpus_terms(chunks, keys)
    counts = materialized(term_counts(questions, ["question_id"]), "asked")
    idf = materialized(corpus_frequencies(entries, everything, counts), "idf")
    raw = counts.join(idf.where("asked"), "term").withColumn("_w", F.col("tf") * F.col("idf"))
    asked = _vectors(_unit(raw, ["question_id"]), ["question_id"])
    empty_terms, empty_weights = F.array().cast("array<string>"), F.array().cast("array<double>")

    def complete(vectors: DataFrame, everything: DataFrame, key: Sequence[str]) -> DataFrame:
        return everything.select(*key).join(vectors, list(key), "left").select(
            *key, F.coalesce("terms", empty_terms).alias("terms"), F.coalesce("weights", empty_weights).alias("weights"))

    frequent, rare = _weighed(entries, idf)
    weights = frequent.unionByName(rare).withColumn("_w", F.col("tf") * F.col("idf"))
    packed = weights.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"),
        F.sort_array(F.collect_list(F.when(F.col("asked"), F.struct("term", "_w")))).alias("_e"),
    )
    index = packed.select(*keys, F.col("_e.term").alias("terms"), F.transform("_e", lambda e: e["_w"] / F.col("_norm")).alias("weights"))
    winners = tile_top_k(
        complete(asked, questions, ["question_id"]), complete(index, everything, keys), sparse_scores, max(1, top_k),
        "question_id", keys, queries_per_bucket=queries_per_bucket, items_per_block=items_per_block,
        sizes=(questions.count(), everything.count()),
    )
    return ranked(winners, max(1, top_k), "question_id", keys)


def material_search(
    chunks: DataFrame, questions: DataFrame, top_k: int = 4, material: str = "material_id", order: str = "chunk_no",
    index: DataFrame | None = None, idf: DataFrame | None = None,
) -> DataFrame:
    """Best chunks of one material for each ``(question_id, material_id, text)``.

    Every material has its own vocabulary and weights.  The terms asked of a material
    go to its chunks as one array, so that only the postings of asked terms leave them;
    question terms meet those by ``(material, term)`` and the products are added up.
    A stored ``index`` and its ``idf`` per material and term may be given.
    Chunks without a common word score 0 and may fill a short list; only the first
    ``top_k`` chunks of a material can get that far.  Ties follow the chunk order.
    """
    keys, k = [material, order], max(1, top_k)
    counts = materialized(term_counts(questions, ["question_id", material]), "asked")
    if index is None or idf is None:
        index = materialized(_material_weights(chunks, [material], keys, counts), "postings")
        idf = index.groupBy(material, "term").agg(F.first("idf").alias("idf"))
    raw = counts.join(idf, [material, "term"]).withColumn("_w", F.col("tf") * F.col("idf"))
    weighted = _unit(raw, ["question_id", material]).select("question_id", material, "term", F.col("weight").alias("_q"))
    hits = weighted.join(index.select(*keys, "term", "weight"), [material, "term"]).groupBy("question_id", *keys).agg(F.sum(F.col("_q") * F.col("weight")).alias("score"))
    first = chunks.select(*keys).withColumn("_n", F.row_number().over(Window.partitionBy(material).orderBy(order))).where(F.col("_n") <= k)
    fill = questions.select("question_id", material).distinct().join(first.drop("_n"), material).select(
        "question_id", *keys, F.lit(0.0).alias("score"))
    found = hits.select("question_id", *keys, "score").unionByName(fill).groupBy("question_id", *keys).agg(F.round(F.max("score"), 9).alias("score"))
    place = Window.partitionBy("question_id", material).orderBy(F.desc("score"), order)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def extractive_answer(hits: DataFrame, chunks: DataFrame, keys: Sequence[str] = CHUNK, excerpt: int = 500) -> DataFrame:
    """Answer text, source list and context block per question (at most k sources each)."""
    joined = hits.join(chunks, list(keys))
    bounds = F.concat(F.col("source_start"), F.lit(" -> "), F.col("source_end"))
    entry = F.struct(
        "rank",
        F.concat(F.lit("- "), F.substring(S.single_spaced("text"), 1, excerpt), F.lit(" ("), bounds, F.lit(")")).alias("line"),
        F.concat(F.lit("* "), bounds).alias("source"),
        F.concat("chunk_id", F.lit(" ("), bounds, F.lit("):\n"), "text").alias("block"),
    )
    grouped = joined.groupBy("question_id").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return grouped.select(
        "question_id",
        F.concat(F.lit(ANSWER_HEAD), F.array_join("_e.line", "\n"), F.lit(ANSWER_SOURCES), F.array_join("_e.source", "\n"))
        .alias("answer"),
        F.array_join("_e.block", "\n\n").alias("context"),
    )


def embedding_knn(
    queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "l2", exclude_self: bool = False,
    centres: int | None = None,
) -> DataFrame:
    """``k`` nearest ``(vec_id, vector)`` rows per ``(query_id, vector)`` row.

    With ``centres`` (Euclidean distance only) the vectors lie in that many balls and
    only those that can hold one of the ``k`` are scored: for clustered vectors.
    Without, all pairs are scored, which is faster where the balls overlap.
    """
    asked = queries.withColumn("extra", F.lit(1 if exclude_self else 0).cast("bigint"))
    if centres is not None:
        if metric != "l2":
            raise ValueError("balls bound Euclidean distances only")
        winners = Balls(vectors, "vec_id", centres).search(asked, k, "query_id")
    else:
        winners = tile_top_k(asked, vectors, dense_scores(metric), k, "query_id", ["vec_id"])
    if exclude_self:
        winners = winners.where(F.col("query_id") != F.col("vec_id"))
    distance = -F.col("score") if metric == "l2" else 1 - F.col("score")
    return ranked(winners, k, "query_id", ["vec_id"]).select("query_id", "vec_id", "rank", distance.alias("distance"))


SEPARATORS = ("\n\n", "\n", " ", "")  # fixed values: paragraph, line, word, character


def _pieces(text: str, separator: str) -> list[str]:
    """Split so that every piece but the first keeps its leading separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *[separator + r for r in rest]] if p]


def _merge(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces up to ``size``, carrying back at most ``overlap`` characters."""
    window: list[str] = []
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window).strip()
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    yield "".join(window).strip()


def split_text(text: str, size: int = 500, overlap: int = 50, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of one text: coarse separators first, finer ones for what is too long."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    finer = separators[at + 1 :]
    chunks: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        chunks += _merge(small, size, overlap)
        small = []
        chunks += split_text(piece, size, overlap, finer) if finer else [piece]
    chunks += _merge(small, size, overlap)
    return [c for c in chunks if c]


STEP_BYTES = 1 << 20  # bytes of text that a task splits before it hands the pieces on


def _steps(sizes: Sequence[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs ``(first row, rows)`` of at most ``most`` bytes, or of one row that is larger."""
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > most:
            yield first, row - first
            first, held = row, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes) - first


def split_batches(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """``(key, piece_no, piece)`` of ``(key, text)`` rows; a batch goes through in steps of bounded bytes."""
    for batch in batches:
        for first, rows in _steps(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
            part = batch.slice(first, rows)
            owners, numbers, pieces = [], [], []
            for row, text in enumerate(part.column(1)):
                found = split_text(text.as_py(), size, overlap) if text.is_valid else []
                owners += [row] * len(found)
                numbers += range(1, len(found) + 1)
                pieces += found
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owners, pa.int32())), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())],
                names=[batch.schema.names[0], "piece_no", "piece"])


def recursive_split(documents: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """``(doc_id, piece_no, piece)``; Arrow batches, one document at a time, pieces handed on megabyte by megabyte."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: split_batches(batches, size, overlap), f"doc_id {kind}, piece_no int, piece string")
