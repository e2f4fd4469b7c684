"""Toxicity: a character n-gram classifier scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import symbols as S
from tidemark.llm import tables
from tidemark.llm.language_id import held_out

LENGTHS = (3, 4, 5, 6)
BITS = 20
BLOCK = 1 << 19
SLICES = 64
FEATURES = 4096
LEAST_Z = 4
SAMPLE = 12_000
THRESHOLD = 0.3


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every different n-gram of every text, block by block.

    Texts are lower-cased; n-grams are of characters, spaces included, hashed to
    ``2**BITS`` buckets.  ``wanted`` keeps only the buckets with a number >= 0 and
    gives these numbers.
    """
    sizes = np.array([len(t) if t else 0 for t in texts])
    for x, y in S.blocks(sizes, BLOCK):
        # Two spaces between texts, so that words at their ends look like others.
        lowered = [f" {(t or '').lower()} " for t in texts[x:y]]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) for t in lowered])
        row = np.repeat(np.arange(x, y), [len(t) for t in lowered])
        sums = S.prefix_sums(S.mix(codes.astype(np.uint64)))
        rows, buckets = [], []
        for n in LENGTHS:
            if len(codes) < n:
                continue
            bucket = (S.gram_hash(sums, n) >> np.uint64(64 - BITS)).astype(np.int64)
            inside = np.arange(len(bucket)) + n <= ends[row[: len(bucket)] - x]
            if wanted is not None:
                bucket = wanted[bucket]
                inside &= bucket >= 0
            rows.append(row[: len(bucket)][inside])
            buckets.append(bucket[inside])
        if rows:
            pair = np.unique((np.concatenate(rows) << BITS) | np.concatenate(buckets))
            yield pair >> BITS, pair & ((1 << BITS) - 1)


def count_features(labelled: DataFrame) -> np.ndarray:
    """Documents of each class with each bucket; tasks send sums of a fixed size."""
    width = (1 << BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for row, bucket in features(batch.column("text").to_pylist()):
                for k in (0, 1):
                    total[k] += np.bincount(bucket[label[row] == k], minlength=1 << BITS)
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(range(SLICES), pa.int32()),
            "total": [total[:, i * width : (i + 1) * width].tobytes() for i in range(SLICES)]})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("total").to_pylist())
        return pa.table({"slice": group.column("slice").slice(0, 1).combine_chunks(), "total": pa.array([total.tobytes()], pa.binary())})

    sent = labelled.mapInArrow(count, "slice int, total binary")
    out = np.zeros((2, 1 << BITS), np.int64)
    for r in sent.groupBy("slice").applyInArrow(add, "slice int, total binary").collect():
        out[:, r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["total"], np.int64).reshape(2, width)
    return out


class Model:
    """Number of each bucket (-1: none), weight of each number, and the intercept."""

    def __init__(self, number: np.ndarray, weight: np.ndarray, intercept: float):
        self.number, self.weight, self.intercept = number, weight, intercept

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.intercept)
        for row, feature in features(texts, self.number):
            np.add.at(total, row, self.weight[feature])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(labelled: DataFrame, n_features: int = FEATURES) -> Model:
    """Fit on ``text, label`` rows, whose number the caller bounds.

    The buckets whose share differs most between the classes (by its z-score)
    become features; their value is the log-count ratio, their weight is learnt by
    logistic regression.  Without both classes the score is the base rate.
    """
    counts = count_features(labelled)
    sizes = [r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()]
    number = np.full(1 << BITS, -1, np.int64)
    if len(sizes) < 2:
        has = {r["label"] for r in labelled.select("label").distinct().collect()}
        return Model(number, np.zeros(0), 4.0 if has == {1} else -4.0)
    bad, good = counts[1], counts[0]
    share = (bad + good + 1) / (sum(sizes) + 2)
    z = (bad / sizes[1] - good / sizes[0]) / np.sqrt(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
    chosen = np.argsort(-np.abs(z), kind="stable")[:n_features]
    chosen = chosen[np.abs(z[chosen]) > LEAST_Z]
    number[chosen] = np.arange(len(chosen))
    ratio = np.log((bad[chosen] + 1) / (sizes[1] + 2)) - np.log((good[chosen] + 1) / (sizes[0] + 2))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[list[int]] = [[] for _ in texts]
            for row, feature in features(texts, number):
                for i, part in zip(*_grouped(row, feature)):
                    found[i] = part
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    rows = labelled.select("text", "label").mapInArrow(encode, "label int, found array<int>").collect()
    y = np.array([r["label"] for r in rows], float)
    column = np.array([f for r in rows for f in r["found"]], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r["found"]) for r in rows])
    weight, intercept = logistic(row, column, ratio[column], y, len(chosen))
    return Model(number, weight * ratio, intercept)


def _grouped(row: np.ndarray, feature: np.ndarray) -> tuple[list[int], list[list[int]]]:
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    return row[cuts].tolist(), [p.tolist() for p in np.split(feature, cuts[1:])] if len(cuts) else []


def logistic(row, column, value, y, width, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Regularised logistic regression by accelerated gradient steps."""
    weight, intercept = np.zeros(width), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    norm = np.bincount(row, value**2, len(y)).max(initial=0) + 1
    look, look_b, pace, n = weight, intercept, 4 / norm, len(y)
    for k in range(steps):
        margin = np.bincount(row, value * look[column], n) + look_b
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        gradient = np.bincount(column, value * error[row], width) / n + penalty * look
        new, new_b = look - pace * gradient * 8, look_b - pace * 8 * error.mean()
        pull = k / (k + 3)
        look, look_b = new + pull * (new - weight), new_b + pull * (new_b - intercept)
        weight, intercept = new, new_b
    return weight, intercept


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The classifier is fitted on at most ``sample`` rows of ``labels`` (``doc_id,
    toxic``) outside the held-out rest, the first by md5 of the id; equal ids count
    once, with the higher label and the least of their texts.  Null and empty texts get the score of a text
    without features.  Columns besides ``doc_id`` and ``text`` are ignored, rows may
    repeat; a null doc_id is never learnt from.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = tables.first_by_hash(chosen, "doc_id", sample).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    base = docs.select("doc_id", "text", held_out().alias("held_out"))
    scratch = tables.Scratch(docs.sparkSession, "toxicity")
    # At most ``sample`` ids: a proven bound for the broadcast.
    found = base.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    labelled = scratch.keep(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"))
    model = train(labelled)
    scratch.drop(labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value)],
                                             names=["doc_id", "held_out", "score"])

    kind = base.schema["doc_id"].dataType.simpleString()
    found = base.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(tables.documents(spark, sf_dir), tables.documents(spark, sf_dir, "labels"))
