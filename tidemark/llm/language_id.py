"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import tables
from tidemark.llm.symbols import blocks

UNKNOWN = "und"
DIMENSIONS = 1024
BLOCK = 1 << 19
PIECE = 1 << 20
GRAMS = 1 << 14
LEAST = 1 << 9  # what a short text weighs in a block, which bounds the texts of a block
SALTS = 32
QUANTILE, SLACK = 0.99, 1.5
SHORT = 100
_LETTERS: list[np.ndarray] = []
_VECTORS: dict[int, np.ndarray] = {}


def letters() -> np.ndarray:
    """True at every code point that is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_vectors(alphabet: np.ndarray) -> np.ndarray:
    """A random row of +1 and -1 for each letter (row 0: no letter), seeded by its code point."""
    rows = []
    for c in [0, *alphabet.tolist()]:
        if c not in _VECTORS:
            if len(_VECTORS) > 20_000:  # a cache, nothing is lost
                _VECTORS.clear()
            _VECTORS[c] = np.random.Generator(np.random.PCG64([17, c])).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)
        rows.append(_VECTORS[c])
    return np.array(rows)


def gram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Bind three letters: permute by their place, then multiply."""
    return np.roll(vectors, 2, 1)[a] * np.roll(vectors, 1, 1)[b] * vectors[c]


def bundles(texts: list[str], owner: np.ndarray, owners: int) -> np.ndarray:
    """Sum of the trigram vectors of the texts of each owner.

    Every letter is the middle of one trigram; what is no letter is one symbol.
    """
    joined = " ".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    is_letter = letters()[codes]
    seen = np.zeros(int(codes.max()) + 1, np.int64)
    seen[codes[is_letter]] = 1
    alphabet = np.flatnonzero(seen)
    rank = np.cumsum(seen) * seen
    symbol = rank[codes]
    middle = np.flatnonzero(is_letter)
    out = np.zeros((owners, DIMENSIONS), np.float32)
    if not len(middle):
        return out
    size = len(alphabet) + 1
    gram = (symbol[middle - 1] * size + symbol[middle]) * size + symbol[middle + 1]
    if size**3 <= 1 << 22:
        there = np.zeros(size**3, np.int64)
        there[gram] = 1
        distinct = np.flatnonzero(there)
        place = (np.cumsum(there) - 1)[gram]
    else:
        distinct, place = np.unique(gram, return_inverse=True)
    who, who_place = np.unique(owner, return_inverse=True)
    row = who_place[text[middle - 1]]
    order = np.argsort(place, kind="stable") if len(distinct) > GRAMS else slice(None)
    row, place = row[order], place[order]
    hands = letter_vectors(alphabet)
    # Scripts with many letters have many trigrams: their vectors are made a bounded number at a time.
    for low in range(0, len(distinct), GRAMS):
        part = distinct[low : low + GRAMS]
        x, y = np.searchsorted(place, [low, low + GRAMS]) if len(distinct) > GRAMS else (0, len(place))
        vectors = gram_vectors(part // size**2, part // size % size, part % size, hands).astype(np.float32)
        counts = np.bincount(row[x:y] * len(part) + place[x:y] - low, minlength=len(who) * len(part)).astype(np.float32)
        out[who] += counts.reshape(len(who), -1) @ vectors
    return out


def batch_bundles(texts: list[str | None], owner: np.ndarray, owners: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Bundles of a batch in blocks of bounded size; a long text comes in pieces.

    Yields the rows of the block and one bundle for each of ``owners`` values.
    """
    sizes = np.array([LEAST + (len(t) if t else 0) for t in texts])
    for x, y in blocks(sizes, BLOCK):
        pieces, whose = [], []
        for i in range(x, y):
            text = (texts[i] or "").lower()
            # Pieces end behind a space, so no trigram is cut in two.
            start = 0
            while start < len(text):
                stop = start + PIECE
                if stop < len(text):
                    stop = max(text.rfind(" ", start, stop) + 1, 0) or stop
                    stop = stop if stop > start else start + PIECE
                pieces.append(text[start:stop])
                whose.append(owner[i])
                start = stop
        total = np.zeros((owners, DIMENSIONS), np.float64)
        lengths = np.array([len(p) for p in pieces])
        for a, b in blocks(lengths, PIECE):
            total += bundles(pieces[a:b], np.array(whose[a:b]), owners)
        yield slice(x, y), total


def held_out() -> F.Column:
    """Rows that no model of this package learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototype vectors, bundled over all given rows of ``doc_id, text, lang``.

    Tasks send one sum for each language, so what travels does not grow with the
    rows; languages are the distinct values of ``lang``.
    """
    schema = "lang string, salt int, total binary"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        salt = 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            names = sorted(set(langs))
            salt = salt or len(texts) + sum(len(t or "") for t in texts[:8])
            owner = np.array([names.index(x) for x in langs], np.int64)
            for _, found in batch_bundles(texts, owner, len(names)):
                for name, vector in zip(names, found):
                    total[name] = total.get(name, 0) + vector
        yield pa.RecordBatch.from_pylist(
            [{"lang": k, "salt": salt % SALTS, "total": v.tobytes()} for k, v in total.items()],
            pa.schema([("lang", pa.string()), ("salt", pa.int32()), ("total", pa.binary())]))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in group.column("total").to_pylist())
        return pa.table({"lang": group.column("lang").slice(0, 1).combine_chunks(), "total": pa.array([total.tobytes()], pa.binary())})

    rows = docs.mapInArrow(sums, schema).groupBy("lang", "salt").applyInArrow(add, "lang string, total binary").collect()
    names = sorted({r["lang"] for r in rows})
    vectors = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        vectors[names.index(r["lang"])] += np.frombuffer(r["total"], np.float64)
    return names, vectors


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def letter_counts(texts: list[str | None]) -> np.ndarray:
    """Letters of every text, which are its trigrams."""
    codes = np.frombuffer("\0".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([0, *(len(t or "") + 1 for t in texts)])[:-1]
    return np.add.reduceat(letters()[codes].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def learnt(learn: DataFrame) -> DataFrame:
    return learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))


def predictions(docs: DataFrame, names: list[str], raw: np.ndarray) -> DataFrame:
    """``docs`` with ``lang_pred, score, n_letters, n_apart, nearness``.

    ``nearness`` is the projection of the mean trigram of a text, not centred, on
    the prototype of ``lang_pred``: how usual its trigrams are in that language.
    Its mean does not depend on the length of the text, as a cosine does.
    ``n_apart`` is the number of trigrams that would say as much if all differed:
    their number squared by the sum of the squares of their counts.
    """
    mean = unit(raw).mean(0) if names else np.zeros(DIMENSIONS)
    centred = unit(unit(raw) - (mean if len(names) > 1 else 0)) if names else raw
    plain = unit(raw)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            count, apart, nearness = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            sizes = np.array([LEAST + (len(t) if t else 0) for t in texts])
            for x, y in blocks(sizes, BLOCK) if names else ():
                count[x:y] = letter_counts(texts[x:y])
                for _, v in batch_bundles(texts[x:y], np.arange(y - x), y - x):
                    some = np.flatnonzero(np.abs(v).sum(1) > 0)
                    cosine = unit(unit(v[some]) - (mean if len(names) > 1 else 0)) @ centred.T
                    best = cosine.argmax(1)
                    score[x + some] = np.clip((1 + cosine[np.arange(len(some)), best]) / 2, 0, 1)
                    nearness[x + some] = (v[some] * plain[best]).sum(1) / np.maximum(count[x + some], 1)
                    apart[x + some] = count[x + some] ** 2.0 * DIMENSIONS / np.square(v[some]).sum(1)
                    for i, k in zip(some, best):
                        label[x + i] = names[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(label, pa.string()), pa.array(score), pa.array(count), pa.array(apart), pa.array(nearness)],
                names=[*batch.schema.names, "lang_pred", "score", "n_letters", "n_apart", "nearness"])

    fresh = docs.drop("lang_pred", "score", "n_letters", "n_apart", "nearness")
    more = T.StructType.fromDDL("lang_pred string, score double, n_letters bigint, n_apart double, nearness double")
    return fresh.mapInArrow(predict, T.StructType([*fresh.schema.fields, *more.fields]))


def identify_language(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    ``learn`` has ``text, lang``; rows without ``lang`` are not used.  Prototypes
    and documents are centred on the mean prototype, ``score`` is their cosine
    moved from -1..1 to 0..1.  A null text and a text without a letter give
    ``und`` and 0, as does a ``learn`` without rows.  Equal cosines go to the
    first language in order.  All columns of ``docs`` stay but those named ``lang_pred,
    score, n_letters, n_apart`` or ``nearness``; rows may repeat.
    """
    return predictions(docs, *prototypes(learnt(learn))).drop("n_letters", "n_apart", "nearness")


def shortfall(usual: F.Column) -> F.Column:
    """How far ``nearness`` is below that of the language, in units of what one trigram varies.

    The mean of n different trigrams varies with 1 / sqrt(n).
    """
    return (1 - F.col("nearness") / usual) * F.sqrt("n_apart")


def recognise_language(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred, score, recognised``.

    A language is recognised if ``shortfall`` is no more than ``SLACK`` times its
    ``QUANTILE`` among all learnt rows that were found in their own language.  Each
    of them counts twice, whole and with its first ``SHORT`` characters alone, so
    the bound holds for short texts.  Two or three words can hardly fail it.
    """
    names, raw = prototypes(learnt(learn))
    both = learnt(learn).select("lang", F.explode(F.array("text", F.substring("text", 1, SHORT))).alias("text"))
    scratch = tables.Scratch(docs.sparkSession, "language")
    own = scratch.keep(predictions(both, names, raw).where("lang = lang_pred").select("lang", "n_letters", "n_apart", "nearness"))
    usual = own.groupBy("lang").agg((F.sum(F.col("nearness") * F.col("n_letters")) / F.sum("n_letters")).alias("usual"))
    # One row for each language.
    bounds = own.join(F.broadcast(usual), "lang").groupBy("lang").agg(
        F.max("usual").alias("usual"), F.percentile_approx(shortfall(F.col("usual")), F.lit(QUANTILE), F.lit(10_000)).alias("bound")).collect()
    scratch.drop(own)
    found = predictions(docs, names, raw)
    usual = bound = F.lit(None).cast("double")
    for r in bounds:
        usual = F.when(F.col("lang_pred") == r["lang"], r["usual"]).otherwise(usual)
        bound = F.when(F.col("lang_pred") == r["lang"], SLACK * max(r["bound"], 0.0)).otherwise(bound)
    return found.withColumn("recognised", F.coalesce(shortfall(usual) <= bound, F.lit(False))).drop("n_letters", "n_apart", "nearness")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text", "lang", held_out().alias("held_out"))
    learn = docs.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    found = identify_language(docs.select("doc_id", "held_out", "text"), learn)
    return found.select("doc_id", "held_out", "lang_pred", "score")
