"""Quality rules: text statistics and a learned decision list."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import symbols as S
from tidemark.llm import tables

BLOCK = 1 << 20
SYMBOLS = b"#*$%&|<>"  # fixed by the contract
SAMPLE = 20_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("size", "mean_word_chars", "symbols_per_word", "dup_lines_per_word", "repeat_share", "letter_share",
            "upper_share", "digit_share", "distinct_share", "mean_line_words")
STATS = "doc_id {kind}, " + ", ".join(f"{c} bigint" for c in STATISTICS) + ", " + ", ".join(f"{c} double" for c in MEASURES)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key stands twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Counts and measures of the documents of a block."""
    n = len(offsets) - 1
    starts, ends, first = S.word_spans(data, offsets)
    words = np.diff(first)
    doc_of_word = np.repeat(np.arange(n), words)
    lead = (data & 0xC0) != 0x80  # first byte of a code point
    inside = ~S.SPACES[data]
    hashes = S.word_hashes(data, starts, ends)
    salt = S.mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(S.BASE))
    # Windows of three words, told apart by document.
    gram = S.gram_hash(S.prefix_sums(hashes), 3)
    whole = np.arange(len(gram)) + 3 <= first[1:][doc_of_word[: len(gram)]]
    at = np.flatnonzero(whole)
    at = at[repeated(S.mix(gram[at] ^ salt[doc_of_word[at]]))]
    edge = np.bincount(at, minlength=len(starts) + 3) - np.bincount(at + 3, minlength=len(starts) + 3)
    covered = np.cumsum(edge)[: len(starts)] > 0
    # Lines: cut at every \n and at every text's end.
    cut = np.unique(np.concatenate((np.flatnonzero(data == 10) + 1, offsets[:-1][offsets[:-1] < offsets[1:]], offsets[-1:])))
    begin, stop = cut[:-1], cut[1:]
    doc_of_line = np.searchsorted(offsets, begin, "right") - 1
    stop = stop - (data[stop - 1] == 10)
    in_words = np.concatenate(([0], np.cumsum(inside)))
    worded = in_words[stop] > in_words[begin]
    begin, stop, doc_of_line = begin[worded], stop[worded], doc_of_line[worded]
    lines = S.mix(S.sequence_hashes(S.byte_values(3)[data], begin, stop) ^ salt[doc_of_line])
    distinct = np.unique(lines, return_index=True)[1]
    n_lines = np.bincount(doc_of_line, minlength=n)
    dup_lines = n_lines - np.bincount(doc_of_line[distinct], minlength=n)
    per_word = lambda x: x / np.maximum(words, 1)
    chars = per_doc(lead & inside, offsets)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = per_doc(symbol[data], offsets)
    unique = np.unique(S.mix(hashes ^ salt[doc_of_word]), return_index=True)[1]
    repeats = per_doc(covered, first)
    counts = dict(zip(STATISTICS, (words, chars, symbols, dup_lines, repeats)))
    per_char = lambda x: x / np.maximum(chars, 1)
    measures = dict(zip(MEASURES, (
        words.astype(float), per_word(chars), per_word(symbols), per_word(dup_lines), per_word(repeats),
        per_char(per_doc(_LETTER[data], offsets)), per_char(per_doc((data >= 65) & (data <= 90), offsets)),
        per_char(per_doc((data >= 48) & (data <= 57), offsets)),
        per_word(np.bincount(doc_of_word[unique], minlength=n)), words / np.maximum(n_lines, 1))))
    return counts, measures


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts and the measures of every row; a null text has no words."""
    base = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.bytes_of(batch.column("text"))
            for x, y in S.blocks(np.diff(offsets), BLOCK):
                counts, measures = statistics(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                arrays = [pa.array(v.astype(np.int64)) for v in counts.values()] + [pa.array(v.astype(float)) for v in measures.values()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(x, y - x), *arrays], names=["doc_id", *counts, *measures])

    return base.mapInArrow(count, STATS.format(kind=base.schema["doc_id"].dataType.simpleString()))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.measure]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.measure)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Sequence[Condition], values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(values)
    return out


def grow(values: dict[str, np.ndarray], bad: np.ndarray, most: int, steps: int = 40) -> Rule:
    """Add the threshold with the best information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for name, v in values.items():
            mine = np.unique(np.quantile(v[inside], np.linspace(0, 1, steps)))
            hurt = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, steps)))
            for t in np.union1d(mine, hurt):
                for above in (False, True):
                    c = Condition(name, above, float(t))
                    hit = inside & c.holds(values)
                    p = (hit & bad).sum()
                    if not p:
                        continue
                    gain = p * (np.log2(p / hit.sum()) - np.log2(p0 / (p0 + n0)))
                    if gain > best_gain:
                        best, best_gain = c, gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return tuple(rule)


def precision(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covers(rule, values, len(bad))
    return ((hit & bad).sum() + 1) / (hit.sum() + 2)


def decision_list(values: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, most_rules: int = 12,
                  most_conditions: int = 4, least: float = 0.9) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, take out what is covered.

    Ends at a rule whose precision on the rows of ``prune`` is below ``least``, at
    ``most_rules``, or when no bad row is left.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    for _ in range(most_rules):
        part = {k: v[left & ~prune] for k, v in values.items()}
        rule = grow(part, bad[left & ~prune], most_conditions)
        if not rule:
            break
        test = {k: v[left & prune] for k, v in values.items()}
        truth = bad[left & prune]
        while len(rule) > 1 and precision(rule[:-1], test, truth) >= precision(rule, test, truth):
            rule = rule[:-1]
        hit = covers(rule, values, len(bad)) & left
        found = covers(rule, test, len(truth))
        if not found.any() or truth[found].mean() < least:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def learn_rules(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``sample`` labelled rows, the first by md5 of the id.

    Of rows with one id one counts, with the lower quality.  Rules are for rows that the
    base limits let pass.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.md5(F.col("doc_id").cast("string"))
    joined = stats.where(~base_failed()).join(known, "doc_id")
    single = tables.Scratch(stats.sparkSession, "labelled").keep(
        joined.groupBy("doc_id", "quality").agg(F.min(F.struct(*MEASURES)).alias("m")).select("doc_id", "quality", "m.*"))
    first = tables.first_by_hash(single, "doc_id", sample).withColumn("_order", order)
    rows = first.orderBy("_order", "doc_id").limit(sample).select("_order", "quality", *MEASURES).collect()
    if not rows:
        return []
    values = {m: np.array([r[m] for r in rows]) for m in MEASURES}
    prune = np.array([int(r["_order"][-2:], 16) % 3 == 0 for r in rows])
    return decision_list(values, np.array([r["quality"] == 0 for r in rows]), prune)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row of ``docs``.

    ``kept`` is false for rows that fail the base limits, else the verdict of the
    decision list learnt from ``labels`` (``doc_id, quality``); without labels all
    others are kept.  Rows may repeat; a null doc_id is never learnt from; columns
    besides ``doc_id`` and ``text`` are ignored.
    """
    scratch = tables.Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(text_statistics(docs))
    rules = learn_rules(stats, labels, sample)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(tables.documents(spark, sf_dir), tables.documents(spark, sf_dir, "labels"))
    return found.select("doc_id", *STATISTICS, "base_failed", "kept")
