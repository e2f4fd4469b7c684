"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ordering import running_totals
from tidemark.llm import tables

CAPACITY = 1024
END = 0
ORDER_BUCKETS = 4096


@lru_cache(maxsize=4)
def encoders(tokenizer: str, ranks: str | None):
    """The tokenizer of a task, and a faster one with the same vocabulary if its ranks are given."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    if ranks is None:
        return slow, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return slow, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def token_ids(text: str, tokenizer: str, ranks: str | None) -> np.ndarray:
    """Ids of a text and the end id.

    Both encoders give the same ids.  The faster one is used for texts of
    characters below U+0800 without the start of a special token, where the
    character classes of the two do not depend on a version of Unicode.
    """
    slow, fast = encoders(tokenizer, ranks)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if fast is not None and "<|" not in text and not (len(raw) and raw.max() >= 0xE0):
        ids = fast.encode_ordinary(text)
    else:
        ids = slow.encode(text, add_special_tokens=False).ids
    return np.array([*ids, END], np.uint32)


def tokenised(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int) -> DataFrame:
    """``doc_id, doc_tokens, crcs`` (and ``rest = doc_tokens % capacity``): pieces end at multiples of ``capacity``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, crcs = [], []
            for text in batch.column("text").to_pylist():
                ids = token_ids(text or "", tokenizer, ranks)
                sizes.append(len(ids))
                crcs.append([zlib.crc32(ids[s : s + capacity].tobytes()) for s in range(0, len(ids), capacity)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(encode, f"doc_id {kind}, doc_tokens bigint, crcs array<bigint>")
    return out.withColumn("rest", F.col("doc_tokens") % capacity)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is largest within ``room``.

    Bit ``s`` of a bitset says that the sum ``s`` can be reached; one bitset after
    each length lets the counts be read back.
    """
    mask = (1 << (room + 1)) - 1
    reach = [1]
    lengths = sorted((n for n in counts if n <= room), reverse=True)
    used_lengths = []
    for n in lengths:
        bits = now = reach[-1]
        for _ in range(min(counts[n], room // n)):
            now = (now << n) & mask
            if not now & ~bits:
                break
            bits |= now
        used_lengths.append(n)
        reach.append(bits)
        if bits >> room:
            break
    total = reach[-1].bit_length() - 1
    taken: dict[int, int] = {}
    for k in range(len(used_lengths) - 1, -1, -1):
        n = used_lengths[k]
        while not reach[k] >> total & 1:
            total -= n
            taken[n] = taken.get(n, 0) + 1
    return taken


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns of lengths and how many sequences each fills, by minimum bin slack.

    The largest length that is left opens a sequence; subset sums choose what
    comes with it.  A pattern is repeated while the counts last, so there are at
    most about as many patterns as different lengths, however many pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    out = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        pattern = best_fill({n: c for n, c in rest.items() if c}, capacity - largest)
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


PLACES = "rest bigint, low bigint, high bigint, each bigint, sequence bigint, at bigint"


def places(patterns: list[tuple[dict[int, int], int]], first: int) -> list[tuple[int, ...]]:
    """For each pattern and length: the ranks it takes, pieces per sequence, first sequence, offset."""
    taken: dict[int, int] = {}
    rows = []
    for pattern, times in patterns:
        at = 0
        for n in sorted(pattern, reverse=True):
            low = taken.get(n, 0)
            taken[n] = low + pattern[n] * times
            rows.append((n, low, taken[n], pattern[n], first, at))
            at += n * pattern[n]
        first += times
    return rows


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is cut into full sequences and one rest.  Rests are counted by
    length (fewer than ``capacity`` numbers, all the driver sees), minimum bin
    slack turns the counts into patterns, and every rest finds its place by its
    rank among those of its length.  A null text counts as empty and has the end
    id alone; every row is packed for itself, repeated ids and null ids too;
    columns besides ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    scratch = tables.Scratch(spark, "packing")
    lens = scratch.keep(tokenised(docs, tokenizer, ranks, capacity))
    full = F.floor(F.col("doc_tokens") / capacity)
    counts = lens.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("full")).orderBy("rest").collect()
    before, bases = 0, []
    for r in counts:
        bases.append((r["rest"], before))
        before += r["full"]
    rows = places(plan({r["rest"]: r["n"] for r in counts}, capacity), before)

    by_doc = F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(ORDER_BUCKETS))
    slim = lens.select("doc_id", "doc_tokens", "crcs", "rest", full.alias("n_full"), F.lit(1).cast("bigint").alias("one"))
    ranked = running_totals(slim, [F.col("doc_id"), F.col("doc_tokens"), F.col("crcs")], ["one", "n_full"], by_doc, ["rest"])
    # Both tables have at most one row for each length or length and pattern.
    ranked = ranked.join(F.broadcast(spark.createDataFrame(bases, "rest bigint, base bigint")), "rest")
    rank = F.col("cum_one") - 1
    pieces = ranked.select(
        "doc_id", "doc_tokens", "rest", rank.alias("rank"), (F.col("base") + F.col("cum_n_full") - F.col("n_full")).alias("first"),
        F.posexplode("crcs").alias("k", "ids_crc32"))
    whole = pieces.where((F.col("k") + 1) * capacity <= F.col("doc_tokens")).select(
        "doc_id", (F.col("k") * F.lit(capacity).cast("bigint")).alias("start"), F.lit(capacity).cast("bigint").alias("length"), "ids_crc32",
        "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    where = F.broadcast(spark.createDataFrame(rows, PLACES))
    tail = pieces.where((F.col("k") + 1) * capacity > F.col("doc_tokens")).join(where, "rest").where("rank >= low AND rank < high")
    step = F.col("rank") - F.col("low")
    rest = tail.select(
        "doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(step / F.col("each"))).alias("sequence_id"),
        (F.col("at") + step % F.col("each") * F.col("rest")).alias("offset"))
    return whole.unionByName(rest)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, ranks: str | None = None) -> DataFrame:
    """``sequence_id, ids`` of every sequence: the tokens themselves, in order of offset.

    ``doc_id`` must be unique and not null here.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [token_ids(t or "", tokenizer, ranks) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    tokens = docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")
    cut = placed.join(tokens, "doc_id").select(
        "sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("piece"))
    return cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces")).select(
        "sequence_id", F.flatten("pieces.ids").alias("ids"))


def public_files() -> tuple[str, str]:
    import public_tokenizers

    folder = os.path.dirname(public_tokenizers.path("x"))
    return os.path.join(folder, "byte_bpe_50k.json"), os.path.join(folder, "byte_bpe_50k.tiktoken")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tables.documents(spark, sf_dir), *public_files())
