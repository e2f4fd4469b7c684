"""Document fingerprints by one-permutation MinHash, in Spark expressions alone."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import tables

SPACES = "[\\x20\\x09-\\x0D]+"
PROBES = 16


@dataclass(frozen=True)
class Sketch:
    """``bins`` minima of one hash of each ``width``-word shingle, ``bits`` low bits kept of each."""

    width: int = 5
    bins: int = 256
    bits: int = 4

    def __post_init__(self):
        powers = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
        if self.bins not in powers or self.bits not in (1, 2, 4, 8) or self.bins * self.bits < 64 or self.width < 1:
            raise ValueError("bins is a power of two, bits 1, 2, 4 or 8, and together they fill 64-bit words")

    @property
    def rest(self) -> int:
        """Bits of a hash below its bin number."""
        return 65 - self.bins.bit_length()


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, width: int) -> Column:
    """A 64-bit hash of every ``width`` consecutive words; fewer words are one shingle, none are none."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = lambda h: F.size(h)
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(n(h) == 0, F.array().cast("array<bigint>")).when(n(h) < width, F.array(F.xxhash64(h))).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))))


def probe(b: int, t: int, bins: int) -> int:
    """Where an empty bin ``b`` looks in step ``t``: a fixed random sequence for each bin."""
    return int.from_bytes(hashlib.blake2b(struct.pack("<qq", b, t), digest_size=8).digest(), "little") % bins


def codes(text: Column, sketch: Sketch = Sketch()) -> Column:
    """Low bits of every bin's minimum, empty bins filled by optimal densification.

    Each shingle is hashed once: the leading bits name its bin, the others are its
    value.  An empty bin looks at the bins that its own fixed random sequence names
    and copies the first that holds a shingle; which one that is depends on the
    bins that are filled, and two documents borrow alike wherever both had to.
    ``PROBES`` steps of the sequence are drawn with replacement; the few bins that
    are still empty then take the filled bin that is lowest in their own random
    order, which ends for a single shingle too.  A text without words has zeros.
    """
    bins, rest, low = sketch.bins, sketch.rest, (1 << sketch.bits) - 1
    none = (1 << rest) - 1
    # One sentinel for each bin, larger than every value: so each bin has a head in the sorted list.
    floors = F.array(*[F.lit(b << rest | none).cast("bigint") for b in range(-(bins // 2), bins // 2)])
    bin_of = lambda v: F.shiftright(v, rest)

    steps = [F.array(*[F.lit(probe(b, t, bins)) for b in range(bins)]) for t in range(PROBES)]

    def filled(m: Column) -> Column:
        def borrowed(b: Column, own: Column) -> Column:
            order = F.transform(own, lambda v: F.struct(F.xxhash64(b, bin_of(v)).alias("r"), v.alias("v")))
            return F.coalesce(*[F.get(m, F.get(step, b)) for step in steps], F.array_min(order)["v"], F.lit(0).cast("bigint"))

        return let(F.filter(m, lambda v: v.isNotNull()), lambda own: F.transform(m, lambda v, b: F.coalesce(v, borrowed(b, own)).bitwiseAND(F.lit(low))))

    ordered = F.sort_array(F.concat(shingles(text, sketch.width), floors))
    heads = let(ordered, lambda s: F.filter(s, lambda v, i: (i == 0) | (bin_of(v) != bin_of(F.get(s, i - 1)))))
    return let(F.transform(heads, lambda v: F.when(v.bitwiseAND(F.lit(none)) != none, v)), filled)


def packed(code: Column, sketch: Sketch = Sketch()) -> Column:
    """The codes side by side in 64-bit words."""
    each = 64 // sketch.bits
    return let(code, lambda c: F.transform(
        F.sequence(F.lit(0), F.lit(sketch.bins // each - 1)),
        lambda w: F.aggregate(F.slice(c, w * each + 1, F.lit(each)), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, sketch.bits).bitwiseOR(x))))


def fingerprint(text: Column, sketch: Sketch = Sketch()) -> Column:
    """Packed fingerprint of a text, as an array of 64-bit words."""
    return packed(codes(text, sketch), sketch)


def printed(words: Column) -> Column:
    """A fingerprint in hex digits."""
    return F.array_join(F.transform(words, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def likeness(a: Column, b: Column, sketch: Sketch = Sketch()) -> Column:
    """Estimate of the Jaccard similarity of two documents' shingles from their fingerprints.

    The share of equal codes, less what codes of ``bits`` bits agree by chance.
    """
    lows = sum(1 << k for k in range(0, 64, sketch.bits))
    lows -= (1 << 64) if lows >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        d, k = x.bitwiseXOR(y), sketch.bits // 2
        while k:
            d, k = d.bitwiseOR(F.shiftrightunsigned(d, k)), k // 2
        return F.bit_count(d.bitwiseAND(F.lit(lows).cast("bigint")))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0 ** -sketch.bits
    return F.greatest(F.lit(0.0), (1 - unequal / sketch.bins - chance) / (1 - chance))


def successors(classes: DataFrame, scratch: tables.Scratch) -> DataFrame:
    """``id, digest`` of each document with the keys of the next and of the one before, in a ring.

    The order is cut into range partitions, written with their numbers.  Neighbours
    are found inside a partition; the partitions' first and last rows, one each,
    join them.
    """
    ranged = scratch.keep(classes.repartitionByRange("id", "digest").withColumn("bucket", F.spark_partition_id()))
    row = F.struct("id", "digest", "n_chars")
    ends = ranged.groupBy("bucket").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    buckets, whole = Window.orderBy("bucket"), Window.partitionBy()
    # As many rows as range partitions.
    ends = ends.select(
        "bucket", F.coalesce(F.lead("first").over(buckets), F.min("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(buckets), F.max("last").over(whole)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("id", "digest")
    return scratch.keep(
        ranged.withColumn("next", F.lead(row).over(inside)).withColumn("prev", F.lag(row).over(inside)).join(ends, "bucket")
        .select("id", "digest", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev")))


def edited_neighbours(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """``doc_id, n_chars, edited, print, edited_print, near_edited, near_next`` of every row of ``docs``.

    ``edited`` is the text with its last quarter (``floor(n_chars / 4)`` code points)
    replaced by the first as many code points, or all, of the next document in the
    order of doc_id; after the last document comes the first.  ``print`` and
    ``edited_print`` are the packed fingerprints, ``near_edited`` and ``near_next``
    the likeness of the text to its edited form and to the next document.

    A null text counts as empty: no shingles, a fingerprint of zeros, alike to other
    texts without words.  A null doc_id counts as larger than all others; documents
    of one doc_id follow each other by digest.  Rows that repeat doc_id and text are
    one document and each get its result.  An only document is its own successor.
    Other columns are ignored.

    Texts travel once, reduced to one row for each document before the shuffle;
    their first parts travel a second time, cut to what the document before needs.
    """
    scratch = tables.Scratch(docs.sparkSession, "fingerprints")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(tables.ordered_id().alias("id"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    classes = rows.select("id", "digest", F.length("text").cast("bigint").alias("n_chars")).distinct()
    order = successors(classes, scratch)

    # Both uses of ``whole`` read all of its columns (hence the condition), so one exchange serves both.
    whole = (
        rows.withColumn("print", fingerprint(F.col("text"), sketch)).groupBy("id", "digest")
        .agg(F.first(F.struct("text", "print")).alias("doc"), F.count(F.lit(1)).alias("n")).where("n > 0")
        .join(order, ["id", "digest"]))
    quarter = F.floor(F.col("prev.n_chars") / 4).cast("int")
    heads = whole.select(
        F.col("prev.id").alias("id"), F.col("prev.digest").alias("digest"), F.substring(F.col("doc.text"), F.lit(1), quarter).alias("head"),
        F.col("doc.print").alias("next_print"))
    n = F.length("doc.text")
    found = (
        whole.join(heads, ["id", "digest"])
        .withColumn("edited", F.concat(F.substring(F.col("doc.text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("head")))
        .withColumn("edited_print", fingerprint(F.col("edited"), sketch)))
    own = F.col("doc.print")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(
        F.nullif("id", F.lit(tables.LAST_ID)).alias("doc_id"), n.cast("bigint").alias("n_chars"), "edited", own.alias("print"), "edited_print",
        likeness(own, F.col("edited_print"), sketch).alias("near_edited"), likeness(own, F.col("next_print"), sketch).alias("near_next"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_neighbours(tables.documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), printed(F.col("print")).alias("fingerprint"),
        printed(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")
