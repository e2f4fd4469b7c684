"""Near-duplicate detection with a chosen-path set similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import symbols as S
from tidemark.llm import tables
from tidemark.llm.repeats import pack, runs, unpack

BLOCK = 1 << 19
COORDINATES = 128
BITMAP = 4096
TILE = 256
SMALL = 8
MISS = 1e-6
BACKGROUND = 16  # unrelated documents share a child this many times less often than a parent


@dataclass(frozen=True)
class Similar:
    """Sets of ``width``-word shingles with at least ``percent`` per cent of their union in common."""

    width: int = 2
    percent: int = 80


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every document of a block, and where each document's begin.

    A-Z is lower-cased.  A document with fewer than ``width`` words has its whole
    sequence as one shingle, one without words has none.
    """
    data = _LOWER[data]
    starts, ends, first = S.word_spans(data, offsets)
    words = S.word_hashes(data, starts, ends)
    count = np.diff(first)
    sums = S.prefix_sums(words)
    size = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    doc = np.repeat(np.arange(len(count)), size)
    begin = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    shingle = S.span_hash(sums, begin, np.minimum(begin + width, first[1:][doc]))
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = runs(doc, shingle)
    shingle, doc = shingle[new], doc[new]
    return shingle, np.searchsorted(doc, np.arange(len(count) + 1))


def sketches(docs: DataFrame, similar: Similar) -> DataFrame:
    """``id, digest, n_shingles, print, sketch`` of every row of ``id, digest, text``.

    ``print`` is equal for equal sets only (128 bits); ``sketch`` has the low 16
    bits of ``COORDINATES`` minwise tokens, and behind them a bitmap of the set.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = S.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(S.BASE)) | np.uint64(1)
        for batch in batches:
            data, offsets = S.bytes_of(batch.column("text"))
            for x, y in S.blocks(np.diff(offsets), BLOCK):
                tokens, cut = shingles(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], similar.width)
                n = np.diff(cut)
                some = np.flatnonzero(n)
                both = [np.zeros(y - x, np.uint64), np.zeros(y - x, np.uint64)]
                sketch = np.zeros((y - x, COORDINATES), np.uint16)
                if len(some):
                    for k in (0, 1):
                        both[k][some] = np.add.reduceat(S.mix(tokens ^ np.uint64(k * S.BASE)), cut[:-1][some])
                    for k in range(COORDINATES):
                        # The high half of a product is well mixed; its minimum picks the token.
                        low = np.minimum.reduceat((tokens * factor[k]) >> np.uint64(8), cut[:-1][some])
                        sketch[some, k] = S.mix(low).astype(np.uint16)
                bits = np.zeros((y - x, BITMAP), bool)
                bits[np.repeat(np.arange(y - x), n), (tokens >> np.uint64(11)) % np.uint64(BITMAP)] = True
                sketch = np.concatenate((sketch.view(np.uint8), np.packbits(bits, axis=1)), axis=1)
                names = np.column_stack(both)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(x, y - x), batch.column("digest").slice(x, y - x), pa.array(n.astype(np.int64)),
                    pa.array([r.tobytes() for r in names], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["id", "digest", "n_shingles", "print", "sketch"])

    return docs.mapInArrow(make, "id bigint, digest binary, n_shingles bigint, print binary, sketch binary")


def sketch_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens and bitmap (as 64-bit words) of sketches."""
    rows = S.bytes_of(column)[0].reshape(-1, 2 * COORDINATES + BITMAP // 8)
    return np.ascontiguousarray(rows[:, : 2 * COORDINATES]).view(np.uint16), np.ascontiguousarray(rows[:, 2 * COORDINATES :]).view(np.uint64)


def hopeful_pairs(one: pa.Array, two: pa.Array, n_one: np.ndarray, n_two: np.ndarray, x: np.ndarray, y: np.ndarray, similar: Similar) -> np.ndarray:
    """Which of the pairs ``(x, y)`` of rows may reach the threshold.

    Sketches must agree almost as often as the threshold asks (five deviations
    below).  A bit that only one bitmap has stands for a token that only its set
    has, which bounds the share of the union from above, without an estimate.
    """
    share = similar.percent / 100
    least = COORDINATES * share - 5 * math.sqrt(COORDINATES * share * (1 - share))
    a, b = sketch_parts(one), sketch_parts(two)
    good = np.zeros(len(x), bool)
    for s in range(0, len(x), 8192):
        i, j = x[s : s + 8192], y[s : s + 8192]
        own = np.bitwise_count(a[1][i] & ~b[1][j]).sum(1, dtype=np.int64)
        other = np.bitwise_count(b[1][j] & ~a[1][i]).sum(1, dtype=np.int64)
        common = np.minimum(n_one[i] - own, n_two[j] - other)
        good[s : s + 8192] = ((a[0][i] == b[0][j]).sum(1) >= least) & (
            100 * common >= similar.percent * (n_one[i] + n_two[j] - common))
    return good


class Forest:
    """Independent random trees over the coordinates of a sketch.

    A node branches into each coordinate with probability ``1 / (threshold *
    COORDINATES)``: two sets at the threshold share one child on average, so they
    meet at some leaf of a tree with a chance that falls only slowly with depth.
    Depth grows with the logarithm of the number of sets, which keeps the leaves
    small; trees are repeated until a pair at the threshold is missed with
    probability ``MISS``.
    """

    def __init__(self, n: int, threshold: float):
        self.depth = max(2, math.ceil(math.log(max(n, 2)) / math.log(BACKGROUND)))
        meet = 1.0
        for _ in range(self.depth):
            meet = 1 - math.exp(-meet)
        self.trees = math.ceil(math.log(MISS) / math.log(1 - meet))
        draw = np.random.Generator(np.random.PCG64(5))
        rate = 1 / threshold
        paths: list[tuple[int, list[int]]] = [(t, []) for t in range(self.trees)]
        for _ in range(self.depth):
            paths = [(t, p + [int(c)]) for t, p in paths for c in draw.choice(COORDINATES, min(COORDINATES, draw.poisson(rate)), replace=False)]
        # Paths with the same coordinates lead to the same leaf, in any tree.
        self.paths = np.array(sorted({tuple(sorted(p)) for _, p in paths}), np.int64).reshape(-1, self.depth)

    def leaves(self, sketch: np.ndarray) -> np.ndarray:
        """Hash of every leaf of every row of ``sketch``: the tokens along its path."""
        out = np.zeros((len(sketch), len(self.paths)), np.uint64)
        for level in range(self.depth):
            out = S.mix(out * np.uint64(S.BASE) + sketch[:, self.paths[:, level]].astype(np.uint64) + np.uint64(1))
        return S.mix(out + np.arange(1, len(self.paths) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


LEAVES = "slot int, leaf binary, size binary, label binary, ids binary"
PAIRS = "a bigint, b bigint"
PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def leaf_rows(sets: DataFrame, forest: Forest, buckets: int) -> DataFrame:
    """Each set at each of its leaves, packed into one row for a bucket and a batch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = batch.slice(start, 4096)
                sketch, _ = sketch_parts(rows.column("sketch"))
                leaf = forest.leaves(sketch).ravel()
                if not len(leaf):
                    continue
                wide = [np.repeat(rows.column(c).to_numpy(), len(forest.paths)) for c in ("n_shingles", "label", "id")]
                slot = ((leaf >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((wide[2], slot))
                slot, leaf = slot[order], leaf[order]
                size, label, ids = (w[order] for w in wide)
                cuts = np.flatnonzero(np.diff(slot, prepend=-1))
                ends = np.append(cuts[1:], len(slot))
                low = (leaf & np.uint64(0xFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)[:, :5]
                cells = [
                    pa.array([np.ascontiguousarray(low[x:y].T).tobytes() for x, y in zip(cuts, ends)], pa.binary()),
                    *[pa.array([pack(v[x:y], d) for x, y in zip(cuts, ends)], pa.binary()) for v, d in ((size, False), (label - ids, False), (ids, True))]]
                yield pa.RecordBatch.from_arrays([pa.array(slot[cuts].astype(np.int32)), *cells], names=["slot", "leaf", "size", "label", "ids"])

    return sets.mapInArrow(make, LEAVES)


def leaf_members(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Leaf, size, label and id of the members of a bucket, ordered by leaf and id."""
    planes = [np.frombuffer(x, np.uint8).reshape(5, -1) for x in table.column("leaf").to_pylist()]
    leaf = np.zeros((sum(p.shape[1] for p in planes), 8), np.uint8)
    leaf[:, :5] = np.concatenate([p.T for p in planes])
    leaf = leaf.view(np.uint64).ravel()
    size, shift = (unpack(table.column(c).to_pylist(), np.int64) for c in ("size", "label"))
    ids = unpack(table.column("ids").to_pylist(), np.int64, True)
    order = np.lexsort((ids, leaf))
    return leaf[order], size[order], (ids + shift)[order], ids[order]


def sized(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that still allow the wanted share of the union."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def places(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member of ordered leaves: where its leaf starts and how many it has."""
    if not len(leaf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = runs(leaf)
    which = np.cumsum(head) - 1
    return np.flatnonzero(head)[which], np.bincount(which)[which]


def first_pairs(table: pa.Table, similar: Similar) -> pa.Table:
    """Every member of a leaf with the leaf's first: as many pairs as members, however large the leaf."""
    leaf, size, _, ids = leaf_members(table)
    start, _ = places(leaf)
    later = np.flatnonzero(np.arange(len(leaf)) > start)
    return _pair_table([(start[later], later)], ids, size, similar)


def drawn_pairs(table: pa.Table, similar: Similar) -> pa.Table:
    """Every member of a leaf with two drawn members, if those have another label.

    Where nearly all members have one label, nearly all pairs are of a member that
    is still apart and one of the many, so one round joins what is easily joined.
    """
    leaf, size, label, ids = leaf_members(table)
    start, n = places(leaf)
    at = np.arange(len(leaf))
    out = []
    for seed in (1, 2):
        draw = S.mix(leaf + S.mix(ids.astype(np.uint64) * np.uint64(S.BASE) + np.uint64(seed)))
        other = start + ((draw >> np.uint64(20)) % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)
        apart = np.flatnonzero(label[other] != label)
        out.append((other[apart], at[apart]))
    return _pair_table(out, ids, size, similar)


def _mixed(leaf: np.ndarray, label: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Members of leaves with more than one label."""
    other = (label != label[start]).astype(np.int64)
    return np.add.reduceat(other, np.flatnonzero(runs(leaf)))[np.cumsum(runs(leaf)) - 1] > 0


def mixed_pairs(table: pa.Table, similar: Similar) -> pa.Table:
    """Pairs of different labels in small leaves."""
    leaf, size, label, ids = leaf_members(table)
    if not len(leaf):
        return PAIRS_ARROW.empty_table()
    start, n = places(leaf)
    at = np.arange(len(leaf))
    small = _mixed(leaf, label, start) & (n <= SMALL)
    out = []
    for gap in range(1, SMALL):
        ok = np.flatnonzero(small & (at - gap >= start))
        ok = ok[label[ok] != label[ok - gap]]
        out.append((ok - gap, ok))
    return _pair_table(out, ids, size, similar)


MEMBERS = "hub bigint, id bigint, label bigint, apart boolean"


def mixed_members(table: pa.Table) -> pa.Table:
    """Members of large leaves with more than one label, under the label that most have (the hub)."""
    leaf, _, label, ids = leaf_members(table)
    hub, member = [], []
    if len(leaf):
        start, n = places(leaf)
        for first in np.flatnonzero(_mixed(leaf, label, start) & (n > SMALL) & (np.arange(len(leaf)) == start)):
            names, counts = np.unique(label[first : first + n[first]], return_counts=True)
            member.append(np.arange(first, first + n[first]))
            hub.append(np.full(n[first], names[counts.argmax()]))
    at = np.concatenate(member) if member else np.zeros(0, np.int64)
    hubs = np.concatenate(hub) if hub else at
    rows = np.unique(np.column_stack((hubs, ids[at], label[at])), axis=0)
    return pa.table({"hub": np.ascontiguousarray(rows[:, 0]), "id": np.ascontiguousarray(rows[:, 1]), "label": np.ascontiguousarray(rows[:, 2]),
                     "apart": rows[:, 0] != rows[:, 2]})


def tile_pairs(members: DataFrame, sets: DataFrame, similar: Similar) -> DataFrame:
    """Hopeful pairs of a hub: those that are apart against all members, in tiles.

    A tile holds about ``TILE`` rows of each side, however large the hub is; only
    pairs that pass ``hopeful_pairs`` become rows.
    """
    tiles = members.groupBy("hub").agg(
        F.ceil(F.sum(F.col("apart").cast("int")) / TILE).alias("rows"), F.ceil(F.count(F.lit(1)) / TILE).alias("columns"))
    full = members.join(sets.select("id", "n_shingles", "sketch"), "id").join(tiles, "hub")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("left"), F.col("rows")).otherwise(F.col("columns")))
    every = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("left"), F.col("columns")).otherwise(F.col("rows")) - 1)
    sides = full.withColumn("left", F.explode(F.when(F.col("apart"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    dealt = sides.select("hub", "id", "label", "n_shingles", "sketch", "left", mine.alias("mine"), F.explode(every).alias("other"))
    tiled = dealt.withColumn("i", F.when(F.col("left"), F.col("mine")).otherwise(F.col("other"))).withColumn(
        "j", F.when(F.col("left"), F.col("other")).otherwise(F.col("mine")))

    def compare(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        one, two = table.filter(pa.array(left)).combine_chunks(), table.filter(pa.array(~left)).combine_chunks()
        if not one.num_rows or not two.num_rows:
            return PAIRS_ARROW.empty_table()
        get = lambda c: (one.column(c).to_numpy(), two.column(c).to_numpy())
        (la, lb), (na, nb), (ia, ib) = get("label"), get("n_shingles"), get("id")
        x, y = np.nonzero((la[:, None] != lb[None, :]) & sized(na[:, None], nb[None, :], similar.percent))
        good = hopeful_pairs(one.column("sketch"), two.column("sketch"), na, nb, x, y, similar)
        x, y = ia[x[good]], ib[y[good]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)}, schema=PAIRS_ARROW)

    # The join by hub satisfies a grouping by hub and tile; a key of its own deals the tiles out.
    return tiled.withColumn("tile", F.xxhash64("hub", "i", "j")).groupBy("tile").applyInArrow(compare, PAIRS).distinct()


def _pair_table(out: list, ids: np.ndarray, size: np.ndarray, similar: Similar) -> pa.Table:
    if not out:
        return PAIRS_ARROW.empty_table()
    x, y = (np.concatenate(v) for v in zip(*out))
    ok = sized(size[x], size[y], similar.percent) & (ids[x] != ids[y])
    x, y = ids[x[ok]], ids[y[ok]]
    pairs = np.unique(np.column_stack((np.minimum(x, y), np.maximum(x, y))), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])}, schema=PAIRS_ARROW)


def promising(pairs: DataFrame, sets: DataFrame, similar: Similar) -> DataFrame:
    """Pairs that pass ``hopeful_pairs``."""
    side = sets.select("id", "sketch", "n_shingles")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, row = (batch.column(c).to_numpy() for c in ("n_one", "n_two")), np.arange(batch.num_rows)
            good = hopeful_pairs(batch.column("one"), batch.column("two"), *n, row, row, similar)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(side.toDF("a", "one", "n_one"), "a").join(side.toDF("b", "two", "n_two"), "b")
    return joined.select("a", "b", "one", "two", "n_one", "n_two").mapInArrow(keep, PAIRS)


def confirmed(pairs: DataFrame, texts: DataFrame, similar: Similar) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [S.bytes_of(batch.column(c)) for c in ("one", "two")]
            good = np.zeros(batch.num_rows, bool)
            weight = np.diff(sides[0][1]) + np.diff(sides[1][1])
            for x, y in S.blocks(weight, BLOCK):
                sets = [shingles(d[o[x] : o[y]], o[x : y + 1] - o[x], similar.width) for d, o in sides]
                n = [np.diff(c) for _, c in sets]
                # Sets are distinct, so a token that stands twice in a pair is shared.
                row = np.concatenate([np.repeat(np.arange(y - x), k) for k in n])
                token = np.concatenate([t for t, _ in sets])
                order = np.lexsort((token, row))
                row, token = row[order], token[order]
                twice = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
                common = np.bincount(row[1:][twice], minlength=y - x)
                good[x:y] = 100 * common >= similar.percent * (n[0] + n[1] - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(texts.toDF("a", "one"), "a").join(texts.toDF("b", "two"), "b")
    return joined.select("a", "b", "one", "two").mapInArrow(check, PAIRS)


def components(links: DataFrame, scratch: tables.Scratch) -> DataFrame:
    """``id, label``: the smallest id that links reach, for every linked id.

    Every round each id takes the smallest label among its neighbours and then its
    label's label, so chains shrink to half; links whose ends agree are dropped.
    """
    both = scratch.keep(links.union(links.select("b", "a")).toDF("id", "other").distinct())
    labels = scratch.keep(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("id").agg(F.min("near").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        moved = scratch.keep(lower.join(jump, "low", "left").select(
            "id", F.least("low", "lower").alias("label"), (F.least("low", "lower") < F.col("label")).alias("moved")))
        done = not moved.where("moved").take(1)
        scratch.drop(labels)
        labels = scratch.keep(moved.select("id", "label"))
        scratch.drop(moved)
        if done:
            scratch.drop(both)
            return labels


def text_digest() -> F.Column:
    """With the doc_id it names a row; rows equal in both are one document."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def near_duplicates(docs: DataFrame, similar: Similar = Similar()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Rows with equal sets form one class before the join, which has a number of its
    own: doc_ids may be null or repeated.  They only give the order (a null one is
    the largest): a component is named by its smallest doc_id.  Classes branch down
    the trees of a ``Forest``, leaves give pairs, sketches drop hopeless pairs and
    full sets confirm links.  The members of a leaf are first compared with one of
    them, then with drawn ones, and those that are still apart with all others, so
    a leaf full of near copies costs few pairs.  A null text and one without words have an empty set, which is
    linked with nothing.  The row with the smallest doc_id is kept, of different texts
    with that doc_id the one with the lowest digest; rows equal in doc_id and text are
    one document and share its fate.  Columns besides ``doc_id`` and ``text`` are ignored.
    """
    return near_rows(docs, similar).drop("digest")


def near_rows(docs: DataFrame, similar: Similar) -> DataFrame:
    """``near_duplicates`` with the ``digest`` of every row."""
    spark = docs.sparkSession
    scratch = tables.Scratch(spark, "near")
    base = docs.select(tables.ordered_id().alias("id"), text_digest().alias("digest"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = scratch.keep(sketches(base, similar))
    classes = rows.where("n_shingles > 0").groupBy("print").agg(F.min(F.struct("id", "digest", "n_shingles", "sketch")).alias("s"))
    # Numbers are given while the table is written; from here on ``id`` is the number of a class.
    numbered = scratch.keep(classes.select("print", F.monotonically_increasing_id().alias("id"), F.col("s.id").alias("doc_id"), "s.digest", "s.n_shingles", "s.sketch"))
    sets = numbered.withColumn("label", F.col("id"))
    n = sets.count()
    forest = Forest(n, similar.percent / 100)
    buckets = max(64, n * len(forest.paths) // 500_000)

    def search(found, labelled: DataFrame) -> DataFrame:
        packed = leaf_rows(labelled.select("id", "n_shingles", "sketch", "label"), forest, buckets).groupBy("slot")
        if found is not mixed_members:
            return promising(packed.applyInArrow(lambda t: found(t, similar), PAIRS).distinct(), sets, similar)
        members = scratch.keep(packed.applyInArrow(mixed_members, MEMBERS).distinct())
        return tile_pairs(members, sets, similar)

    def link(hopeful: DataFrame) -> DataFrame:
        ends = hopeful.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # One text for each class, that of its first row.
        wanted = ends.join(sets.select("id", "doc_id", "digest"), "id")
        texts = base.withColumnRenamed("id", "doc_id").join(wanted, ["doc_id", "digest"]).groupBy("id").agg(F.min("text").alias("text"))
        return scratch.keep(confirmed(hopeful, scratch.keep(texts), similar))

    labelled, links = sets, None
    for found in (first_pairs, drawn_pairs, mixed_pairs, mixed_members):
        pairs = scratch.keep(search(found, labelled))
        if links is not None and not pairs.take(1):
            continue
        new = link(pairs)
        links = new if links is None else scratch.keep(links.union(new))
        labels = components(links, scratch)
        labelled = scratch.keep(sets.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    named = labelled.select("print", "label", F.struct(F.col("doc_id").alias("id"), "digest").alias("own"))
    first = named.groupBy("label").agg(F.min("own").alias("first"))
    # Like the classes, one row each; components are at most as many.
    found = rows.select("id", "digest", "n_shingles", "print").join(named.join(first, "label").select("print", "first"), "print", "left")
    mine = F.struct("id", "digest")
    first = F.coalesce("first", mine)
    return found.select(
        F.nullif("id", F.lit(tables.LAST_ID)).alias("doc_id"), "n_shingles",
        F.nullif(first["id"], F.lit(tables.LAST_ID)).alias("component_id"), (first == mine).alias("kept"), "digest")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tables.documents(spark, sf_dir))
