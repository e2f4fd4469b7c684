"""Vector code compression: product codebooks fitted exactly over Hilbert-sorted flat blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import tables

CANDIDATE_GROUPS = 64
VECTORS_A_TASK = 1 << 15


@dataclass(frozen=True)
class Codec:
    """``parts`` codebooks of ``entries`` entries, ``rounds`` rounds, blocks of ``block`` vectors."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    block: int = 128

    def __post_init__(self):
        if not (1 <= self.parts <= 7 and 1 <= self.entries <= 256 and self.rounds >= 0 and self.block >= 1):
            raise ValueError("at most 7 parts of at most 256 entries: a code is one byte for each part")


@dataclass(frozen=True)
class Kernel:
    """Number type in which every distance is exact: doubles below 2**53, 64-bit integers, else Python's."""

    kind: type

    @staticmethod
    def of(largest: int, width: int) -> Kernel:
        most = width * (2 * largest + 2) ** 2
        return Kernel(np.float64 if most < 2**52 else np.int64 if most < 2**62 else object)

    def distances(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distance of every row of ``x`` from every entry."""
        x, entries = x.astype(self.kind), entries.astype(self.kind)
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


RAW = "row bigint, vec_id bigint, label string, vec binary"
RAW_ARROW = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()), ("vec", pa.binary())])
BLOCK = "part int, n int, rows binary, vecs binary, lo binary, hi binary, sums binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("rows", "vecs", "lo", "hi", "sums")])


def whole_numbers(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Vectors as ``floor(scale * x)``; broken ones are left out."""
    for batch in batches:
        vec = batch.column("embedding")
        right = pc.fill_null(pc.equal(pc.list_value_length(vec), dims), False)
        batch, vec = batch.filter(right), vec.filter(right)
        x = vec.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(vec), dims)
        fine = np.isfinite(x).all(1)
        y = np.floor(x[fine] * scale)
        if len(y) and np.abs(y).max() >= 2.0**62:
            raise OverflowError("a component is too large: squared distances must fit in 64 bits")
        y, batch = y.astype(np.int64), batch.filter(pa.array(fine))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in y], pa.binary())], schema=RAW_ARROW)


def matrix(column: pa.Array | list, width: int) -> np.ndarray:
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), np.int64).reshape(len(values), width)


def ranges(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Least and largest value of every dimension, and the count, as far as one task has seen."""
    lo = hi = None
    n = 0
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("vec"), dims)
            a, b = x.min(0), x.max(0)
            lo, hi = (a, b) if lo is None else (np.minimum(lo, a), np.maximum(hi, b))
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims, dtype=np.int32)), pa.array(lo), pa.array(hi), pa.array(np.full(dims, n))], names=["dim", "lo", "hi", "n"])


def hilbert_keys(x: np.ndarray, bits: int) -> list[bytes]:
    """Place of each point of a grid of ``2**bits`` cells a side on the Hilbert curve, as bytes in that order."""
    axes = [x[:, i].astype(np.uint64) for i in range(x.shape[1])]
    zero = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        side, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(axes)):
            up = (axes[i] & side) != 0
            swap = np.where(up, zero, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(up, axes[0] ^ below, axes[0]) ^ swap
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = zero
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> np.uint64(level)) & np.uint64(1) == 1, turn ^ np.uint64((1 << level) - 1), turn)
    planes = [((a ^ turn) >> np.uint64(level)) & np.uint64(1) for level in range(bits - 1, -1, -1) for a in axes]
    packed = np.packbits(np.stack(planes, 1).astype(np.uint8), axis=1)
    return [k.tobytes() for k in packed]


def keyed_parts(batches: Iterator[pa.RecordBatch], dims: int, parts: int, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every part of every vector with its place on the curve through that part's box."""
    width = dims // parts
    bits = max(1, min(8, 64 // width))
    step = (hi - lo).astype(np.float64) + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column("vec"), dims)
        cells = np.minimum((x - lo) / step * (1 << bits), (1 << bits) - 1).astype(np.int64)
        for p in range(parts):
            own = slice(p * width, (p + 1) * width)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(x), p, np.int32)), pa.array(hilbert_keys(cells[:, own], bits), pa.binary()), batch.column("row"),
                pa.array([v.tobytes() for v in x[:, own]], pa.binary())], names=["part", "key", "row", "vec"])


def flat_blocks(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of ``size`` neighbours on the curve, each one row with its box and its sums."""

    def block(part: int, rows: list[np.ndarray], vecs: list[np.ndarray]) -> list:
        r, x = np.concatenate(rows), np.concatenate(vecs)
        # Sums of a block fit: components are below 2**62 / block, or Python adds them.
        sums = x.sum(0) if np.abs(x).max(initial=0) < 2**48 else np.array([0])
        return [part, len(r), r.tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), sums.tobytes()]

    done: list[list] = []
    part, rows, vecs, have = -1, [], [], 0
    for batch in batches:
        p, r, x = batch.column("part").to_numpy(), batch.column("row").to_numpy(), matrix(batch.column("vec"), width)
        at = 0
        while at < len(p):
            if have and (p[at] != part or have == size):
                done.append(block(part, rows, vecs))
                rows, vecs, have = [], [], 0
            part = int(p[at])
            end = min(int(np.searchsorted(p, part, "right")), at + size - have)
            rows.append(r[at:end])
            vecs.append(x[at:end])
            have, at = have + end - at, end
        if len(done) >= 64:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), BLOCK_ARROW.types)], schema=BLOCK_ARROW)
            done = []
    if have:
        done.append(block(part, rows, vecs))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), BLOCK_ARROW.types)], schema=BLOCK_ARROW)


def nearest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, book: np.ndarray, kernel: Kernel) -> np.ndarray:
    """Index of the nearest entry of every row of a block, ties to the lower index.

    An entry whose least distance from the box is above the least of all entries'
    largest distances from it can be nearest to nothing inside.
    """
    b, low, high = book.astype(kernel.kind), lo.astype(kernel.kind), hi.astype(kernel.kind)
    out = np.maximum(np.maximum(low - b, b - high), 0)
    far = np.maximum(np.abs(b - low), np.abs(b - high))
    short = np.flatnonzero((out * out).sum(1) <= (far * far).sum(1).min())
    if len(short) == 1:
        return np.full(len(x), short[0])
    return short[np.argmin(kernel.distances(x, book[short]), axis=1)]


def each_block(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for row in batch.to_pylist():
            numbers = {c: np.frombuffer(row[c], np.int64) for c in ("rows", "vecs", "lo", "hi", "sums")}
            yield row["part"], numbers["rows"], numbers["vecs"].reshape(-1, width), numbers["lo"], numbers["hi"], numbers["sums"]


def entry_sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int, kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """One round, task side: count and sums of the parts that each entry got, ``dim`` -1 for the count."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for part, _, x, lo, hi, sums in each_block(batches, width):
        entry = nearest(x, lo, hi, books[part], kernel)
        if (entry == entry[0]).all() and len(sums) == width:  # the block's own sums, nothing is added up
            got = [(int(entry[0]), len(x), sums)]
        else:
            order = np.argsort(entry, kind="stable")
            cuts = np.flatnonzero(np.diff(entry[order], prepend=-1))
            wide = x if kernel.kind is not object else x.astype(object)
            each = np.add.reduceat(wide[order], cuts, axis=0)
            got = list(zip(entry[order][cuts].tolist(), np.diff(np.append(cuts, len(x))).tolist(), each))
        for e, n, s in got:
            row = np.array([n, *s.tolist()], object)
            total[part, e] = total[part, e] + row if (part, e) in total else row
    if total:
        keys = np.repeat(np.array(list(total), np.int32), width + 1, axis=0)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.tile(np.arange(-1, width, dtype=np.int32), len(total))),
            pa.array([str(v) for row in total.values() for v in row], pa.string())], names=["part", "entry", "dim", "s"])


def coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int, kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """Last assignment: entry and exact squared distance of every part."""
    for part, rows, x, lo, hi, _ in each_block(batches, width):
        entry = nearest(x, lo, hi, books[part], kernel)
        gap = x.astype(kernel.kind) - books[part][entry].astype(kernel.kind)
        error = (gap * gap).sum(1)
        yield pa.RecordBatch.from_arrays([
            pa.array(rows), pa.array(np.full(len(rows), part, np.int32)), pa.array(entry.astype(np.int64)),
            pa.array([int(e) for e in error], pa.int64())], names=["row", "part", "entry", "error"])


@dataclass
class Coded:
    """``codes`` has ``vec_id, label, code, error``; ``books`` one integer array for each part."""

    codes: DataFrame
    books: list[np.ndarray]

    def books_sha256(self) -> str:
        numbers = ",".join(str(int(v)) for book in self.books for v in book.ravel())
        return hashlib.sha256(numbers.encode()).hexdigest()


def first_vectors(rows: DataFrame, n: int) -> list[bytes]:
    """Vectors of the ``n`` smallest vec_ids.

    Candidates are reduced in groups on the executors, so that the driver gets
    ``CANDIDATE_GROUPS * n`` short rows at most, however many partitions there are.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("vec"), F.col("row")]
    group = Window.partitionBy(F.pmod(F.xxhash64("row"), F.lit(CANDIDATE_GROUPS))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= n)
    return [bytes(r.vec) for r in few.orderBy(*order).limit(n).collect()]


def compress(vectors: DataFrame, codec: Codec = Codec()) -> Coded:
    """Codes of all vectors of ``vectors`` (columns ``vec_id, embedding, label``).

    Components become ``floor(scale * x)``.  Each part of the vectors is sorted
    along a Hilbert curve and cut into flat blocks, written once with their box and
    sums.  A round reads the blocks: the distances between box and entries leave a
    short list of entries, an exact integer kernel decides among them, and a block
    with one entry on its list hands over its stored sums.  Only sums by entry
    (``parts * entries`` rows) reach the driver, which makes the next codebook and
    sends it to the tasks; its size is bounded by ``parts * entries * dims``.

    Left out are vectors that are null or empty, hold null or non-finite components,
    or are not of the commonest length (the shorter one of two).  A null vec_id counts as the
    largest and comes back as null; rows that share a vec_id are coded one by one.
    Columns besides the three are ignored.  Of an empty table the codebooks are empty.
    A common length that ``parts`` does not divide raises ``ValueError``.
    """
    spark = vectors.sparkSession
    scratch = tables.Scratch(spark, "vectors")
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    common = base.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common.dims if common else codec.parts
    if dims % codec.parts:
        raise ValueError(f"{dims} components do not make {codec.parts} equal parts")
    width = dims // codec.parts
    rows = scratch.keep(
        base.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "embedding")
        .mapInArrow(lambda it: whole_numbers(it, dims, codec.scale), RAW))
    seen = rows.select("vec").mapInArrow(lambda it: ranges(it, dims), "dim int, lo bigint, hi bigint, n bigint")
    box = seen.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).orderBy("dim").collect()
    if not box:
        return Coded(rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), [np.zeros((0, width), np.int64)] * codec.parts)
    lo, hi = (np.array([r[c] for r in box], np.int64) for c in ("lo", "hi"))
    kernel = Kernel.of(max(abs(int(lo.min())), abs(int(hi.max()))), width)

    start = np.stack([np.frombuffer(v, np.int64) for v in first_vectors(rows, codec.entries)])
    books = [start[:, p * width : (p + 1) * width] for p in range(codec.parts)]
    tasks = max(8, -(-box[0].n * codec.parts // VECTORS_A_TASK))
    blocks = scratch.keep(
        rows.select("row", "vec").mapInArrow(lambda it: keyed_parts(it, dims, codec.parts, lo, hi), "part int, key binary, row bigint, vec binary")
        # The row number ends the sort key: a vector that a third of all rows share is dealt to many tasks.
        .repartitionByRange(tasks, "part", "key", "row").sortWithinPartitions("part", "key", "row")
        .mapInArrow(lambda it: flat_blocks(it, width, codec.block), BLOCK))
    for _ in range(codec.rounds):
        now = books
        sums = blocks.mapInArrow(lambda it: entry_sums(it, now, width, kernel), "part int, entry int, dim int, s string")
        total = sums.groupBy("part", "entry", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        at = {(r.part, r.entry, r.dim): int(r.s) for r in total}
        books = [b.copy() for b in now]
        for (p, e, d), s in at.items():
            if d >= 0:
                books[p][e, d] = s // at[p, e, -1]
    parts = blocks.mapInArrow(lambda it: coded(it, books, width, kernel), "row bigint, part int, entry bigint, error bigint")
    place = F.lit(codec.parts - 1) - F.col("part")
    joined = parts.groupBy("row").agg(
        F.sum(F.col("entry") * F.pow(F.lit(256), place).cast("bigint")).alias("code"), F.sum("error").alias("error"))
    codes = rows.select("row", "vec_id", "label").join(joined, "row").select(
        "vec_id", "label", F.lower(F.lpad(F.hex("code"), 2 * codec.parts, "0")).alias("code"), "error")
    return Coded(scratch.keep(codes), books)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compress(tables.documents(spark, sf_dir, "embeddings"))
    by_label = done.codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return done.codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(done.books_sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by brute force: all distances, ``Codec()`` spelled out."""
    steps = ["""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS v FROM kept, (SELECT unnest(range(4)) AS p)),
book0 AS MATERIALIZED (
  SELECT p, i, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM parts) WHERE i < 256)"""]
    for k in range(5):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(v) AS v, min(d * 256 + i) AS best FROM (
    SELECT x.vec_id, x.label, x.p, x.v, b.i, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts x JOIN book{k} b ON x.p = b.p) GROUP BY vec_id, label, p)""")
        if k < 4:
            steps.append(f"""
sums{k} AS (
  SELECT p, i, list(m ORDER BY j) AS v FROM (
    SELECT p, i, j, CAST((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (
      SELECT p, best % 256 AS i, unnest(v) AS c, unnest(range(len(v))) AS j FROM near{k}) GROUP BY p, i, j) GROUP BY p, i),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(s.v, b.v) AS v FROM book{k} b LEFT JOIN sums{k} s ON b.p = s.p AND b.i = s.i)""")
    return "WITH " + ",".join(steps) + """,
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(best % 256 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM near4 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) FROM book4) AS codebooks_sha256
FROM coded
"""


OP11_SQL = _sql()
