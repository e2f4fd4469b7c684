"""Passes over the windows of a corpus: which hashes do two documents have?

Documents lie in *blocks*, written once in the order they were read and named by
reading task and number, so a doc_id that many rows share (or lack) makes no
larger block.  In each pass a block sends the distinct hashes of its candidate
windows, sorted and packed by hash range; the range answers each block with those
that another document has as well.  A window that a third of all documents share
costs one record for each block.  No position and no text travels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import symbols as S
from tidemark.llm.repeats import runs
from tidemark.llm.tables import Scratch, ordered_id, text_bytes

BLOCK = 4 << 20  # bytes of text in a block
RANGE = 4 << 20  # bytes of all text for each hash range
PIECE = 1 << 19  # bytes of text hashed at once
KEEP = np.uint64(16)  # low bits of a hash that only the last pass sends

BLOCKS = "block bigint, doc_ids binary, sizes binary, body binary, n_bytes bigint"
BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary()), ("n_bytes", pa.int64())])
SETS = "block bigint, slot bigint, hashes binary, low binary, many binary, owners binary"
SETS_ARROW = pa.schema([("block", pa.int64()), ("slot", pa.int64())] + [(c, pa.binary()) for c in ("hashes", "low", "many", "owners")])


def packed(values: np.ndarray) -> bytes:
    """Rising unsigned values as differences of as few bytes as the largest needs."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : raw[0]] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array, place by place, so that places of zeros compress away."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(kind).ravel()


def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as compressed blocks, one row each."""
    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids, sizes, data = (np.concatenate(x) for x in zip(*held))
        body = pa.compress(data, "zstd", asbytes=True) if len(data) else b""
        return pa.RecordBatch.from_arrays([
            pa.array([(task << 32) + number], pa.int64()), pa.array([planes(ids)], pa.binary()), pa.array([planes(sizes)], pa.binary()),
            pa.array([body], pa.binary()), pa.array([len(data)], pa.int64())], schema=BLOCKS_ARROW)

    for batch in batches:
        data, offsets = S.bytes_of(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        for x, y in S.blocks(np.diff(offsets), BLOCK // 8):
            held.append((ids[x:y], np.diff(offsets[x : y + 1]), data[offsets[x] : offsets[y]]))
            size += int(offsets[y] - offsets[x])
            if size >= BLOCK:
                yield flush()
                held, size, number = [], 0, number + 1
    if held:
        yield flush()


def opened(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of the documents of one block."""
    at = {c: row.column(c)[0].as_py() for c in ("doc_ids", "sizes", "body", "n_bytes")}
    body = pa.decompress(at["body"], at["n_bytes"], "zstd", asbytes=True) if at["n_bytes"] else b""
    sizes = from_planes(at["sizes"], np.int64)
    return from_planes(at["doc_ids"], np.int64), np.frombuffer(body, np.uint8), np.concatenate(([0], np.cumsum(sizes)))


class Piece:
    """Symbols of some documents of a block; hashes of their windows by length."""

    def __init__(self, values: Callable[[int], np.ndarray], starts: np.ndarray, docs: np.ndarray):
        self.values, self.starts, self.docs, self._sums = values, starts, docs, {}
        size = np.diff(starts)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.left = np.repeat(starts[1:], size) - np.arange(len(self.doc))  # symbols to the end of the document

    def hashes(self, length: int, at: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """Of the windows from positions ``at`` (all of those that fit into the block)."""
        if seed not in self._sums:
            self._sums[seed] = S.prefix_sums(self.values(seed), seed)
        if at is None:
            return S.gram_hash(self._sums[seed], length, seed)
        return S.span_hash(self._sums[seed], at, at + length, seed)

    def fits(self, length: int) -> np.ndarray:
        """Positions from which ``length`` symbols stand in one document."""
        return np.flatnonzero(self.left >= length)


def word_pieces(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[Piece]:
    for x, y in S.blocks(np.diff(offsets), PIECE):
        block, here = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
        starts, ends, first = S.word_spans(block, here)
        yield Piece(lambda seed, b=block, s=starts, e=ends: S.word_hashes(b, s, e, seed), first, np.arange(x, y))


class Known:
    """The answers that one block got, for lookups."""

    def __init__(self, answers: pa.Table):
        rows = [unpacked(h) for h in answers.column("hashes").to_pylist()]
        hashes = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        # A table of 2**22 marks spares most positions the binary search.
        self.marks = np.zeros(1 << 22, bool)
        self.marks[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the first equal answer, -1 without one."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.marks[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)]) if len(self.hashes) else out[:0]
        place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[maybe] if len(maybe) else np.zeros(0, bool)
        out[maybe[hit]] = place[hit]
        return out


class Owners(Known):
    """Answers of the last pass: windows, 96 bits each, and the first document of each."""

    def __init__(self, answers: pa.Table):
        super().__init__(answers)
        low = [from_planes(x, np.uint32) for x in answers.column("low").to_pylist()]
        owners = [from_planes(x, np.int64) for x in answers.column("owners").to_pylist()]
        self.low = np.concatenate(low)[self.order] if low else np.zeros(0, np.uint32)
        self.owners = np.concatenate(owners)[self.order] if owners else np.zeros(0, np.int64)

    def before(self, hashes: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """True for windows that a document with a smaller id than ``ids`` has."""
        place = self.find(hashes)
        open_, out = np.flatnonzero(place >= 0), np.zeros(len(hashes), bool)
        place = place[open_]
        while len(open_):  # once, unless two windows share 64 bits
            same = self.low[place] == low[open_]
            out[open_[same]] = self.owners[place[same]] < ids[open_[same]]
            more = ~same & (place + 1 < len(self.hashes))
            more[more] = self.hashes[place[more] + 1] == hashes[open_[more]]
            open_, place = open_[more], place[more] + 1
        return out


def slots(hashes: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Range of each hash of ``bits`` bits; rises with the hash."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def set_rows(block: int, hashes: np.ndarray, bits: int, ranges: int, low: np.ndarray | None = None,
             many: np.ndarray | None = None, owners: np.ndarray | None = None) -> pa.Table:
    """Sorted hashes as one row for each range."""
    slot = slots(hashes, bits, ranges)
    cuts = np.flatnonzero(np.diff(slot, prepend=-1))
    ends = np.append(cuts[1:], len(slot))[: len(cuts)]
    spans = list(zip(cuts.tolist(), ends.tolist()))
    extra = [pa.array([None if v is None else planes(v[x:y]) for x, y in spans], pa.binary()) for v in (low, many, owners)]
    return pa.Table.from_arrays([pa.array(np.full(len(cuts), block, np.int64)), pa.array(slot[cuts]),
                                 pa.array([packed(hashes[x:y]) for x, y in spans], pa.binary()), *extra], schema=SETS_ARROW)


def shared_rows(block: int, hashes: np.ndarray, rows: np.ndarray, ranges: int) -> pa.Table:
    """Windows of a pass that is not the last: 48 bits each, and whether two documents of the block have it."""
    order = np.argsort(hashes, kind="stable")  # of equal hashes the documents stay in order
    hashes, rows = hashes[order], rows[order]
    head = np.flatnonzero(runs(hashes))
    last = np.append(head[1:], len(hashes))[: len(head)] - 1
    return set_rows(block, hashes[head], 48, ranges, many=(rows[head] != rows[last]).astype(np.uint8))


def owner_rows(block: int, hashes: np.ndarray, low: np.ndarray, ids: np.ndarray, ranges: int) -> pa.Table:
    """Windows of the last pass: 96 bits each, their first document in the block."""
    order = np.lexsort((ids, low, hashes))
    hashes, low, ids = hashes[order], low[order], ids[order]
    head = runs(hashes, low)
    # Whether a later document of the block has it too: of equal windows the largest id comes last.
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(ids))[: len(first)] - 1
    return set_rows(block, hashes[first], 64, ranges, low[first], (ids[first] != ids[last]).astype(np.uint8), ids[first])


def judge(table: pa.Table, last: bool) -> pa.Table:
    """One range of hashes: to each block, those of its hashes that another document has.

    The last pass names the smallest doc_id with each window, and is silent to a
    block that holds only that one.
    """
    lists = [unpacked(h) for h in table.column("hashes").to_pylist()]
    hashes = np.concatenate(lists)
    many = np.concatenate([from_planes(m, np.uint8) for m in table.column("many").to_pylist()]) > 0
    low = owners = None
    if last:
        low = np.concatenate([from_planes(x, np.uint32) for x in table.column("low").to_pylist()])
        ids = np.concatenate([from_planes(x, np.int64) for x in table.column("owners").to_pylist()])
        order = np.lexsort((ids, low, hashes))
        head = runs(hashes[order], low[order])
        owners = np.empty(len(ids), np.int64)
        owners[order] = ids[order][head][np.cumsum(head) - 1]
        told = many | (ids > owners)
    else:
        order = np.argsort(hashes, kind="stable")
        head = runs(hashes[order])
        which = np.cumsum(head) - 1
        told = np.empty(len(hashes), bool)
        told[order] = (np.bincount(which) > 1)[which] | (np.bincount(which, many[order]) > 0)[which]
    ends = np.cumsum([len(x) for x in lists])
    out: list[list] = [[], [], [], []]
    for block, x, y in zip(table.column("block").to_pylist(), ends - [len(x) for x in lists], ends):
        say = np.flatnonzero(told[x:y]) + x
        if len(say):
            for column, value in zip(out, (block, packed(hashes[say]), None if low is None else planes(low[say]),
                                           None if owners is None else planes(owners[say]))):
                column.append(value)
    n = len(out[0])
    return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array([0] * n, pa.int64()), pa.array(out[1], pa.binary()),
                                 pa.array(out[2], pa.binary()), pa.array([None] * n, pa.binary()), pa.array(out[3], pa.binary())], schema=SETS_ARROW)


class Passes:
    """Blocks of ``docs`` (``doc_id``, ``text``) and the passes made over them."""

    def __init__(self, docs: DataFrame, name: str):
        self.scratch = Scratch(docs.sparkSession, name)
        base = docs.select(ordered_id().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
        self.ranges = max(64, text_bytes(docs) // RANGE)  # size of a range's group, whatever the corpus holds
        self.blocks = self.scratch.keep(base.mapInArrow(lay_out, BLOCKS))
        self.answers: DataFrame | None = None

    def run(self, ask: Callable[[pa.Table, pa.Table], pa.Table], last: bool = False) -> None:
        """``ask(block, answers)`` of every block to the ranges; their answers replace the former ones."""
        sent = self.read(ask, SETS)
        heard = self.scratch.keep(sent.groupBy("slot").applyInArrow(lambda t: judge(t, last), SETS))
        if self.answers is not None:
            self.scratch.drop(self.answers)
        self.answers = heard

    def read(self, task: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``task(block, answers)`` of every block."""
        if self.answers is None:
            nothing = SETS_ARROW.empty_table()

            def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        yield from task(pa.Table.from_batches([batch.slice(i, 1)]), nothing).to_batches()

            return self.blocks.mapInArrow(alone, schema)
        return self.blocks.groupBy("block").cogroup(self.answers.groupBy("block")).applyInArrow(
            lambda b, a: task(b, a), schema)


CUT = "doc_id bigint, text binary, n_symbols bigint, n_removed bigint, starts array<bigint>, ends array<bigint>"
CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_symbols", pa.int64()), ("n_removed", pa.int64()),
                       ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def covered(n: int, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``n`` symbols, which lie in a window from ``starts``; the maximal runs of them."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    gone = np.concatenate(([0], (np.cumsum(edge[:n]) > 0).astype(np.int8), [0]))
    turn = np.diff(gone)
    return gone[1:-1] > 0, np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
