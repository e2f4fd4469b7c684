"""Repeated windows of a corpus, found without sending every window.

A *window* is ``length`` consecutive symbols (bytes or words) of one document.
Every window contains an *anchor*: the gram of ``gram`` symbols with the lowest
hash in it.  Equal windows have equal anchors, and neighbouring windows mostly
share one, so only about two of ``length - gram + 2`` positions are sent.

1. *First pass.*  Each document sends its anchors.  An anchor that no other
   document has ends here: none of its windows can be repeated.
2. *Second pass.*  All windows of one anchor form a *span*.  If an earlier
   document has the same span, all its windows are repeated at once.
3. *Third pass.*  The first holder of each span whose anchor also stands in other
   spans sends its windows one by one; the first document of a window owns it.

Passes one and two travel together.  Records of a block of documents are packed
into one binary row for each bucket, and equal records of a block are merged
before they travel, so a window that a third of all documents share costs one
record for each block.  Equality is decided by more than 96 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import symbols as S
from tidemark.llm.tables import Scratch, ordered_id, text_bytes

BLOCK = 1 << 19
EMIT = 16 << 20
PART = 8 << 20
PACKED = "slot int, kind int, a binary, b binary, c binary, d binary"
PACKED_ARROW = pa.schema([("slot", pa.int32()), ("kind", pa.int32())] + [(c, pa.binary()) for c in "abcd"])
BY_ANCHOR, BY_SPAN, KNOWN, WINDOW, COVER = range(5)
COVERED, OWNER = 1, 2


@dataclass(frozen=True)
class Scan:
    """What to look for: ``kind`` is ``bytes`` or ``words``."""

    kind: str
    length: int
    gram: int

    def read(self, data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Symbol values of a block and each document's first symbol."""
        if self.kind == "bytes":
            return S.byte_values(seed)[data], offsets
        starts, ends, first = S.word_spans(data, offsets)
        return S.word_hashes(data, starts, ends, seed), first


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Bytes of an array, most of them zero where ``values`` are rising ids."""
    if delta:
        values = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpack(rows: list[bytes], kind: type, delta: bool = False) -> np.ndarray:
    out = []
    for raw in rows:
        planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
        values = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(np.cumsum(values, dtype=kind) if delta else values)
    return np.concatenate(out) if out else np.zeros(0, kind)


def rows_by(slot: np.ndarray, kind: int, ids: np.ndarray, a: np.ndarray, b: np.ndarray | None = None,
            c: np.ndarray | None = None) -> pa.RecordBatch:
    """One packed row for each slot: ``a b c`` as they are, the ids last."""
    order = np.lexsort((ids, slot))
    slot = slot[order]
    cuts = np.flatnonzero(np.diff(slot, prepend=-1)) if len(slot) else np.zeros(0, int)
    ends = np.append(cuts[1:], len(slot))
    columns = []
    for values in (a, b, c):
        values = None if values is None else values[order]
        columns.append(pa.array([None if values is None else pack(values[x:y]) for x, y in zip(cuts, ends)], pa.binary()))
    ids = ids[order]
    columns.append(pa.array([pack(ids[x:y], True) for x, y in zip(cuts, ends)], pa.binary()))
    head = [pa.array(slot[cuts].astype(np.int32)), pa.array(np.full(len(cuts), kind, np.int32))]
    return pa.RecordBatch.from_arrays(head + columns, schema=PACKED_ARROW)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """Where the answers for a document go; also where its text goes."""
    x = ids.astype(np.uint64)
    return ((S.mix(x) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


@dataclass
class Anchors:
    """Anchors of a block: document row, gram and span hash, windows ``first..last``."""

    doc: np.ndarray
    gram: np.ndarray
    span: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(values: np.ndarray, starts: np.ndarray, scan: Scan) -> tuple[Anchors, np.ndarray]:
    """Anchors of a block and its prefix sums."""
    sums = S.prefix_sums(values)
    grams = S.gram_hash(sums, scan.gram)
    width, have, low = scan.length - scan.gram + 1, 1, np.uint64(63)
    empty = np.zeros(0, np.int64)
    if len(grams) < width:
        return Anchors(empty, grams[:0], grams[:0], empty, empty), sums
    # The place in the document modulo 64 rides in the low bits (windows are at most
    # that wide): it decides ties alike whatever block the document is in.
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(doc)) - starts[:-1][doc]
    best = (grams & ~low) | (place[: len(grams)].astype(np.uint64) & low)
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    doc = doc[: len(best)]
    at = np.flatnonzero(np.arange(len(best)) + scan.length <= starts[1:][doc])
    anchor = at + (((best[at] & low).astype(np.int64) - place[at]) & 63)
    doc = doc[at]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    first, last = at[new], at[np.append(new[1:], len(at))[: len(new)] - 1]
    span = S.span_hash(sums, first, last + scan.length)
    return Anchors(doc[new], grams[anchor[new]], span, first, last), sums


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted arrays differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def asks(batches: Iterator[pa.RecordBatch], scan: Scan, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """First and second pass, task side: what each block wants to know."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        gram, span, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, span, gram))
        gram, span, ids = gram[order], span[order], ids[order]
        # A block knows for itself that the later holders of a span are covered.
        head = runs(gram, span)
        owner = ids[head][np.cumsum(head) - 1] if len(ids) else ids
        known = ids > owner
        if known.any():
            to = part_of(ids[known], parts)
            for row in _split(rows_by(to, KNOWN, ids[known], span[known], np.full(known.sum(), COVERED, np.uint8)), buckets):
                yield row
        gram, span, ids = gram[head], span[head], ids[head]
        # An anchor with several spans in this block needs no vote of others: its
        # spans go by their own hash, and one record tells the anchor's bucket.
        group = runs(gram)
        which = np.cumsum(group) - 1
        many = np.bincount(which)[which] > 1 if len(gram) else np.zeros(0, bool)
        if many.any():
            yield rows_by(_slot(span[many], buckets), BY_SPAN, ids[many], span[many], _low(gram[many]))
        tell = group | ~many
        yield rows_by(_slot(gram[tell], buckets), BY_ANCHOR, ids[tell], span[tell], _low(gram[tell]), many[tell].astype(np.uint8))

    for batch in batches:
        data, offsets = S.bytes_of(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        for x, y in S.blocks(np.diff(offsets), BLOCK):
            values, starts = scan.read(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            found, _ = anchors(values, starts, scan)
            if len(found.doc):
                held.append((found.gram, found.span, ids[x:y][found.doc]))
            size += int(offsets[y] - offsets[x])
            if size >= EMIT and held:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _split(batch: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows already addressed to a part travel through any bucket: the part goes to ``kind``."""
    part = batch.column("slot").to_numpy()
    kind = batch.column("kind").to_numpy() | ((part + 1) << 3)
    slot = ((S.mix(part.astype(np.uint64) + np.uint64(len(batch.column("a")[0].as_py()))) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(kind.astype(np.int32)), *batch.columns[2:]], schema=PACKED_ARROW)


def _slot(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _of(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array((table.column("kind").to_numpy() & 7) == kind))


def _pass_on(table: pa.Table, kind: int) -> pa.Table:
    """Rows for a part that a bucket only hands on."""
    mine = _of(table, kind)
    whole = mine.column("kind").to_numpy()
    return pa.Table.from_arrays(
        [pa.array(((whole >> 3) - 1).astype(np.int32)), pa.array((whole & 7).astype(np.int32)), *mine.columns[2:]], schema=PACKED_ARROW)


def _columns(table: pa.Table, *kinds: type | None) -> list[np.ndarray]:
    out = [unpack(table.column(c).to_pylist(), k) for c, k in zip("abc", kinds) if k is not None]
    return out + [unpack(table.column("d").to_pylist(), np.int64, True)]


def judge_spans(table: pa.Table, parts: int) -> pa.Table:
    """First and second pass, bucket side: which spans are covered, which must be looked into."""
    out = [_pass_on(table, KNOWN)]
    span, gram, many, ids = _columns(_of(table, BY_ANCHOR), np.uint64, np.uint32, np.uint8)
    order = np.lexsort((ids, span, gram))
    span, gram, many, ids = span[order], gram[order], many[order], ids[order]
    head, group = runs(gram, span), runs(gram)
    out += _answers(span, ids, head, group, many > 0, parts)
    span, gram, ids = _columns(_of(table, BY_SPAN), np.uint64, np.uint32)
    order = np.lexsort((ids, gram, span))
    span, gram, ids = span[order], gram[order], ids[order]
    head = runs(span, gram)
    out += _answers(span, ids, head, head, np.ones(len(span), bool), parts)
    return pa.concat_tables(out)


def _answers(span, ids, head, group, many, parts) -> list[pa.Table]:
    if not len(span):
        return []
    owner = ids[head][np.cumsum(head) - 1]
    which = np.cumsum(group) - 1
    split = (np.bincount(which, head) > 1) | (np.bincount(which, many) > 0)
    state = np.where(ids > owner, COVERED, np.where(split[which], OWNER, 0)).astype(np.uint8)
    say = state > 0
    return [pa.Table.from_batches([rows_by(part_of(ids[say], parts), KNOWN, ids[say], span[say], state[say])], PACKED_ARROW)]


def _keyed(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return S.mix(hashes + ids.astype(np.uint64) * np.uint64(S.BASE))


TEXTS = "slot int, doc_ids binary, sizes binary, body binary, n_bytes bigint"
TEXTS_ARROW = pa.schema([("slot", pa.int32()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary()), ("n_bytes", pa.int64())])


def texts_by_part(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Compressed texts, one row for each part and ``EMIT`` bytes of input."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("doc_id").to_numpy()
        part = part_of(ids, parts)
        order = np.argsort(part, kind="stable")
        data, offsets = S.bytes_of(table.column("text").combine_chunks().cast(pa.large_binary()).take(pa.array(order)))
        ids, part, sizes = ids[order], part[order], np.diff(offsets)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cuts[1:], len(part))[: len(cuts)]
        bodies = [data[offsets[x] : offsets[y]] for x, y in zip(cuts, ends)]
        return pa.RecordBatch.from_arrays([
            pa.array(part[cuts].astype(np.int32)),
            pa.array([pack(ids[x:y], True) for x, y in zip(cuts, ends)], pa.binary()),
            pa.array([pack(sizes[x:y]) for x, y in zip(cuts, ends)], pa.binary()),
            pa.array([pa.compress(b, "zstd", asbytes=True) if len(b) else b"" for b in bodies], pa.binary()),
            pa.array([len(b) for b in bodies], pa.int64())], schema=TEXTS_ARROW)

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= EMIT:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def texts_of(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of the documents of one part."""
    sizes = unpack(docs.column("sizes").to_pylist(), np.int64)
    bodies = [pa.decompress(b, n, "zstd", asbytes=True) for b, n in zip(docs.column("body").to_pylist(), docs.column("n_bytes").to_pylist()) if n]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    return unpack(docs.column("doc_ids").to_pylist(), np.int64, True), data, np.concatenate(([0], np.cumsum(sizes)))


AT = 32  # bits of a position; above them stands which of the texts of its doc_id it is in


def text_ranks(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rank of each text among the different texts of its doc_id, by digest, in whatever order the rows come.

    All rows of a doc_id are in one part, so rank and doc_id name a text.
    """
    out = np.zeros(len(ids), np.int64)
    names, which, counts = np.unique(ids, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[which] > 1)
    groups: dict[int, dict[bytes, list[int]]] = {}
    for i in again.tolist():
        digest = hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest()
        groups.setdefault(int(which[i]), {}).setdefault(digest, []).append(i)
    for group in groups.values():
        for rank, digest in enumerate(sorted(group)):
            out[group[digest]] = rank
    return out


def look_into(docs: pa.Table, answers: pa.Table, scan: Scan, buckets: int, parts: int) -> pa.Table:
    """Third pass, task side: covered spans, and windows of the spans' first holders."""
    out = [PACKED_ARROW.empty_table()]
    span, state, ids = _columns(answers, np.uint64, np.uint8)
    if not len(span) or not docs.num_rows:
        return out[0]
    key = _keyed(span, ids)
    order = np.argsort(key, kind="stable")
    key, state = key[order], state[order]
    doc_ids, data, offsets = texts_of(docs)
    ranks = text_ranks(doc_ids, data, offsets)
    cover: list[tuple[np.ndarray, ...]] = []
    fine: list[tuple[np.ndarray, ...]] = []
    for x, y in S.blocks(np.diff(offsets), BLOCK):
        block, here = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
        values, starts = scan.read(block, here)
        found, sums = anchors(values, starts, scan)
        if not len(found.doc):
            continue
        who = doc_ids[x:y][found.doc]
        want = _keyed(found.span, who)
        place = np.minimum(np.searchsorted(key, want), len(key) - 1)
        verdict = np.where(key[place] == want, state[place], 0)
        at = found.first - starts[found.doc] + (ranks[x:y][found.doc] << AT)
        hit = verdict == COVERED
        cover.append((who[hit], at[hit], (found.last - found.first)[hit] + scan.length))
        owners = np.flatnonzero(verdict == OWNER)
        if len(owners):
            counts = (found.last - found.first)[owners] + 1
            which = np.repeat(owners, counts)
            step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            p = found.first[which] + step
            other = S.prefix_sums(scan.read(block, here, 1)[0], 1)
            fine.append((S.span_hash(sums, p, p + scan.length), _low(S.span_hash(other, p, p + scan.length, 1)), who[which], at[which] + step))
    if cover:
        who, at, size = (np.concatenate(v) for v in zip(*cover))
    else:
        who = at = size = np.zeros(0, np.int64)
    if fine:
        one, two, owner, where = (np.concatenate(v) for v in zip(*fine))
        order = np.lexsort((owner, two, one))
        one, two, owner, where = one[order], two[order], owner[order], where[order]
        head = runs(one, two)
        first = owner[head][np.cumsum(head) - 1]
        later = owner > first
        who, at = np.append(who, owner[later]), np.append(at, where[later])
        size = np.append(size, np.full(later.sum(), scan.length))
        same = ~later
        out.append(pa.Table.from_batches([rows_by(_slot(one[same], buckets), WINDOW, owner[same], one[same], two[same], where[same])]))
    if len(who):
        batch = rows_by(part_of(who, parts), COVER, who, at.astype(np.int64), size.astype(np.int64))
        out.append(pa.Table.from_batches(list(_split(batch, buckets)), PACKED_ARROW))
    return pa.concat_tables(out)


def judge_windows(table: pa.Table, scan: Scan, parts: int) -> pa.Table:
    """Third pass, bucket side: every window but those of its first document is repeated."""
    one, two, where, ids = _columns(_of(table, WINDOW), np.uint64, np.uint32, np.int64)
    order = np.lexsort((ids, two, one))
    one, two, where, ids = one[order], two[order], where[order], ids[order]
    head = runs(one, two)
    later = ids > ids[head][np.cumsum(head) - 1] if len(ids) else np.zeros(0, bool)
    where, ids = where[later], ids[later]
    answer = rows_by(part_of(ids, parts), COVER, ids, where, np.full(len(ids), scan.length, np.int64))
    return pa.concat_tables([_pass_on(table, COVER), pa.Table.from_batches([answer], PACKED_ARROW)])


CUT = "doc_id bigint, text binary, n_symbols bigint, n_removed bigint, starts array<bigint>, ends array<bigint>"
CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_symbols", pa.int64()), ("n_removed", pa.int64()),
                       ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def cut(docs: pa.Table, answers: pa.Table, scan: Scan) -> pa.Table:
    """Take the covered symbols out of each text; spans are in symbols of the input."""
    at, size, ids = _columns(answers, np.int64, np.int64)
    order = np.lexsort((at, ids))
    at, size, ids = at[order], size[order], ids[order]
    who, data, offsets = texts_of(docs)
    ranks = text_ranks(who, data, offsets)
    lows, highs = np.searchsorted(ids, who), np.searchsorted(ids, who, "right")
    rows: list[list] = [[], [], [], [], [], []]
    for i, doc in enumerate(who):
        body = data[offsets[i] : offsets[i + 1]]
        words = body.tobytes().split() if scan.kind == "words" else None
        n = len(body) if words is None else len(words)
        starts = ends = np.zeros(0, np.int64)
        # Rows that share doc_id and text share their answers.
        low, high = lows[i] + np.searchsorted(at[lows[i] : highs[i]], [ranks[i] << AT, (ranks[i] + 1) << AT])
        if high > low:
            mine, width = at[low:high] - (ranks[i] << AT), size[low:high]
            edge = np.bincount(mine, minlength=n + 1) - np.bincount(mine + width, minlength=n + 1)
            gone = np.concatenate(([0], (np.cumsum(edge[:n]) > 0).astype(np.int8), [0]))
            turn = np.diff(gone)
            starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            if words is None:
                kept = body[gone[1:-1] == 0].tobytes()
            else:
                kept = b" ".join([w for w, g in zip(words, gone[1:-1].tolist()) if not g])
        else:
            kept = body.tobytes() if words is None else b" ".join(words)
        for column, value in zip(rows, (doc, kept, n, int((ends - starts).sum()), starts, ends)):
            column.append(value)
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(rows, CUT_ARROW.types)], schema=CUT_ARROW)


def cut_repeats(docs: DataFrame, scan: Scan) -> DataFrame:
    """``doc_id, text, n_symbols, n_removed, starts, ends`` of every row of ``docs``.

    ``text`` is what is left (for words: joined by one space), ``starts`` and
    ``ends`` the maximal removed runs.  A null text counts as empty.  A null
    doc_id counts as larger than all others and comes back as null.  Rows with
    one doc_id never remove from each other.  Columns besides ``doc_id`` and
    ``text`` are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    base = docs.select(ordered_id().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = text_bytes(docs)
    # Sizes of one group in one task, whatever the corpus holds.
    parts = max(64, total // PART)
    buckets = max(64, total // PART)

    sent = base.mapInArrow(lambda it: asks(it, scan, buckets, parts), PACKED)
    first = scratch.keep(sent.groupBy("slot").applyInArrow(lambda t: judge_spans(t, parts), PACKED))

    split = base.mapInArrow(lambda it: texts_by_part(it, parts), TEXTS)
    looked = split.groupBy("slot").cogroup(first.groupBy("slot")).applyInArrow(
        lambda d, a: look_into(d, a, scan, buckets, parts), PACKED)
    second = scratch.keep(looked.groupBy("slot").applyInArrow(lambda t: judge_windows(t, scan, parts), PACKED))
    scratch.drop(first)
    left = split.groupBy("slot").cogroup(second.groupBy("slot")).applyInArrow(lambda d, a: cut(d, a, scan), CUT)
    return left.withColumn("doc_id", F.nullif("doc_id", F.lit(2**63 - 1)))
