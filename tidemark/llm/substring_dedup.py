"""Substring dedup by level-wise doubling, on words.

Level one hashes every window of ``base`` words (13 of 50).  Windows that no second
document has end there.  At each further level a position stays a candidate only
if the windows of half the length that make up its window, the one at its start
and the one at its end, were both found repeated; those alone are extended to twice
the length and looked up again, until ``length`` words are reached or no candidate
is left.  The last level keeps 96 bits of each window and names its first document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import passes, tables

BASE = 13


def levels(length: int, base: int = BASE) -> list[int]:
    """Lengths that double (rounded up) from about ``base`` to ``length``."""
    out = [length]
    while out[0] > base:
        out.insert(0, -(-out[0] // 2))
    return out


def candidates(piece: passes.Piece, known: passes.Known | None, shorter: int, longer: int) -> np.ndarray:
    """Positions whose window of ``longer`` words is made of two repeated ones of ``shorter``."""
    at = piece.fits(longer)
    if known is None or not len(at):
        return at
    repeated = np.zeros(len(piece.doc) + 1, bool)
    hashes = piece.hashes(shorter)
    repeated[: len(hashes)] = known.find(hashes >> passes.KEEP) >= 0
    return at[repeated[at] & repeated[at + longer - shorter]]


def ask(block: pa.Table, answers: pa.Table, shorter: int, longer: int, last: bool, ranges: int) -> pa.Table:
    """One level, block side: the candidates' windows of ``longer`` words."""
    ids, data, offsets = passes.opened(block)
    known = passes.Known(answers) if shorter else None
    hashes, low, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for piece in passes.word_pieces(ids, data, offsets):
        at = candidates(piece, known, shorter, longer)
        rows.append(piece.docs[piece.doc[at]])
        hashes.append(piece.hashes(longer, at))
        if last:
            low.append(piece.hashes(longer, at, 1).astype(np.uint32))
    name, hashes, rows = block.column("block")[0].as_py(), np.concatenate(hashes), np.concatenate(rows)
    if last:
        return passes.owner_rows(name, hashes, np.concatenate(low), ids[rows], ranges)
    return passes.shared_rows(name, hashes >> passes.KEEP, rows, ranges)


def cut(block: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    """Take out the words of windows that an earlier document has; spans are in words of the input."""
    if not block.num_rows:
        return passes.CUT_ARROW.empty_table()
    ids, data, offsets = passes.opened(block)
    owners = passes.Owners(answers)
    out: list[list] = [[], [], [], [], [], []]
    for piece in passes.word_pieces(ids, data, offsets):
        hashes = piece.hashes(length)
        at = piece.fits(length)
        at = at[owners.find(hashes[at]) >= 0]
        who = ids[piece.docs[piece.doc[at]]]
        at = at[owners.before(hashes[at], piece.hashes(length, at, 1).astype(np.uint32), who)]
        bounds = np.searchsorted(at, piece.starts)
        for i, doc in enumerate(piece.docs):
            words = data[offsets[doc] : offsets[doc + 1]].tobytes().split()
            gone, starts, ends = passes.covered(len(words), at[bounds[i] : bounds[i + 1]] - piece.starts[i], length)
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if len(starts) else words)
            for column, value in zip(out, (ids[doc], kept, len(words), int((ends - starts).sum()), starts, ends)):
                column.append(value)
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, passes.CUT_ARROW.types)], schema=passes.CUT_ARROW)


def substring_dedup(docs: DataFrame, length: int = 50, base: int = BASE) -> DataFrame:
    """Remove words that stand in a window of ``length`` words of an earlier document.

    ``length`` ends the doubling: longer repeats are unions of its windows.  Words
    are runs of bytes other than the six ASCII space characters.

    Returns ``doc_id, text, n_words, n_removed, starts, ends`` of every row of
    ``docs``; ``text`` is what is left, joined by one space, ``starts`` and ``ends``
    the maximal removed runs.  A null text counts as empty.  A null doc_id counts as
    larger than all others and comes back as null.  Rows with one doc_id, or without
    one, never remove from each other.  Columns besides ``doc_id`` and ``text`` are
    ignored.
    """
    over = passes.Passes(docs, "substrings")
    ranges, shorter = over.ranges, 0
    for longer in levels(length, base):
        last = longer == length
        over.run(lambda b, a, s=shorter, n=longer, last=last: ask(b, a, s, n, last, ranges) if b.num_rows else passes.SETS_ARROW.empty_table(), last)
        shorter = longer
    left = over.read(lambda b, a: cut(b, a, length), passes.CUT)
    left = left.withColumn("doc_id", F.nullif("doc_id", F.lit(tables.LAST_ID))).withColumn("text", F.col("text").cast("string"))
    return left.withColumnRenamed("n_symbols", "n_words")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup(tables.documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
owners AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT w.doc_id, w.i FROM windows w JOIN owners o ON w.h = o.h AND o.owner < w.doc_id),
removed AS (
  SELECT doc_id, list_sort(list(DISTINCT k)) AS gone
  FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE
    array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM words d LEFT JOIN removed r ON d.doc_id = r.doc_id
"""
