"""Doubling levels: equal to brute force with several levels, whoever shares an id; packing of hash sets."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import corpus, cut_brute, cut_rows
from tidemark.llm import passes, substring_dedup

WORDS = (lambda t: t.encode().split(), b" ".join)


def test_levels_double():
    assert substring_dedup.levels(50) == [13, 25, 50]
    assert substring_dedup.levels(7, 2) == [2, 4, 7]
    assert substring_dedup.levels(5) == [5]


@pytest.mark.parametrize("length, base", [(12, 3), (7, 1)])
def test_many_levels(spark, length, base):
    """A third of all rows has no id, and some texts lie in blocks of their own."""
    rows = corpus()
    rows = [(None if k % 3 == 0 else r[0], *r[1:]) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, slot int, label string").repartition(5)
    assert cut_rows(substring_dedup.substring_dedup(docs, length, base), "n_words") == cut_brute(rows, WORDS[0], length, WORDS[1])


def test_no_candidates_survive(spark):
    """Every window of 13 words is repeated, none of 50: all levels run, nothing goes."""
    part = [[f"p{k}w{i}" for i in range(20)] for k in range(6)]
    rows = [(k, " ".join(part[k] + part[(k + 1) % 6] + [f"own{k}"])) for k in range(6)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {(r.doc_id, r.n_removed, r.n_words) for r in found} == {(k, 0, 41) for k in range(6)}
    for r in found:
        assert hashlib.md5(r.text.encode()).hexdigest() == hashlib.md5(rows[r.doc_id][1].encode()).hexdigest()


def test_sets_come_back():
    r = random.Random(1)
    for bits in (48, 64):
        values = np.unique(np.array([r.getrandbits(bits) for _ in range(5000)], np.uint64))
        assert (passes.unpacked(passes.packed(values)) == values).all()
        rows = passes.set_rows(7, values, bits, 64)
        assert (np.concatenate([passes.unpacked(h) for h in rows["hashes"].to_pylist()]) == values).all()
        assert len(set(rows["slot"].to_pylist())) == 64 and max(rows["slot"].to_pylist()) == 63
    ids = np.array([5, 2**63 - 1, 0], np.int64)
    assert (passes.from_planes(passes.planes(ids), np.int64) == ids).all()


def test_two_windows_of_one_hash():
    """Windows that share 64 bits are told apart by the other 32."""
    hashes = np.array([3, 9, 9, 9], np.uint64)
    answers = pa.table({"hashes": [passes.packed(hashes)], "low": [passes.planes(np.array([1, 4, 5, 6], np.uint32))],
                        "owners": [passes.planes(np.array([0, 10, 20, 30], np.int64))]})
    owners = passes.Owners(answers)
    got = owners.before(np.array([9, 9, 9, 9, 3, 8], np.uint64), np.array([4, 5, 6, 7, 1, 1], np.uint32), np.array([11, 20, 31, 99, 1, 1], np.int64))
    assert got.tolist() == [True, False, True, False, True, False]
