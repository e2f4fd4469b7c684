"""Long sequences that a polynomial hash modulo 2**64 cannot tell apart."""

import pytest

from tidemark.llm import near_dedup, quality_rules, substring_dedup
from tidemark.llm import symbols as S


def evil(n, zero="a", one="b"):
    """Two different words of ``n`` letters that collide for every odd base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((zero, one)[b] for b in bits), "".join((one, zero)[b] for b in bits)


A, B = evil(2048)


def test_hashes_differ():
    for n in (1024, 2048, 8192):
        one, two = evil(n)
        data, offsets = S.bytes_of(__import__("pyarrow").array([one, two]))
        for seed in (0, 1):
            h = S.word_hashes(data, *S.word_spans(data, offsets)[:2], seed)
            assert h[0] != h[1]


def test_nothing_is_removed(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*words, A])), (2, " ".join([B, *words[:30]])), (3, " ".join([*words[11:], B]))]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("width", [2, 5])
def test_nothing_is_linked(spark, width):
    rows = [(1, A), (2, B), (3, f"x {A}"), (4, f"x {B}")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), near_dedup.Similar(width=width)).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in found)


def test_no_line_is_repeated():
    data, offsets = S.bytes_of(__import__("pyarrow").array([f"{A}\n{B}", f"{A}\n{A}\n{B}"]))
    counts, _ = quality_rules.statistics(data, offsets)
    assert counts["n_dup_lines"].tolist() == [0, 1]
