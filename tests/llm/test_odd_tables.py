"""Clashing names, very long texts and rows without ids, for the stages and the operators mended for them."""

import pytest

import corpus_pipeline
from tidemark.llm import quality_rules, sharding, tables, toxicity

CLASH = ["score", "recognised", "n_letters", "nearness", "n_apart", "lang_pred", "_id", "_sha", "_digest", "_hash", "_copies", "_copy", "_rest", "row", "digest", "copies", "kept", "a b"]
LONG = 3 << 20


@pytest.fixture(scope="module")
def clashing(spark):
    words = "the quick brown fox jumps over a lazy dog and runs far away from here".split()
    rows = [(i, " ".join(words[(i * k) % len(words)] + str(k % 7) for k in range(1, 60 + i)), "en", f"src{i}", *[f"{c}{i}" for c in CLASH]) for i in range(12)]
    rows.append((50, None, None, None, *CLASH))
    names = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, {names}")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns(spark, clashing, name):
    found = dict(corpus_pipeline.STAGES)[name](spark, clashing, "")
    assert found.columns == clashing.columns
    rows = found.collect()
    assert rows and all(r[c] == (f"{c}{r.doc_id}" if r.doc_id < 50 else c) for r in rows for c in CLASH)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, clashing, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, clashing.limit(0), "").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_very_long_texts(spark, name):
    rows = [(1, "x" * LONG, "en", "src1"), (2, "some words " * (LONG // 11), "en", "src2"), (3, "a short text of words", "en", "src1")]
    found = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), "")
    assert {r.doc_id for r in found.select("doc_id").collect()} <= {1, 2, 3} and found.count() >= 1


def test_shards_of_rows_without_id_fit(spark):
    """3 000 rows of 1 000 bytes without an id, and as many with one and the same."""
    rows = [(None, f"{i:04d}" * 250) for i in range(3000)] + [(7, f"{i:04d}" * 250) for i in range(3000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == 6000 and not any(r.oversize for r in found)
    sums = {}
    for r in found:
        sums[r.depth, r.prefix] = sums.get((r.depth, r.prefix), 0) + r.n_bytes
    assert max(sums.values()) <= sharding.LIMIT


def test_first_by_hash(spark):
    ids = spark.range(50_000).withColumnRenamed("id", "doc_id")
    got = tables.first_by_hash(ids, "doc_id", 1000)
    assert 1000 <= got.count() < 1050
    assert tables.first_by_hash(ids, "doc_id", 10**6).count() == 50_000 and tables.first_by_hash(ids.limit(0), "doc_id", 5).count() == 0


def test_one_row_for_each_labelled_id(spark, monkeypatch):
    """Rows that repeat a labelled id reach the fit once."""
    docs = spark.createDataFrame([(i % 5, f"text {i} " + "word " * 60) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id bigint, quality int, toxic int")
    sizes = []
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows: sizes.append(rows.count()) or real(rows))
    toxicity.toxicity(docs, labels).count()
    assert sizes and sizes[0] <= 5
    assert isinstance(quality_rules.learn_rules(quality_rules.text_statistics(docs), labels), list)
