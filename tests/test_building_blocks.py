"""Ordering, quantiles, tiles, scalars, contracts, text and streaming helpers."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordering as O
from tidemark.functions import scalars as S
from tidemark.operators import binary_metrics as B
from tidemark.operators import credit as CR
from tidemark.operators import dialog as D
from tidemark.operators import jobs as J
from tidemark.operators import models as M
from tidemark.operators import retrieval as RT
from tidemark.operators import splits
from tidemark.operators import text as TX
from tidemark.operators import tiles
from tidemark.session import work_path
from tidemark.sources import contracts, readers, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [("10", 10), ("штуки 2", 2), ("", 10), ("нет", 10), ("99", 20), ("-5", 1), ("0", 1)])
def test_parse_count(spark, text, want):
    assert one(spark, S.parse_count("t"), t=text) == want


@pytest.mark.parametrize("seconds, want", [(0, "00:00:00"), (3661.9, "01:01:01"), (-4, "00:00:00"), (360000, "100:00:00")])
def test_format_seconds(spark, seconds, want):
    assert one(spark, S.format_seconds("t"), t=float(seconds)) == want


@pytest.mark.parametrize("url, want", [
    ("https://www.youtube.com/watch?v=abc&t=1", "abc"), ("https://youtu.be/xyz?si=1", "xyz"),
    ("https://m.youtube.com/shorts/s1/x", "s1"), ("https://www.youtube.com/watch?x=1", None),
    ("https://example.com/watch?v=abc", None), ("not a url", None)])
def test_video_id(spark, url, want):
    assert one(spark, S.video_id("u"), u=url) == want


def test_article_ids_and_division(spark):
    assert one(spark, S.normalize_article_id("v"), v=" 108775015.0 ") == "0108775015"
    assert one(spark, S.normalize_article_id("v"), v="123456789012") == "123456789012"
    assert one(spark, S.safe_divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.safe_divide(F.lit(math.inf), F.lit(2.0))) is None


@pytest.mark.parametrize("day, want", [("2025-09-01", 1), ("2025-09-08", 2), ("2025-09-15", 1), ("2026-01-05", 1)])
def test_week_parity(spark, day, want):
    assert one(spark, S.week_parity("d"), d=day) == want


def test_split_rank_with_a_hot_key(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(100000)).cast("double").alias("value"), "id")
    ranked = O.split_rank(rows, [F.col("value"), F.col("id")], O.magnitude_bucket(F.col("value")), "n", ["key"]).collect()
    for key in {r["key"] for r in ranked}:
        group = sorted((r["value"], r["id"], r["n"]) for r in ranked if r["key"] == key)
        assert [g[2] for g in group] == list(range(1, len(group) + 1))


def test_quantiles_equal_interpolation(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=501), [0.0, -3.5, 1e9, 1e-9], np.repeat(2.5, 300)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = (0.0, 0.1, 0.5, 0.73, 0.99, 1.0)
    got = df.sparkSession.range(1).select(O.quantile_array(df, "x", probs).alias("q")).first()["q"]
    assert np.allclose(got, np.quantile(values, probs))


def test_global_position(spark):
    ids = [f"id{i * 7919 % 1000}" for i in range(1000)]
    df = spark.createDataFrame([(i,) for i in ids * 2], "v string")
    got = {r["v"]: r["n"] for r in O.global_position(df, "v", "n").collect()}
    assert got == {v: n for n, v in enumerate(sorted(set(ids)))}


def test_salted_join_keeps_every_row(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    right = spark.range(97).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = O.salted_join(left, right, ["k"])
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    q, v = rng.integers(-3, 4, size=(23, 4)).astype(float), rng.integers(-3, 4, size=(57, 4)).astype(float)
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id bigint, vector array<double>")
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, vector array<double>")
    winners = tiles.tile_top_k(queries, items, tiles.dense_scores("dot"), 5, "query_id", ["vec_id"],
                               queries_per_bucket=7, items_per_block=10)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in tiles.ranked(winners, 5, "query_id", ["vec_id"]).collect()}
    for i in range(23):
        want = sorted(range(57), key=lambda j: (-(q[i] @ v[j]), j))[:5]
        assert [got[i, n] for n in range(1, 6)] == want


def test_binary_metrics_identities(spark):
    rows = [(0, 0.1), (0, 0.3), (1, 0.6), (1, 0.9)]
    df = spark.createDataFrame(rows, "target int, p double")
    report = B.full_report(df, 0.5).first()
    assert report["ks_statistic"] == report["roc_auc"] == report["average_precision"] == report["f1"] == 1.0
    assert sum(report[c] for c in ("true_negative", "false_positive", "false_negative", "true_positive")) == 4
    assert B.select_f1_threshold(df).first()["threshold"] == 0.6
    with pytest.raises(contracts.ContractError):
        B.validate_scores(df.where("target = 1"))
    folds = spark.createDataFrame([(0.7, 0.2), (0.9, 0.4)], "roc_auc double, average_precision double")
    summary = B.fold_summary(folds).first()
    assert abs(summary["roc_auc_mean"] - 0.8) < 1e-12 and abs(summary["average_precision_mean"] - 0.3) < 1e-12


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.3), float(np.round(rng.random(), 2))) for _ in range(700)]
    df = spark.createDataFrame(rows, "target int, p double")
    pos, neg = [p for t, p in rows if t], [p for t, p in rows if not t]
    want = np.mean([[1.0 if a > b else 0.5 if a == b else 0.0 for b in neg] for a in pos])
    assert abs(B.roc_auc(df).first()[0] - want) < 1e-12


def test_client_split_and_samples(spark):
    base = spark.range(20).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") % 2).cast("int").alias("TARGET"))
    split = splits.client_split(base)
    counts = {(r["split"], r["TARGET"]): r["count"] for r in split.groupBy("split", "TARGET").count().collect()}
    assert counts == {("train", 0): 8, ("train", 1): 8, ("holdout", 0): 2, ("holdout", 1): 2}
    assert splits.split_coverage(split, base).first().asDict() == {"only_in_split": 0, "only_in_base": 0}
    assert splits.stratified_sample(base, 7).count() == 7
    assert splits.stratified_sample(base, 99).count() == 20
    with pytest.raises(ValueError):
        splits.stratified_sample(base, 1)


def test_future_rows_are_excluded(spark):
    rows = [(1, 10, -2, 0, "Active", 3.0), (1, 11, -1, 3, "Completed", 1.0), (1, 12, 1, 9, "Active", 1.0)]
    table = CR.pos_cash_features(spark.createDataFrame(
        rows, "SK_ID_CURR bigint, SK_ID_PREV bigint, MONTHS_BALANCE int, SK_DPD int, NAME_CONTRACT_STATUS string, "
              "CNT_INSTALMENT_FUTURE double")).first()
    assert (table["POS_RECORD_COUNT"], table["POS_DPD_MAX"], table["POS_ACTIVE_CREDIT_COUNT"]) == (2, 3, 1)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1.0), (1, math.inf), (None, 2.0)], "SK_ID_CURR bigint, X double")
    found = {r["check"]: r["violations"] for r in contracts.feature_table_violations(df, prefixes=("Y_",)).collect()}
    assert found == {"empty_table": 0, "null_key": 1, "duplicate_key": 1, "infinite_value": 1, "missing_value": 0,
                     "forbidden_column": 0, "unexpected_name": 1}
    with pytest.raises(contracts.ContractError, match="missing required columns"):
        contracts.require_columns(df, ["A"])
    with pytest.raises(contracts.ContractError):
        contracts.validate_inference_input(df.withColumn("TARGET", F.lit(1)))
    with pytest.raises(FileNotFoundError):
        readers.load_transactions(spark, "/tmp/does-not-exist.parquet")
    with pytest.raises(contracts.ContractError):
        sinks.check_bundle({"features": ["a"], "threshold": 0.5, "low_cutoff": 0.7, "high_cutoff": 0.6})


def test_recommendations_contract(spark):
    bad = spark.createDataFrame([("u", "1", 1, 0.5), ("u", "1", 2, 0.4)],
                                "customer_id string, article_id string, rank int, score double")
    with pytest.raises(contracts.ContractError):
        sinks.write_recommendations(bad, work_path(spark, "bad"))
    path = work_path(spark, "good")
    saved = sinks.write_recommendations(bad.limit(1), path)
    assert saved.dtypes[2:] == [("rank", "smallint"), ("score", "double")]
    assert sinks.read_recommendations(spark, path).first()["article_id"] == "0000000001"


def test_text_files_and_pairs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("  hello\nworld \n")
    (tmp_path / "sub" / "b.md").write_text("notes")
    (tmp_path / "blank.txt").write_text(" \n ")
    (tmp_path / "c.pdf").write_text("no")
    rows = readers.read_text_materials(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in rows) == ["hello\nworld", "notes"]
    listing = readers.file_listing(spark, str(tmp_path), "*.txt")
    pairs = readers.pair_files(listing, listing.where("file_name <> 'blank.txt'")).collect()
    assert [r["file_name"] for r in pairs] == ["a.txt"]


def chunk_reference(texts, size=1200, step=1000):
    """Sequential packing as a plain loop over one document."""
    out, current = [], []

    def close():
        if current:
            out.append("\n\n".join(current))
            current.clear()

    for text in texts:
        if len(text) > size:
            close()
            at = 0
            while True:
                piece = text[at:at + size].strip()
                if piece:
                    out.append(piece)
                if at + size >= len(text):
                    break
                at += step
        else:
            if current and len("\n\n".join([*current, text])) > size:
                close()
            current.append(text)
    close()
    return out


def test_chunks_equal_sequential_packing(spark):
    rng = np.random.default_rng(9)
    docs = [(i, "\n".join("word " * int(n) for n in rng.integers(0, 500, size=12))) for i in range(30)]
    docs += [(100, "x" * 1200), (101, "x" * 1201), (102, "x" * 2200), (103, "x" * 2201), (104, ""), (105, "a" * 599 + "\n" + "b" * 599)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {}
    for r in TX.chunk_segments(TX.segments_of(df)).orderBy("material_id", "chunk_no").collect():
        got.setdefault(r["material_id"], []).append(r["text"])
    for key, text in docs:
        assert got.get(key, []) == chunk_reference([t.strip() for t in text.split("\n") if t.strip()])


def test_recursive_split_properties():
    text = "\n\n".join(f"Paragraph {i} " + "lorem ipsum dolor " * (i % 40) for i in range(60)) + "z" * 1700
    pieces = RT.split_text(text)
    assert all(0 < len(p) <= 500 for p in pieces)
    assert set("".join(pieces).split()) >= set(w for w in text.split() if len(w) < 400)
    assert RT.split_text("short text") == ["short text"]
    assert RT.split_text("a" * 1000) == ["a" * 500, "a" * 500, "a" * 100]


def test_key_terms_and_topics(spark):
    df = spark.createDataFrame([(1, "About Vectors and vectors\nMatrices Tensor-product lecture Graphs Kernels Extra"), (2, " ")],
                               "doc_id bigint, text string")
    materials = TX.segments_of(df)
    terms = TX.key_terms(materials).orderBy("material_id", "term_no").collect()
    assert [r["term"] for r in terms if r["material_id"] == 1] == ["Vectors", "Matrices", "Tensor-product", "Graphs", "Kernels"]
    assert [r["term"] for r in terms if r["material_id"] == 2] == ["Материал"]
    topics = TX.topics_fallback(materials).where("material_id = 2").collect()
    assert [(r["title"], r["source_start"]) for r in topics] == [("Тема 1", "text")]


@pytest.mark.parametrize("keep, over", [(6, 10), (2, 4), (4, 4), (2, 8)])
def test_compaction_equals_simulation(spark, keep, over):
    lines = [(1, t, "user" if t % 2 == 0 else "assistant", f"l{t:03d}") for t in range(61)]
    got = {r["exchange"]: (r["held"], r["evicted"]) for r in D.dialog_compaction(
        spark.createDataFrame(lines, "chat_id bigint, turn bigint, role string, line string"), keep, over).collect()}
    held, want = [], {}
    for n in range(30):
        held += [lines[2 * n][3], lines[2 * n + 1][3]]
        gone = None
        if len(held) > over:
            gone, held = "\n".join(held[:-keep]), held[-keep:]
        want[n + 1] = (len(held), gone)
    assert got == want


def test_context_crosses_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "TURNS_PER_SLICE", 5)
    lines = [(1, t, "user", f"l{t}") for t in range(23)]
    rows = D.dialog_context(spark.createDataFrame(lines, "chat_id bigint, turn bigint, role string, line string")).collect()
    assert len(rows) == 23
    for r in rows:
        assert r["context"] == "\n".join(f"l{t}" for t in range(max(0, r["turn"] - 6), r["turn"]))


def test_bundle_round_trip(spark):
    from tidemark.operators import models as M

    data = spark.range(60).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") % 2).cast("int").alias("TARGET"),
                                  F.when(F.col("id") % 7 != 0, F.col("id") % 2 + F.col("id") % 5).alias("amount"),
                                  F.when(F.col("id") % 9 != 0, F.concat(F.lit("o'"), F.col("id") % 3)).alias("kind"))
    weighted = CR.balanced_weights(data)
    model = M.logistic_pipeline(weighted, ["amount", "kind"], 5).fit(weighted)
    path = work_path(spark, "bundle")
    details = {"features": ["amount", "kind"], "threshold": 0.5, "low_cutoff": 0.3, "high_cutoff": 0.6}
    sinks.save_bundle(model, path, details)
    loaded, read = sinks.load_bundle(spark, path)
    assert read["features"] == ["amount", "kind"]
    unseen = data.drop("TARGET").withColumn("kind", F.lit("new value"))
    rows = M.predict_batch(loaded, unseen, read).collect()
    assert len(rows) == 60 and all(0 <= r["p"] <= 1 and r["risk_band"] in ("low", "medium", "high") for r in rows)


def test_out_of_fold_scores_beat_chance(spark):
    from tidemark.operators import models as M

    data = spark.range(300).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") % 3 == 0).cast("int").alias("TARGET"),
                                   (F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0) + F.rand(1) * 1.5).alias("x"))
    oof = M.cv_out_of_fold(data, lambda d, f: M.logistic_pipeline(d, f, 5))
    assert oof.count() == oof.select("SK_ID_CURR").distinct().count() == 300
    assert B.roc_auc(oof).first()[0] > 0.75


def test_shared_folder_needs_setting_on_a_cluster(spark):
    assert os.path.isdir(work_path(spark, "x").rsplit("/", 1)[0])


def test_boosted_trees_take_wide_text_columns(spark):
    rows = spark.range(400).selectExpr(
        "id AS SK_ID_CURR", "concat('v', id % 100) AS kind", "CAST(id % 7 AS double) AS size",
        "CAST(id % 100 < 50 AS int) AS TARGET", "1.0 AS weight")
    model = M.boosted_trees(rows, ["kind", "size"], iterations=2, depth=3).fit(rows)
    assert model.stages[-1].getNumTrees == 2


def test_unnamed_lesson_is_no_gap(spark):
    lessons = spark.createDataFrame([(1, 1, None, "t"), (1, 3, "math", "t")], "grp int, code int, subject string, teacher string")
    slots = spark.range(1, 4).selectExpr("CAST(id AS int) AS code", "'a' AS time_from", "'b' AS time_to")
    found = {r["code"]: (r["subject"], r["is_gap"]) for r in J.schedule_with_gaps(lessons, slots, ["grp"]).collect()}
    assert found == {1: (J.UNNAMED, False), 2: (J.GAP, True), 3: ("math", False)}


def test_failed_publish_keeps_the_old_table(spark):
    path = work_path(spark, "published")
    sinks.save_table(spark.range(3), path)
    with pytest.raises(Exception):
        sinks.publish(spark, f"{path}.never_written", path)
    assert sinks.read_published(spark, path).count() == 3
