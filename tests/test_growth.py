"""Steps whose tables must not outgrow their input."""

import datetime as dt
import math
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import als as A
from tidemark.operators import candidates as K
from tidemark.operators import content as CT
from tidemark.operators import ranking_metrics as R
from tidemark.operators import recommender_features as RF
from tidemark.operators import retrieval as RT
from tidemark.operators import tiles


def test_a_shared_list_scores_as_its_copies_for_every_user(spark):
    truth = spark.createDataFrame(
        [("u1", "A"), ("u1", "B"), ("u1", "B"), ("u2", "C"), ("u3", "X")], "customer_id string, article_id string")
    shared = spark.createDataFrame([("B", 1), ("D", 2), ("A", 3), ("A", 5), ("C", 4)], "article_id string, rank int")
    copies = shared.crossJoin(truth.select("customer_id").distinct())
    for k in (1, 3, 4, 9):
        one, many = (sorted(R.per_user_metrics(truth, recs, k).collect()) for recs in (shared, copies))
        assert one == many and len(one) == 3
    assert R.ranking_report(truth, shared, 3).first().asDict() == pytest.approx(
        {"users": 3, "recall": 1 / 3, "map": (1 + 2 / 3) / 2 / 3, "hit_rate": 1 / 3})


def brute_search(chunks, questions, k):
    words = lambda t: re.findall(r"\w{2,}", t.lower())
    tf = {}
    for m, no, t in chunks:
        tf.setdefault((m, no), Counter()).update(words(t))
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(chunks)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(counts):
        v = {w: n * idf[w] for w, n in counts.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    units = {c: unit(n) for c, n in tf.items()}
    rows = set()
    for q, text in questions:
        asked = unit(Counter(words(text)))
        best = sorted((-round(sum(x * u.get(w, 0) for w, x in asked.items()), 9), c) for c, u in units.items())[:k]
        rows |= {(q, *c, n, round(-s, 6)) for n, (s, c) in enumerate(best, 1)}
    return rows


@pytest.mark.parametrize("frequent", [0, 3, 1 << 16])
def test_corpus_search_with_frequent_and_rare_terms(spark, monkeypatch, frequent):
    monkeypatch.setattr(RT, "FREQUENT", frequent)
    r = random.Random(3)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(400)]
    chunks = [(m, no, " ".join(r.choices(vocabulary, k=r.randint(0, 9)))) for m in range(12) for no in range(1, 5)]
    questions = [(1, "w1 w2 w2"), (2, "w7"), (3, "none known"), (4, "")]
    found = RT.tfidf_search(
        spark.createDataFrame(chunks, "material_id int, chunk_no int, text string"),
        spark.createDataFrame(questions, "question_id int, text string"), 4).collect()
    got = {(x.question_id, x.material_id, x.chunk_no, x["rank"], round(x.score, 6)) for x in found}
    assert got == brute_search(chunks, questions, 4)


def test_chunks_of_one_key_are_counted_together(spark):
    chunks = [(1, 1, "one two"), (1, 1, "two three"), (2, 1, "three")]
    index = RT.tfidf_index(spark.createDataFrame(chunks, "material_id int, chunk_no int, text string"), []).collect()
    raw = {"one": math.log(2) + 1, "two": 2 * (math.log(2) + 1), "three": math.log(4 / 3) + 1}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert {(x.material_id, x.term): x.weight for x in index} == pytest.approx({(1, w): x / norm for w, x in raw.items()} | {(2, "three"): 1.0})


def test_searches_send_no_term_rows_of_whole_texts(spark):
    """Before, every word of a material crossed four exchanges; now texts cross one and asked postings go on."""
    chunks = spark.createDataFrame([(m, 1, f"a{m} common words") for m in range(50)], "material_id int, chunk_no int, text string")
    plan = RT.tfidf_index(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" in plan[: plan.index("Exchange")]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_profiles_and_affinities_unfold_where_their_customer_is(spark):
    """Before, each of a pair's entries was sent by itself, before and after its sum."""
    history = spark.createDataFrame(
        [("u", "A", 2, dt.date(2020, 1, 1)), ("u", "B", 1, dt.date(2020, 1, 2)), ("v", "A", 1, dt.date(2020, 1, 2))],
        "customer_id string, article_id string, purchases long, last_purchase date")
    articles = spark.createDataFrame([("A", *"abcdef"), ("B", *"abcdeg")], ["article_id", *RF.ITEM_ATTRIBUTES])
    counts = RF.category_affinity(history, articles)
    assert {(r.customer_id, r.category, r.value): r.purchases for r in counts.collect()} == {
        ("u", "product_type_name", "a"): 3, ("u", "colour_group_name", "c"): 3, ("u", "section_name", "e"): 3,
        ("u", "garment_group_name", "f"): 2, ("u", "garment_group_name", "g"): 1,
        ("v", "product_type_name", "a"): 1, ("v", "colour_group_name", "c"): 1, ("v", "section_name", "e"): 1,
        ("v", "garment_group_name", "f"): 1}
    profiles = CT.user_profiles(history, articles, F.lit(dt.date(2020, 1, 3)))
    for frame in (counts, profiles):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("REPARTITION_BY_NUM")  # parents come first: unfolded afterwards
        assert "hashpartitioning(customer_id" not in plan[: plan.index("Generate")]


def test_merged_sources_cross_one_exchange(spark):
    rows = spark.createDataFrame([("u", "A", 1.0, 1), ("v", "A", 1.0, 1)], "customer_id string, article_id string, als_score double, als_rank int")
    other = rows.toDF("customer_id", "article_id", "content_similarity_score", "content_rank")
    merged = K.merge_candidate_sources({"als": rows, "content_based": other}, 5)
    assert merged.count() == 2 and exchanges(merged) == 1


def test_affinity_maps_are_joined_last(spark):
    history = spark.createDataFrame(
        [("u", "A", dt.date(2020, 1, 1), 1.0, 2)], "customer_id string, article_id string, t_dat date, price double, sales_channel_id int")
    articles = spark.createDataFrame([("A", *"abcdef")], ["article_id", *RF.ITEM_ATTRIBUTES])
    wide = RF.candidate_features(spark.createDataFrame([("u", "A"), ("v", "A")], "customer_id string, article_id string"), history, articles)
    plan = wide._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert [("customer_id" in j, "article_id" in j) for j in joins] == [(True, False), (True, False), (False, True), (False, True), (True, True)]
    assert {r.customer_id: (r.user_colour_count, r.user_item_purchase_count, r.item_total_purchases) for r in wide.collect()} == {"u": (1, 1, 1), "v": (0, 0, 1)}


def test_items_are_repeated_no_oftener_than_needed():
    """Before, a bucket held 1024 queries whatever it returned."""
    assert tiles.bucket_size(2_000_000, 40, 6, 12) == 8192
    assert tiles.bucket_size(2_000_000, 40, 200, 12) == (1 << 20) // 200
    assert tiles.bucket_size(20_000, 1, 6, 12) == 1024  # a tile for every core comes first
    assert tiles.bucket_size(0, 1, 6, 12) == 1024


def test_tiles_of_any_bucket_size_find_the_same(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    items = spark.createDataFrame(rows, "vec_id int, vector array<float>")
    queries = items.withColumnRenamed("vec_id", "query_id")

    def found(**sizes):
        winners = tiles.tile_top_k(queries, items, tiles.dense_scores("l2"), 3, "query_id", ["vec_id"], **sizes)
        return sorted(tuple(x) for x in tiles.ranked(winners, 3, "query_id", ["vec_id"]).select("query_id", "vec_id", "rank").collect())

    assert found() == found(queries_per_bucket=50, items_per_block=70)


def test_batch_scoring_reads_the_histories_once(spark, monkeypatch):
    """Features are made for training and scoring alike: scoring joins finished tables and reads no line again."""
    from tidemark.operators import models as M
    from tidemark.plans import models as PM

    seen = {}

    def stop(model, rows, details, assemble):
        seen["plan"] = assemble(rows)._jdf.queryExecution().optimizedPlan().toString()
        return rows

    monkeypatch.setattr(PM, "fitted", lambda data, build: None)
    monkeypatch.setattr(M, "predict_batch", stop)
    PM.predict_batch(spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in seen["plan"] and "INST_PAYMENT_COUNT" in seen["plan"]


def shuffle_ids(spark):
    """Shuffles with files on this machine's disks."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    names = (name for folder in folders for _, _, files in os.walk(folder.getPath()) for name in files)
    return {int(name.split("_")[1]) for name in names if name.startswith("shuffle_")}


def test_factor_exchanges_of_past_iterations_leave_the_disk(spark):
    """Before, the files of ten iterations lay there at once."""
    r = random.Random(4)
    history = spark.createDataFrame(
        [(f"u{r.randrange(40)}", f"a{r.randrange(30)}", 1, dt.date(2020, 1, 1)) for _ in range(400)],
        "customer_id string, article_id string, purchases long, last_purchase date").dropDuplicates(["customer_id", "article_id"])
    before = shuffle_ids(spark)
    fit = A.als_train(history, factors=4, iterations=9, blocks=2)
    assert len(shuffle_ids(spark) - before) < 18 and fit.model.itemFactors.count() == 30


def test_splitting_holds_a_step_of_texts_not_a_batch(spark):
    """Before, the pieces of ten thousand texts were held at once."""
    texts = [None, "", " ", "word " * 900, "x" * 1700, "a\n\nb", "word " * 5000, "end"]
    asked = []

    def batch():
        asked.append(1)
        return pa.RecordBatch.from_arrays([pa.array(range(len(texts) * 40)), pa.array(texts * 40)], names=["doc_id", "text"])

    steps = list(RT.split_batches((batch() for _ in range(2)), 500, 50))
    assert len(asked) == 2 and len(steps) == 4
    assert max(sum(len(p) for p in s.column(2).to_pylist()) for s in steps) < 1.2 * RT.STEP_BYTES
    assert list(RT._steps([3, 9, 1, 1, 1], 3)) == [(0, 1), (1, 1), (2, 3)] and list(RT._steps([])) == []
    found = RT.recursive_split(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    want = [(i, n, p) for i, t in enumerate(texts) if t for n, p in enumerate(RT.split_text(t), 1)]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_histories_in_one_pass_equal_their_tables(spark):
    """Before, lines met their orders four times."""
    from tidemark.operators import credit as CR
    from tidemark.plans import credit as PC

    r = random.Random(7)
    day = lambda: r.choice([None, *range(-90, 30)])
    bureau = spark.createDataFrame(
        [(i, r.choice([None, 1, 2, 3, 4]), day()) for i in range(60)], "SK_ID_BUREAU int, SK_ID_CURR int, DAYS_CREDIT int")
    rows = [(r.randrange(70), day(), day(), r.choice([None, 5.0, 7.0]), r.choice([None, 5.0, 6.0]), day(), r.choice([None, 0, 3]),
             r.choice(["Active", "Completed", None]), r.choice([None, 0.0, 9.0]), r.choice("0135CX")) for _ in range(400)]
    names = ["SK_ID_PREV", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT", "MONTHS_BALANCE", "SK_DPD",
             "NAME_CONTRACT_STATUS", "AMT_BALANCE", "STATUS"]
    all_rows = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, "int int int double double int int string double string".split())))
    all_rows = all_rows.withColumns({c: F.col("AMT_BALANCE") + n for n, c in enumerate(
        ("CNT_INSTALMENT_FUTURE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_PAYMENT_CURRENT", "AMT_DRAWINGS_CURRENT"))})
    lines = all_rows.join(bureau.select(F.col("SK_ID_BUREAU").alias("SK_ID_PREV"), "SK_ID_CURR"), "SK_ID_PREV")
    months = all_rows.withColumnRenamed("SK_ID_PREV", "SK_ID_BUREAU")
    base = spark.createDataFrame([(i,) for i in range(1, 7)], "SK_ID_CURR int")
    want = base
    for table in (CR.bureau_balance_features(bureau, months), CR.installments_features(lines), CR.pos_cash_features(lines), CR.credit_card_features(lines)):
        want = want.join(table, "SK_ID_CURR", "left")
    got = PC.assembled(base, {"histories": CR.history_features(lines, bureau, months)})
    steady = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.collect())
    assert got.columns == want.columns and steady(got) == steady(want)
    plan = PC.assembled(PC.application_of(spark, "/root/testdata/sf0.001"), PC.feature_tables(spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"Relation \[.*l_orderkey", plan._jdf.queryExecution().optimizedPlan().toString())) == 2


def test_only_short_content_lists_meet_the_completion(spark):
    """Before, all lists were ranked again, and all known pairs crossed an exchange to complete a few."""
    articles = spark.createDataFrame(
        [(f"a{n:02d}", "t", "g", f"c{n % 2}", "d", "s", None) for n in range(20)],
        ", ".join(f"{c} string" for c in ("article_id", *RF.ITEM_ATTRIBUTES)))
    history = spark.createDataFrame(
        [(dt.date(2020, 1, 1), "u", "a00"), (dt.date(2020, 1, 2), "v", "a01"), (dt.date(2020, 1, 2), "v", "a03")], "t_dat date, customer_id string, article_id string")
    users = spark.createDataFrame([("u",), ("v",), ("new",)], "customer_id string")
    found = CT.content_candidates(CT.user_profiles(history, articles), articles, history, K.popular_items(history, 2), users, limit=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Union" not in plan[plan.index("Window") : plan.index("Window") + window.index("LeftAnti")]
    lists = {}
    for r in sorted(found.collect(), key=lambda r: (r.customer_id, r.content_rank)):
        lists.setdefault(r.customer_id, []).append((r.article_id, r.content_rank))
    assert lists == {"u": [("a02", 1), ("a04", 2), ("a06", 3), ("a08", 4)], "v": [("a05", 1), ("a07", 2), ("a09", 3), ("a11", 4)],
                     "new": [("a00", 1), ("a01", 2), ("a02", 3), ("a03", 4)]}


def test_attribute_names_do_not_travel_with_pairs(spark):
    articles = spark.createDataFrame([("A", *"abcdef")], ["article_id", *RF.ITEM_ATTRIBUTES])
    history = spark.createDataFrame([(dt.date(2020, 1, 1), "u", "A")], "t_dat date, customer_id string, article_id string")
    plan = CT.user_profiles(history, articles, F.lit(dt.date(2020, 1, 3)))._jdf.queryExecution().optimizedPlan().toString()
    assert "product_type_name=" in plan and "product_type_name=" not in plan[plan.index("RepartitionByExpression") :]
