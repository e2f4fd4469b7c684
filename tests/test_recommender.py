"""Small exact fixtures for the recommender operators."""

import datetime as dt

import pytest

from tidemark.operators import candidates as K
from tidemark.operators import content as CT
from tidemark.operators import ranking_metrics as R
from tidemark.operators import recommender_features as RF
from tidemark.operators import splits
from tidemark.sources.contracts import ContractError


def day(n):
    return dt.date(2020, 1, n)


@pytest.fixture(scope="module")
def history(spark):
    rows = [(day(1), "u1", "A"), (day(2), "u1", "B"), (day(3), "u1", "A"), (day(4), "u2", "B"), (day(5), "u2", "C")]
    return spark.createDataFrame(rows, "t_dat date, customer_id string, article_id string")


@pytest.fixture(scope="module")
def articles(spark):
    same = ("t", "g", "c", "d", "s", "x")
    rows = [("A", *same), ("B", *same), ("C", "t2", "g2", "c2", "d2", "s2", None)]
    return spark.createDataFrame(rows, "article_id string, " + ", ".join(f"{c} string" for c in RF.ITEM_ATTRIBUTES))


def test_popular_items_breaks_ties_by_id(history):
    rows = [tuple(r) for r in K.popular_items(history, 2).collect()]
    assert rows == [("A", 2, 1), ("B", 2, 2)]
    assert K.popular_items(K.purchase_pairs(history), 2).collect() == K.popular_items(history, 2).collect()
    with pytest.raises(ValueError):
        K.popular_items(history, 0)


def test_personal_history_limit(history):
    rows = {r["customer_id"]: r["article_id"] for r in K.personal_history(history, 1).collect()}
    assert rows == {"u1": "A", "u2": "C"}


def test_temporal_split_and_windows(history):
    parts = {(r["t_dat"].day, r["part"]) for r in splits.temporal_split(history, 2).collect()}
    assert parts == {(1, "history"), (2, "history"), (3, "history"), (4, "future"), (5, "future")}
    tagged = splits.temporal_windows(history, 1, 2, 1).collect()
    assert sum(r["window"] == "final_history" and r["role"] == "target" for r in tagged) == 1
    assert sum(r["window"] == "validation_history" for r in tagged) == 4
    with pytest.raises(ValueError):
        splits.temporal_windows(history, 7, 2, 3)


def test_ground_truth_and_cold_users(spark):
    past = spark.createDataFrame([("u1", "A")], "customer_id string, article_id string")
    future = spark.createDataFrame(
        [(day(1), "u1", "B"), (day(1), "u1", "B"), (day(2), "u1", "C"), (day(2), "cold", "X")],
        "t_dat date, customer_id string, article_id string")
    truth = splits.ground_truth(past, future).orderBy("position").collect()
    assert [(r["customer_id"], r["article_id"], r["position"]) for r in truth] == [("u1", "B", 1), ("u1", "C", 2)]
    assert [r[0] for r in splits.cold_start_users(past, future).collect()] == ["cold"]


def test_merge_counts_sources_and_keeps_best_rank(spark):
    als = spark.createDataFrame([("u", "A", 0.9, 1), ("u", "B", 0.8, 2), ("u", "A", 0.1, 5)],
                                "customer_id string, article_id string, als_score double, als_rank int")
    content = spark.createDataFrame([("u", "A", 0.7, 2), ("u", "C", 0.6, 1)],
                                    "customer_id string, article_id string, content_similarity_score double, content_rank int")
    merged = {r["article_id"]: r for r in K.merge_candidate_sources({"als": als, "content_based": content}).collect()}
    assert set(merged) == {"A", "B", "C"}
    assert (merged["A"]["number_of_candidate_sources"], merged["A"]["als_score"]) == (2, 0.9)
    assert (merged["C"]["als_rank"], merged["C"]["from_als"], merged["C"]["popularity_score"]) == (0, 0, 0.0)
    first = K.merge_candidate_sources({"als": als, "content_based": content}, 1).collect()
    assert [r["article_id"] for r in first] == ["A"]
    with pytest.raises(ValueError):
        K.merge_candidate_sources({})


def test_metrics_on_known_lists(spark):
    truth = spark.createDataFrame([("u1", "A"), ("u1", "B"), ("u2", "C")], "customer_id string, article_id string")
    recs = spark.createDataFrame([("u1", "A", 1), ("u1", "X", 2), ("u2", "C", 1)],
                                 "customer_id string, article_id string, rank int")
    row = R.ranking_report(truth, recs, 2).first()
    assert (row["recall"], row["map"], row["hit_rate"]) == (0.75, 0.75, 1.0)


def test_average_precision_ignores_repeats(spark):
    truth = spark.createDataFrame([("u", "A"), ("u", "B"), ("nobody", "A")], "customer_id string, article_id string")
    recs = spark.createDataFrame([("u", "A", 1), ("u", "A", 2), ("u", "B", 3)],
                                 "customer_id string, article_id string, rank int")
    rows = {r["customer_id"]: r["average_precision"] for r in R.per_user_metrics(truth, recs, 3).collect()}
    assert rows == {"u": 1.0, "nobody": 0.0}


def test_top_k_completes_from_popularity(spark):
    scored = spark.createDataFrame([("u", "B", 0.5), ("u", "A", 0.5), ("u", "B", 0.9)],
                                   "customer_id string, article_id string, score double")
    popular = spark.createDataFrame([("A", 9, 1), ("C", 8, 2), ("D", 7, 3)],
                                    "article_id string, popularity_score int, popularity_rank int")
    users = spark.createDataFrame([("u",), ("new",)], "customer_id string")
    rows = K.top_k_with_fallback(scored, popular, 3, users).orderBy("customer_id", "rank").collect()
    lists = {}
    for r in rows:
        lists.setdefault(r["customer_id"], []).append((r["article_id"], r["score"]))
    assert lists == {"u": [("B", 0.9), ("A", 0.5), ("C", 0.0)], "new": [("A", 0.0), ("C", 0.0), ("D", 0.0)]}
    with pytest.raises(ValueError):
        K.top_k_with_fallback(scored, popular, 51)


def test_candidate_features_have_no_nulls(spark, articles):
    history = spark.createDataFrame(
        [(day(1), "u1", "A", 1.0, 2), (day(2), "u1", "A", 3.0, 1), (day(3), "u2", "B", 2.0, 2)],
        "t_dat date, customer_id string, article_id string, price double, sales_channel_id int")
    candidates = spark.createDataFrame([("u1", "A"), ("u1", "C"), ("u2", "A")], "customer_id string, article_id string")
    customers = spark.createDataFrame([("u1", 30.0), ("u2", None)], "customer_id string, age double")
    rows = {(r["customer_id"], r["article_id"]): r
            for r in RF.candidate_features(candidates, history, articles, customers).collect()}
    top = rows["u1", "A"]
    assert (top["user_total_purchases"], top["user_item_purchase_count"], top["user_bought_item_before"]) == (2, 2, 1)
    assert (top["user_product_type_count"], top["user_average_price"], top["user_online_share"]) == (2, 2.0, 0.5)
    assert rows["u1", "C"]["garment_group_name"] == "Unknown"
    assert all(v is not None for r in rows.values() for v in r)
    with pytest.raises(ContractError):
        RF.check_history(history, "2020-01-03")


def test_content_prefers_similar_items(spark, history, articles):
    bought = history.where("customer_id = 'u1' and article_id = 'A'")
    profiles = CT.user_profiles(bought, articles)
    popular = K.popular_items(history, 3)
    users = spark.createDataFrame([("u1",), ("stranger",)], "customer_id string")
    rows = CT.content_candidates(profiles, articles, bought, popular, users, limit=2).collect()
    lists = {}
    for r in sorted(rows, key=lambda r: (r["customer_id"], r["content_rank"])):
        lists.setdefault(r["customer_id"], []).append((r["article_id"], round(r["content_similarity_score"], 6)))
    # B equals A and is unseen; C shares nothing, so it completes the list at score 0.
    assert lists["u1"] == [("B", 1.0), ("C", 0.0)]
    assert lists["stranger"] == [("A", 0.0), ("B", 0.0)]


def test_content_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    items = [(f"{i:04d}", *[f"v{rng.integers(3)}" for _ in RF.ITEM_ATTRIBUTES]) for i in range(60)]
    table = spark.createDataFrame(items, "article_id string, " + ", ".join(f"{c} string" for c in RF.ITEM_ATTRIBUTES))
    buys = [(day(int(rng.integers(1, 20))), f"u{int(rng.integers(6))}", f"{int(rng.integers(60)):04d}") for _ in range(80)]
    past = spark.createDataFrame(buys, "t_dat date, customer_id string, article_id string")
    got = CT.content_candidates(
        CT.user_profiles(past, table), table, past, K.popular_items(past, 5), limit=55, id_prefix=2).collect()
    vectors = {i[0]: {f"{c}={v}" for c, v in zip(RF.ITEM_ATTRIBUTES, i[1:])} for i in items}
    last = max(b[0] for b in buys)
    for user in {b[1] for b in buys}:
        counts = {}
        for when, who, item in buys:
            if who == user:
                n, latest = counts.get(item, (0, when))
                counts[item] = (n + 1, max(latest, when))
        profile = {}
        for item, (n, latest) in counts.items():
            weight = np.exp(-((last - latest).days + 1) / 30) * (1 + np.log1p(n))
            for f in vectors[item]:
                profile[f] = profile.get(f, 0) + weight
        norm = np.sqrt(sum(w * w for w in profile.values()))
        scores = {i: sum(profile.get(f, 0) for f in fs) / norm / np.sqrt(6) for i, fs in vectors.items() if i not in counts}
        want = sorted(((round(s, 9), i) for i, s in scores.items() if s > 0), key=lambda p: (-p[0], p[1]))[:55]
        mine = sorted((r for r in got if r["customer_id"] == user), key=lambda r: r["content_rank"])
        assert [r["article_id"] for r in mine][: len(want)] == [i for _, i in want]
        assert len(mine) == min(55, 60 - len(counts))
