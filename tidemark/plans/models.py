"""Registered content, factorisation and model queries.

All models train with the operators' full schedules on all feature tables:
996 rounds of boosting for credit risk, up to 500 with a stop on validation AUC
for the ranker.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import als as A
from tidemark.operators import candidates as K
from tidemark.operators import content as CT
from tidemark.operators import credit as CR
from tidemark.operators import models as M
from tidemark.operators import splits
from tidemark.plans import batch_recommendations as BR
from tidemark.plans import credit as PC
from tidemark.plans import recommender as PR
from tidemark.plans.registry import query, steadied, steady_sql, with_tables
from tidemark.session import materialized, work_path
from tidemark.sources import canonical as C
from tidemark.sources import contracts, readers, sinks

FEATURES = ", ".join(f"'{c}=' || {c}" for c in CT.ITEM_ATTRIBUTES)
ITEMS = f"SELECT article_id, unnest([{FEATURES}]) AS feature FROM attrs"
WEIGHTED = f"""SELECT customer_id, article_id, exp(-greatest({PR.REF} - last_purchase, 0) / CAST(30 AS DOUBLE))
    * (1 + ln(1 + purchases)) AS w FROM pairs"""
PROFILES = """SELECT customer_id, feature, w * 6 / sum(w) OVER (PARTITION BY customer_id) AS weight FROM (
    SELECT customer_id, feature, sum(w) AS w FROM weighted JOIN items USING (article_id) GROUP BY ALL)"""
SCORES = """SELECT p.customer_id, i.article_id, round(sum(p.weight) / (any_value(n) * sqrt(CAST(6 AS DOUBLE))), 9) AS score
    FROM profiles p JOIN items i USING (feature) JOIN (SELECT customer_id, sqrt(sum(weight * weight)) AS n FROM profiles
    GROUP BY ALL) USING (customer_id) GROUP BY p.customer_id, i.article_id"""
CONTENT = """SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY tier, score DESC, place, article_id) AS rank FROM (
    SELECT customer_id, article_id, 0 AS tier, score, 0 AS place FROM scores WHERE score > 0
    AND (customer_id, article_id) NOT IN (SELECT (customer_id, article_id) FROM pairs)
    UNION ALL SELECT u.customer_id, a.article_id, 1, 0, coalesce(popularity_rank, 1000000) FROM (SELECT CAST(c_custkey AS VARCHAR)
    AS customer_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT customer_id FROM history)) u
    CROSS JOIN attrs a LEFT JOIN popular USING (article_id))"""
BASE = ("history", "popular", "pairs", "articles", "attrs")


@query("one_hot_items", PR.base("articles", "attrs", items=ITEMS) + "SELECT * FROM items")
def one_hot_items(spark, folder):
    return CT.one_hot_items(C.articles(spark, folder))


@query("user_profiles", PR.base(*BASE, items=ITEMS, weighted=WEIGHTED, profiles=PROFILES) + f"""SELECT customer_id,
    feature, {steady_sql('weight')} AS weight FROM profiles""")
def user_profiles(spark, folder):
    return steadied(CT.user_profiles(PR.direct(spark, folder).history, C.articles(spark, folder)), {})


@query("content_candidates", PR.base(*BASE, items=ITEMS, weighted=WEIGHTED, profiles=PROFILES, scores=SCORES, c=CONTENT) + f"""
    SELECT customer_id, article_id, {steady_sql('score')} AS content_similarity_score, rank AS content_rank FROM c
    WHERE rank <= 50""")
def content_candidates(spark, folder):
    """All customers: those without history get the completion list."""
    case, articles = PR.Case(spark, folder), C.articles(spark, folder)
    found = CT.content_candidates(
        CT.user_profiles(case.pairs, articles), articles, case.pairs, case.popular, C.customers(spark, folder))
    return steadied(found, {})


def fit_als(history):
    return A.als_train(history)


@query("als_train")
def als_train(spark, folder):
    users, items = A.factor_tables(fit_als(PR.Case(spark, folder).pairs))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    return users.select(F.lit("user").alias("side"), F.col("customer_id").alias("id"), norm.alias("norm")).unionByName(
        items.select(F.lit("item").alias("side"), F.col("article_id").alias("id"), norm.alias("norm")))


@query("als_candidates")
def als_candidates(spark, folder):
    pairs = PR.Case(spark, folder).pairs
    return A.als_candidates(fit_als(pairs), pairs)


# --- credit models -----------------------------------------------------------

def modeling_data(spark, folder, tables=None):
    tables = tables or PC.feature_tables(spark, folder)
    data = PC.assembled(PC.application_of(spark, folder), tables)
    split = splits.client_split(C.application(spark, folder))
    return CR.split_modeling_data(data, split)


def fitted(data, build):
    train = CR.balanced_weights(data.where("split = 'train'"))
    features = contracts.select_model_features(data)
    return build(train, features).fit(train)


@query("logistic_pipeline")
def logistic_pipeline(spark, folder):
    data = materialized(modeling_data(spark, folder))
    return M.score(fitted(data, M.logistic_pipeline), data, [M.KEY, M.LABEL, "split"])


@query("boosted_trees")
def boosted_trees(spark, folder):
    data = materialized(modeling_data(spark, folder))
    return M.score(fitted(data, M.boosted_model), data, [M.KEY, M.LABEL, "split"])


@query("feature_importance")
def feature_importance(spark, folder):
    data = materialized(modeling_data(spark, folder))
    return M.feature_importance(fitted(data, M.logistic_pipeline), data)


@query("cv_out_of_fold")
def cv_out_of_fold(spark, folder):
    return M.cv_out_of_fold(modeling_data(spark, folder).where("split = 'train'").drop("split"), M.logistic_pipeline)


@query("train_and_holdout")
def train_and_holdout(spark, folder):
    return M.train_and_holdout(materialized(modeling_data(spark, folder)), M.logistic_pipeline)[2]


DETAILS = {"threshold": 0.5, "low_cutoff": 0.4, "high_cutoff": 0.6}


@query("evaluate_holdout")
def evaluate_holdout(spark, folder):
    data = materialized(modeling_data(spark, folder))
    return M.evaluate_holdout(fitted(data, M.logistic_pipeline), data, DETAILS)


@query("predict_batch")
def predict_batch(spark, folder):
    """Bare applications come in; their features are assembled on the way, from the tables that training read."""
    tables = {name: materialized(table, name) for name, table in PC.feature_tables(spark, folder).items()}
    data = materialized(modeling_data(spark, folder, tables))
    details = {**DETAILS, "features": contracts.select_model_features(data)}
    return M.predict_batch(
        fitted(data, M.logistic_pipeline), PC.application_of(spark, folder).drop(M.LABEL), details,
        lambda rows: PC.assembled(rows, tables),
    )


@query("model_bundle")
def model_bundle(spark, folder):
    """Save, load again and score with the loaded bundle."""
    data = materialized(modeling_data(spark, folder))
    path = work_path(spark, "bundle")
    sinks.save_bundle(fitted(data, M.logistic_pipeline), path, {**DETAILS, "features": contracts.select_model_features(data)})
    model, details = sinks.load_bundle(spark, path)
    return M.evaluate_holdout(model, data, details)


# --- ranker ------------------------------------------------------------------

def ranker_parts(spark, folder):
    """Ranker trained on the four sources of the train window, factorisation among them."""
    case = PR.Case(spark, folder)
    articles, customers = C.articles(spark, folder), C.customers(spark, folder)
    users = case.pairs.select("customer_id").distinct()
    candidates = materialized(BR.all_candidates(fit_als(case.pairs), case.pairs, articles, users), "candidates")
    table = BR.ranking_table(candidates, case.history, case.future, articles, customers, case.pairs)
    return BR.train_ranker(table), case, articles, customers, candidates


@query("ranker_score")
def ranker_score(spark, folder):
    from tidemark.operators import recommender_features as RF

    ranker, case, articles, customers, candidates = ranker_parts(spark, folder)
    wide = RF.candidate_features(candidates, case.history, articles, customers, pairs=case.pairs)
    return M.ranker_score(ranker, wide)


@query("batch_recommendations")
def batch_recommendations(spark, folder):
    ranker, _, articles, customers, _ = ranker_parts(spark, folder)
    everything = materialized(C.transactions(spark, folder), "transactions")
    pairs = materialized(K.purchase_pairs(everything), "pairs")
    return BR.batch_recommendations(
        everything, articles, customers, ranker, fit_als(pairs), work_path(spark, "final_recommendations"), pairs=pairs)


# --- contracts as queries ----------------------------------------------------

@query("require_columns", with_tables("transactions") + "SELECT count(*) AS rows FROM transactions")
def require_columns(spark, folder):
    rows = contracts.require_columns(C.transactions(spark, folder), readers.TRANSACTION_COLUMNS)
    return rows.agg(F.count(F.lit(1)).alias("rows"))


@query("validate_inference_input", """SELECT 'empty_table' AS "check", 0 AS violations UNION ALL SELECT 'null_key',
    (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0) UNION ALL SELECT 'duplicate_key',
    (SELECT count(*) - count(DISTINCT c_custkey // 2) FROM customer WHERE c_custkey % 9 <> 0)
    UNION ALL SELECT 'bad_label', 0""")
def validate_inference_input(spark, folder):
    """Keys broken on purpose: some missing, the others shared by neighbours."""
    key = F.col("SK_ID_CURR")
    rows = C.application(spark, folder).drop("TARGET").withColumn("SK_ID_CURR", F.when(key % 9 != 0, F.floor(key / 2)))
    return contracts.application_violations(rows, label=None)


@query("select_model_features", with_tables("application") + "SELECT SEGMENT, NATION, DAYS_EMPLOYED FROM application")
def select_model_features(spark, folder):
    rows = C.application(spark, folder)
    return contracts.ordered_features(rows, contracts.select_model_features(rows))


@query("feature_table_cache", with_tables("pos_cash_balance", f=PC.POS) + PC._steady_select("f", *PC.POS_COLUMNS))
def feature_table_cache(spark, folder):
    path = work_path(spark, "pos_cash_features")

    def check(saved):
        return contracts.feature_table_violations(saved, prefixes=("POS_",))

    def build():
        return CR.pos_cash_features(C.pos_cash_balance(spark, folder))

    sinks.feature_table_cache(spark, path, build, check)
    return steadied(sinks.feature_table_cache(spark, path, build, check), PC.DIGITS)
