"""Vector search over balls: equal to brute force, and skips what it can."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import balls, content, retrieval


def frame(spark, rows, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{key} int, vector array<double>").repartition(3)


def nearest(q, v, k):
    far = np.round(np.sqrt(((q[:, None] - v[None]) ** 2).sum(2)), 9)
    return {(i, int(j)) for i, line in enumerate(far) for j in np.lexsort((np.arange(len(v)), line))[:k]}


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_balls_equal_brute_force(spark, spread):
    r = np.random.default_rng(4)
    middles = r.normal(size=(12, 6)) * 4
    v = middles[r.integers(0, 12, 400)] + r.normal(size=(400, 6)) * spread
    v[200:330] = v[7]  # a third of all vectors is one point: ties and a large ball
    q = np.concatenate([v[:30], r.normal(size=(10, 6))])
    found = balls.Balls(frame(spark, v, "vec_id"), "vec_id", centres=24, tile_items=50, tile_queries=8)
    rows = retrieval.ranked(found.search(frame(spark, q, "query_id").withColumn("extra", F.lit(0)), 7, "query_id"), 7, "query_id", ["vec_id"]).collect()
    assert {(x.query_id, x.vec_id) for x in rows} == nearest(q, v, 7) and len(rows) == 7 * len(q)
    assert found.scored_pairs <= len(q) * len(v)
    if spread < 1:
        assert found.scored_pairs < 0.7 * len(q) * len(v)


def test_few_or_no_vectors(spark):
    v = np.eye(3)
    few = retrieval.embedding_knn(frame(spark, v, "query_id"), frame(spark, v, "vec_id"), k=9, exclude_self=True, centres=16).collect()
    assert len(few) == 6 and all(x.query_id != x.vec_id for x in few)
    none = spark.createDataFrame([], "vec_id int, vector array<double>")
    assert retrieval.embedding_knn(frame(spark, v, "query_id"), none, centres=16).collect() == []
    assert retrieval.embedding_knn(none.withColumnRenamed("vec_id", "query_id"), frame(spark, v, "vec_id"), centres=16).collect() == []
    with pytest.raises(ValueError):
        retrieval.embedding_knn(none, none, metric="cosine", centres=16)


def test_catalogue_of_ids_with_one_prefix(spark):
    ids = [f"000000000000{n:03d}" for n in range(40)]
    articles = spark.createDataFrame([(x,) for x in ids + ids[:3]], "article_id string")
    popular = spark.createDataFrame([(ids[9], 1), (ids[2], 2)], "article_id string, popularity_rank int")
    pool = content.completion_pool(articles, popular).orderBy("position").collect()
    assert [x.article_id for x in pool] == [ids[9], ids[2]] + [x for x in ids if x not in (ids[9], ids[2])]
    assert [x.position for x in pool] == list(range(1, 41))
