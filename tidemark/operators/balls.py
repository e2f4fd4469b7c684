"""Exact nearest vectors (Euclidean) that opens only the blocks which can hold one.

Every vector goes to the nearest of a bounded number of centres, so a block is a
ball: centre, radius, count.  A query first looks into the balls nearest to it
until they hold enough vectors; the k-th distance found there is a bound.  Then it
opens every other ball whose nearest possible point, ``distance to the centre -
radius``, is within that bound.  The triangle inequality makes the result exact
whatever the centres are; how much is skipped depends on how clustered the data is.

Only the centres' table travels to all tasks: ``centres`` rows, a parameter.  A ball
that holds a third of all vectors, or that a third of all queries open, is dealt
over tiles of bounded size on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tiles import dense_scores, score_tiles
from tidemark.session import materialized

SLACK = 1e-6  # scores are rounded to nine digits; a ball this close to the bound is opened


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (vectors**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * (vectors @ centres.T)
    return np.sqrt(np.maximum(squared, 0.0))


class Balls:
    """``vectors`` (``key``, ``vector``) in balls around ``centres`` of their own."""

    def __init__(self, vectors: DataFrame, key: str, centres: int = 256, tile_items: int = 50_000, tile_queries: int = 1024):
        self.key, self.tile_items, self.tile_queries = key, tile_items, tile_queries
        picked = vectors.select(key, "vector").orderBy(F.md5(F.col(key).cast("string")), key).limit(centres).collect()
        self.centres = np.array([r["vector"] for r in picked], np.float64)
        types = dict(vectors.select(key, "vector").dtypes)
        middle = self.centres

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    far = _distances(_matrix(batch["vector"]), middle)
                    ball = far.argmin(1)
                    yield batch.assign(_ball=ball.astype(np.int32), _far=far[np.arange(len(ball)), ball])

        schema = f"`{key}` {types[key]}, vector {types['vector']}, _ball int, _far double"
        # Written once: statistics and both rounds read it.
        self.placed = materialized(vectors.select(key, "vector").mapInPandas(place, schema), "balls") if picked else None
        stats = [] if self.placed is None else self.placed.groupBy("_ball").agg(F.max("_far").alias("r"), F.count(F.lit(1)).alias("n")).collect()
        self.radius, self.count = np.full(len(picked), -np.inf), np.zeros(len(picked), np.int64)
        for row in stats:
            self.radius[row["_ball"]], self.count[row["_ball"]] = row["r"], row["n"]

    def opened(self, queries: DataFrame, limit: int, query_key: str, bound: str | None = None) -> DataFrame:
        """``queries`` with one row for each ball to open: the first ones, or with a ``bound`` column all others within it."""
        centres, radius, count = self.centres, self.radius, self.count

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                far = _distances(_matrix(batch["vector"]), centres)
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(count[order], axis=1)
                need = batch["extra"].to_numpy() + limit
                first = np.zeros(far.shape, bool)
                np.put_along_axis(first, order, held - count[order] < need[:, None], axis=1)
                take = first if bound is None else ~first & (far - radius[None, :] <= batch[bound].to_numpy()[:, None] + SLACK * (1 + far))
                row, ball = np.nonzero(take & (count > 0)[None, :])
                yield batch.iloc[row].assign(_ball=ball.astype(np.int32))

        types = dict(queries.dtypes)
        schema = ", ".join(f"`{c}` {types[c]}" for c in queries.columns) + ", _ball int"
        return queries.mapInPandas(choose, schema)

    def score(self, opened: DataFrame, limit: int, query_key: str) -> tuple[DataFrame, int]:
        """Winners of the opened balls' tiles, and how many pairs that scores."""
        opened = materialized(opened, "opened")
        asked = np.zeros(len(self.count), np.int64)
        for row in opened.groupBy("_ball").count().collect():  # at most one row for each centre
            asked[row["_ball"]] = row["count"]
        blocks, buckets = (np.maximum(1, -(-x // size)) for x, size in ((self.count, self.tile_items), (asked, self.tile_queries)))
        table = opened.sparkSession.createDataFrame(
            [(k, int(blocks[k]), int(buckets[k])) for k in range(len(asked)) if asked[k]], "_ball int, _blocks int, _buckets int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        dealt = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
        left = opened.join(F.broadcast(table), "_ball").withColumn("_bucket", dealt(query_key, "_buckets")).withColumn("_block", upto("_blocks"))
        right = self.placed.join(F.broadcast(table), "_ball").withColumn("_block", dealt(self.key, "_blocks")).withColumn("_bucket", upto("_buckets"))
        keep = ["vector", "_ball", "_block", "_bucket"]
        found = score_tiles(left.select(query_key, "extra", *keep), right.select(self.key, *keep), ["_ball", "_block", "_bucket"],
                            dense_scores("l2"), limit, query_key, [self.key])
        return found, int((asked * self.count).sum())

    def search(self, queries: DataFrame, limit: int, query_key: str) -> DataFrame:
        """``(query_key, key, score)``: at least the ``limit + extra`` best of each query; ``score`` is minus the distance.

        ``scored_pairs`` afterwards says how many pairs of query and vector were scored.
        """
        self.scored_pairs = 0
        queries = queries.select(query_key, "vector", "extra")
        if self.placed is None:
            return queries.join(queries.limit(0).select(F.col(query_key).alias(self.key), F.lit(0.0).alias("score")), F.lit(False)).select(
                query_key, self.key, "score")
        near, pairs = self.score(self.opened(queries, limit, query_key), limit, query_key)
        near = materialized(near, "near_balls")
        place = Window.partitionBy(query_key).orderBy(F.desc("score"), self.key)
        bound = near.withColumn("_place", F.row_number().over(place)).join(queries.select(query_key, "extra"), query_key).where(
            F.col("_place") == F.col("extra") + limit).select(query_key, (-F.col("score")).alias("_bound"))
        bounded = queries.join(bound, query_key, "left").na.fill(float("inf"), ["_bound"])
        far, more = self.score(self.opened(bounded, limit, query_key, "_bound"), limit, query_key)
        self.scored_pairs = pairs + more
        return near.unionByName(far)
