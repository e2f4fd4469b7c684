"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import hash_bucket, running_totals, seeded_hash
from tidemark.llm import tables

LEVELS = ("domain", "lang", "source")
UNKNOWN = "unknown"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Whole-number weights of siblings; a name without one has ``other``.

    The budget is ``share`` per mille of all tokens, ``epochs`` how often a
    document may be used at most.
    """

    weights: dict[str, int] = field(default_factory=lambda: {"domain/web": 5, "domain/curated": 5, "lang/en": 6, "lang/de": 2, "lang/fr": 2, "lang/es": 1})
    other: int = 1
    share: int = 600
    epochs: int = 1
    seed: int = 7


def domain_of(source: Column) -> Column:
    """Sources with a number of two digits are curated, all others come from the web."""
    return F.when(source.rlike(r"^src\d\d$"), "curated").otherwise("web")


def weight(level: str, mix: Mix) -> Column:
    out = F.lit(mix.other)
    for name, value in mix.weights.items():
        where, _, which = name.partition("/")
        if where == level:
            out = F.when(F.col(level) == which, value).otherwise(out)
    return out.cast("bigint")


def fill(nodes: DataFrame, parents: Sequence[str], level: str, mix: Mix) -> DataFrame:
    """Split each parent's ``budget`` among its children by weight, up to their ``capacity``.

    What a child cannot use goes to its siblings by weight.  Children in order of
    capacity per weight are filled up until the rest can take its share: one pass
    of running sums finds the same amounts as repeated redistribution.
    """
    w = weight(level, mix)
    order = Window.partitionBy(*parents).orderBy((F.col("capacity") / F.col("w")).asc(), F.col(level))
    whole = Window.partitionBy(*parents)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    staged = nodes.withColumn("w", w).select(
        "*", F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("c_before"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"))
    full = F.col("capacity") * F.col("w_left") <= F.col("w") * (F.col("budget") - F.col("c_before"))
    # The first child that is not filled up fixes the share of all behind it.
    cut = F.min(F.when(~full, F.struct(F.col("c_before").alias("c"), F.col("w_left").alias("w")))).over(whole)
    part = F.expr("(w * (budget - cut.c)) div cut.w")
    return staged.withColumn("cut", cut).withColumn("given", F.when(F.col("cut").isNull() | full, F.col("capacity")).otherwise(part)).drop(
        "w", "c_before", "w_left", "cut")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (the level columns and ``tokens``) with their ``budget``.

    Shares go down the tree level by level.  A node asks for no more than its
    subtree can give, so what a leaf lacks stays with its siblings first and
    reaches another branch only if the whole subtree is short.
    """
    tree = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    tree = tree.withColumn("budget", F.expr(f"(sum(tokens) OVER () * {mix.share}) div 1000"))
    for depth, level in enumerate(LEVELS):
        here, parents = LEVELS[: depth + 1], LEVELS[:depth]
        nodes = tree.groupBy(*here).agg(F.sum("capacity").alias("capacity"), F.max("budget").alias("budget"))
        given = fill(nodes, parents, level, mix).select(*here, F.col("given").alias("_budget"))
        tree = tree.join(given, list(here)).withColumn("budget", F.col("_budget")).drop("_budget")
    return tree.select(*LEVELS, "tokens", "budget")


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, leaf_budget, copies`` of every row of ``docs``.

    Tokens are words.  A leaf (domain, language, source) takes whole documents in
    the seeded order of an epoch until its budget is reached, the last one whole;
    a budget above the leaf's tokens starts further epochs in an order of their
    own.  ``copies`` says how often a row is taken, 0 for rows left out.  Null
    languages and sources are one group ``unknown``; a null text has no tokens and
    is taken only if its leaf's budget reaches it.  Equal ids are ordered by their
    tokens and text; other columns are ignored.
    """
    return mixed_rows(docs, mix).drop("text_hash")


def mixed_rows(docs: DataFrame, mix: Mix) -> DataFrame:
    """``mix_sources`` with the ``text_hash`` of every row, which tells rows of one doc_id apart."""
    scratch = tables.Scratch(docs.sparkSession, "mixing")
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    source = F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN))
    rows = scratch.keep(docs.select(
        "doc_id", domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), source.alias("source"),
        tokens.alias("n_tokens"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = scratch.keep(leaf_budgets(leaves, mix))
    out = rows.withColumn("copies", F.lit(0).cast("bigint"))
    for epoch in range(mix.epochs):
        digest = seeded_hash(mix.seed + epoch, F.col("key"))
        ranked = running_totals(out.withColumn("_digest", digest), [F.col("_digest"), F.col("n_tokens"), F.col("text_hash")],
                                ["n_tokens"], hash_bucket(F.col("_digest")), LEVELS)
        # One row for each leaf; Spark's own size check decides how it travels.
        left = (F.col("budget") - epoch * F.col("tokens")) > F.col("cum_n_tokens") - F.col("n_tokens")
        out = ranked.join(budgets, list(LEVELS)).select(*out.columns[:-1], (F.col("copies") + left.cast("bigint")).alias("copies"))
    return out.join(budgets, list(LEVELS)).select("doc_id", *LEVELS, "n_tokens", "text_hash", F.col("budget").alias("leaf_budget"), "copies")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(tables.documents(spark, sf_dir))


def _sql_level(level: str, parents: Sequence[str], source: str) -> str:
    mix = Mix()
    cases = " ".join(f"WHEN '{k.split('/')[1]}' THEN {v}" for k, v in mix.weights.items() if k.startswith(f"{level}/"))
    w = f"CASE {level} {cases} ELSE {mix.other} END" if cases else str(mix.other)
    here = ", ".join([*parents, level])
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    order = f"({by} ORDER BY CAST(capacity AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
n_{level} AS (SELECT {here}, CAST(sum(capacity) AS BIGINT) AS capacity, max(budget) AS budget, {w} AS w FROM {source} GROUP BY {here}),
s_{level} AS (SELECT *, coalesce(CAST(sum(capacity) OVER {order} AS BIGINT), 0) AS cb,
  CAST(sum(w) OVER ({by}) AS BIGINT) - coalesce(CAST(sum(w) OVER {order} AS BIGINT), 0) AS wl FROM n_{level}),
f_{level} AS (SELECT *, capacity * wl <= w * (budget - cb) AS filled FROM s_{level}),
c_{level} AS (SELECT *, min(CASE WHEN NOT filled THEN cb END) OVER ({by}) AS c,
  arg_min(CASE WHEN NOT filled THEN wl END, CASE WHEN NOT filled THEN cb END) OVER ({by}) AS cw FROM f_{level}),
t_{level} AS (SELECT x.* REPLACE (CASE WHEN filled OR c IS NULL THEN n.capacity ELSE (w * (n.budget - c)) // cw END AS budget)
  FROM {source} x JOIN c_{level} n USING ({here}))"""


OP9_SQL = rf"""
WITH rows AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, 'unknown'), '^src\d\d$') THEN 'curated' ELSE 'web' END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows GROUP BY ALL),
tree AS (SELECT *, tokens * {Mix().epochs} AS capacity,
  (CAST(sum(tokens) OVER () AS BIGINT) * {Mix().share}) // 1000 AS budget FROM leaves),
{_sql_level("domain", (), "tree")},
{_sql_level("lang", ("domain",), "t_domain")},
{_sql_level("source", ("domain", "lang"), "t_lang")},
ranked AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5(CAST(doc_id AS VARCHAR) || '|{Mix().seed}') ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM rows)
SELECT r.doc_id, domain, lang, source, n_tokens, CAST(budget AS BIGINT) AS leaf_budget,
  CAST(budget > cum - n_tokens AS BIGINT) AS copies
FROM ranked r JOIN t_source USING (domain, lang, source)
"""
