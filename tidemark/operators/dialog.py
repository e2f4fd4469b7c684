"""Dialogue memory as batch: context before a message, compaction, budgets.

Line numbers come from a bucketed rank and windows run over slices of a chat,
so one endless chat is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import split_rank

TURNS_PER_SLICE = 4096


def numbered_lines(dialogue: DataFrame) -> DataFrame:
    """Adds ``n``: 1-based line number within the chat."""
    bucket = F.floor(F.col("turn") / TURNS_PER_SLICE)
    return split_rank(dialogue, [F.col("turn"), F.col("line")], bucket, "n", ["chat_id"])


def dialog_context(dialogue: DataFrame, keep: int = 6) -> DataFrame:
    """For each user message the last ``keep`` earlier lines.

    Every slice of a chat also receives the last lines of the slice before it,
    which is all the window frame can reach.
    """
    lines = numbered_lines(dialogue)
    home = F.floor((F.col("n") - 1) / TURNS_PER_SLICE)
    spill = F.floor((F.col("n") - 1 + keep) / TURNS_PER_SLICE)
    sliced = lines.withColumn("_home", home).withColumn("_slice", F.explode(F.sequence(home, spill)))
    frame = Window.partitionBy("chat_id", "_slice").orderBy("n").rowsBetween(-keep, -1)
    framed = sliced.withColumn("context", F.array_join(F.collect_list("line").over(frame), "\n"))
    return framed.where((F.col("_home") == F.col("_slice")) & (F.col("role") == "user")).select(
        "chat_id", "turn", "line", "context")


def exchange_lines(dialogue: DataFrame) -> DataFrame:
    """Lines of completed exchanges: the first 2·⌊lines/2⌋ of a chat, in pairs."""
    lines = numbered_lines(dialogue)
    return lines.withColumn("exchange", F.ceil(F.col("n") / 2))


def held_after(exchange, keep: int, over: int):
    """Lines held after an exchange, in closed form."""
    first = over // 2 + 1
    period = (over - keep) // 2 + 1
    cycle = keep + 2 * F.pmod(exchange - first, F.lit(period))
    return F.when(2 * exchange <= over, 2 * exchange).otherwise(cycle)


def dialog_compaction(dialogue: DataFrame, keep: int = 6, over: int = 10) -> DataFrame:
    """Per exchange: lines held afterwards and the text evicted by it, if any.

    Exchanges first, first+p, first+2p… compact.  The line that an exchange
    evicts follows from its number, so each line finds its compaction directly.
    """
    if keep % 2 or over % 2 or not 0 < keep <= over:
        raise ValueError("keep and over must be even with 0 < keep <= over")
    first, period = over // 2 + 1, (over - keep) // 2 + 1
    lines = exchange_lines(dialogue)
    whole = lines.groupBy("chat_id", "exchange").agg(F.count(F.lit(1)).alias("_lines")).where("_lines = 2")
    # The c-th compaction ends at exchange first + c·period and evicts lines up to 2·exchange − keep.
    step = F.greatest(F.ceil((F.col("n") + keep - 2 * first) / (2 * period)), F.lit(0))
    evicted = (
        lines.withColumn("exchange", (first + step * period).cast("bigint"))
        .groupBy("chat_id", "exchange")  # at most over + 2 − keep lines each
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("evicted"))
    )
    return whole.join(evicted, ["chat_id", "exchange"], "left").select(
        "chat_id", "exchange", held_after(F.col("exchange"), keep, over).alias("held"), "evicted")
