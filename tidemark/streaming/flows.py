"""Structured Streaming forms of the update log, dialogue memory and ingestion.

Each flow is a source, a transformation and a materialized sink.  ``run`` uses
``availableNow``, so the same code drains a backlog and then stops; a service
would pass its own trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import scalars as S
from tidemark.operators.text import material_stats, segments_of
from tidemark.session import STATE_STORE


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000, glob: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as an unbounded table, in arrival order."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(path)
    )


def run(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what is available into a Parquet table with exactly-once commits."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


RANGE = 8192
LANES = 64


class SeenIds(StatefulProcessor):
    """Ids of one range that were answered: a bitmap, and one flag once the range is full.

    A range holds every ``LANES``-th id, so consecutive ids are dealt to as many keys.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "bits binary, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = self.seen.get() if self.seen.exists() else (bytes(RANGE // 8), 0)
        bits = bytearray(held or b"")
        for batch in rows:
            fresh = []
            for place in batch["place"].tolist():
                new = n < RANGE and not bits[place >> 3] >> (place & 7) & 1
                if new:
                    bits[place >> 3] |= 1 << (place & 7)
                    n += 1
                fresh.append(new)
            yield batch.loc[fresh, ["update_id", "next_offset", "chat_id", "text"]]
        self.seen.update((b"" if n == RANGE else bytes(bits), n))

    def close(self) -> None:
        pass


def chat_updates(updates: DataFrame) -> DataFrame:
    """One reply row for each update with a chat and a text, for ever.

    A redelivered id is dropped however late it comes: the state remembers every id,
    in one bit, and a full range of ids in a flag.  The stream checkpoint is the
    offset; ``next_offset`` mirrors what a poller would ask for next.
    """
    usable = updates.where(F.col("chat_id").isNotNull() & (F.length(S.trimmed(F.coalesce("text", F.lit("")))) > 0))
    number = F.col("update_id")
    rows = usable.select(
        F.floor(number / (RANGE * LANES)).cast("bigint").alias("range"), F.pmod(number, F.lit(LANES)).cast("int").alias("lane"),
        F.floor(F.pmod(number, F.lit(RANGE * LANES)) / LANES).cast("int").alias("place"),
        "update_id", (number + 1).alias("next_offset"), "chat_id", S.trimmed("text").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("range", "lane").transformWithStateInPandas(
        statefulProcessor=SeenIds(), outputStructType=", ".join(f"{c} {kinds[c]}" for c in ("update_id", "next_offset", "chat_id", "text")),
        outputMode="Append", timeMode="None")


BLOCK = 64


class DialogMemory(StatefulProcessor):
    """Recent lines and latest summary of one chat, in turn order whatever the order of arrival.

    Turns count from ``first`` without gaps; a turn without a line to remember has a
    null one.  A line that comes before its turn waits in keyed state, with the others of
    its ``BLOCK`` turns, so that state is read and written by block, not by line.  A missing
    turn is given up after ``patience_ms`` without it, if that is set.  Turns that were
    passed already are redeliveries.
    """

    def __init__(self, keep: int = 6, over: int = 10, ttl_ms: int | None = None, first: int = 0, patience_ms: int | None = None) -> None:
        self.keep, self.over, self.ttl_ms, self.first, self.patience_ms = keep, over, ttl_ms, first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line string", self.ttl_ms)
        self.waiting = handle.getMapState("blocks", "block bigint", "turns array<bigint>, lines array<string>", self.ttl_ms)
        self.meta = handle.getValueState("meta", "next bigint, exchange bigint, pending string, summary string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            meta, blocks = self._meta(), {}
            for turn, line in zip(batch["turn"].tolist(), batch["line"].tolist()):
                if turn >= meta[0]:
                    self._block(blocks, turn)[turn] = line if isinstance(line, str) else None
            yield from self._release(key, meta, blocks)
        if self.patience_ms is not None and any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        numbers = [k[0] for k in self.waiting.keys()]
        if numbers:
            meta, blocks = self._meta(), {}
            turn = min(self._block(blocks, min(numbers) * BLOCK))
            yield from self._release(key, (turn, *meta[1:]), blocks)
            if any(True for _ in self.waiting.keys()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def _meta(self) -> tuple:
        return tuple(self.meta.get() or (self.first, 0, None, None))

    def _block(self, blocks: dict, turn: int) -> dict:
        """Lines by turn of the block of a turn, those in state among them."""
        number = turn // BLOCK
        if number not in blocks:
            stored = self.waiting.getValue((number,))
            blocks[number] = (dict(zip(*stored)) if stored else {}, stored is not None)
        return blocks[number][0]

    def _keep(self, blocks: dict, number: int) -> None:
        """Write a block back, or remove it once all of it is passed."""
        waiting, stored = blocks.pop(number)
        if waiting:
            self.waiting.updateValue((number,), (list(waiting), list(waiting.values())))
        elif stored:
            self.waiting.removeKey((number,))

    def _release(self, key, meta: tuple, blocks: dict) -> Iterator[pd.DataFrame]:
        """Exchanges that the lines complete which have no gap before them."""
        following, exchange, pending, summary = meta
        held = None
        out = []
        while following in (block := self._block(blocks, following)):
            line = block.pop(following)
            following += 1
            if following % BLOCK == 0:
                self._keep(blocks, following // BLOCK - 1)
            if line is None:
                continue
            if pending is None:
                pending = line
                continue
            held = [r[0] for r in self.lines.get()] if held is None else held
            held += [pending, line]
            pending, evicted = None, None
            exchange += 1
            if len(held) > self.over:
                evicted = summary = "\n".join(held[: -self.keep])
                held = held[-self.keep :]
            out.append((key[0], exchange, len(held), evicted))
        for number in list(blocks):
            self._keep(blocks, number)
        if self.ttl_ms and held is None:
            held = [r[0] for r in self.lines.get()]
        if held:
            self.lines.put([(line,) for line in held])
        if self.ttl_ms or (following, exchange, pending, summary) != meta:
            self.meta.update((following, exchange, pending, summary))
        if out:
            yield pd.DataFrame(out, columns=["chat_id", "exchange", "held", "evicted"])

    def close(self) -> None:
        pass


def dialog_memory(
    lines: DataFrame, keep: int = 6, over: int = 10, ttl_ms: int | None = None, first: int = 0, patience_ms: int | None = None
) -> DataFrame:
    """``(chat_id, exchange, held, evicted)`` per exchange, state kept by chat; input has ``chat_id, turn, line``.

    With ``patience_ms`` or ``ttl_ms`` the stream has timers, so it needs a trigger that
    keeps going: ``run`` (``availableNow``) would wait for the next timer for ever.
    """
    return lines.select("chat_id", "turn", "line").groupBy("chat_id").transformWithStateInPandas(
        statefulProcessor=DialogMemory(keep, over, ttl_ms, first, patience_ms),
        outputStructType="chat_id bigint, exchange bigint, held bigint, evicted string",
        outputMode="Append", timeMode="ProcessingTime" if ttl_ms or patience_ms is not None else "None",
    )


def run_stateful(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """``run`` with keyed state on disk."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        return run(stream, path, checkpoint)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ingest_materials(arrivals: DataFrame, log: str, checkpoint: str, compact_every: int = 32) -> DataFrame:
    """Newly arrived texts become processed/failed rows in a status log.

    ``arrivals`` has ``doc_id, text`` and may have ``version``: of two versions of a
    material the higher counts, in whatever order they come; without the column the
    file's time is the version.  A micro-batch only writes its own ``batch`` folder,
    overwriting it on a replay.  After every ``compact_every`` batches the state so far
    is written as one row per material, and readers take that and the batches since.
    """
    spark = arrivals.sparkSession
    version = F.col("version").cast("bigint") if "version" in arrivals.columns else F.unix_micros(F.col("_metadata.file_modification_time"))
    marked = arrivals.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), version.alias("version"))

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("doc_id").agg(F.max_by("text", F.struct("version", "text")).alias("text"), F.max("version").alias("version"))
        stats = material_stats(segments_of(newest, "version"), "version")
        stats.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            state = latest_rows(status_rows(spark, log, batch_id))
            state.write.mode("overwrite").parquet(f"{log}/snapshot={batch_id}")

    query = marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_materials(status_rows(spark, log))


STATUS = ["status", "segments_count", "characters_count", "error_message"]
STATUS_LOG = "material_id bigint, version bigint, status string, segments_count bigint, characters_count bigint, error_message string"


def status_rows(spark: SparkSession, log: str, upto: int | None = None) -> DataFrame:
    """The newest finished snapshot and the batches after it (up to one, if given)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers: dict[str, list[int]] = {"batch": [], "snapshot": []}
    if files.exists(folder):
        for entry in files.listStatus(folder):
            kind, _, number = entry.getPath().getName().partition("=")
            if kind in numbers and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                numbers[kind].append(int(number))
    snapshots = [n for n in numbers["snapshot"] if upto is None or n < upto]
    since = max(snapshots, default=-1)
    paths = [f"{log}/batch={n}" for n in sorted(numbers["batch"]) if n > since and (upto is None or n <= upto)]
    paths += [f"{log}/snapshot={since}"] if snapshots else []
    return spark.read.parquet(*paths) if paths else spark.createDataFrame([], STATUS_LOG)


def latest_rows(log: DataFrame) -> DataFrame:
    """One row per material, that of its highest version."""
    newest = F.max_by(F.struct(*STATUS), F.struct("version", *STATUS))
    return log.groupBy("material_id").agg(F.max("version").alias("version"), newest.alias("_s")).select("material_id", "version", "_s.*")


def latest_materials(log: DataFrame) -> DataFrame:
    """Current state of each material: the upsert view over the status log."""
    return latest_rows(log).drop("version")
