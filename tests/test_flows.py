"""Publishing under readers, search inside one material, and streams whose rows come in any order."""

import math
import os
import random
import re
import threading
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as K
from tidemark.operators import dialog as D
from tidemark.operators import retrieval as RT
from tidemark.session import STATE_STORE, work_path
from tidemark.sources import sinks
from tidemark.sources.contracts import ContractError
from tidemark.streaming import flows as FL


def test_readers_never_fail_while_tables_are_published(spark):
    path = work_path(spark, "published")
    sinks.save_table(spark.range(1), path)
    seen, errors, done = set(), [], threading.Event()

    def read():
        while not done.is_set():
            try:
                seen.add(sinks.read_published(spark, path).count())
            except Exception as e:
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 9):
        sinks.save_table(spark.range(n), path)
    done.set()
    reader.join()
    assert not errors and seen <= set(range(1, 9)) and seen
    assert sinks.read_published(spark, path).count() == 8


def test_an_open_frame_keeps_its_version(spark):
    path = work_path(spark, "published")
    old = sinks.save_table(spark.range(5), path)
    sinks.save_table(old.where("id < 2"), path)  # reads the version it replaces
    assert old.count() == 5 and sinks.read_published(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, work_path(spark, "never"))


def test_cache_publishes_only_what_passes(spark):
    path, built = work_path(spark, "cache"), []

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    def check(most):
        return lambda df: df.agg((F.count(F.lit(1)) > most).cast("int").alias("violations")).select(F.lit("size").alias("check"), "violations")

    with pytest.raises(ContractError):
        sinks.feature_table_cache(spark, path, build(9), check(5))
    assert sinks.feature_table_cache(spark, path, build(3), check(5)).count() == 3
    assert sinks.feature_table_cache(spark, path, build(4), check(5)).count() == 3
    with pytest.raises(ContractError):
        sinks.feature_table_cache(spark, path, build(9), check(5), rebuild=True)
    assert sinks.feature_table_cache(spark, path, build(4), check(5)).count() == 3
    assert sinks.feature_table_cache(spark, path, build(4), check(5), rebuild=True).count() == 4 and built == [9, 3, 9, 4]


# ---- search inside one material


def search_brute(chunks, question, k):
    words = lambda t: re.findall(r"\w{2,}", t.lower())
    tf = [Counter(words(t)) for _, t in chunks]
    df = Counter(w for c in tf for w in c)
    idf = {w: math.log((1 + len(chunks)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(c):
        v = {w: n * idf[w] for w, n in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    q = unit(Counter(words(question)))
    scored = [(-round(sum(x * unit(c).get(w, 0) for w, x in q.items()), 9), no) for (no, _), c in zip(chunks, tf)]
    return [(no, -s) for s, no in sorted(scored)[:max(1, k)]]


@pytest.mark.parametrize("k", [0, 2, 4])
def test_search_inside_one_material(spark, k):
    r = random.Random(6)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta x yy".split())
    materials = {m: [(no, " ".join(word() for _ in range(r.randint(1, 12)))) for no in range(1, n + 1)] for m, n in ((1, 1), (2, 7), (3, 40))}
    asked = [(10, 1, "alpha beta"), (11, 2, "gamma gamma delta"), (12, 3, "unknown words only"), (13, 3, "eps"), (14, 3, ""), (15, 2, "theta unknown")]
    chunks = spark.createDataFrame([(m, no, t) for m, c in materials.items() for no, t in c], "material_id int, chunk_no int, text string")
    found = RT.material_search(chunks, spark.createDataFrame(asked, "question_id int, material_id int, text string"), k).collect()
    for q, m, text in asked:
        got = [(r.chunk_no, r.score) for r in sorted((x for x in found if x.question_id == q), key=lambda x: x["rank"])]
        want = search_brute(materials[m], text, k)
        assert [n for n, _ in got] == [n for n, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-8)


def test_search_reads_postings_only(spark):
    """No cross join and no Python: question terms meet their material's postings."""
    chunks = spark.createDataFrame([(1, 1, "one two")], "material_id int, chunk_no int, text string")
    found = RT.material_search(chunks, spark.createDataFrame([(1, 1, "one")], "question_id int, material_id int, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


# ---- streams


def delivered(spark, rows, schema, files, name):
    """One file for each list of rows, in that order of arrival."""
    inbox = work_path(spark, name)
    for part in files:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(inbox)
    return FL.file_stream(spark, inbox, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def dealt(r, n, files):
    order = r.sample(range(n), n)
    return [order[k::files] for k in range(files)]


def test_dialogue_lines_in_any_order(spark):
    r = random.Random(1)
    rows = [(chat, turn, None if turn == 0 else f"m{chat}.{turn}") for chat in (1, 2) for turn in range(31)]
    schema = "chat_id bigint, turn bigint, line string"
    files = dealt(r, len(rows), 4)
    files[3] += files[0][:5]  # some come again
    stream = delivered(spark, rows, schema, files, "lines")
    found = FL.run_stateful(FL.dialog_memory(stream), work_path(spark, "memory"), work_path(spark, "offsets"))
    batch = D.dialog_compaction(spark.createDataFrame([x for x in rows if x[2]], schema))
    key = lambda df: sorted((x.chat_id, x.exchange, x.held, x.evicted) for x in df.collect())
    assert key(found) == key(batch) and found.count() == 30


def test_missing_turns_are_given_up_after_patience(spark):
    """Turn 2 never comes: the lines behind it wait, then go on without it."""
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 3, "c"), (1, 4, "d"), (2, 0, "x")]
    schema = "chat_id bigint, turn bigint, line string"
    stream = delivered(spark, rows, schema, [[0, 1], [2, 3], [4]], "lines")
    path, before = work_path(spark, "memory"), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (
        FL.dialog_memory(stream, patience_ms=1).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", work_path(spark, "offsets")).trigger(processingTime="200 milliseconds").start())
    try:
        found, end = [], time.time() + 60
        while len(found) < 2 and time.time() < end:
            time.sleep(1)
            if os.path.isdir(f"{path}/_spark_metadata"):
                found = spark.read.schema("chat_id bigint, exchange bigint").parquet(path).collect()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set(
            "spark.sql.streaming.stateStore.providerClass", before)
    assert sorted((x.chat_id, x.exchange) for x in found) == [(1, 1), (1, 2)]


def test_every_update_is_answered_once(spark):
    r = random.Random(2)
    rows = [(i, i % 7 if i % 10 else None, f"t{i}" if i % 9 else " ") for i in [*range(-40, 900), 2**40, 2**40 + 1]]
    files = dealt(r, len(rows), 3)
    files.append(sorted(files[0] + files[1][:50]))
    stream = delivered(spark, rows, "update_id bigint, chat_id bigint, text string", files, "updates")
    found = FL.run_stateful(FL.chat_updates(stream), work_path(spark, "replies"), work_path(spark, "offsets"))
    want = sorted((i, i + 1, c, t) for i, c, t in rows if c is not None and t.strip())
    assert sorted(tuple(x) for x in found.select("update_id", "next_offset", "chat_id", "text").collect()) == want


def test_a_full_range_becomes_a_flag(spark, monkeypatch):
    monkeypatch.setattr(FL, "RANGE", 16)
    monkeypatch.setattr(FL, "LANES", 2)
    rows = [(i, 1, "t") for i in range(64)]
    stream = delivered(spark, rows, "update_id bigint, chat_id bigint, text string", [range(40), range(64), range(64)], "updates")
    found = FL.run_stateful(FL.chat_updates(stream), work_path(spark, "replies"), work_path(spark, "offsets"))
    assert sorted(x.update_id for x in found.collect()) == list(range(64))


def test_materials_by_version(spark):
    """Higher versions count whenever they come, within a batch and over compactions."""
    rows = [(1, "new text", 3), (1, "old", 1), (2, " ", 1), (2, "filled", 2), (3, "kept", 5), (3, "", 4), (1, "", 2), (4, None, 1)]
    stream = delivered(spark, rows, "doc_id bigint, text string, version int", [[0, 1], [2], [3, 4], [5], [6], [7]], "uploads")
    log = work_path(spark, "status")
    found = FL.ingest_materials(stream, log, work_path(spark, "offsets"), compact_every=2)
    assert {r.material_id: (r.status, r.characters_count) for r in found.collect()} == {
        1: ("processed", 8), 2: ("processed", 6), 3: ("processed", 4), 4: ("failed", 0)}
    assert FL.status_rows(spark, log).count() == 4  # one compacted snapshot, nothing since


# ---- branches of whole-table queries


def test_lookup_falls_back_to_popularity(spark):
    requests = spark.createDataFrame([("a", 2), ("b", 1)], "customer_id string, k bigint")
    stored = spark.createDataFrame([("a", "7", 1, 0.5), ("a", "8", 2, 0.4), ("a", "9", 3, 0.1)], "customer_id string, article_id string, rank int, score double")
    popular = spark.createDataFrame([("1", 1, 5), ("2", 2, 4)], "article_id string, popularity_rank int, purchases bigint")
    found = K.recommend_lookup(requests, stored, popular).collect()
    assert sorted((r.customer_id, r.source, r["rank"], r.article_id) for r in found) == [
        ("a", "personalized", 1, "7"), ("a", "personalized", 2, "8"), ("b", "popularity_fallback", 1, "1")]


class Calls:
    """State of one key in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*values):
            self.calls += 1
            if name in ("update", "put"):
                self.rows[None] = values[0]
            elif name == "updateValue":
                self.rows[values[0]] = values[1]
            elif name == "removeKey":
                del self.rows[values[0]]
            elif name in ("exists", "containsKey"):
                return (values[0] if values else None) in self.rows
            elif name == "keys":
                return iter(list(self.rows))
            elif name == "get":
                return self.rows.get(None)
            else:
                return self.rows.get(values[0])
        return call


def test_waiting_lines_are_read_and_written_by_block():
    """Before, each line took four calls to the state, one by one."""
    states = {n: Calls() for n in ("lines", "waiting", "meta")}
    states["lines"].rows[None] = []
    memory = FL.DialogMemory(2, 4)
    vars(memory).update(states)
    turns = list(range(200))
    late, early = turns[:100:2], [*turns[1:100:2], *turns[100:]]
    found = []
    for part in (early, late, early):  # the first half comes again at the end
        rows = pd.DataFrame({"turn": part, "line": [f"l{t}" for t in part]})
        found += [tuple(r) for f in memory.handleInputRows((1,), iter([rows[:70], rows[70:]]), None) for r in f.itertuples(index=False)]
    assert [r[1] for r in found] == list(range(1, 101)) and found[2][2:] == (2, "l0\nl1\nl2\nl3")
    assert not states["waiting"].rows and states["meta"].rows[None][:2] == (200, 100)
    assert sum(s.calls for s in states.values()) < 60
