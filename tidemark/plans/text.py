"""Registered text queries: segments, chunks, TF-IDF, answers, terms, dialogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import dialog as D
from tidemark.operators import retrieval as RT
from tidemark.operators import text as TX
from tidemark.plans.registry import query, steadied, steady_sql, with_tables
from tidemark.session import materialized, work_path
from tidemark.sources import canonical as C
from tidemark.sources import readers

WS = S.SPACE


def trim_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{WS}+|{WS}+$', '', 'g')"


def spaced_sql(value: str) -> str:
    return f"regexp_replace({trim_sql(value)}, '{WS}+', ' ', 'g')"


COMPACT = f"""CASE WHEN length(c) <= 220 THEN c ELSE regexp_replace(substr(c, 1, 219), '{WS}+$', '') || '...' END"""

NUMBERED = """SELECT material_id, pos, text, source, length(text) AS n,
    row_number() OVER (PARTITION BY material_id ORDER BY pos) AS k FROM segments"""
PACKED = """SELECT material_id, k, CAST(1 AS BIGINT) AS g, CASE WHEN n > 1200 THEN -1 ELSE n END AS size
    FROM numbered WHERE k = 1 UNION ALL
    SELECT s.material_id, s.k, CASE WHEN s.n > 1200 OR p.size < 0 OR p.size + 2 + s.n > 1200 THEN p.g + 1 ELSE p.g END,
    CASE WHEN s.n > 1200 THEN -1 WHEN p.size < 0 OR p.size + 2 + s.n > 1200 THEN s.n ELSE p.size + 2 + s.n END
    FROM packed p JOIN numbered s ON s.material_id = p.material_id AND s.k = p.k + 1"""
PARTS = f"""SELECT material_id, g, 0 AS w, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text,
    arg_min(source, k) AS source_start, arg_max(source, k) AS source_end
    FROM numbered JOIN packed USING (material_id, k) WHERE n <= 1200 GROUP BY material_id, g UNION ALL
    SELECT material_id, g, w, {trim_sql('substr(text, w * 1000 + 1, 1200)')}, source, source FROM
    (SELECT *, unnest(range(0, CAST(ceil((n - 1200) / 1000.0) AS BIGINT) + 1)) AS w
    FROM numbered JOIN packed USING (material_id, k) WHERE n > 1200)"""
CHUNKS = """SELECT material_id, no AS chunk_no, printf('chunk_%04d', no) AS chunk_id, text, source_start, source_end FROM (
    SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY g, w) AS no FROM parts WHERE length(text) > 0)"""
QUESTIONS = """SELECT item_id AS question_id, text FROM benchmark"""
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TF = f"""SELECT material_id, chunk_no, term, count(*) AS tf FROM
    (SELECT material_id, chunk_no, unnest({TOKENS}) AS term FROM chunks) GROUP BY ALL"""
IDF = """SELECT term, ln((1.0 + (SELECT count(*) FROM chunks)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term"""
INDEX = """SELECT material_id, chunk_no, term, w / sqrt(sum(w * w) OVER (PARTITION BY material_id, chunk_no)) AS weight
    FROM (SELECT material_id, chunk_no, term, tf * idf AS w FROM tf JOIN idf USING (term))"""
HITS = f"""SELECT question_id, material_id, chunk_no, score, rank FROM (SELECT *, row_number() OVER (
    PARTITION BY question_id ORDER BY score DESC, material_id, chunk_no) AS rank FROM (
    SELECT q.question_id, c.material_id, c.chunk_no, round(coalesce(s.score, 0), 9) AS score
    FROM questions q CROSS JOIN chunks c LEFT JOIN (SELECT question_id, material_id, chunk_no, sum(q.weight * i.weight)
    AS score FROM (SELECT question_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY question_id)) AS weight FROM (
    SELECT question_id, term, count(*) * any_value(idf) AS w FROM (SELECT question_id, unnest({TOKENS}) AS term
    FROM questions) JOIN idf USING (term) GROUP BY question_id, term)) q JOIN index i USING (term) GROUP BY ALL) s
    ON s.question_id = q.question_id AND s.material_id = c.material_id AND s.chunk_no = c.chunk_no))
    WHERE rank <= 4"""
STEPS = {"numbered": NUMBERED, "packed": PACKED, "parts": PARTS, "chunks": CHUNKS, "questions": QUESTIONS, "tf": TF,
         "idf": IDF, "index": INDEX, "hits": HITS}


def base(last: str, **extra: str) -> str:
    names = list(STEPS)
    return with_tables("segments", **{n: STEPS[n] for n in names[: names.index(last) + 1]}, **extra)


def materials_of(spark, folder):
    return TX.segments_of(readers.table(spark, folder, "documents"))


def chunks_of(spark, folder):
    return TX.chunk_segments(materials_of(spark, folder))


def questions_of(spark, folder):
    return readers.table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), "text")


@query("read_text_materials", with_tables("segments") + """SELECT lang, count(*) AS lines FROM segments
    JOIN documents ON doc_id = material_id GROUP BY lang""")
def read_text_materials(spark, folder):
    """Documents written as text files, read back whole and counted by language."""
    path = work_path(spark, "materials")
    readers.table(spark, folder, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    files = readers.read_text_materials(spark, path)
    lines = files.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.explode(F.split("text", "\n")).alias("l"))
    return lines.where(F.length(S.trimmed("l")) > 0).groupBy("lang").agg(F.count(F.lit(1)).alias("lines"))


@query("chunk_segments", base("chunks") + "SELECT * FROM chunks")
def chunk_segments(spark, folder):
    return chunks_of(spark, folder)


@query("recursive_split")
def recursive_split(spark, folder):
    return RT.recursive_split(readers.table(spark, folder, "documents"))


@query("tfidf_index", base("tf", idf="""SELECT material_id, term, ln((1.0 + any_value(size)) / (1.0 + count(*))) + 1 AS idf
    FROM tf JOIN (SELECT material_id, count(*) AS size FROM chunks GROUP BY ALL) USING (material_id)
    GROUP BY material_id, term""") + f"""SELECT material_id, chunk_no, term,
    {steady_sql('w / sqrt(sum(w * w) OVER (PARTITION BY material_id, chunk_no))')} AS weight
    FROM (SELECT material_id, chunk_no, term, tf * idf AS w FROM tf JOIN idf USING (material_id, term))""")
def tfidf_index(spark, folder):
    return steadied(RT.tfidf_index(chunks_of(spark, folder)), {})


def hits_of(spark, folder):
    return RT.tfidf_search(chunks_of(spark, folder), questions_of(spark, folder))


@query("tfidf_search", base("hits") + f"""SELECT question_id, material_id, chunk_no, rank, {steady_sql('score', 4)} AS score
    FROM hits""")
def tfidf_search(spark, folder):
    return steadied(hits_of(spark, folder), {"score": 4})


@query("extractive_answer", base("hits") + f"""SELECT question_id,
    '{RT.ANSWER_HEAD.strip()}' || chr(10) || chr(10)
    || string_agg('- ' || substr({spaced_sql('text')}, 1, 500) || ' (' || source_start || ' -> ' || source_end || ')', chr(10) ORDER BY rank)
    || chr(10) || chr(10) || 'Источники:' || chr(10)
    || string_agg('* ' || source_start || ' -> ' || source_end, chr(10) ORDER BY rank) AS answer,
    string_agg(chunk_id || ' (' || source_start || ' -> ' || source_end || '):' || chr(10) || text,
    chr(10) || chr(10) ORDER BY rank) AS context
    FROM hits JOIN chunks USING (material_id, chunk_no) GROUP BY question_id""")
def extractive_answer(spark, folder):
    chunks = materialized(chunks_of(spark, folder), "chunks")
    return RT.extractive_answer(RT.tfidf_search(chunks, questions_of(spark, folder)), chunks)


def asked_of(spark, folder):
    """Each material is asked one question of the benchmark, dealt by its number."""
    items = readers.table(spark, folder, "benchmark").select("item_id", "text")
    size = items.agg(F.count(F.lit(1))).scalar()
    materials = readers.table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"), F.col("doc_id").alias("material_id"), F.pmod("doc_id", size).alias("item_id"))
    return materials.join(items, "item_id").select("question_id", "material_id", "text")


ASKED = """SELECT doc_id AS question_id, doc_id AS material_id, b.text FROM documents
    JOIN benchmark b ON b.item_id = doc_id % (SELECT count(*) FROM benchmark)"""
OWN_IDF = """SELECT material_id, term, ln((1.0 + any_value(size)) / (1.0 + count(*))) + 1 AS idf
    FROM tf JOIN (SELECT material_id, count(*) AS size FROM chunks GROUP BY ALL) USING (material_id) GROUP BY material_id, term"""
OWN_INDEX = """SELECT material_id, chunk_no, term, w / sqrt(sum(w * w) OVER (PARTITION BY material_id, chunk_no)) AS weight
    FROM (SELECT material_id, chunk_no, term, tf * idf AS w FROM tf JOIN own_idf USING (material_id, term))"""
OWN_HITS = f"""SELECT question_id, material_id, chunk_no, score, rank FROM (SELECT *, row_number() OVER (
    PARTITION BY question_id ORDER BY score DESC, chunk_no) AS rank FROM (
    SELECT q.question_id, c.material_id, c.chunk_no, round(coalesce(s.score, 0), 9) AS score
    FROM asked q JOIN chunks c USING (material_id) LEFT JOIN (SELECT question_id, chunk_no, sum(q.weight * i.weight)
    AS score FROM (SELECT question_id, material_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY question_id)) AS weight FROM (
    SELECT question_id, material_id, term, count(*) * any_value(idf) AS w FROM (SELECT question_id, material_id, unnest({TOKENS}) AS term
    FROM asked) JOIN own_idf USING (material_id, term) GROUP BY ALL)) q JOIN own_index i USING (material_id, term)
    GROUP BY ALL) s ON s.question_id = q.question_id AND s.chunk_no = c.chunk_no)) WHERE rank <= 4"""
OWN = {"asked": ASKED, "own_idf": OWN_IDF, "own_index": OWN_INDEX, "own_hits": OWN_HITS}


@query("material_search", base("tf", **OWN) + f"""SELECT question_id, material_id, chunk_no, rank,
    {steady_sql('score', 4)} AS score FROM own_hits""")
def material_search(spark, folder):
    return steadied(RT.material_search(materialized(chunks_of(spark, folder), "chunks"), asked_of(spark, folder)), {"score": 4})


@query("material_answer", base("tf", **OWN) + f"""SELECT question_id,
    '{RT.ANSWER_HEAD.strip()}' || chr(10) || chr(10)
    || string_agg('- ' || substr({spaced_sql('text')}, 1, 500) || ' (' || source_start || ' -> ' || source_end || ')', chr(10) ORDER BY rank)
    || chr(10) || chr(10) || 'Источники:' || chr(10)
    || string_agg('* ' || source_start || ' -> ' || source_end, chr(10) ORDER BY rank) AS answer,
    string_agg(chunk_id || ' (' || source_start || ' -> ' || source_end || '):' || chr(10) || text,
    chr(10) || chr(10) ORDER BY rank) AS context
    FROM own_hits JOIN chunks USING (material_id, chunk_no) GROUP BY question_id""")
def material_answer(spark, folder):
    chunks = materialized(chunks_of(spark, folder), "chunks")
    return RT.extractive_answer(RT.material_search(chunks, asked_of(spark, folder)), chunks)


@query("embedding_knn", f"""SELECT query_id, vec_id, rank, {steady_sql('distance', 4)} AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
    AS distance FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id)) WHERE rank <= 5""")
def embedding_knn(spark, folder):
    """Every stored vector asks for its nearest other vectors."""
    vectors = readers.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = RT.embedding_knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors, exclude_self=True)
    return steadied(found, {"distance": 4})


@query("material_stats", with_tables("segments") + """SELECT doc_id AS material_id,
    CASE WHEN coalesce(c, 0) = 0 THEN 'failed' ELSE 'processed' END AS status, coalesce(n, 0) AS segments_count,
    coalesce(c + 2 * (n - 1), 0) AS characters_count,
    CASE WHEN coalesce(c, 0) = 0 THEN 'No extractable text found' END AS error_message
    FROM documents LEFT JOIN (SELECT material_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS c FROM segments
    GROUP BY ALL) ON doc_id = material_id""")
def material_stats(spark, folder):
    return steadied(TX.material_stats(materials_of(spark, folder)), {})


@query("topics_fallback", with_tables("segments", numbered=NUMBERED, filled=f"""SELECT material_id, k, text, source
    FROM numbered WHERE k <= 3 UNION ALL SELECT doc_id, 1, 'Материал', 'text' FROM documents
    WHERE doc_id NOT IN (SELECT material_id FROM segments)""", c=f"""SELECT material_id, k,
    {spaced_sql('text')} AS c, source FROM filled""") + f"""SELECT material_id, k AS topic_no, 'Тема ' || k AS title,
    {COMPACT} AS summary, source AS source_start, source AS source_end FROM c""")
def topics_fallback(spark, folder):
    return steadied(TX.topics_fallback(materials_of(spark, folder)), {})


@query("key_terms", with_tables("segments", words=f"""SELECT material_id, source, pos, ws[i] AS term, i FROM (
    SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (
    SELECT *, regexp_extract_all(text, '{TX.TERM_PATTERN}') AS ws FROM segments))""",
    firsts=f"""SELECT material_id, lower(term) AS key, min((pos, i)) AS place, arg_min(term, (pos, i)) AS term,
    arg_min(source, (pos, i)) AS source FROM words WHERE lower(term) NOT IN
    ({', '.join(f"'{w}'" for w in TX.TERM_STOP_WORDS)}) GROUP BY material_id, lower(term)""",
    ranked="SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY place) AS term_no FROM firsts") + f"""
    SELECT material_id, term_no, term, '{TX.TERM_DEFINITION[0]}' || source || '.' AS definition, source FROM ranked
    WHERE term_no <= 5 UNION ALL SELECT doc_id, 1, '{TX.DEFAULT_TERM}', '{TX.DEFAULT_DEFINITION}', 'text'
    FROM documents WHERE doc_id NOT IN (SELECT material_id FROM firsts)""")
def key_terms(spark, folder):
    return steadied(TX.key_terms(materials_of(spark, folder)), {})


@query("prompt_budget", with_tables("segments", l="""SELECT material_id, pos, '- ' || source || ': ' || substr(text, 1, 500)
    AS line FROM segments""", u="""SELECT *, sum(length(line)) OVER (PARTITION BY material_id ORDER BY pos) AS used
    FROM l""") + """SELECT doc_id AS material_id, count(line) AS segments_kept,
    CAST(coalesce(max(used), 0) AS BIGINT) AS used_chars, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS prompt
    FROM documents LEFT JOIN (SELECT * FROM u WHERE used <= 8000) ON doc_id = material_id GROUP BY doc_id""")
def prompt_budget(spark, folder):
    return steadied(TX.prompt_budget(materials_of(spark, folder)), {})


@query("compact_text", f"""SELECT doc_id, {COMPACT} AS compact
    FROM (SELECT doc_id, {spaced_sql('text')} AS c FROM documents)""")
def compact_text(spark, folder):
    return readers.table(spark, folder, "documents").select("doc_id", S.compact_text("text").alias("compact"))


@query("truncate_for_model", f"""SELECT doc_id, CASE WHEN length(text) <= 25000 THEN text
    ELSE regexp_replace(substr(text, 1, 25000), '{WS}+$', '') || chr(10) || chr(10)
    || '{S.CUT_NOTICE.strip()}' END AS text FROM documents""")
def truncate_for_model(spark, folder):
    return readers.table(spark, folder, "documents").select("doc_id", S.truncate_for_model("text").alias("text"))


REPLY = """CASE event_id % 5
    WHEN 0 THEN '[{"title": " ' || event_type || ' ", "summary": "s' || user_id || '", "source_start": "p' || event_id || '"}]'
    WHEN 1 THEN 'Sure: [{"title": "' || event_type || '", "summary": "s"}, {"title": "", "summary": "x"}] done'
    WHEN 2 THEN '{"title": "single", "summary": "object"}' WHEN 3 THEN 'no array here' ELSE '[{"title": "cut' END"""


def replies_of(spark, folder):
    """Model-like replies built from events: bare, wrapped, object, none, broken."""
    rows = readers.table(spark, folder, "events")
    case = F.col("event_id") % 5
    event, user = F.col("event_type"), F.col("user_id").cast("string")
    bare = F.concat(F.lit('[{"title": " '), event, F.lit(' ", "summary": "s'), user, F.lit('", "source_start": "p'),
                    F.col("event_id").cast("string"), F.lit('"}]'))
    wrapped = F.concat(F.lit('Sure: [{"title": "'), event, F.lit('", "summary": "s"}, {"title": "", "summary": "x"}] done'))
    text = (
        F.when(case == 0, bare).when(case == 1, wrapped).when(case == 2, '{"title": "single", "summary": "object"}')
        .when(case == 3, "no array here").otherwise('[{"title": "cut')
    )
    return rows.select(F.col("event_id").alias("reply_id"), text.alias("text"))


@query("json_array_rows", """SELECT event_id AS reply_id, event_type AS title, CASE event_id % 5 WHEN 0 THEN 's' || user_id
    ELSE 's' END AS summary, CASE event_id % 5 WHEN 0 THEN 'p' || event_id ELSE 'text' END AS source_start,
    'text' AS source_end FROM events WHERE event_id % 5 IN (0, 1)""")
def json_array_rows(spark, folder):
    return TX.json_array_records(replies_of(spark, folder), "reply_id")


# --- dialogue ----------------------------------------------------------------

LINES = "SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn, line) AS n FROM dialogue"


@query("dialog_context", with_tables("dialogue", l=LINES, ctx="""SELECT *, list(line) OVER (PARTITION BY chat_id ORDER BY n
    ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS c FROM l""") + """SELECT chat_id, turn, line,
    coalesce(array_to_string(c, chr(10)), '') AS context FROM ctx WHERE role = 'user'""")
def dialog_context(spark, folder):
    return D.dialog_context(C.dialogue(spark, folder))


KEEP, OVER = 2, 4  # the synthetic chats are short: the defaults (6, 10) would never compact


@query("dialog_compaction", with_tables("dialogue", l=LINES, sizes="SELECT chat_id, count(*) // 2 AS e FROM l GROUP BY ALL",
    sim=f"""SELECT chat_id, e, CAST(0 AS BIGINT) AS exchange, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS gone,
    CAST(0 AS BIGINT) AS before FROM sizes UNION ALL SELECT chat_id, e, exchange + 1,
    CASE WHEN held + 2 > {OVER} THEN {KEEP} ELSE held + 2 END,
    CASE WHEN held + 2 > {OVER} THEN gone + held + 2 - {KEEP} ELSE gone END, gone FROM sim WHERE exchange < e""") + """
    SELECT s.chat_id, exchange, any_value(held) AS held, string_agg(line, chr(10) ORDER BY n) AS evicted
    FROM sim s LEFT JOIN l ON l.chat_id = s.chat_id AND n > before AND n <= gone WHERE exchange > 0
    GROUP BY s.chat_id, exchange""")
def dialog_compaction(spark, folder):
    return steadied(D.dialog_compaction(C.dialogue(spark, folder), KEEP, OVER), {})
