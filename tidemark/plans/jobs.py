"""Registered job-reporting queries and the scalar functions they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import jobs as J
from tidemark.plans.registry import query, steadied, steady_sql, with_tables
from tidemark.sources import readers

LISTING = """SELECT page_id, url AS path, CAST(page_id AS VARCHAR) AS stem, CASE page_id % 5 WHEN 0 THEN page_id || '.jpg'
    WHEN 1 THEN page_id || '.PNG' WHEN 2 THEN page_id || '.v2.jpeg' WHEN 3 THEN page_id || '.txt'
    ELSE '.' || page_id || '.jpg' END AS file_name FROM pages"""


def listing_of(spark, folder):
    number = F.col("page_id").cast("string")
    case = F.col("page_id") % 5
    name = (
        F.when(case == 0, F.concat(number, F.lit(".jpg"))).when(case == 1, F.concat(number, F.lit(".PNG")))
        .when(case == 2, F.concat(number, F.lit(".v2.jpeg"))).when(case == 3, F.concat(number, F.lit(".txt")))
        .otherwise(F.concat(F.lit("."), number, F.lit(".jpg")))
    )
    return readers.table(spark, folder, "pages").select("page_id", F.col("url").alias("path"), name.alias("file_name"))


@query("batch_inventory", with_tables(l=LISTING, o="""SELECT *, CASE page_id % 5 WHEN 0 THEN stem || '_face.jpg'
    WHEN 1 THEN stem || '_face.PNG' WHEN 2 THEN stem || '.v2_face.jpeg' END AS output_file FROM l""") + """
    SELECT page_id, file_name, output_file, CASE WHEN output_file IS NULL THEN 'ignored' WHEN page_id % 7 = 0
    THEN 'skipped' ELSE 'todo' END AS status FROM o""")
def batch_inventory(spark, folder):
    listing = listing_of(spark, folder)
    stem = F.regexp_extract("file_name", r"^(.*)\.[^.]+$", 1)
    done = listing.where("page_id % 7 = 0").select(
        F.concat(stem, F.lit("_face."), F.regexp_extract("file_name", r"([^.]+)$", 1)).alias("file_name"))
    return readers.batch_inventory(listing, done).drop("path")


@query("pair_files", with_tables(l=LISTING) + """SELECT file_name, path AS image_path, '/masks/' || file_name AS mask_path
    FROM l WHERE page_id % 3 <> 0""")
def pair_files(spark, folder):
    images = listing_of(spark, folder).select("path", "file_name")
    masks = listing_of(spark, folder).where("page_id % 3 <> 0").select(
        F.concat(F.lit("/masks/"), "file_name").alias("path"), "file_name")
    return readers.pair_files(images, masks)


@query("source_type", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'audio' WHEN 2 THEN 'video'
    WHEN 3 THEN 'document' ELSE 'invalid' END AS source_type FROM pages""")
def source_type(spark, folder):
    endings = F.array(*[F.lit(e) for e in (".PDF", ".mp3", ".tar.mov", ".Md", ".exe", "txt")])
    name = F.concat(F.lit("a/b.c/f"), F.col("page_id").cast("string"), F.get(endings, (F.col("page_id") % 6).cast("int")))
    return readers.table(spark, folder, "pages").select("page_id", S.source_type(name).alias("source_type"))


@query("video_id", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 's' || page_id
    WHEN 2 THEN 'b' || page_id END AS video_id FROM pages""")
def video_id(spark, folder):
    number = F.col("page_id").cast("string")
    case = F.col("page_id") % 6
    url = (
        F.when(case == 0, F.concat(F.lit(" https://WWW.youtube.com/watch?list=x&v=v"), number, F.lit("&t=3 ")))
        .when(case == 1, F.concat(F.lit("https://m.youtube.com/shorts/s"), number, F.lit("/more")))
        .when(case == 2, F.concat(F.lit("https://youtu.be/b"), number, F.lit("?si=1")))
        .when(case == 3, F.concat(F.lit("https://www.youtube.com/playlist?v="), number))
        .when(case == 4, F.concat(F.lit("https://example.org/watch?v="), number)).otherwise(F.col("url"))
    )
    return readers.table(spark, folder, "pages").select("page_id", S.video_id(url).alias("video_id"))


@query("format_seconds", """SELECT event_id, printf('%02d:%02d:%02d', t // 3600, (t % 3600) // 60, t % 60) AS clock
    FROM (SELECT event_id, greatest(CAST(trunc(value * 997 - 2000) AS BIGINT), 0) AS t FROM events)""")
def format_seconds(spark, folder):
    clock = S.format_seconds(F.col("value") * 997 - 2000)
    return readers.table(spark, folder, "events").select("event_id", clock.alias("clock"))


@query("week_parity", """SELECT o_orderkey, 1 + (((d - make_date(year(d) - CASE WHEN month(d) < 9 THEN 1 ELSE 0 END, 9, 1))
    // 7) % 4) % 2 AS parity FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def week_parity(spark, folder):
    return steadied(readers.table(spark, folder, "orders").select("o_orderkey", S.week_parity("o_orderdate").alias("parity")), {})


@query("parse_count", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN greatest(1, least(20, user_id))
    WHEN 1 THEN greatest(1, least(20, user_id)) WHEN 2 THEN 10 WHEN 3 THEN 1 ELSE 20 END AS wanted FROM events""")
def parse_count(spark, folder):
    user = F.col("user_id").cast("string")
    case = F.col("event_id") % 5
    text = (
        F.when(case == 0, F.concat(F.lit(" "), user, F.lit(" "))).when(case == 1, F.concat(F.lit("give "), user, F.lit(" of 7")))
        .when(case == 2, " none ").when(case == 3, F.concat(F.lit("-"), user)).otherwise(F.repeat(F.lit("9"), F.lit(45)))
    )
    return steadied(readers.table(spark, folder, "events").select("event_id", S.parse_count(text).alias("wanted")), {})


BOXES = """SELECT l_orderkey AS image, l_partkey * 10 + l_linenumber AS pos, l_partkey % 100 - 10 AS x,
    l_suppkey % 90 - 5 AS y, l_linenumber * 3 + l_partkey % 7 AS width, l_linenumber * 2 + l_partkey % 11 AS height
    FROM lineitem"""


def boxes_of(spark, folder):
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    return readers.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image"), (part * 10 + line).alias("pos"), (part % 100 - 10).alias("x"),
        (F.col("l_suppkey") % 90 - 5).alias("y"), (line * 3 + part % 7).alias("width"), (line * 2 + part % 11).alias("height"),
    )


@query("largest_box", with_tables(b=BOXES, g="""SELECT image, count(*) AS boxes, arg_max({'x': x, 'y': y, 'width': width,
    'height': height}, (width * height, -pos, x, y)) AS b FROM b GROUP BY image""") + """SELECT image, boxes, b.x AS x,
    b.y AS y, b.width AS width, b.height AS height FROM g""")
def largest_box(spark, folder):
    boxes = boxes_of(spark, folder).withColumn("pos", F.col("pos") * 10000 - F.col("x") * 100 - F.col("y"))
    return steadied(J.largest_box(boxes), {})


@query("expand_box", with_tables(b=BOXES, e="""SELECT *, greatest(x - CAST(floor(CAST(0.3 AS DOUBLE) * width + 0.5) AS BIGINT), 0) AS x1,
    greatest(y - CAST(floor(CAST(0.4 AS DOUBLE) * height + 0.5) AS BIGINT), 0) AS y1,
    least(x + width + CAST(floor(CAST(0.3 AS DOUBLE) * width + 0.5) AS BIGINT), 80) AS x2,
    least(y + height + CAST(floor(CAST(0.5 AS DOUBLE) * height + 0.5) AS BIGINT), 60) AS y2,
    width > 0 AND height > 0 AND x < 80 AND y < 60 AND x + width > 0 AND y + height > 0 AS meets FROM b""") + """
    SELECT image, pos, CASE WHEN meets THEN x1 END AS x, CASE WHEN meets THEN y1 END AS y,
    CASE WHEN meets THEN x2 - x1 END AS width, CASE WHEN meets THEN y2 - y1 END AS height FROM e""")
def expand_box(spark, folder):
    grown = S.expand_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(80), F.lit(60))
    return steadied(boxes_of(spark, folder).withColumn("_b", grown).select("image", "pos", "_b.*"), {})


DETECTIONS = """SELECT l_orderkey AS image, (l_linenumber % 4) * 90 AS angle, CASE WHEN l_partkey % 4 <> 0
    THEN l_partkey % 50 + 1 END AS width, CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey % 40 + 1 END AS height,
    100 + (l_linenumber % 2) * 60 AS iw, 160 - (l_linenumber % 2) * 60 AS ih, l_linenumber % 4 + CAST(0.5 AS DOUBLE) AS ms
    FROM lineitem"""


@query("best_orientation", with_tables(d=DETECTIONS, a="""SELECT image, angle, max(CAST(width * height AS DOUBLE) / (iw * ih)) AS r,
    count(width) AS faces, max(ms) AS ms FROM d GROUP BY ALL""", t="SELECT image, sum(ms) AS total FROM a GROUP BY ALL",
    b="""SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(r, 12) DESC, angle) AS n FROM a WHERE faces > 0""") + f"""
    SELECT t.image, angle, {steady_sql('r')} AS relative_area, faces, {steady_sql('total')} AS total_time_ms
    FROM t LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON t.image = b.image""")
def best_orientation(spark, folder):
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    detections = readers.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image"), ((line % 4) * 90).alias("angle"),
        F.when(part % 4 != 0, part % 50 + 1).alias("width"), F.when(part % 4 != 0, F.col("l_suppkey") % 40 + 1).alias("height"),
        (100 + (line % 2) * 60).alias("image_width"), (160 - (line % 2) * 60).alias("image_height"),
        (line % 4 + 0.5).alias("time_ms"),
    )
    return steadied(J.best_orientation(detections), {})


@query("batch_run_summary", f"""SELECT count(*) FILTER (s <> 'ignored') AS total_supported, count(*) FILTER (s = 'success')
    AS successful, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped,
    count(*) FILTER (s = 'ignored') AS ignored, {steady_sql("coalesce(sum(value) FILTER (s = 'success'), 0)", 2)}
    AS total_detection_time_ms FROM (SELECT value, ['success', 'failed', 'skipped', 'ignored', 'success'][event_id % 5 + 1]
    AS s FROM events)""")
def batch_run_summary(spark, folder):
    states = F.array(*[F.lit(s) for s in ("success", "failed", "skipped", "ignored", "success")])
    items = readers.table(spark, folder, "events").select(
        F.get(states, (F.col("event_id") % 5).cast("int")).alias("status"), F.col("value").alias("detection_time_ms"))
    return steadied(J.batch_run_summary(items), {"total_detection_time_ms": 2})


def payloads_of(spark, folder):
    """One nested payload per part: an item with and an item without details."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    salary = (
        F.when(key % 4 == 0, F.lit("null"))
        .when(key % 4 == 1, F.concat(F.lit('{"from": '), size, F.lit('000, "to": null, "currency": "RUR"}')))
        .when(key % 4 == 2, F.concat(F.lit('{"from": null, "to": '), size, F.lit('500, "currency": "usd"}')))
        .otherwise(F.concat(F.lit('{"from": '), size, F.lit('100, "to": '), size, F.lit("900}")))
    )
    body = F.concat(
        F.lit('{"items": [{"name": " '), "p_name", F.lit(' ", "alternate_url": "u'), key.cast("string"),
        F.lit('", "employer": {"name": "'), "p_brand", F.lit('"}, "salary": '), salary,
        F.lit(', "snippet": {"requirement": "", "responsibility": "'), "p_type", F.lit('"}}, {"name": "Менеджер '), "p_name", F.lit('"}]}'),
    )
    return readers.table(spark, folder, "part").select(key.alias("payload_id"), body.alias("body"))


LISTINGS = """SELECT p_partkey AS payload_id, CAST(0 AS BIGINT) AS item_no, p_name AS name, p_brand AS employer,
    CASE p_partkey % 4 WHEN 1 THEN p_size * 1000 WHEN 3 THEN CAST(p_size || '100' AS BIGINT) END AS salary_from,
    CASE p_partkey % 4 WHEN 2 THEN CAST(p_size || '500' AS BIGINT) WHEN 3 THEN CAST(p_size || '900' AS BIGINT) END AS salary_to,
    CASE WHEN p_partkey % 4 = 2 THEN 'USD' ELSE 'RUR' END AS currency, p_type AS snippet, 'u' || p_partkey AS url FROM part
    UNION ALL SELECT p_partkey, 1, 'Менеджер ' || p_name, NULL, NULL, NULL, 'RUR', NULL, NULL FROM part"""


@query("explode_listings", with_tables(l=LISTINGS) + "SELECT * FROM l")
def explode_listings(spark, folder):
    return steadied(J.explode_listings(payloads_of(spark, folder)), {})


@query("rank_listings", with_tables(l=LISTINGS, t="""SELECT payload_id, item_no, name, employer, url, snippet, salary_from, salary_to,
    coalesce(greatest(salary_from, salary_to), 0) AS best_salary, CASE WHEN salary_from IS NOT NULL AND salary_to IS NOT NULL
    THEN replace(format('{:,}', salary_from) || ' – ' || format('{:,}', salary_to), ',', ' ') || ' ' || sign
    WHEN salary_from IS NOT NULL THEN 'от ' || replace(format('{:,}', salary_from), ',', ' ') || ' ' || sign
    WHEN salary_to IS NOT NULL THEN 'до ' || replace(format('{:,}', salary_to), ',', ' ') || ' ' || sign
    ELSE 'не указана' END AS salary_text FROM (SELECT *, CASE currency WHEN 'RUR' THEN '₽' ELSE currency END AS sign FROM l
    WHERE lower(name) NOT LIKE '%менеджер%' AND lower(name) NOT LIKE '%small%')
    ORDER BY best_salary DESC, payload_id, item_no LIMIT 20""", r="""SELECT *, row_number() OVER (ORDER BY best_salary DESC,
    payload_id, item_no) AS place FROM t""") + """SELECT payload_id, item_no, place, best_salary, salary_text,
    place || '. ' || name || chr(10) || '   Работодатель: ' || employer || chr(10) || '   Зарплата: ' || salary_text
    || chr(10) || '   Ссылка: ' || url || chr(10) || '   Кратко: ' || snippet AS display FROM r""")
def rank_listings(spark, folder):
    listings = J.explode_listings(payloads_of(spark, folder))
    top = J.rank_listings(listings, 20, (*J.EXCLUDED_WORDS, "small"))
    return steadied(top.select("payload_id", "item_no", "place", "best_salary", "salary_text", "display"), {})


LESSONS = """SELECT user_id % 20 AS grp, isodow(ts) AS day, CAST(hour(ts) AS BIGINT) AS code,
    event_type || CASE event_id % 3 WHEN 0 THEN ' [Пр]' WHEN 1 THEN ' [Лаб]' ELSE ' [Лек]' END AS subject,
    't' || user_id % 3 AS teacher, CAST(ts AS DATE) AS d FROM events"""
SLOTS = """SELECT CAST(h AS BIGINT) AS code, printf('%02d:00', h) AS time_from, printf('%02d:45', h) AS time_to
    FROM (SELECT DISTINCT hour(ts) AS h FROM events)"""


def lessons_of(spark, folder):
    kinds = F.array(*[F.lit(m) for m in (J.PRACTICE, J.LAB, J.LECTURE)])
    return readers.table(spark, folder, "events").select(
        (F.col("user_id") % 20).alias("grp"), (F.weekday("ts") + 1).cast("bigint").alias("day"),
        F.hour("ts").cast("bigint").alias("code"),
        F.concat("event_type", F.lit(" "), F.get(kinds, (F.col("event_id") % 3).cast("int"))).alias("subject"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("teacher"), F.to_date("ts").alias("d"),
    )


@query("schedule_with_gaps", with_tables(a=LESSONS, s=SLOTS, l="""SELECT DISTINCT grp, day, code, subject, teacher FROM a""", b="SELECT grp, day, min(code) AS lo, max(code) AS hi FROM l GROUP BY ALL") + """
    SELECT b.grp, b.day, s.code, time_from, time_to, coalesce(subject, 'окно') AS subject, teacher, subject IS NULL AS is_gap
    FROM b JOIN s ON s.code BETWEEN lo AND hi LEFT JOIN l ON l.grp = b.grp AND l.day = b.day AND l.code = s.code""")
def schedule_with_gaps(spark, folder):
    """All events as lessons of their group, day and hour."""
    rows = lessons_of(spark, folder)
    slots = rows.select("code").distinct().select(
        "code", F.format_string("%02d:00", "code").alias("time_from"), F.format_string("%02d:45", "code").alias("time_to"))
    return J.schedule_with_gaps(rows.drop("d"), slots, ["grp", "day"])


@query("parity_variant", with_tables(a=LESSONS, m="""SELECT *, split_part(subject, ' [', 1) AS base, 1 + (((d - DATE '2023-09-01') // 7) % 4) % 2 AS parity
    FROM a""", f="""SELECT grp, day, code, base, bool_or(subject LIKE '%[Пр]%') AND bool_or(subject LIKE '%[Лаб]%') AS two FROM m
    GROUP BY ALL""") + """SELECT grp, day, code, subject, teacher, d FROM m JOIN f USING (grp, day, code, base)
    WHERE NOT two OR (parity = 1 AND subject LIKE '%[Лаб]%') OR (parity = 2 AND subject LIKE '%[Пр]%')""")
def parity_variant(spark, folder):
    return J.parity_variant(lessons_of(spark, folder), S.week_parity("d"), ["grp", "day", "code"])
