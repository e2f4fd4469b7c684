"""Operators of the training-data package against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from tidemark.llm import exact_dedup, language_id, mixing, near_dedup, packing, quality_rules, queries, sharding, substring_dedup, suffix_dedup, toxicity
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, slot int, label string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(odd=True):
    """Texts with shared passages, copies, near copies, periodic runs; nulls and repeated rows."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7)))
    passage = [word() for _ in range(70)]
    texts = []
    for k in range(60):
        own = [word() for _ in range(r.randint(5, 150))]
        if k % 4 == 0:
            at = r.randint(0, len(own))
            own[at:at] = passage[r.randint(0, 15):]
        if k % 9 == 0:
            own += ["to"] * 60
        texts.append(" ".join(own))
    texts += [texts[0], texts[1].replace(" ", "\n\t"), texts[3] + " tail", texts[3].upper(), "", " ", "x", "日本語 " * 40]
    rows = [(i * 3, t, r.choice(["en", "de", None]), r.choice(["src1", "src12", None]), 1, "z") for i, t in enumerate(texts)]
    if odd:
        rows += [(999, None, None, None, None, None), (None, texts[0], "en", "src1", 1, "z"), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def cut_brute(rows, symbols, length, glue):
    last = 2**63
    key = lambda i: last if i is None else i
    owner = {}
    for i, t, *_ in rows:
        s = symbols(t or "")
        for p in range(len(s) - length + 1):
            w = tuple(s[p:p + length])
            owner[w] = min(owner.get(w, last), key(i))
    out = []
    for i, t, *_ in rows:
        s = symbols(t or "")
        gone = [False] * len(s)
        for p in range(len(s) - length + 1):
            if owner[tuple(s[p:p + length])] < key(i):
                gone[p:p + length] = [True] * length
        kept = glue([x for x, g in zip(s, gone) if not g])
        out.append((key(i), len(s), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cut_rows(df, n):
    return sorted((2**63 if r["doc_id"] is None else r["doc_id"], r[n], r["n_removed"],
                   hashlib.sha256(r["text"].encode() if isinstance(r["text"], str) else bytes(r["text"])).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("length", [50, 7])
def test_substring_dedup(docs, length):
    want = cut_brute(corpus(), lambda t: t.encode().split(), length, b" ".join)
    assert cut_rows(substring_dedup.substring_dedup(docs, length), "n_words") == want


def test_suffix_dedup(docs):
    want = cut_brute(corpus(), lambda t: t.encode(), 50, bytes)
    got = suffix_dedup.suffix_dedup(docs)
    assert cut_rows(got, "n_bytes") == want
    for r in got.collect():
        assert sum(b - a for a, b in zip(r["starts"], r["ends"])) == r["n_removed"]


def test_near_dedup(docs):
    rows = corpus()
    sets = []
    for i, t, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        sets.append((2**63 - 1 if i is None else i, frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()))
    label = {i: i for i, _ in sets}
    for _ in range(4):
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    none = lambda i: None if i == 2**63 - 1 else i
    assert got == {(none(i), len(s), none(label[i]), label[i] == i) for i, s in sets}


def test_leaves_full_of_near_copies(spark):
    """A leaf of many similar sets links them all, and nothing else."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(150)] = f"q{r.random()}"
        rows.append((i, " ".join(words)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = [frozenset(zip(t.split(), t.split()[1:])) for _, t in rows]
    label = list(range(400))
    changed = True
    pairs = [(i, j) for i in range(400) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert [got[i] for i in range(400)] == label


def test_exact_dedup(docs):
    rows = corpus()
    norm = [(2**63 if i is None else i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t, *_ in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    none = lambda i: None if i == 2**63 else i
    want = sorted(str((none(i), none(min(groups[t])), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())) for i, t in norm)
    got = exact_dedup.exact_dedup(docs, files_per_batch=1).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_packing_round_trip(docs):
    rows = corpus()
    json, ranks = packing.public_files()
    got = packing.pack(docs, json, ranks, capacity=64).collect()
    fill, seen = {}, {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    for i, group in texts.items():
        want = []
        for t in group:
            ids = slow.encode(t, add_special_tokens=False).ids + [0]
            for s in range(0, len(ids), 64):
                part = b"".join(x.to_bytes(4, "little") for x in ids[s:s + 64])
                want.append((s, len(part) // 4, zlib.crc32(part)))
        assert sorted(seen[i]) == sorted(want)
    total = sum(r["length"] for r in got)
    assert len(fill) <= -(-total // 64) + 3


def test_fast_tokenizer_gives_the_same_ids():
    r = random.Random(1)
    json, ranks = packing.public_files()
    chars = [chr(c) for c in (*range(1, 128), *range(160, 0x800))]
    for _ in range(300):
        text = "".join(r.choice(chars if r.random() < 0.3 else "ab  \n'st1") for _ in range(40))
        assert packing.token_ids(text, json, ranks).tolist() == packing.token_ids(text, json, None).tolist()


def test_shards_fit(docs):
    got = sharding.shard(docs, limit=4000).collect()
    assert len(got) == len(corpus())
    sums = {}
    for r in got:
        sums.setdefault((r["depth"], r["prefix"]), []).append(r)
    for rows in sums.values():
        total = sum(r["n_bytes"] for r in rows)
        assert all(r["shard_bytes"] == total for r in rows)
        assert total <= 4000 or len({r["doc_id"] for r in rows}) == 1
    for (d, p) in sums:  # only an oversized parent was split
        if d:
            parent = sum(r["n_bytes"] for (e, q), rows in sums.items() for r in rows if e >= d - 1 and q >> (e - d + 1) == p >> 1)
            assert parent > 4000


def test_mixing_reaches_budgets(docs):
    rows = [r.asDict() for r in mixing.mix_sources(docs, mixing.Mix(share=1500, epochs=2)).collect()]
    assert len(rows) == len(corpus())
    leaves = {}
    for r in rows:
        leaves.setdefault((r["domain"], r["lang"], r["source"]), []).append(r)
    for group in leaves.values():
        taken = sum(r["copies"] * r["n_tokens"] for r in group)
        budget = group[0]["leaf_budget"]
        assert budget <= 2 * sum(r["n_tokens"] for r in group)
        assert taken >= budget and taken - budget <= 2 * max(r["n_tokens"] for r in group)
    total = sum(r["n_tokens"] for r in rows)
    assert abs(sum(g[0]["leaf_budget"] for g in leaves.values()) - total * 3 // 2) <= 3 * len(leaves)


def test_statistics(docs):
    want = []
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        cover = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        want.append(str((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover))))
    got = quality_rules.text_statistics(docs).collect()
    assert sorted(str((r["doc_id"], *[r[c] for c in quality_rules.STATISTICS])) for r in got) == sorted(want)


def test_models_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = [r for r in language_id.op2_language_id(spark, FOLDER).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in found) > 0.95 * len(found)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    found = [r for r in toxicity.op5_toxicity(spark, FOLDER).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert sum(toxic[r["doc_id"]] == r["predicted"] for r in found) > 0.9 * len(found)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    found = [r for r in quality_rules.op10_quality_rules(spark, FOLDER).collect() if r["doc_id"] in quality and not r["base_failed"]]
    assert sum(quality[r["doc_id"]] == r["kept"] for r in found) > 0.9 * len(found)


def test_odd_rows_of_models(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 1), (3, 0, 0), (6, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for table, n in ((docs, len(corpus())), (empty, 0)):
        found = language_id.identify_language(table, table)
        assert found.count() == n and set(table.columns) < set(found.columns)
        assert toxicity.toxicity(table, labels).count() == n
        assert quality_rules.quality_rules(table, labels).count() == n
    blank = language_id.identify_language(docs, docs).where("text IS NULL OR trim(text) = ''").collect()
    assert blank and all(r["lang_pred"] == "und" and r["score"] == 0 for r in blank)


def test_empty_tables(spark, empty):
    json, ranks = packing.public_files()
    for found in (substring_dedup.substring_dedup(empty), suffix_dedup.suffix_dedup(empty), near_dedup.near_duplicates(empty), exact_dedup.exact_dedup(empty),
                  packing.pack(empty, json, ranks), sharding.shard(empty), mixing.mix_sources(empty)):
        assert found.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_pipeline_on_odd_rows(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, FOLDER).collect(), SCHEMA)
        assert kept.columns == docs.columns and kept.count() <= before.count()
        if name == "exact_dedup":
            texts = [re.sub("[\x20\x09-\x0d]+", " ", r["text"]) for r in kept.collect()]
            assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]+", " ", r["text"]) for r in before.collect()})
        if name == "near_dedup":
            assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in near_dedup.near_duplicates(before).collect() if r["kept"]}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def scattered(changed, prefix=""):
    """200 distinct words, and the same with ``changed`` of them replaced far from each other."""
    words = [f"{prefix}w{k}" for k in range(200)]
    other = list(words)
    for k in range(changed):
        other[10 + 20 * k] = f"{prefix}new{k}"
    return " ".join(words), " ".join(other)


def test_near_stage_takes_five_words(spark):
    """Eight scattered words: 183/215 by two words, 156/236 by five; two of them: 186/206 by five."""
    rows = [(k, t) for k, t in enumerate([*scattered(8, "a"), *scattered(2, "b"), "x y", "x y z"])]
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))})
    close = [(i, j) for j in range(len(rows)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert close == [(2, 3)]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), FOLDER)
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 4, 5}


def test_language_stage_rejects(spark):
    """Gibberish and a language never learnt go; clean texts stay, short ones too."""
    r = random.Random(4)
    letters, vowels = "bcdfghklmnprstvz", "aeiou"

    def vocabulary(seed, consonants, ending):
        q = random.Random(seed)
        return ["".join(q.choice(consonants) + q.choice(vowels) for _ in range(q.randint(1, 3))) + ending for _ in range(300)]

    words = {"aa": vocabulary(1, letters[:6], "st"), "bb": vocabulary(2, letters[6:12], "rk"), "cc": vocabulary(3, letters[12:], "wyq")}
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(k, say(lang, r.randint(20, 120)), lang) for k, lang in enumerate(["aa", "bb"] * 400)]
    rows += [(10_000 + k, say("cc", 60), None) for k in range(20)]
    rows += [(20_000 + k, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)), "aa") for k in range(3)]
    rows += [(30_000 + k, say("aa", 4), None) for k in range(50)]
    rows += [(40_000, None, "aa"), (40_001, "12 34", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, docs, FOLDER).collect()}
    assert not [i for i in kept if 10_000 <= i < 30_000 or i >= 40_000]
    assert all(kept.get(30_000 + k) == "aa" for k in range(50))
    assert sum(i < 10_000 for i in kept) >= 799


def test_mixing_stage_tells_rows_of_one_id_apart(spark):
    rows = [(None if k % 3 else k, f"en{k} " * (5 + k % 7), "en", "src1") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = [r["n_tokens"] for r in mixing.mix_sources(docs).collect() if r["copies"]]
    got = [len(r["text"].split()) for r in corpus_pipeline.mix(spark, docs, FOLDER).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(rows)


def odd_ids():
    """Null and repeated ids over different texts, some of them near copies of others."""
    a, b, c, d = (scattered(1, p) for p in "pqrs")
    clean = [" ".join(f"c{k}x{n}" for n in range(220)) for k in range(6)]
    return [(5, a[0]), (None, a[1]), (None, b[0]), (None, b[1]), (None, clean[0]), (None, clean[1]), (7, c[0]), (7, clean[2]), (7, clean[3]),
            (8, c[1]), (9, d[0]), (9, d[1]), (9, clean[4]), (6, clean[5])]


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    rows = odd_ids()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(r["text"] for r in corpus_pipeline.near(spark, docs, FOLDER).collect())
    lost = [rows[1][1], rows[9][1]]  # a null id linked with 5, and 8 linked with one text of 7
    for one, two in ((rows[2][1], rows[3][1]), (rows[10][1], rows[11][1])):  # null with null, 9 with 9
        assert (one in kept) != (two in kept)
        lost.append(two if one in kept else one)
    assert kept == sorted(t for _, t in rows if t not in lost)
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(docs, corpus_pipeline.NEAR).collect()))
    assert got == sorted([(5, 5, True), (0, 5, False), (0, 0, True), (0, 0, False), (0, 0, True), (0, 0, True), (7, 7, True), (7, 7, True), (7, 7, True),
                          (8, 7, False), (9, 9, True), (9, 9, False), (9, 9, True), (6, 6, True)])


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_cuts_tell_rows_of_one_id_apart(spark, kind):
    rows = odd_ids() + [(1, "lead " + odd_ids()[2][1]), (2, "tail " * 9 + odd_ids()[6][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    if kind == "words":
        want = cut_brute(rows, lambda t: t.encode().split(), 50, b" ".join)
        assert cut_rows(substring_dedup.substring_dedup(docs), "n_words") == want
    else:
        want = cut_brute(rows, lambda t: t.encode(), 50, bytes)
        assert cut_rows(suffix_dedup.suffix_dedup(docs), "n_bytes") == want
