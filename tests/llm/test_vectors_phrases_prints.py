"""Vector codes, collocations and fingerprints against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from tidemark.llm import collocations as C
from tidemark.llm import fingerprints as P
from tidemark.llm import queries
from tidemark.llm import vector_codes as V
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>, label string, row int, part string, code string, n int"
TEXTS = "doc_id bigint, text string, lang string, id int, digest string, shard string, ids string, n int"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_collocations"])
def test_equal_to_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES[name]) is None


# ---- vector codes


def codes_brute(rows, codec, dims):
    kept = [(i, [math.floor(codec.scale * x) for x in v], label) for i, v, label, *_ in rows
            if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], struct.pack(f"<{dims}q", *r[1])))
    width = dims // codec.parts
    cut = lambda v, p: tuple(v[p * width:(p + 1) * width])
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:codec.entries]] for p in range(codec.parts)]
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(codec.parts)] for _, v, _ in kept]
    for _ in range(codec.rounds):
        got = assign()
        for p in range(codec.parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), g in zip(kept, got) if g[p] == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    out = [(i, label, "".join(f"{e:02x}" for e in g), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(g))) for (i, v, label), g in zip(kept, assign())]
    return out, books


def vectors(r, n, dims, size=0.3):
    centres = [[r.gauss(0, size) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        rows.append((i * 2, [x + r.gauss(0, size / 5) for x in r.choice(centres)], r.choice(["a", "b", None]), 1, "z", "z", 2))
    return rows


@pytest.mark.parametrize("size", [0.3, 3e4, 1e6])
def test_codes_equal_brute_force(spark, size):
    """Doubles, 64-bit integers and Python's integers as kernel; copies, ties, broken rows, clashing columns."""
    r = random.Random(5)
    rows = vectors(r, 150, 8, size)
    same = [0.25 * size] * 8
    rows += [(1000 + i, same, "a", 1, "z", "z", 2) for i in range(120)]
    rows += [(7, None, "a", 1, "z", "z", 2), (9, [], "a", 1, "z", "z", 2), (11, [1.0] * 7 + [None], "a", 1, "z", "z", 2), (13, [math.nan] * 8, None, 1, "z", "z", 2),
             (15, [math.inf] * 8, None, 1, "z", "z", 2), (17, [1.0, 2.0], "a", 1, "z", "z", 2), (None, rows[3][1], "b", 1, "z", "z", 2), rows[5], rows[5], (10, rows[9][1], None, 1, "z", "z", 2)]
    codec = V.Codec(entries=16, rounds=3, block=16)
    done = V.compress(spark.createDataFrame(rows, VECTORS).repartition(4), codec)
    want, books = codes_brute(rows, codec, 8)
    key = lambda t: tuple((v is None, str(v)) for v in t)
    assert sorted([tuple(x) for x in done.codes.select("vec_id", "label", "code", "error").collect()], key=key) == sorted(want, key=key)
    assert [[tuple(e) for e in b.tolist()] for b in done.books] == books


def test_codes_of_few_or_no_vectors(spark):
    empty = V.compress(spark.createDataFrame([], VECTORS))
    assert empty.codes.count() == 0 and empty.books_sha256() == hashlib.sha256(b"").hexdigest()
    one = V.compress(spark.createDataFrame([(3, [0.5] * 4, None, 1, "z", "z", 2)], VECTORS))
    assert [tuple(r) for r in one.codes.collect()] == [(3, None, "00000000", 0)]
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(3, [0.5] * 5, None, 1, "z", "z", 2)], VECTORS))


def test_shortlist_never_loses_the_nearest():
    r = np.random.default_rng(3)
    for _ in range(50):
        x, book = r.integers(-50, 50, (20, 3)), r.integers(-60, 60, (12, 3))
        want = [int(np.argmin(((book - v) ** 2).sum(1))) for v in x]
        assert V.nearest(x, x.min(0), x.max(0), book, V.Kernel.of(60, 3)).tolist() == want


def test_hilbert_neighbours_touch():
    """All cells of a small grid, in the order of their keys: each is next to the one before."""
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    walk = grid[np.argsort(np.array([int.from_bytes(k, "big") for k in V.hilbert_keys(grid, 3)]))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# ---- collocations


def phrases_brute(rows, mining):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, mining.longest + 1):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {w: n for w, n in f.items() if len(w) > 1 and n >= mining.least}
        rest = []
        for w, a in often.items():
            if any(len(x) > len(w) and 100 * n >= mining.covered_percent * a and any(x[i:i + len(w)] == w for i in range(len(x))) for x, n in often.items()):
                continue
            score, _, left, right = min((math.floor(Fraction(1000 * a * totals[lang], f[w[:k]] * f[w[k:]])), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            rest.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (s, a, w, left, right) in enumerate(sorted(rest)[:mining.top], 1):
            out.append((lang, rank, w.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(11)
    words = ["to", "be", "Or", "not", "é", "日本", "x", "The", "rain", "in", "Spain", "\x00", "ÀB"]
    rows = []
    for i in range(120):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!? "]) for _ in range(r.randint(0, 60)))
        rows.append((i, text + "the rain in spain stays" * (i % 3 == 0), r.choice(["en", "fr", None]), 1, "z", "z", "z", 2))
    return rows + [(500, None, "en", 1, "z", "z", "z", 2), (501, "", None, 1, "z", "z", "z", 2), (None, "to be or not", "und", 1, "z", "z", "z", 2), rows[3], rows[3], (502, "zz " * 3000, "en", 1, "z", "z", "z", 2)]


@pytest.mark.parametrize("mining", [C.Mining(least=8, top=40), C.Mining(longest=2, least=3), C.Mining(longest=4, least=5, covered_percent=80, top=15)])
def test_phrases_equal_brute_force(spark, prose, mining, monkeypatch):
    monkeypatch.setattr(C, "SHARD", 700)
    found = C.collocations(spark.createDataFrame(prose, TEXTS).repartition(4), mining)
    assert sorted(tuple(x) for x in found.collect()) == phrases_brute(prose, mining)


def test_phrases_of_nothing(spark):
    assert C.collocations(spark.createDataFrame([], TEXTS)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, 1, "z", "z", "z", 2), (2, "rare words", None, 1, "z", "z", "z", 2)], TEXTS)).count() == 0


def test_phrases_of_a_very_long_text(spark):
    """3 MiB without a space is one word; with spaces it is one piece."""
    rows = [(1, "a" * (3 << 20), "en"), (2, "ab cd ef gh ij kl " * (3 << 16), "en")]
    found = C.collocations(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), C.Mining(longest=3))
    n, f = 6 * (3 << 16) + 1, 3 << 16
    assert {r.phrase for r in found.collect()} == {"ab cd ef", "bc".replace("bc", "cd ef gh"), "ef gh ij", "gh ij kl", "ij kl ab", "kl ab cd"}
    assert all(r.n == n and r.a in (f, f - 1) for r in found.collect())


@pytest.mark.parametrize("bits", [1, 3, 13, 22, 31, 40])
def test_packed_ids_come_back(bits):
    r = np.random.default_rng(bits)
    for n in range(2, 6):
        packing = C.Packing(n, bits)
        ids = [r.integers(0, 2**bits, 500) for _ in range(n)]
        columns = packing.pack(ids)
        assert all(int(c.max()) < 2**w for c, w in zip(columns, packing.widths))
        assert (packing.unpack(columns) == np.stack(ids, 1)).all()


@pytest.mark.parametrize("widths", [[1], [7], [40], [64], [60, 33], [3, 64]])
def test_filters_lose_nothing(widths):
    r = np.random.default_rng(7)
    raw = [r.integers(0, 2**w - 1, 900, dtype=np.uint64, endpoint=True) for w in widths]
    order, new = C.in_order(raw)
    columns = [x[order][new] for x in raw]
    counts = r.integers(1, 600, len(columns[0]))
    back, n = C.from_filter(C.to_filter(columns, counts, widths), widths)
    assert (n == counts).all() and all((a == b).all() for a, b in zip(back, columns))


# ---- fingerprints


def xx(values, kind):
    seed = 42
    for v, k in zip(values, kind):
        raw = v if isinstance(v, bytes) else struct.pack("<i" if k == "i" else "<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def print_brute(text, sketch):
    words = [xx([w.encode()], "s") for w in re.findall("[^\x20\x09-\x0d]+", text)]
    sets = [words[i:i + sketch.width] for i in range(max(1, len(words) - sketch.width + 1))] if words else []
    low, bins = {}, sketch.bins
    for s in sets:
        h = xx(s, "q" * len(s))
        b = (h >> sketch.rest) + bins // 2
        low[b] = min(low.get(b, 1 << 63), h)
    out = []
    for b in range(bins):
        steps = [P.probe(b, t, bins) for t in range(P.PROBES)]
        near = next((low[s] for s in [b, *steps] if s in low), None)
        if near is None and low:
            near = min((xx([b, h >> sketch.rest], "iq"), h) for h in low.values())[1]
        out.append((near or 0) & ((1 << sketch.bits) - 1))
    return out


def hexed(code, sketch):
    return "".join(f"{int(''.join(f'{c:0{sketch.bits}b}' for c in code[i:i + 64 // sketch.bits]), 2):016x}" for i in range(0, len(code), 64 // sketch.bits))


@pytest.fixture(scope="module")
def pages():
    r = random.Random(2)
    rows = [(i * 3, " ".join(r.choice(["ab", "cé", "日", "dd", "e", "fgh"]) + str(r.randint(0, 40)) for _ in range(r.choice([1, 3, 5, 30, 200]))), "en", 1, "z", "z", "z", 2) for i in range(40)]
    rows += [(200, "", None, 1, "z", "z", "z", 2), (201, None, None, 1, "z", "z", "z", 2), (202, " \t\n", None, 1, "z", "z", "z", 2), (203, rows[4][1], None, 1, "z", "z", "z", 2)]
    return rows + [(None, "no id at all here", None, 1, "z", "z", "z", 2), (None, "another without id", None, 1, "z", "z", "z", 2), rows[7], rows[7], (6, "same id, other text", None, 1, "z", "z", "z", 2)]


@pytest.mark.parametrize("sketch", [P.Sketch(), P.Sketch(width=2, bins=64, bits=8), P.Sketch(width=1, bins=128, bits=1)])
def test_prints_equal_brute_force(spark, pages, sketch):
    found = P.edited_neighbours(spark.createDataFrame(pages, TEXTS).repartition(3), sketch).withColumn("print", P.printed("print")).withColumn("edited_print", P.printed("edited_print"))
    ring = sorted({(i if i is not None else 2**63, t or "") for i, t, *_ in pages}, key=lambda p: (p[0], hashlib.sha256(p[1].encode()).digest()))
    chance = 2.0 ** -sketch.bits
    near = lambda a, b: max(0.0, (sum(x == y for x, y in zip(a, b)) / len(a) - chance) / (1 - chance))
    want = {}
    for (i, t), (_, following) in zip(ring, ring[1:] + ring[:1]):
        q = len(t) // 4
        edited = t[:len(t) - q] + following[:q]
        a, b, c = (print_brute(x, sketch) for x in (t, edited, following))
        want[i, edited, hexed(a, sketch)] = (len(t), hexed(b, sketch), near(a, b), near(a, c))
    got = [(2**63 if r.doc_id is None else r.doc_id, r.edited, r.print, r.n_chars, r.edited_print, r.near_edited, r.near_next) for r in found.collect()]
    assert len(got) == len(pages)
    for r in got:
        n, e, x, y = want[r[:3]]
        assert r[3:5] == (n, e) and r[5:] == pytest.approx((x, y))


def test_prints_estimate_similarity(spark):
    """Mean error of the corrected estimate over pairs of known similarity, with one and four bits."""
    r = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
        for k in range(0, 400, 400 // (i % 8 + 1)):
            words[k] = "changed"
        rows.append((i, words, [f"w{r.randint(0, 10**6)}" if r.random() < i / 400 else w for w in words]))
    truth = []
    for _, a, b in rows:
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        truth.append(len(x & y) / len(x | y))
    docs = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, a, b in rows], "i int, a string, b string")
    for bits, most in ((1, 0.08), (4, 0.045)):
        sketch = P.Sketch(bits=bits)
        got = [x[0] for x in docs.orderBy("i").select(P.likeness(P.fingerprint(docs.a, sketch), P.fingerprint(docs.b, sketch), sketch)).collect()]
        assert sum(abs(g - t) for g, t in zip(got, truth)) / len(truth) < most


def test_prints_of_odd_tables(spark):
    assert P.edited_neighbours(spark.createDataFrame([], TEXTS)).count() == 0
    one = P.edited_neighbours(spark.createDataFrame([(4, "abcdefgh", None, 1, "z", "z", "z", 2)], TEXTS)).first()
    assert one.edited == "abcdefab" and one.near_next == 1
    big = [(1, "x" * (3 << 20), None, 1, "z", "z", "z", 2), (2, "ab cd " * (1 << 19), None, 1, "z", "z", "z", 2)]
    found = {r.doc_id: r for r in P.edited_neighbours(spark.createDataFrame(big, TEXTS)).collect()}
    assert found[1].n_chars == found[2].n_chars == 3 << 20 and found[1].edited.endswith("x" + big[1][1][: 3 << 18])
