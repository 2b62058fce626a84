"""Decontamination, toxicity, secrets, pieces and licenses."""

import bisect
import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomix.llm import decontamination, licenses, pieces, queries, secrets, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute_contamination(docs, items, n=13):
    wins = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                ids = wins.get(tuple(w[i : i + size]))
                if ids:
                    hit |= set(range(i, i + size))
                    found |= ids
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.fixture(scope="module")
def bench(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, long), (2, "Tiny item, here."), (3, None), (4, ""), (2, "tiny other item"), (5, long.upper() + " more and more words that end it all now so there")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("built_bytes", [1 << 20, 60])
def test_contamination(spark, bench, built_bytes):
    long = " ".join(f"W{i}" for i in range(20))
    texts = ["nothing", f"a b {long} c", f"{' '.join(long.split()[:13])}", " ".join(long.split()[:12]), "x tiny ITEM here y tiny item here", None, "", "tiny other-item", f"{long} {long}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_contamination(list(enumerate(texts)), [tuple(r) for r in bench.collect()])
    found = decontamination.find_contamination(docs, bench, built_bytes=built_bytes).withColumn("hit", decontamination.n_hit())
    assert {r.doc_id: (r.n_words, r.hit, r["items"]) for r in found.collect()} == expected
    left = {r.doc_id: r.text for r in decontamination.remove_contamination(docs, bench, share=0.95, built_bytes=built_bytes).collect()}
    assert left[0] == "nothing" and left[1] == "a b  c" and 2 not in left and left[4] == "x  y " + "" or left[4] == "x  y "


@pytest.mark.parametrize("built_bytes", [1 << 24, 0])
def test_contamination_matches_brute_force(spark, docs, data, built_bytes):
    """Both ways over the tables, with items that share windows and rows that share an item's id."""
    rows = spark.read.parquet(f"{data}/benchmark.parquet")
    rows = rows.select(F.col("item_id").cast("string").alias("item_id"), "text").union(rows.select(F.concat(F.lit("copy "), F.col("item_id").cast("string")), "text")).union(rows.limit(3).select(F.lit("0"), F.upper("text")))
    expected = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in rows.collect()])
    found = decontamination.find_contamination(docs, rows, built_bytes=built_bytes).withColumn("hit", decontamination.n_hit()).collect()
    assert any(x[1] for x in expected.values())
    assert {r.doc_id: (r.n_words, r.hit, r["items"]) for r in found} == expected


def test_contamination_index_is_small():
    """A benchmark of a few MB takes about the bytes that are measured before it is built."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    items = [(str(i), " ".join(r.choices(vocabulary, k=200))) for i in range(2000)]
    with np.errstate(over="ignore"):
        index = decontamination.window_index(items, 13)
        built = len(index["text"]) + index["limits"].nbytes + sum(x.nbytes for s in index["sizes"].values() for x in s if isinstance(x, np.ndarray))
        assert built < sum(len(t) for _, t in items) + decontamination.WORD_BYTES * 200 * 2000 + (1 << 21)
        scan = decontamination.scanner(index)
        out = scan(pa.array([" ".join(["x", *items[7][1].split()[50:80], "y"]), items[9][1], "clean text of words " * 30]))
    assert out[3] == [["7"], ["9"], []] and [x["end"] - x["start"] for x in (out[1][0][0], out[1][1][0])] == [30, 200]


def test_contamination_edges(spark, edges, no_docs, bench):
    found = decontamination.find_contamination(edges, bench).collect()
    assert len(found) == 10 and {r.doc_id: r.n_words for r in found}[16] == 30_000
    assert decontamination.find_contamination(no_docs, bench).count() == 0
    assert not any(r["items"] for r in decontamination.find_contamination(edges, bench.limit(0)).collect())
    assert decontamination.remove_contamination(edges, bench).columns == edges.columns
    assert decontamination.remove_contamination(edges, bench).count() == 10


@pytest.fixture(scope="module")
def many():
    """Tables with labels enough to measure held-out rows."""
    folder = os.environ.get("TEST_LABELLED_DIR", "/root/testdata/sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("the tables are not there")
    return folder


def test_toxicity_held_out(spark, many):
    """Of the rows whose labels are never learnt, toxic ones are caught and clean ones are left alone."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{many}/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, many).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    for held_out in (True, False):
        seen = {y: [r.predicted for r in rows if r.held_out == held_out and labels.get(r.doc_id) == y] for y in (0, 1)}
        assert len(seen[1]) >= 100 and np.mean(seen[1]) >= 0.9 and np.mean(seen[0]) <= 0.02, held_out


def test_toxicity_learns_from_long_texts(spark):
    r = random.Random(8)
    clean = lambda n: "".join(r.choice("aeioulnrst ") for _ in range(n))
    rows = [(i, " ".join([clean(90), "zxqk"] * 20 if i % 3 == 0 else [clean(2000)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_chars=300)
    assert model.score(clean(80) + " zxqk " + clean(80)) > 0.5 > model.score(clean(170))


def test_toxicity_generalises():
    r = random.Random(1)
    clean = ["".join(r.choice("aeioulnrst ") for _ in range(400)) for _ in range(400)]
    rows = [(t, 0) for t in clean[:150]] + [(t[:100] + " zxqk " + t[100:], 1) for t in clean[150:200]]
    m = toxicity.fit(rows)
    good = [m.score(t) for t in clean[200:300]]
    bad = [m.score(t[:300] + " zxqks " + t[300:]) for t in clean[300:]]
    assert np.mean([s < 0.3 for s in good]) > 0.95 and np.mean([s >= 0.3 for s in bad]) > 0.9


def test_toxicity_edges(spark, edges, no_docs):
    none = toxicity.train(edges, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score == pytest.approx(0) for r in toxicity.score(edges, none, keep=["doc_id"]).collect())
    one = toxicity.train(edges, spark.createDataFrame([(13, 1), (14, 1), (16, 7)], "doc_id long, toxic int"))
    assert all(r.score == pytest.approx(1) for r in toxicity.score(edges, one, keep=["doc_id"]).collect())
    assert toxicity.score(no_docs, one).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    out = docs.filter(queries.held_out("doc_id")).select("doc_id").collect()
    import zlib

    assert {r.doc_id for r in out} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2}


def brute_base(t):
    found = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans():
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "ABCDEFGHIJKLMN", "é", "😀", "short", "\n", "x.y-z_/+=", "ſecret"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert secrets.base_spans(t) == brute_base(t), t


def test_battery():
    r = random.Random(3)
    token = lambda a, n: "".join(r.choice(a) for _ in range(n))
    for code in (2, 3, 5, 6, 7):
        found = [secrets.battery(token(secrets.ENCODINGS[code][1], 40)) for _ in range(500)]
        assert np.mean([d <= secrets.REJECT for _, _, d in found]) > 0.98, code
    for word in ("internationalizationalize", "thequickbrownfoxjumpsoverthelazydog", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "the_quick_brown_fox_jumps", "https-www-example-of-a-long-name", "SOME_CONSTANT_NAME_IN_CAPITALS"):
        assert secrets.battery(word)[2] > secrets.REJECT, word
    names = [secrets.ENCODINGS[secrets.infer(x)][0] for x in ("deadbeef00", "XYZ234", "a+/b", "a-b_/+")]
    assert names == ["hex", "base32", "base64", "mixed"] and secrets.battery("=" * 30) is None


def brute_discoveries(tested, level):
    """Benjamini and Hochberg's procedure on the p-values of single tokens, (cell, bin) each, in bands."""
    bands, out = len(secrets.BANDS) + 1, []
    nulls = {c: secrets.null_of(c, collections.Counter(b for d, b in tested if d == c)) for c, _ in set(tested)}
    p = [0.5 * math.erfc((nulls[c][0] - b) / nulls[c][1] / math.sqrt(2)) if b < nulls[c][0] else 1.0 for c, b in tested]
    for band in range(bands):
        mine = sorted(x for x, (c, _) in zip(p, tested, strict=True) if c % bands == band)
        passed = [x for i, x in enumerate(mine, 1) if x <= level * bisect.bisect_right(mine, x) / len(mine)]
        out.append(max(passed, default=-1.0))
    return [x <= out[c % bands] for x, (c, _) in zip(p, tested, strict=True)]


def test_discoveries():
    r = random.Random(4)
    for level in (0.01, 0.2):
        tested = [(r.choice([31, 37, 43]), min(150, int(r.gauss(*r.choice([(30, 8), (90, 10)]))))) for _ in range(400)]
        rows = {x: tested.count(x) for x in tested}
        highest = secrets.accepted([(c, b, n) for (c, b), n in rows.items()], level)
        assert [b <= highest.get(c, -1) for c, b in tested] == brute_discoveries(tested, level)
    assert secrets.accepted([(31, 90, 10)]) == {} == secrets.accepted([])


def test_false_discoveries():
    """Few secrets among many ordinary tokens of several forms are found, and little else."""
    r = random.Random(1)
    words = "the quick brown fox jumps over lazy dog configuration manager service handler request response internal error module system network value total index".split()
    forms = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper(), lambda w: "https-www-" + "-".join(w), lambda w: "/".join(w), lambda w: "-".join([*w[:2], "2024", *w[2:]]), lambda w: "".join(w)]
    ordinary = [forms[i % 8]([r.choice(words) for _ in range(12)])[: r.randint(20, 60)] for i in range(10_000)]
    for n, least in ((24, 0.9), (44, 0.9)):
        for many in (1, 50):
            tokens = ["".join(r.choice(secrets.ENCODINGS[6][1]) for _ in range(n)) for _ in range(many)]
            _, tested = secrets.scan(pa.array([*ordinary, *tokens]))
            rows = collections.Counter((x["cell"], x["bin"]) for t in tested for x in t)
            highest = secrets.accepted([(c, b, k) for (c, b), k in rows.items()])
            hit = [any(x["bin"] <= highest.get(x["cell"], -1) for x in t) for t in tested]
            assert sum(hit[len(ordinary) :]) >= least * many and sum(hit[: len(ordinary)]) <= 5
    # Secrets do not shape the null, however many they are.
    tokens = ["".join(r.choice(secrets.ENCODINGS[6][1]) for _ in range(44)) for _ in range(3000)]
    rows = collections.Counter((x["cell"], x["bin"]) for t in secrets.scan(pa.array(tokens))[1] for x in t)
    highest = secrets.accepted([(c, b, k) for (c, b), k in rows.items()])
    assert sum(n for (c, b), n in rows.items() if b <= highest.get(c, -1)) > 0.95 * 3000


def test_long_texts_of_spans():
    """A span or a token costs the same in a text of many."""
    text = " ".join(f"token={'x' * 12}{i} {'Word' * 6}{i}" for i in range(20_000))
    base, tested = secrets.scan(pa.array([text]))
    assert len(base[0]) == len(tested[0]) == 20_000


def test_secrets(spark, edges, no_docs):
    r = random.Random(5)
    tokens = ["".join(r.choice(secrets.ENCODINGS[5][1]) for _ in range(44)) for _ in range(20)]
    texts = [f"a key {t} in a text" for t in tokens] + ["ordinary words", "password: hunter2hunter2 and more", "deadbeefdeadbeef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x for x in secrets.find_secrets(df).select("doc_id", secrets.span_string("spans").alias("s")).collect()}
    assert sum(out[i].s == "random:6:50" for i in range(20)) >= 18
    assert out[20].s == "" and out[21].s == "assign:0:24" and out[22].s == "hex:0:16"
    assert sum(x.text == "a key <secret> in a text" for x in secrets.redact(df).collect()) >= 18
    assert [x.text for x in secrets.redact(df).filter("doc_id >= 20").orderBy("doc_id").collect()] == ["ordinary words", "<secret> and more", "<secret>"]
    assert secrets.find_secrets(edges).count() == 10 and secrets.find_secrets(no_docs).count() == 0
    assert secrets.redact(edges).columns == edges.columns


def test_secrets_query(spark, data):
    """Base and random spans against a scan of single texts and tokens."""
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = {}
    for i, t in docs.items():
        base = brute_base(t)
        tokens = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t)]
        found[i] = base, [(s, e) for s, e in tokens if not any(s < y and x < e for x, _, y in base) and secrets.battery(t[s:e])]
    tested = [(i, s, e, secrets.battery(docs[i][s:e])) for i, (_, x) in found.items() for s, e in x]
    hits = brute_discoveries([(c * (len(secrets.BANDS) + 1) + b, secrets.bin_of(d)) for _, _, _, (c, b, d) in tested], secrets.FALSE_DISCOVERY)
    rows = queries.op7_secrets(spark, data).collect()
    assert len(rows) == len(docs)
    text = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    for r in rows:
        base = found[r.doc_id][0]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest()
        assert r.spans == text(base + [(s, 3, e) for (i, s, e, _), hit in zip(tested, hits, strict=True) if hit and i == r.doc_id])


@pytest.fixture(scope="module")
def model():
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no piece model")
    with open(pieces.MODEL, "rb") as f:
        return pieces.PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=pieces.MODEL)


def _odd_texts(n):
    r = random.Random(6)
    parts = list("abAB  \n\t▁é日本😀0.,-_'\"") + ["<0x0A>", "the", "ing", " tion", "  ", "    ", "\x00", "</s>"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 90))) for _ in range(n)] + ["a" * 3000, "=/" * 2000, " " * 500, "thethe" * 500, "\n" * 100]


def test_pieces_equal_library(model, library):
    for t in _odd_texts(1500):
        assert model.encode(t) == library.encode(t), t


def test_pieces_round_trip(model):
    for t in _odd_texts(300):
        assert model.decode(model.encode(t)) == t.replace("▁", " ")


def test_stream_commits_early(model):
    """Whatever the stride, pieces are those of the whole; a window is committed long before the end."""
    text = "▁" + "▁".join(["streaming", "viterbi"] * 60)
    whole = list(model.stream(text, stride=10**9))
    for stride in (1, 3, 17, 64):
        assert list(model.stream(text, stride=stride)) == whole

    class Watched(str):
        furthest = 0

        def __getitem__(self, k):
            Watched.furthest = max(Watched.furthest, k.stop if isinstance(k, slice) else k)
            return str.__getitem__(self, k)

    first = next(model.stream(Watched(text), stride=16))
    assert first == whole[0] and Watched.furthest < 80


def test_window_is_bounded(model, library):
    """The positions that the walk holds are bounded by the longest piece, however long the text is."""
    r = random.Random(12)
    vocabulary = sorted(p for p in model.ids if len(p) > 2)
    texts = ["".join(r.choices(vocabulary, k=3000)), "a" * 20_000, "".join(r.choice("abAB日é.,=/_") for _ in range(20_000)), "=" * 9999 + "/" * 9999, *_odd_texts(200)]
    model.widest = 0
    for t in filter(None, texts):
        t = "\u2581" + t.replace(" ", "\u2581")
        assert model.ids_of(model.stream(t)) == tuple(library.encode(t[1:].replace("\u2581", " "))), t[:50]
    assert 0 < model.widest <= 2 * (model.longest + pieces.STRIDE)


def test_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_SIZE", 10)
    cache = pieces.Cache(lambda x: (len(x),))
    for _ in range(2):
        for i in range(100):
            assert cache["x" * (i % 50)] == (i % 50,) and len(cache) <= 10 and len(cache.older) <= 10


def test_pieces_query(spark, data, library):
    """The query's ids are the library's, for whole texts."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op8_sentencepiece(spark, data).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.ids == (library.encode(docs[r.doc_id]) if docs[r.doc_id] else []) and r.n_ids == len(r.ids) and r.round_trip


def test_pieces_frames(spark, edges, no_docs, model):
    out = {r.doc_id: r for r in pieces.encode_pieces(edges, keep=["doc_id"]).collect()}
    assert out[10].ids == [] and out[11].ids == [] and all(r.round_trip for r in out.values())
    assert pieces.encode_pieces(no_docs).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(edges.select("doc_id"  , "text").filter("doc_id = 17"), keep=["doc_id"])).first()
    assert back.text == "ÄÖ ß é 😀   \x00 end"


def brute_increasing(pairs):
    best = []
    for p in sorted(pairs):
        ends = [s for s in best if s[-1][0] < p[0] and s[-1][1] < p[1]]
        best.append([*max(ends, key=len, default=[]), p])
    return max(map(len, best), default=0)


def test_alignment():
    r = random.Random(7)
    for _ in range(300):
        pairs = [(r.randrange(12), r.randrange(12)) for _ in range(r.randrange(12))]
        out = licenses.increasing(pairs)
        assert len(out) == brute_increasing(set(pairs)) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(out, out[1:], strict=False))
        a, b = ([r.choice("abcdef") for _ in range(r.randrange(15))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert licenses.align("the quick brown fox".split(), "a quick red fox".split()) == [(1, 1), (3, 3)]


def test_licenses(spark, edges, no_docs):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("charge", "cost").replace("copies of the Software", "copies")
    texts = ["no words of it", "x Released under the MIT License. y Released under the MIT License.", f"head\n{changed}\ntail", "All of the many rights that were once reserved", mit[: len(mit) // 2], "ÄÖ all rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.licenses for r in licenses.find_licenses(df).collect()}
    assert out[0] == out[3] == out[4] == []
    assert [(x.license, x.start, x.end, x.coverage) for x in out[1]] == [("MIT-notice", 2, 32, 1.0), ("MIT-notice", 36, 66, 1.0)]
    assert [x.license for x in out[2]] == ["MIT"] and 0.9 < out[2][0].coverage < 1
    assert [(x.license, x.start, x.end) for x in out[5]] == [("all-rights-reserved", 3, 22)]
    assert licenses.find_licenses(edges).count() == 10 and licenses.find_licenses(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_copies_stand_apart(name):
    """Each of many copies close together has its span, whole or with a word missing."""
    t, whole = licenses.Templates(licenses.TEMPLATES, licenses.COVERAGE), licenses.TEMPLATES[name]
    w = whole.split()
    changed = " ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :]) if len(w) > 6 else whole
    for copies in ([whole] * 2, [whole] * 7, [whole, changed], [changed, whole, changed], [changed] * 3):
        for between in ("\n", "\nfor the other module: ", "\n" + "word " * (len(w) // 3 + 1)):
            text, expected = "x ", []
            for c in copies:
                expected.append((len(text), len(text) + len(c.rstrip("."))))
                text += c + between
            found = t.find(text + "end")
            assert [(x["start"], x["end"]) for x in found] == expected


def test_license_keys_are_lossless():
    """A text that reaches the coverage holds a key word, whichever words are missing."""
    t = licenses.Templates(licenses.TEMPLATES, licenses.COVERAGE)
    for name, w in t.words.items():
        keys = {k for k, names in t.keys.items() if name in names}
        assert sum(x in keys for x in w) > (1 - licenses.COVERAGE) * len(w)
        assert t.find(licenses.TEMPLATES[name])[0]["license"] in (name, "Apache-2.0", "all-rights-reserved")


def brute_licenses(text, coverage=licenses.COVERAGE):
    """(certain, possible): templates that stand in a text word by word, and those of which some stretch holds the words that the coverage asks for."""
    words = [w.lower() for w in licenses.WORD.findall(text or "")]
    certain, possible = collections.Counter(), set()
    for name, t in licenses.TEMPLATES.items():
        t = [w.lower() for w in licenses.WORD.findall(t)]
        n, wanted, i = len(t), collections.Counter(t), 0
        while i <= len(words) - n:
            if words[i : i + n] == t:
                certain[name] += 1
                i += n
            else:
                i += 1
        width = int(n / licenses.DENSITY) + 1
        if any(sum((collections.Counter(words[i : i + width]) & wanted).values()) >= coverage * n for i in range(max(1, len(words) - width + 1))):
            possible.add(name)
    return certain, possible


def test_license_query(spark, data):
    """Whole notices are found as often as they stand in a text, and nothing without words enough."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op10_licenses(spark, data).collect()
    assert len(rows) == len(docs) and sum(r.n_licenses for r in rows) > 0
    for r in rows:
        certain, possible = brute_licenses(docs[r.doc_id])
        found = collections.Counter(x.split(":")[0] for x in filter(None, r.licenses.split(",")))
        assert sum(found.values()) == r.n_licenses and set(found) <= possible, r
        # A short notice that is part of a longer one is reported as that.
        assert all(found[k] >= n or any(len(licenses.TEMPLATES[f]) > len(licenses.TEMPLATES[k]) for f in found) for k, n in certain.items()), (r, certain)


def test_many_copies_and_ties():
    """1 to 20 copies side by side, mixtures of kinds, equal finds, and a long text of notices in linear time."""
    import time

    t = licenses.Templates(licenses.TEMPLATES, licenses.COVERAGE)
    kinds = ["MIT-notice", "CC-BY-NC-4.0", "GPL-3.0-short", "all-rights-reserved", "ISC", "BSD-2-Clause"]
    r = random.Random(9)
    for n in range(1, 21):
        for names in ([kinds[n % 4]] * n, r.choices(kinds, k=n)):
            text, expected = "", []
            for name in names:
                whole = licenses.TEMPLATES[name].rstrip(".")
                expected.append((len(text), len(text) + len(whole), name))
                text += whole + ". "
            assert [(x["start"], x["end"], x["license"]) for x in t.find(text)] == expected
    tie = licenses.Templates({"b": "same words in both", "a": "same words in both"}, licenses.COVERAGE)
    assert [x["license"] for x in tie.find("same words in both and same words in both")] == ["a", "a"]
    began = time.time()
    assert len(t.find("All rights reserved. " * 20_000)) == 20_000
    assert time.time() - began < 30


def test_extra_frames(spark, edges):
    """Operators that keep columns keep those whose names clash with their results."""
    scored = toxicity.score(edges, toxicity.fit([]), name="__score").drop("__score")
    assert scored.columns == edges.columns and scored.filter(F.col("n_words") == "mine").count() == 10
