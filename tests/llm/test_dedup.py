"""Exact, near and line dedup against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fathomix.llm import components, exact_dedup, line_dedup, near_dedup, queries
from fathomix.llm.textbytes import NON_SPACE, Powers, Words, shingles, slices
from fathomix.storage import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, percent=85):
    """id -> (set size, smallest id reachable), by all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_matches_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = near_dedup.near_groups(docs)
    assert as_dict(found) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def _chain(n, words=60, seed=1):
    """Texts that drift: neighbours are near copies, the ends are not; in shuffled order."""
    r = random.Random(seed)
    now = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(now))
        now = [*now[1:], f"w{r.randrange(10**6)}"]
    r.shuffle(out)
    return out


def _family(n, words=80, seed=2):
    """Texts with one or two words changed, most of them linked to few others."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.choice([1, 1, 2, 2])):
            copy[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_near_chains_and_families(spark):
    texts = _chain(60) + _family(80) + ["a b c", "A B  c", "a b c d", "short", "short"]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    assert as_dict(near_dedup.near_groups(df)) == expected
    assert len({c for _, c in expected.values()}) > 3
    kept = near_dedup.drop_near_copies(df)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in expected.values()}


def test_near_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 8)
    rows = list(enumerate(_family(50, seed=5) + _chain(30, seed=6)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(near_dedup.near_groups(df)) == brute_components(rows)


@pytest.mark.parametrize("seed", range(4))
def test_near_search_finds_each_merger(seed):
    """Blocks, with probes from others, against all pairs of different components."""
    np.seterr(over="ignore")
    r = random.Random(seed)
    texts = _family(60, words=60, seed=seed) + _chain(40, seed=seed)
    sets = near_dedup.distinct_sets(pa.array(texts), 5, Powers())
    comp = [r.randrange(12) for _ in texts]
    largest = collections.Counter(comp).most_common(1)[0][0]
    blocks = 4
    rows = [(1, i % blocks, False, comp[i] != largest, i, comp[i], s.tobytes()) for i, s in enumerate(sets)]
    rows += [(1, b, True, True, i, comp[i], s.tobytes()) for i, s in enumerate(sets) if comp[i] != largest for b in range(blocks) if b != i % blocks]
    rows.sort(key=lambda x: (x[:3], x[4]))
    batches = [pa.RecordBatch.from_pylist([dict(zip(near_dedup.SEARCHED, x, strict=True)) for x in rows[a : a + 50]]) for a in range(0, len(rows), 50)]

    def merged(links):
        root = list(range(12))
        for u, v in links:
            a, b = root[comp[u]], root[comp[v]]
            root = [a if x == b else x for x in root]
        return [min(i for i in range(12) if root[i] == x) for x in root]

    found = [(x["u"], x["v"]) for b in near_dedup._search(85)(iter(batches)) for x in b.to_pylist()]
    of = [shingle_set(t) for t in texts]
    every = [(i, j) for i in range(len(of)) for j in range(i) if 100 * len(of[i] & of[j]) >= 85 * len(of[i] | of[j])]
    assert set(map(frozenset, found)) <= set(map(frozenset, every))
    assert merged(found) == merged(every)


def test_near_edges(edges, no_docs):
    found = near_dedup.near_groups(edges).collect()
    assert len(found) == 10
    by = {r.doc_id: r for r in found}
    assert (by[10].n_shingles, by[10].component_id, by[11].component_id, by[12].kept) == (0, 10, 11, True)
    assert by[14].component_id == 13 and not by[14].kept and by[15].n_shingles == 1 and by[16].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_groups(no_docs).count() == 0
    assert near_dedup.drop_near_copies(edges).columns == edges.columns


def test_sketch_recall():
    """Pairs at the threshold share a band nearly always: those of the query, and those of the pipeline at 0.8."""
    r = random.Random(4)
    np.seterr(over="ignore")
    for percent, bands in ((85, near_dedup.BANDS), (80, 36)):
        sketch = near_dedup.sketcher(5, bands, near_dedup.ROWS)
        missed, least = 0, 1.0
        for _ in range(400):
            # n shingles, of which each word changed far from others takes 5: (n - 5 m) / (n + 5 m) at the threshold.
            n, m = 370, 6 if percent == 85 else 8
            base = [f"t{r.randrange(10**7)}" for _ in range(n + 4)]
            other = list(base)
            for at in r.sample(range(5, n - 5, 6), m):
                other[at] = f"u{r.randrange(10**7)}"
            a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
            least = min(least, len(a & b) / len(a | b))
            found = sketch(pa.array([" ".join(base), " ".join(other)]))[3].to_pylist()
            missed += not set(found[0]) & set(found[1])
        assert missed == 0 and percent <= 100 * least < percent + 1


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 7), (5, 1), (20, 21), (21, 22), (22, 20)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(e, "u long, v long")
    out = dict(components.connected_components(df, Scratch(spark, "t")).collect())
    assert {out[i] for i in (1, 2, 3, 4, 5)} == {1} and out[9] == 8 and out[22] == 20 and {out[100 + i] for i in range(41)} == {100}
    assert components.connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_words_across_rows():
    np.seterr(over="ignore")
    texts = ["a b c d e f", None, "", "A  b\tc d e", "é", "b c d e f"]
    w = Words(pa.array(texts), NON_SPACE, Powers())
    assert w.count().tolist() == [6, 0, 0, 5, 1, 5]
    s, limits = shingles(w, 5)
    assert np.diff(limits).tolist() == [2, 0, 0, 1, 1, 1] and s[0] == s[2] and s[1] == s[4]
    batch = pa.record_batch([pa.array(["x" * 10, "y" * 100, None, "z"])], ["text"])
    assert [p.num_rows for p in slices(batch, "text", 20)] == [1, 1, 2]


def brute_exact(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[key(t)].append(i)
    return sorted(((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=str)


@pytest.mark.parametrize("least", [1, 32])
def test_exact(spark, docs, edges, monkeypatch, least):
    """With a low limit even small groups are broadcast as heavy hitters; results stay the same."""
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", least)
    for df in (docs.select("doc_id", "text"), edges, spark.createDataFrame([(i, "hot  text" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        found = exact_dedup.exact_groups(df).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == brute_exact(rows)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


@pytest.mark.parametrize("top_k", [1, 3])
def test_exact_with_more_hot_digests_than_winners(spark, monkeypatch, top_k):
    """What the sketch has no room for goes the ordinary way."""
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 2)
    rows = [(i, f"text  {i % 10}") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(50)]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), top_k=top_k, tracked=16).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == brute_exact(rows)


def test_exact_is_native(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_exact_edges(edges, no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    kept = exact_dedup.drop_exact_copies(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} >= {10, 12, 13, 15}


def brute_recurring(texts, min_texts=3, min_tokens=3):
    """Lines, with variable fields masked, of enough different texts."""
    where = collections.defaultdict(set)
    for t in set(texts):
        for line in (t or "").split("\n"):
            tokens = [re.sub(r"\S*[0-9]\S*", "<*>", x) for x in line.split()]
            if len(tokens) >= min_tokens:
                where[tuple(tokens)].add(t)
    return {k for k, v in where.items() if len(v) >= min_texts}


def test_line_dedup_exact_lines(docs):
    """Every line that recurs as such goes; a line that stays recurs in no template."""
    rows = {r.doc_id: r.text for r in docs.collect()}
    recurring = brute_recurring(rows.values())
    out = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs, counts=True).collect()}
    assert recurring and len(out) == len(rows)
    for i, r in out.items():
        before, after = (rows[i] or "").split("\n"), (r.text or "").split("\n")
        masked = lambda x: tuple(re.sub(r"\S*[0-9]\S*", "<*>", y) for y in x.split())
        assert not [x for x in after if masked(x) in recurring]
        assert r.n_lines == len(before) and r.n_dropped >= sum(masked(x) in recurring for x in before)
        if not r.n_dropped:
            assert r.text == rows[i]


def test_line_dedup_templates(spark):
    log = [(i, f"{' '.join(chr(97 + i) * k for k in range(2, 8))}\nuser number {i * 7} logged in from host alpha at noon\nerror in the module of {['red', 'blue', 'green', 'grey'][i % 4]} gave up after a while") for i in range(8)]
    df = spark.createDataFrame([*log, (90, "unique line with some words\nsecond unique line of text"), (91, "ab cd\nab cd"), (92, "ab cd"), (93, "ab cd\nx")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df).collect()}
    assert all(out[i] == log[i][1].split("\n")[0] for i in range(8))
    assert out[90].count("\n") == 1 and out[91] == "ab cd\nab cd"


def test_line_dedup_copies_are_one_text(spark):
    df = spark.createDataFrame([(i, "a whole text that\nis copied five times") for i in range(5)], "doc_id long, text string")
    assert all(r.text.count("\n") == 1 for r in line_dedup.drop_recurring_lines(df).collect())


def test_line_dedup_edges(edges, no_docs):
    out = line_dedup.drop_recurring_lines(edges)
    assert out.columns == edges.columns and sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == sorted((str(r.doc_id), r.text) for r in edges.collect() if r.text)
    assert {r.doc_id for r in out.collect() if r.text is None} == {10}
    assert line_dedup.drop_recurring_lines(no_docs).count() == 0
    plan = line_dedup.drop_recurring_lines(edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_short_lines(spark):
    """Lines of one or two tokens recur in the query and the stage; empty ones and bare numbers do not."""
    texts = [f"Les.\n{i}{i}\n\n And  ornd.\nonly {chr(97 + i)}" for i in range(4)] + ["Les. once\n7 8"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert out == {**{i: f"{i}{i}\n\nonly {chr(97 + i)}" for i in range(4)}, 4: texts[4]}


def brute_tree(rows, min_texts=3):
    """doc id -> text without recurring lines: the template tree on plain dictionaries, with token tuples for hashes."""
    blank = re.compile(r"[\x20\x09-\x0D]+")
    split = lambda t: [x for x in blank.split(t) if x]

    def masked(line):
        words = tuple("<*>" if re.search("[0-9]", w) else w for w in split(line))
        return (("own", *split(line)) if words in (("<*>",), ("<*>", "<*>")) else words) if words else None

    def leaves(words):
        n = len(words)
        if words[0] == "own":
            return
        if n >= line_dedup.SHORT:
            d = max(3, min(5, n // 4))
            for i in range(line_dedup.PATHS):
                at = i * (n - d) // (line_dedup.PATHS - 1)
                yield n, at, words[at : at + d]
        elif line_dedup.MATCH * n <= n - 1:
            for i in range(n):
                yield n, i, words[:i] + words[i + 1 :]

    holders, members = collections.defaultdict(set), collections.defaultdict(set)
    for t in {t for _, t in rows if t}:
        for line in t.split("\n"):
            if words := masked(line):
                holders[words].add(t)
    for words in holders:
        for leaf in leaves(words):
            members[leaf].add(words)
    drop = {w for w, t in holders.items() if len(t) >= min_texts}
    lengths = collections.Counter(len(w) for w in holders if w[0] != "own")
    tokens = collections.Counter((len(w), x) for w in holders if w[0] != "own" for x in w)
    for (n, _, own), lines in members.items():
        if len(lines) < 2:
            continue
        if n >= line_dedup.SHORT:
            template = [max((c, x) for x, c in collections.Counter(w[i] for w in lines).items())[1] for i in range(n)]
            lines = {w for w in lines if sum(a == b for a, b in zip(w, template, strict=True)) >= line_dedup.MATCH * n}
            expected = 0
        else:
            expected = lengths[n] * np.prod([tokens[n, x] / (n * lengths[n]) for x in own])
        support = len(set().union(*(holders[w] for w in lines)))
        if support >= min_texts and support >= line_dedup.LIFT * expected:
            drop |= lines
    sequences = lambda t: {tuple(x[i : i + 5]) for x in [split(t.lower())] for i in range(max(1, len(x) - 4))}
    for w, t in holders.items():
        if len(w) >= 50 and w[0] != "own" and len(t) == 2:
            a, b = map(sequences, t)
            if len(a & b) < line_dedup.NEAR * len(a | b):
                drop.add(w)
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if masked(x) not in drop) for i, t in rows}


def test_line_dedup_matches_brute_force(spark, data, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute_tree(rows)
    got = {r.doc_id: r for r in queries.op4_line_dedup(spark, data).collect()}
    assert {i: r.text for i, r in got.items()} == expected
    assert sum(r.n_dropped for r in got.values()) > 0 and all(r.n_lines == len(t.split("\n")) for i, t in rows if t is not None for r in [got[i]])


def test_line_dedup_variable_fields(spark):
    """12 texts each: two templates in turn, 3 variable words of 20, one of 4, a leading one; and prose that stays."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    texts, forms = [], [[word() for _ in range(20)] for _ in range(3)]
    for form, at in ((forms[0], (2, 9, 15)), (forms[1], (0,))):
        texts += [" ".join(word() if i in at else w for i, w in enumerate(form)) for _ in range(12)]
    texts += [f"service {word()} has stopped" for _ in range(12)]
    texts += [f"the job {x} took {word()} of the time that it had" for _ in range(6) for x in ("begins and", "ends but")]
    texts += [" ".join(word() for _ in range(20)) for _ in range(12)] + [" ".join([word(), "has", "a", word()]) for _ in range(12)]
    df = spark.createDataFrame([(i, f"{t}\n{word()}") for i, t in enumerate(texts)], "doc_id long, text string")
    out = {x.doc_id: x.n_dropped for x in line_dedup.drop_recurring_lines(df, counts=True).collect()}
    assert out == {i: int(i < 48) for i in range(len(texts))}


def test_line_dedup_keeps_what_meets_by_chance(spark):
    """Short lines of a few words meet in many texts without a template."""
    import itertools

    lines = [" ".join(x) for x in itertools.product("abcdef", repeat=4)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {x.n_dropped for x in line_dedup.drop_recurring_lines(df, counts=True).collect()} == {0}


def test_line_dedup_clashing_columns_and_long_texts(spark):
    names = ("id", "text_hash", "places", "line", "check", "own_id", "doc", "__n", "n_lines")
    rows = [(i, f"a line that many hold\n{'x ' * 20_000}{i}y{chr(97 + i)}\n" + "\n".join(f"{chr(97 + i)}{k}" for k in range(3000)), *range(len(names))) for i in range(4)]
    df = spark.createDataFrame([*rows, (4, None, *range(len(names)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = line_dedup.drop_recurring_lines(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert tuple(r)[2:] == tuple(range(len(names))) and (r.text is None or r.text.split("\n") == rows[r.doc_id][1].split("\n")[2:])
    assert line_dedup.drop_recurring_lines(df, counts=True).select("n_lines").distinct().count() == 2


def test_line_dedup_query(spark, data, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    short = {k for k in brute_recurring(rows.values(), min_tokens=1) if len(k) < 3 and set(k) != {"<*>"}}
    for r in queries.op4_line_dedup(spark, data).collect():
        assert not [x for x in (r.text or "").split("\n") if tuple(re.sub(r"\S*[0-9]\S*", "<*>", y) for y in x.split()) in short]


def test_line_dedup_templates_share_a_leaf(spark):
    """Two templates and varied prose of one opening and length; in two texts a third form is none."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    forms = [[word() for _ in range(12)] for _ in range(3)]
    fill = lambda form, at: " ".join(["on", "the", "day", "that", *form[:at], word(), *form[at + 1 :]])
    prose = [" ".join(["on", "the", "day", "that", *(word() for _ in range(12))]) for _ in range(40)]
    texts = [fill(forms[0], 5) for _ in range(6)] + [fill(forms[1], 9) for _ in range(4)] + [fill(forms[2], 7) for _ in range(2)] + prose
    df = spark.createDataFrame([(i, f"{t}\nown {word()} line") for i, t in enumerate(texts)], "doc_id long, text string")
    out = {x.doc_id: x.n_dropped for x in line_dedup.drop_recurring_lines(df, counts=True).collect()}
    assert out == {i: int(i < 10) for i in range(len(texts))}


def test_line_dedup_long_lines_in_two_texts(spark):
    """A passage of 50 words in two unrelated texts goes; a shorter one, and those of near copies, stay."""
    r = random.Random(4)
    some = lambda n: [("".join(r.choice("abcdefghij") for _ in range(7))) for _ in range(n)]
    long, short, kept = (" ".join(some(n)) for n in (50, 49, 60))
    own = [" ".join(some(100)) for _ in range(3)]
    copies = [f"{kept}\n{own[2]} {x}" for x in ("first edit", "second edit")]
    texts = [f"{own[0]}\n{long}\n{short}", f"{long}\n{own[1]}\n{short}", *copies]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x.text for x in line_dedup.drop_recurring_lines(df).collect()}
    assert out == {0: f"{own[0]}\n{short}", 1: f"{own[1]}\n{short}", 2: copies[0], 3: copies[1]}
