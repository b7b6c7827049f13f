"""Substrings, vectors, benchmark windows, near-duplicates and the pipeline against brute force and edge cases."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, neardup, secrets, store, substrings, vectors
from tidemark.llm import text as T

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "x", "é " * 3000]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def prose(rng, n, words=400):
    return " ".join(f"w{k}" for k in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeated lines, a hot passage, and odd texts."""
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(n)) for n in rng.integers(3, 150, 60)]
    passage, hot = prose(rng, 40), prose(rng, 20)
    texts += [texts[3], texts[3].upper(), texts[3] + "  ", texts[20], " ".join(["it"] * 60), " ".join(["it"] * 45)]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(5)] + [f"{prose(rng, 9)} {hot}\n{prose(rng, 9)}" for _ in range(30)]
    base = prose(rng, 200).split()
    for _ in range(25):
        near = list(base)
        for k in rng.integers(0, 200, int(rng.integers(1, 9))):
            near[k] = "changed"
        texts.append(" ".join(near))
    ids = rng.permutation(1000)[: len(texts) + len(ODD)].tolist()
    return list(zip(ids, [*texts, *ODD], strict=True))


def test_substrings(spark, corpus):
    rows = [*corpus, (corpus[3][0], corpus[3][1]), (None, corpus[3][1])]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in corpus}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = defaultdict(list)
    for r in substrings.deduplicated(docs(spark, rows)).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert sum(map(len, got.values())) == len(rows) and len(got[corpus[3][0]]) == 2
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert set(got[i]) == {(len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())}
    assert got[None][0][1] == 0
    assert substrings.deduplicated(docs(spark, [(1, "x")]).where("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=5), st.lists(st.integers(0, 3), max_size=15))
def test_automaton(sequences, text):
    a = substrings.Automaton()
    for s in sequences:
        a.add(s)
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    slow = [max((n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in known), default=0) for e in range(len(text))]
    assert a.matches(text) == slow


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=5))
def test_fm_index(text, phrases):
    text = np.array(text, np.int64)
    order = decontaminate.suffixes(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = decontaminate.FMIndex(text, 4)
    size = np.array([len(p) for p in phrases])
    low, high = index.ranges(np.concatenate(phrases), np.cumsum(size) - size, size)
    for p, a, b in zip(phrases, low, high):
        places = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
        assert places == [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]


def test_benchmark(spark, corpus):
    rng = np.random.default_rng(9)
    items = [(1, corpus[65][1]), (2, "W1 w2!"), (3, "..."), (4, None), (10, prose(rng, 30)), (11, corpus[5][1]), (11, prose(rng, 15))]
    rows = [*corpus, (2000, items[4][1].upper().replace(" ", "-"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    windows = defaultdict(set)
    for i, t in items:
        w = find(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    for parts in (decontaminate.load(bench), decontaminate.load(bench, part_bytes=200)):
        got = {r.doc_id: r for r in decontaminate.report(docs(spark, rows), parts).collect()}
        for i, t in rows:
            w, hit, own = find(lower(t)), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit.update(range(k, k + n))
                        own |= windows[tuple(w[k : k + n])]
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(own), bool(hit) and 20 * len(hit) >= len(w))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in decontaminate.cleaned(docs(spark, rows), parts, drop=False).collect()}
    assert clean[2000] == "" and len(clean) == len(rows)
    assert all(clean[i] == t for i, t in rows if not got[i].n_hit)
    again = decontaminate.report(docs(spark, list(clean.items())), parts).where("n_hit > 0").count()
    assert again == 0
    assert decontaminate.report(docs(spark, rows), decontaminate.load(bench.where("false"))).where("n_hit > 0").count() == 0


def test_near_duplicates(spark, corpus):
    rows = [*corpus, corpus[3], (None, "a b c d e f")]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0))
    ids = [i for i in sets if i is not None]
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups_of(pairs, ids)
    got = neardup.near_duplicates(docs(spark, rows).withColumn("n", F.lit(1)).withColumn("h1", F.lit(1))).collect()
    assert len(got) == len(rows) and len(set(want.values())) < len(ids) - 5
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(docs(spark, [(1, "x")]).where("false")).count() == 0


def test_tiles_change_nothing(spark, corpus, monkeypatch):
    want = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, corpus)).collect()}
    monkeypatch.setattr(neardup, "TILE_ROWS", 4)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, corpus)).collect()} == want


def test_joint_estimate():
    rng = np.random.default_rng(2)
    for true in (0.3, 0.6, 0.9):
        n = 2000
        both = int(n * 2 * true / (1 + true))
        a, b = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
        b[:both] = a[:both]
        x, y = (neardup.registers(np.sort(s), np.array([0, n]))[0] for s in (a, b))
        union = neardup.registers(np.unique(np.concatenate([a, b])), np.array([0, len(np.unique(np.concatenate([a, b])))]))[0]
        assert (np.maximum(x, y) == union).all()
        equal, more = np.array([(x == y).sum()]), np.array([(x > y).sum()])
        assert neardup.jaccard(equal, more, neardup.M - equal - more, np.array([n]), np.array([n]))[0] == pytest.approx(true, abs=0.15)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in store.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert store.components(links.where("false")).count() == 0


def cloud(seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    rows, k = [], 0
    for i in range(300):
        c = centres[i % 12]
        v = (c + rng.standard_normal(16) * 0.09).tolist()
        rows.append((k, v, int(i % 3 if i % 12 else 0)))
        k += 1
    rows += [(k + i, rows[5][1], rows[5][2]) for i in range(4)]
    k += 4
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, [2.0] * 3, [1e200] * 16, [-0.0] * 15 + [1.0]]
    rows += [(k + i, v, 0) for i, v in enumerate(odd)] + [(k + 20, rows[0][1], None), (k + 21, rows[0][1], None)]
    return rows


def test_vectors(spark, monkeypatch):
    rows = cloud()
    good = {i: np.array(v, float) / np.sqrt(np.sum(np.square(np.array(v, float) / np.abs(np.array(v, float)).max()))) / np.abs(np.array(v, float)).max() for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in rows}
    pairs = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98]
    want, links = groups_of(pairs, label), defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert len(pairs) > 300
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for tile in (vectors.TILE, 5):
        monkeypatch.setattr(vectors, "TILE", tile)
        got = vectors.near_duplicates(frame).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert vectors.near_duplicates(frame.where("false")).count() == 0


def test_pipeline(spark):
    """Each stage against what it should do to its own input."""
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = frame
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in taken.collect()}
        taken = store.written(stage(spark, taken, DATA), "stage")
        after = {r.doc_id: r for r in taken.collect()}
        assert set(after) <= set(before)
        if name != "tokens":
            assert taken.columns == frame.columns and taken.dtypes == frame.dtypes
        if name == "near duplicates":
            least = alike([(i, r.text) for i, r in before.items()], 80)  # brute force over all pairs
            assert set(after) == {i for i, k in least.items() if i == k}
        if name == "benchmark":
            parts = decontaminate.load(spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert decontaminate.report(taken, parts).where("n_hit > 0").count() == 0
        if name == "secrets":
            assert secrets.scan(taken).where("n_assign + n_access + n_hex > 0").count() == 0
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "tokens":
            assert all(after[i].decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest() for i in after) and set(after) == set(before)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, taken.collect()))


def alike(rows, percent):
    """Component of each id by brute force over pairs of five-word shingle sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0))
    return groups_of([(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])], sets)


def changed(rng, words, at):
    """A text and a copy of it with other words at some places, which share less the more places there are."""
    text = prose(rng, words, 10**6).split()
    return [" ".join(text), " ".join("changed" if k in at else w for k, w in enumerate(text))]


def test_search_follows_the_threshold():
    for percent in range(1, 100):
        s, j = neardup.search(percent), percent / 100
        draws = np.random.default_rng(percent).binomial(s.m, j, 10**6)
        assert s.m % s.rows == 0 and (1 - j**s.rows) ** (s.m // s.rows) <= neardup.MISS
        assert (draws < s.equal).mean() <= neardup.MISS and (draws / s.m < s.floor).mean() <= 5 * neardup.MISS
    assert neardup.search(85)[:2] == (100, 5)
    for percent in (0, 101):
        with pytest.raises(ValueError):
            neardup.search(percent)


@pytest.mark.parametrize("percent", [50, 65, 80])
def test_near_duplicates_at_other_thresholds(spark, percent):
    rng = np.random.default_rng(percent)
    texts = [t for k in range(1, 8) for _ in range(8) for t in changed(rng, 100, set(range(10, 10 + 8 * k, 8)))]
    rows = list(enumerate(texts))
    want = alike(rows, percent)
    assert 0 < len(rows) - len(set(want.values())) < len(rows) // 2
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), percent=percent).collect()} == want


def test_pipeline_drops_near_copies_of_four_fifths(spark):
    rng = np.random.default_rng(8)
    texts = [t for at in ({40, 60}, {50}, {20, 40, 60}) for _ in range(12) for t in changed(rng, 100, at)]
    rows = list(enumerate(texts))
    assert len(set(alike(rows, 80).values())) < len(set(alike(rows, 85).values()))
    left = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), DATA)
    assert {r.doc_id for r in left.collect()} == set(alike(rows, 80).values())


def test_hubs_join_a_large_group(spark, monkeypatch):
    """A group of near copies in buckets beyond a tile: the same components, from rows in proportion to the group."""
    rng = np.random.default_rng(12)
    base, other = prose(rng, 150, 10**6).split(), prose(rng, 150, 10**6).split()
    texts = [" ".join(base)]
    for b, n in ((base, 160), (other, 30)):
        for _ in range(n):
            near = list(b)
            near[int(rng.integers(0, 150))] = f"x{int(rng.integers(0, 10**6))}"
            texts.append(" ".join(near))
    rows = [(int(i), t) for i, t in zip(rng.permutation(1000), texts)]
    monkeypatch.setattr(neardup, "TILE_ROWS", 16)
    taken = []
    plain = neardup.active
    monkeypatch.setattr(neardup, "active", lambda tiles, s: taken.append(tiles.count()) or plain(tiles, s))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == alike(rows, 85)
    bands = neardup.search(85).m // 5
    assert 2 <= len(taken) <= neardup.HUBS + 1 and sum(taken) < 4 * len(rows) * bands  # in slices of 16 by 16 they would be 12 times as many
