"""Every operator and pipeline stage on nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, chat, decontaminate, langid, neardup, quality, secrets, substrings, toxicity, vectors

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "n h1 h2 bucket part kind class class2 data score spans registers i j salt c w s count id gram bits chunk file block group step threshold kept n_words least removed sha256 spot key keys m component rep".split()


def long_text():
    rng = np.random.default_rng(3)
    words = np.array([f"word{k}" for k in range(5000)])
    return " ".join(words[rng.integers(0, 5000, 200_000)])


@pytest.fixture(scope="module")
def rows():
    same = "a text that comes several times under other ids, with enough words for a window of thirteen"
    out = [(1, same, "en", "a"), (2, same, "en", "a"), (2, same, "en", "a"), (3, same.upper(), None, None), (4, None, None, None), (5, "", "en", "b"), (6, " \t\n", "en", "b")]
    out += [(7, long_text(), "en", "c"), (None, same, "en", "a"), (None, None, None, None), (8, "é词" * 4000, "xx", "c"), (9, "you idiot", "en", "a"), (10, "password: hunter22hunter", "en", "a")]
    return [(i, t, y, s, None if t is None else len(t)) for i, t, y, s in out]


@pytest.fixture(scope="module")
def operators(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    data, parts = bpe.vocabulary(spark), decontaminate.load(spark.createDataFrame([(1, rows[0][1]), (2, None), (None, "x y")], "item_id long, text string"))
    model = toxicity.fit(frame, spark.createDataFrame([(9, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int"))
    trees = langid.fit(frame.where("lang = 'en' and doc_id <> 7"))
    trusted = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    return {
        "secrets": lambda d: secrets.scan(d),
        "bpe": lambda d: bpe.digests(d, data),
        "substrings": lambda d: substrings.deduplicated(d),
        "quality": lambda d: quality.classify(d, trusted),
        "decontaminate": lambda d: decontaminate.report(d, parts),
        "toxicity": lambda d: toxicity.score(d, model),
        "neardup": lambda d: neardup.near_duplicates(d),
        "langid": lambda d: langid.predict(d, trees),
    }


NAMES = ["secrets", "bpe", "substrings", "quality", "decontaminate", "toxicity", "neardup", "langid"]


@pytest.mark.parametrize("name", NAMES)
def test_documents(spark, rows, operators, name):
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    clashing = frame.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))
    got, again = (sorted(map(repr, map(tuple, operators[name](d).collect()))) for d in (frame, clashing))
    assert got == again and len(got) == len(rows)
    by = {}
    for r in operators[name](frame).collect():
        by.setdefault(r.doc_id, []).append(tuple(r))
    assert len(by[2]) == 2 and by[2][0] == by[2][1] and len(by[None]) == 2
    assert operators[name](frame.where("false")).count() == 0


def test_secrets_in_a_very_long_text(spark):
    t = long_text()
    got = secrets.scan(spark.createDataFrame([(1, t + " token=Zx9Qw7Lm2p " + t)], "doc_id long, text string"), words=[]).first()
    assert got.n_assign == 1 and f":{len(t) + 1}:" in got.spans


def test_equal_code_lengths_go_to_the_first_language(spark):
    known = spark.createDataFrame([(i, "the very same words", y) for i, y in enumerate(["bb", "aa"] * 3)], "doc_id long, text string, lang string")
    assert langid.predict(known, langid.fit(known)).select("lang_pred").distinct().collect()[0].lang_pred == "aa"


def test_a_perplexity_at_the_threshold_is_kept(spark):
    frame = spark.createDataFrame([(i, "some words of a text") for i in range(5)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = quality.classify(frame, frame.select("doc_id"), slack=1.0).collect()
    assert all(r.kept for r in got) and len({r.perplexity for r in got}) == 1
    step = np.log2(got[0].threshold) * quality.STEPS
    assert abs(step - round(step)) < 1e-6 and got[0].perplexity <= got[0].threshold < got[0].perplexity * 1.001


def test_quantiles_by_counts(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", int(x)) for i, x in enumerate(rng.integers(0, 50, 500))]
    got = {r.group: r.step for r in quality.quantiles(spark.createDataFrame(rows, "group string, step long"), 0.9).collect()}
    for g in "ab":
        own = sorted(x for y, x in rows if y == g)
        assert got[g] == own[int(np.ceil(0.9 * len(own))) - 1]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (2, [0.0, 1.0], "b"), (None, [1.0, 0.0], "a"), (3, None, "a"), (4, [1.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    clashing = frame.select("*", *(F.lit(k).alias(c) for k, c in enumerate([*CLASH, "dim", "pass", "vec", "digest", "window", "links"])))
    got = sorted(map(repr, map(tuple, vectors.near_duplicates(frame).collect())))
    assert got == sorted(map(repr, map(tuple, vectors.near_duplicates(clashing).collect()))) and len(got) == len(rows)
    assert "(2, 1, 1, False)" in got and "(4, 0, 4, True)" in got and "(None, 0, None, True)" in got
    assert vectors.near_duplicates(frame.where("false")).count() == 0


def test_a_dense_run_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 8)
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16)
    frame = spark.createDataFrame([(i, (x + 0.001 * rng.standard_normal(16)).tolist(), 1) for i in range(100)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()} == {(99, 0)}


def test_a_long_conversation(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("[INST] x <s>").alias("text"), F.lit(1).alias("segment"), F.lit("y").alias("loss"), F.lit(0).alias("fault"))
    got = chat.read_back(chat.formatted(turns)).collect()
    assert [(r.n_turns, r.n_faults, r.loss_chars) for r in got] == [(20_000, 0, 120_000)]


def test_a_hot_passage_is_dealt_by_its_windows(spark, monkeypatch):
    """Texts that share one ten-word line in different surroundings: called hot, the line's windows spread over parts, with the same result."""
    rng = np.random.default_rng(4)
    line = " ".join(f"common{k}" for k in range(10))
    texts = [" ".join(f"u{int(k)}" for k in rng.integers(0, 10**6, 8)) + f" {line} " + " ".join(f"v{int(k)}" for k in rng.integers(0, 3 if i % 5 == 0 else 10**6, 8)) for i in range(300)]
    copies = [texts[0]] * 150
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *copies])]
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    plain = {r.doc_id: tuple(r) for r in substrings.deduplicated(frame).collect()}
    monkeypatch.setattr(substrings, "LEAST_HOT", 3)
    monkeypatch.setattr(substrings, "HOT", 10**6)
    seen, hot = [], substrings.hot
    monkeypatch.setattr(substrings, "hot", lambda *a: seen.append(hot(*a)) or seen[-1])
    largest, judged = [], substrings.judged

    def watched(stretches, parts):
        sizes = [len(substrings.unpack(r.data, *substrings.Stretches.TYPES)[0]) for r in stretches.select("data").collect()]
        largest.append((max(sizes), sum(sizes)))
        return judged(stretches, parts)

    monkeypatch.setattr(substrings, "judged", watched)
    assert {r.doc_id: tuple(r) for r in substrings.deduplicated(frame).collect()} == plain
    assert len(seen[0].samples) and len(seen[0].classes) == 1
    assert largest[0][0] < 0.3 * largest[0][1]
    assert sum(n for _, _, n, _ in plain.values()) > 0


def test_a_benchmark_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        decontaminate.load(spark.createDataFrame([(1, "some words of a text")], "item_id long, text string"))


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, rows, k):
    name, stage = corpus_pipeline.STAGES[k]
    frame = spark.createDataFrame(rows, DOCS)
    got = stage(spark, frame, DATA)
    kept = [tuple(r) for r in got.collect()]
    if k < 4:
        assert got.columns == frame.columns and got.dtypes == frame.dtypes
    assert stage(spark, frame.where("false"), DATA).count() == 0
    ids = [r[0] for r in kept]
    assert ids.count(2) in ((2,) if name != "near duplicates" else (0,)) and ids.count(None) == 2
    assert {4, 5, 6, 7, 8} <= set(ids)
    if name == "near duplicates":
        assert sorted(i for i in ids if i in (1, 2, 3)) == [1]
        twice = spark.createDataFrame([rows[0], rows[0]], DOCS)
        assert stage(spark, twice, DATA).count() == 2  # rows of one id are one document
