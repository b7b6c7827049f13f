"""Secrets, BPE, chat, language, toxicity and quality against brute force, round trips and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, langid, quality, secrets, toxicity
from tidemark.llm import text as T

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n", "x", "é" * 5000, "same text again", "same text again", "a\u0000b", "词 词 词"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB1é \t\n.-词", max_size=30), max_size=6), st.booleans())
def test_words_like_regex(texts, fold):
    raw = [t.encode() for t in texts]
    for block in T.blocks(pa.array(texts, pa.string()), 8):
        for member, pattern in ((T.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (T.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            w = T.words(block, member, fold)
            for i in range(len(block)):
                text = raw[block.row + i]
                text = text.lower() if fold else text
                spans = [(m.start(), m.end()) for m in re.finditer(pattern, text)]
                a, b = w.first[i], w.first[i + 1]
                assert [(x - block.offsets[i], y - block.offsets[i]) for x, y in zip(w.begin[a:b], w.end[a:b])] == spans


def test_word_hashes_tell_words_apart():
    block = next(T.blocks(pa.array(["ab ab ba a b abc abcd", "ab"])))
    w = T.words(block, T.NOT_SPACE)
    assert w.hash[0] == w.hash[1] == w.hash[7] and len(set(w.hash.tolist())) == 6


SECRET = ["password: hunter22hunter", "PassWd='abc'", 'api_key = "Zx9+/=._-Qw"', "ApiKey:12345678", "AKIAABCDEFGHIJKL and AKIAABC", "f" * 32 + " " + "a" * 31, "passphrase: correct7Horse!Batt#ery", "pwd=123456", "token: the", "tokſn: abcdefgh", "password: password: abcdefghij", "x" * 300 + "secret:" + "9f" * 40]


def slow_spans(t):
    out = []
    for kind, pattern, good in (("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind) for m in re.finditer(pattern, t) if good(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets_against_plain_patterns(spark):
    texts = [*ODD, *SECRET, "é" + " ".join(SECRET)]
    rows = {r.doc_id: r for r in secrets.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = slow_spans(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    assert "guess:12:34" in rows[len(ODD) + 6].spans
    assert rows[len(ODD) + 7].n_guess == 0 and rows[len(ODD) + 8].n_guess == 0


def test_guess_cost():
    for cheap, dear in (("password", "pxqzvkwd"), ("qwertyuiop", "qpwmzrtxvb"), ("aaaaaaaaaa", "akqmzowjxe"), ("12/05/1999", "12x05!1u9q"), ("abcabcabcabc", "abcqpwkzmtyx"), ("P4ssw0rd", "P4xzw0qd")):
        assert secrets.guess_cost(cheap) + 1 < secrets.guess_cost(dear)
    assert secrets.guess_cost("") == 0 and secrets.guess_cost("x" * 20000) < 10


def slow_cost(v, ranks):
    """Brute force over all segmentations, each segment judged by itself."""

    def run(x, follows):
        return len(x) >= 3 and all(follows(a, b) for a, b in zip(x, x[1:]))

    def segment(x, before):
        low = x.lower()
        out = [secrets._single(x)] if len(x) == 1 else []
        for word, extra in ((low, 0.0), (low.translate(secrets.LEET), 0.3)):
            if word in ranks:
                out.append(np.log10(ranks[word] + 1) + extra + (0.3 if x != low else 0))
        if secrets.DATE.fullmatch(x):
            out.append(np.log10(365 * 120 if len(x) > 4 else 120))
        n = len(x)
        if run(low, secrets._near):
            out.append(np.log10(47 * 4 * n) + 0.5 * (n - 3) ** 0.5)
        for first, step in ((94, 0), (94, 1), (188, -1)):
            if run(x, lambda a, b: ord(b) - ord(a) == step):
                out.append(np.log10(first * n))
        if 2 <= n <= 8 and before.endswith(x):
            out.append(np.log10(n + 1))
        return min(out, default=np.inf)

    best = [0.0]
    for j in range(1, len(v) + 1):
        best.append(min(best[i] + segment(v[i:j], v[:i]) for i in range(j)))
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["magic", "the", "P4ss", "word", "1999", "2024-01-15", "12/05/1999", "qwer", "asdf", "zxc", "aaaa", "abcd", "9876", "7!", "x", "Kq", "ab", "1"]), max_size=5).map("".join))
def test_segmentation_against_all_segmentations(value):
    ranks = secrets.ranked(["zebra", "words"])
    assert secrets.guess_cost(value, ranks) == pytest.approx(slow_cost(value, ranks), abs=1e-9)


PROSE = ["The secret is understanding your audience.", "Her secret is simplicity.", "bearer: international", "credentials: certificates", "The token is transferable", "access-key: Transferability.", "secret: state-of-the-art", "token: see/the/documentation", "password: required!", "pwd=password1", "passcode: 2024-01-15", "pass phrase: qwertyuiop12", "api_key: aaaaaaaaaaaa1", "secret = none", "token: TRANSFERABLE"]
HIDDEN = ["passphrase: correct7Horse!Batt#ery", "pwd=xK9$mQ2!vL7p", "private_key: q8Zr-T5yU-w2Ei", "credentials: u7#Rk2!pWq9Z", "bearer: eyJhb9GciOi1JIUz", "access-key => 7Gx!k29Lmq#Z", "secret: 2024-01-15xK9mQ2vL7", "passcode: aaaaQ7!xR9#tWz"]


def test_prose_is_left_alone_and_planted_values_are_found(spark):
    rng = np.random.default_rng(21)
    letters = list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#$%&*")
    planted = [f"pwd: {''.join(rng.choice(letters, int(rng.integers(12, 25))))}" for _ in range(200)]
    plain = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").where("text is not null").limit(200).collect()]
    words = secrets.frequent(docs(spark, plain))
    inside = [f"secret: {w}" for t in plain for w in re.findall(r"[A-Za-z]{6,}", t)[:3]]
    rows = secrets.scan(docs(spark, [*PROSE, *HIDDEN, *planted, *inside]), words=words).orderBy("doc_id").collect()
    spans = [r.spans for r in rows]
    assert [r.n_guess for r in rows[: len(PROSE)]] == [0] * len(PROSE)
    assert all(spans[len(PROSE) : len(PROSE) + len(HIDDEN)])
    found = sum("guess" in s or "assign" in s for s in spans[len(PROSE) + len(HIDDEN) : len(PROSE) + len(HIDDEN) + 200])
    wrong = sum(r.n_guess for r in rows[len(PROSE) + len(HIDDEN) + 200 :])
    print(f"planted values found: {found} of 200; of {len(inside)} words after a credential word, {wrong} were taken for secrets")
    assert found >= 190 and wrong == 0


def test_frequent_words(spark):
    frame = docs(spark, ["bb aaa aaa", None, "", "AAA ccc ddd é éàü éàü", "x" * 30])
    assert secrets.frequent(frame, most=3) == ["aaa", "éàü"]  # more tie for the third place
    assert secrets.frequent(frame) == ["aaa", "éàü", "ccc", "ddd", "x" * 10, "x" * 20]
    assert secrets.frequent(frame.where("false")) == []


def test_redaction(spark):
    got = {r.doc_id: r.text for r in secrets.redacted(docs(spark, [*ODD, *SECRET])).collect()}
    assert [got[i] for i in range(len(ODD))] == ODD
    for i in range(len(SECRET)):
        assert slow_spans(got[len(ODD) + i]) == ""
    empty = secrets.redacted(docs(spark, ["x"]).where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def codec():
    with open(__import__("public_tokenizers").path(bpe.VOCABULARY)) as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library(codec):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_bpe_like_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_long_words(codec, library):
    rng = np.random.default_rng(3)
    for n in (47, 48, 49, 500, 20_000):
        text = "".join(rng.choice(list("abcdeth"), n))
        assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.encode("a" * 5000) == library.encode_ordinary("a" * 5000)


def test_chunks_change_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "FLUSH", 5)
    monkeypatch.setattr(bpe, "PACK", 40)
    texts = [f"some unusual wordsies {k}, anotherly unusual wordsies" for k in range(30)]
    rows = {r.doc_id: r for r in bpe.encoded(docs(spark, [*ODD, *texts]), bpe.vocabulary(spark)).collect()}
    assert all(rows[i].ids == library.encode_ordinary(t or "") for i, t in enumerate([*ODD, *texts]))


def test_folding_by_higher_order_functions(spark, codec, library):
    rng = np.random.default_rng(6)
    words = [w.encode() for w in ("zq", " thezz", " unusualwordsies", "é词", "\n\n\t", "0123456789", "aaaaaaa", "\x00\x01", " tionthereable")]
    words += ["".join(rng.choice(list("abcdeth词é "), int(n))).encode() for n in rng.integers(1, 60, 150)]
    words = [w for w in words if w not in codec.ranks]
    frame = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(words)], "i int, word binary")
    got = frame.select("i", bpe.folded(F.col("word"), bpe.rank_map(codec.ranks)).alias("ids")).orderBy("i").collect()
    assert [r.ids for r in got] == [list(codec.fold(w)) for w in words] and len(words) > 100
    assert all(r.ids == library.encode_ordinary(w.decode()) for r, w in zip(got, words) if len(codec.words(w.decode())) == 1)


def test_words_of_any_length(spark, library):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdeth"), n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000)] + ["word " * 3000]
    rows = {r.doc_id: r for r in bpe.encoded(docs(spark, texts), bpe.vocabulary(spark)).collect()}
    assert all(rows[i].ids == library.encode_ordinary(t) for i, t in enumerate(texts))


def test_only_spark_folds_words_of_usual_length(spark, monkeypatch):
    """The ids of usual words come from the higher-order functions: the fold in the task never sees them."""
    monkeypatch.setattr(bpe.Codec, "fold_long", lambda self, word: (_ for _ in ()).throw(AssertionError(word)))
    assert bpe.digests(docs(spark, ["some unusualwordsies here", "more unusualwordsies, zxqv"]), bpe.vocabulary(spark)).count() == 2


def test_the_rank_map_stays_out_of_plans(spark):
    """The driver prints, logs and keeps every plan of a run; a rank map in it is megabytes each time."""
    rows = bpe.digests(docs(spark, ["some unusualwordsies here"]), bpe.vocabulary(spark))
    assert rows.count() == 1 and len(rows._jdf.queryExecution().toString()) < 200_000


def test_words_are_dealt_in_packets(spark, library):
    """Words that are no pieces take no row each: a chunk sends one packet to a bucket, of less bytes than they have themselves."""
    words = [f"wq{k * 7919:x}zx" for k in range(20_000)]
    rows = bpe.numbered(docs(spark, [" ".join(words)]), bpe.vocabulary(spark), "doc_id", "text").collect()
    packets = [r for r in rows if r.kind == 2]
    assert 0 < len(packets) <= 12 and sum(len(r.data) for r in packets) < sum(map(len, words))
    got = bpe.encoded(docs(spark, [" ".join(words)] * 2), bpe.vocabulary(spark)).collect()
    assert [r.ids for r in got] == [library.encode_ordinary(" ".join(words))] * 2


def test_texts_pack_by_frequency(spark, library):
    """Numbers of words go by frequency, whatever comes first, and take less room than numbers in order of appearance."""
    edges = np.array([0, 159, 160, 255, 160 + (95 << 8) - 1, 160 + (95 << 8), (1 << 24) + 160, (1 << 31) - 1], np.int32)
    assert (bpe.unpaged(*bpe.paged(edges)) == edges).all() and not len(bpe.unpaged(*bpe.paged(edges[:0])))
    rng = np.random.default_rng(9)
    drawn = [*range(18_000, 20_000), *np.minimum(rng.zipf(1.2, 100_000), 20_000).tolist()]
    text = " ".join("".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in drawn)
    numbers = bpe.Numbers()
    plain = bpe.planes(np.array([numbers[w] for w in bpe.Codec("", __import__("public_tokenizers").PATTERN).words(text)], np.int32))
    rows = bpe.numbered(docs(spark, [text]), bpe.vocabulary(spark), "doc_id", "text").where(F.col("kind") == bpe.TEXTS).collect()
    assert sum(len(r.data) for r in rows) < 0.9 * len(bpe.zstandard.ZstdCompressor(level=3).compress(plain))
    assert bpe.encoded(docs(spark, [text]), bpe.vocabulary(spark)).first().ids == library.encode_ordinary(text)


def test_bpe_jobs(spark, library):
    data = bpe.vocabulary(spark)
    rows = {r.doc_id: r for r in bpe.digests(docs(spark, ODD), data).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs(spark, ODD), data), data).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]"]), st.text(alphabet="a[]</>\\INSTs \n", max_size=20)), max_size=6))
def test_chat_round_trip(turns):
    t = chat.Template()
    parts = [p for role, text in turns for p, _ in t.segments(role, text)]
    assert list(t.parse(parts)) == turns
    assert list(t.split("".join(parts))) == turns
    assert sum(loss for role, text in turns for _, loss in t.segments(role, text)) == sum(r == "assistant" for r, _ in turns)


def test_chat_job(spark):
    trap = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", trap), (1, 2, "user", None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, None, None, "x"), (None, 0, "user", "y")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.read_back(chat.formatted(frame)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (rows[1].n_turns, rows[1].turns_sha256) == (3, digest(f"user\nhi\nassistant\n{trap}\nuser\n\n"))
    assert (rows[1].loss_chars, rows[1].loss_sha256, rows[1].n_faults) == (len(trap), digest(trap), 0)
    assert (rows[2].n_turns, rows[2].n_faults, rows[2].loss_sha256) == (2, 2, digest("aa"))
    assert rows[3].turns_sha256 == digest("\nx\n") and rows[None].n_turns == 1
    assert chat.read_back(chat.formatted(frame.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("plain", "[X]")})


def test_context_trees_against_a_slow_coder():
    samples = [[b"abracadabra abra", b"cad"], [b"xyzzy xyz xyzzy"]]
    trees = langid.Trees(["a", "b"], samples, order=3)

    def slow(texts, text):
        counts = {}
        for t in texts:
            t = bytes(3) + t
            for i in range(3, len(t)):
                for d in range(4):
                    counts.setdefault(t[i - d : i], {}).setdefault(t[i], 0)
                    counts[t[i - d : i]][t[i]] += 1
        bits, text = 0.0, bytes(3) + text
        for i in range(3, len(text)):
            for d in (3, 2, 1, 0, -1):
                if d < 0:
                    bits += 8
                    break
                here = counts.get(text[i - d : i])
                if not here:
                    continue
                n, q = sum(here.values()), len(here)
                if text[i] in here:
                    bits += -np.log2(here[text[i]] / (n + q))
                    break
                bits += -np.log2(q / (n + q))
        return bits

    texts = [b"abra cadabra", b"xyz", b"", b"q!", b"abxyz" * 30]
    got = trees.block_bits(T.Block(0, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
    assert got == pytest.approx(np.array([[slow(s, t) for s in samples] for t in texts]), rel=1e-5, abs=1e-4)


def test_languages_held_out(spark):
    from tidemark.llm.queries import op10_langid

    docs_ = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op10_langid(spark, DATA).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs_) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == docs_[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_texts(spark):
    known = docs(spark, ["plain words of text"] * 4)
    trees = langid.fit(known)
    rows = {r.doc_id: r for r in langid.predict(docs(spark, [*ODD, "12 34 !"]), trees).collect()}
    assert [rows[i].lang_pred for i in range(len(ODD) + 1)] == ["und"] * 3 + ["en"] * 6 + ["und"]
    none = langid.predict(docs(spark, ["abc"]), langid.fit(known.where("false"))).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    good = [np.where(y, rng.random(3000) < 0.8, rng.random(3000) < 0.02) for _ in range(5)]
    votes = np.stack([*good, rng.random(3000) < 0.3, *[np.zeros(3000, bool)] * 4], 1).astype(np.float32)
    p = toxicity.label_model(votes, np.full(3000, -1))
    assert ((p > 0.5) == y).mean() > 0.97


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    texts = [" ".join([*rng.choice(words, 40), *(["grumblefish"] * 2 if i % 4 == 0 else [])]) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300)], "doc_id long, toxic int")
    frame = docs(spark, texts)
    model = toxicity.fit(frame, labels)
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(300, 400))
    kept = toxicity.kept(frame, model)
    assert kept.columns == frame.columns and kept.count() == 300
    odd = [r.score for r in toxicity.score(docs(spark, ODD), model).collect()]
    assert len(odd) == len(ODD) and max(odd) < 0.5
    fallback = toxicity.fit(frame, labels.where("false"))
    assert [r.score >= 0.7 for r in toxicity.score(docs(spark, ["you idiot", "hello"]), fallback).collect()] == [True, False]


def slow_kneser_ney(texts, n=quality.N):
    from collections import Counter, defaultdict

    c = {n: Counter()}
    for t in texts:
        t = bytes(n - 1) + t
        c[n].update(t[i : i + n] for i in range(len(t) - n + 1))
    for k in range(n - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    discounts, totals = {}, {}
    for k in c:
        m = Counter(c[k].values())
        n1, n2, n3, n4 = (m[i] for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        discounts[k] = [max(0.05, min(0.95 * i, i - (i + 1) * y * b / a)) if a and b else 0.5 * min(i, 2) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        totals[k] = defaultdict(list)
        for g, x in c[k].items():
            totals[k][g[:-1]].append(x)

    def p(g, k):
        if not k:
            return 1 / 256
        d, here = discounts[k], totals[k].get(g[:-1])
        low = p(g[1:], k - 1)
        if not here:
            return low
        cut = lambda x: d[min(x, 3) - 1]
        x = c[k].get(g, 0)
        return ((x - cut(x) if x else 0) + sum(map(cut, here)) * low) / sum(here)

    return lambda t: -sum(np.log2(p((bytes(n - 1) + t)[i : i + n], n)) for i in range(len(t)))


def test_quality_against_a_slow_model(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "zzz!!qq", None, "", "the cat"]
    frame = docs(spark, texts)
    trusted = spark.createDataFrame([(0,), (1,), (2,), (2,)], "doc_id long")
    rows = {r.doc_id: r for r in quality.classify(frame, trusted).collect()}
    slow = slow_kneser_ney([t.encode() for t in texts[:3]])
    for i, t in enumerate(texts):
        if t:
            assert rows[i].perplexity == pytest.approx(2 ** (slow(t.encode()) / len(t)), rel=1e-6)
        else:
            assert rows[i].perplexity is None and not rows[i].kept
    assert rows[0].kept and not rows[3].kept
    everything = {r.doc_id: r.kept for r in quality.classify(frame, trusted.where("false")).collect()}
    assert everything == {i: bool(t) for i, t in enumerate(texts)}
    assert quality.classify(frame.where("false"), trusted).count() == 0


def test_rare_toxic_terms_are_kept():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(840)]
    plain, common, rare = words[:400], words[400:800], words[800:]
    toxic = [" ".join([*rng.choice(plain, 30), common[i % 400], common[(i + 7) % 400]]) for i in range(2000)]
    toxic += [" ".join([*rng.choice(plain, 30), w]) for w in rare for _ in range(toxicity.SUPPORT + 2)]
    other = [" ".join(rng.choice(plain, 30)) for _ in range(4000)]
    kept = toxicity.mined([t.encode() for t in toxic], [t.encode() for t in other])
    assert len(kept) > 1000 and np.isin(toxicity.terms(toxicity.pack([" ".join(rare).encode()]))[0][: len(rare)], kept).all()
    model = toxicity.train([t.encode() for t in toxic + other], np.array([1] * len(toxic) + [0] * len(other)))
    fresh = [" ".join([*rng.choice(plain, 30), w]).encode() for w in rare]
    assert (model.scores(toxicity.pack(fresh)) >= 0.7).all()


def test_shares_of_sparse_votes():
    rng = np.random.default_rng(6)
    votes = (rng.random((500, 40)) < 0.1).astype(float)
    votes[:, 1] = votes[:, 0]
    p, a, b = rng.random(500), rng.random(40) * 0.3, rng.random(40) * 0.1
    rest = votes - (p[:, None] * a + (1 - p)[:, None] * b)
    rest /= rest.std(0) + 1e-6
    corr = rest.T @ rest / 500
    want = 1 / np.maximum(1, (np.where(np.abs(corr) > 0.1, corr, 0) ** 2).sum(1))
    assert np.allclose(toxicity.shares(toxicity.Votes.of(votes), p, a, b, width=7), want)


def test_no_language_is_left_out(spark, monkeypatch):
    rows = [(i, f"words {chr(97 + i % 5) * 3}", f"l{i % 5}") for i in range(20)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 5)
    assert langid.fit(known, sample=2).names == [f"l{k}" for k in range(5)]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 4)
    with pytest.raises(ValueError, match="more than 8 documents"):
        langid.fit(known, sample=2)
