"""Registered queries: those with SQL give its rows, those without are held against brute force, the labels or the library."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import answer, asked
from tidemark.llm import quality
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_oracles_rows(spark, name):
    assert asked(QUERIES[name](spark, DATA)) == answer(DATA, ORACLES[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op4_vectors", "op5_chat")])
def test_query_gives_every_document_once(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, DATA).select("doc_id").collect()) == ids


def test_vectors_with_links_by_the_oracle(spark, tmp_path):
    """Planted pairs around the threshold, a dense clump and copies; the given tables hold no links."""
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for _ in range(120):
        x = rng.standard_normal(24)
        for cosine in (1.0, rng.uniform(0.97, 0.99)):
            y = rng.standard_normal(24)
            y -= (y @ x) / (x @ x) * x
            y *= np.linalg.norm(x) / np.linalg.norm(y)
            rows.append((k, (cosine * x + np.sqrt(1 - cosine**2) * y).tolist(), int(rng.integers(0, 3))))
            rows.append((k + 1, x.tolist(), rows[-1][2]))
            k += 2
    x = rng.standard_normal(24)
    rows += [(k + i, (x + 0.02 * rng.standard_normal(24)).tolist(), 1) for i in range(150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = answer(str(tmp_path), ORACLES["op4_vectors"])
    got = asked(QUERIES["op4_vectors"](spark, str(tmp_path)))
    links = sum(r.n_links for r in QUERIES["op4_vectors"](spark, str(tmp_path)).collect())
    print(f"{links} link ends, rows that differ from brute force: {len(set(got[1]) ^ set(want[1]))}")
    assert got == want and links > 150 * 149


def test_split_and_held_out_toxicity(spark):
    rows = QUERIES["op8_toxicity"](spark, DATA).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    clean = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    learned = [r for r in rows if labels.get(r.doc_id) == 1 and not r.held_out]
    assert not learned or np.mean([r.predicted for r in learned]) > 0.6


def test_quality_trusts_what_is_labelled_good(spark):
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    direct = quality.classify(spark.read.parquet(f"{DATA}/documents.parquet"), good)
    both = [{r.doc_id: (round(r.perplexity or 0, 9), r.kept) for r in x.collect()} for x in (direct, QUERIES["op6_quality"](spark, DATA))]
    assert both[0] == both[1]
    inside = direct.join(good, "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert inside > 0.95


def test_tokens_like_the_library(spark):
    import public_tokenizers
    import tiktoken

    from tidemark.llm import bpe

    with open(public_tokenizers.path(bpe.VOCABULARY)) as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(f.read()), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe"](spark, DATA).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
