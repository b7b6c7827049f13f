"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, tokens; each stage's rows are written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of `documents`. Rows with a null id are learned from nowhere,
near-duplicates of nothing, and otherwise treated like any. Rows that repeat an id are one document: they stay or go together. Null and empty
texts score as clean, are like nothing, hold no passage and no secret, and have no tokens; they go through all stages. An empty table gives
an empty table. Other columns, nulls in them included, are passed on as they are; n_chars is told anew where a text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, neardup, secrets, store, toxicity
from tidemark.llm.langid import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, by a model learned from two thirds of the labelled ones."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(F.col("doc_id"), 3) != 1)
    return toxicity.kept(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles with a Jaccard index of 0.8 or more."""
    gone = neardup.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark items hold too, and without those of which they are a twentieth."""
    clean = decontaminate.cleaned(docs, decontaminate.load(_table(spark, sf_dir, "benchmark")))
    return recounted(clean)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return recounted(secrets.redacted(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: their number, their digest, and the digest of the text that they decode to."""
    return bpe.digests(docs, bpe.vocabulary(spark))


def recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars told anew from the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark", cut_benchmark),
    ("secrets", mask_secrets),
    ("tokens", encode),
]
#: Learned scores, sketches and merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store.written(docs, name.replace(" ", "_"))
    return docs
