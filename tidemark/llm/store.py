"""Cutting lineage: tables written to the folder that all machines share, and connected components over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import work_dir
from tidemark.sources import shared


def _written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    spark, folder = df.sparkSession, work_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}"), folder


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there, so that lost executors cost a read."""
    return _written(df, name, codec)[0]


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of every node of links(a, b); component is the smallest node reachable.

    Large-star and small-star steps in turn: each node's neighbours are hung on the least of them, by aggregates and joins only,
    so a node with any number of links takes no task's memory. Rounds grow with the logarithm of a component's diameter; a round's
    tables go when the next one has written its own.
    """
    spark = links.sparkSession
    edges, folder = _written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    none = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if edges.isEmpty():
        return none
    before = None
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, between = _written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, new = _written(small, "small")
        shared.remove(spark, folder)
        shared.remove(spark, between)
        folder = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {limit} rounds")
