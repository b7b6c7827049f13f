import pytest
from pyspark.sql import functions as F

from tests.oracle import answer, asked
from tidemark.catalog import CATALOG
from tidemark.functions import bloom


def test_shapes():
    s = bloom.Shape.of(10_000, 0.01)
    assert s.rate(10_000) < 0.011 and bloom.Shape.of(1, 0.5).bits == 64
    with pytest.raises(ValueError):
        bloom.Shape.of(0, 0.1)


def test_filter(spark):
    shape = bloom.Shape.of(1000, 0.01)
    rows = spark.range(1000).selectExpr("cast(id as string) v", "id % 2 k")
    filters = bloom.build(rows, "v", shape, "k")
    held = bloom.may_hold(filters, rows, "v", shape, "k")
    assert held.join(rows.withColumnRenamed("v", "value"), ["k", "value"], "left_semi").count() == 1000
    strangers = spark.range(5000, 9000).selectExpr("cast(id as string) v")
    one = bloom.united([bloom.build(rows.where("k = 0"), "v", shape), bloom.build(rows.where("k = 1"), "v", shape)])
    assert bloom.may_hold(one, strangers, "v", shape).count() < 0.02 * 4000
    assert bloom.may_hold(one, rows, "v", shape).count() == 1000
    words = sorted((r.word, r.mask) for r in one.collect())
    assert bloom.loaded(bloom.dumped(shape, words)) == (shape, words)


def test_values_with_keys(spark):
    shape = bloom.Shape.of(1000, 0.01)
    rows = spark.range(1000).selectExpr("cast(id as string) v", "id % 2 k")
    filters = bloom.build(rows, "v", shape, "k")
    assert bloom.own_may_hold(filters, rows.union(rows), "v", shape, "k").count() == 1000
    assert bloom.own_may_hold(filters, rows.selectExpr("v", "1 - k k"), "v", shape, "k").count() < 20
    assert bloom.own_may_hold(filters, rows.selectExpr("v", "k + 2 k"), "v", shape, "k").count() == 0


def test_days_of_many_users(spark, tmp_path):
    """3,000 users a day, ids from 999,000 on: more than the filters once were made for, and ids that once were taken for strangers'."""
    rows = spark.range(9000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 3 as int), 0, 0, id div 3)").alias("ts"), (999_000 + F.col("id") % 4500).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = asked(CATALOG.queries["m_bloom"](spark, str(tmp_path)))
    assert got == answer(str(tmp_path), CATALOG.oracle["m_bloom"]) and "True" in got[1][0]
