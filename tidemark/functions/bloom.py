"""Bloom filters as tables: one row for each 32 bits that aren't all zero, so building is an aggregate and asking is a join."""

from __future__ import annotations

import base64
import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """bits and hashes of a filter."""

    bits: int
    hashes: int

    @staticmethod
    def of(items: int, rate: float) -> Shape:
        """The shape for so many distinct items at a false-positive rate."""
        if items < 1 or not 0 < rate < 1:
            raise ValueError("at least one item and a rate between 0 and 1 are needed")
        bits = max(64, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
        return Shape(bits, max(1, math.ceil(bits / items * math.log(2))))

    def rate(self, items: int) -> float:
        """The expected false-positive rate once it holds so many items."""
        return (1 - math.exp(-self.hashes * items / self.bits)) ** self.hashes

    def places(self, value: Column) -> Column:
        """The bits of a value, by double hashing."""
        first, step = F.xxhash64(value), F.xxhash64(value, F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: F.pmod(F.pmod(first, F.lit(self.bits)) + i * F.pmod(step, F.lit(self.bits)), F.lit(self.bits)))


def build(rows: DataFrame, column: str, shape: Shape, *keys: str) -> DataFrame:
    """(keys, word, mask): a filter for each key; nulls aren't held."""
    bits = rows.where(F.col(column).isNotNull()).select(*keys, F.explode(shape.places(F.col(column))).alias("bit"))
    return bits.select(*keys, F.expr("bit div 32").alias("word"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("m")).groupBy(*keys, "word").agg(F.bit_or("m").alias("mask"))


def own_may_hold(filters: DataFrame, values: DataFrame, column: str, shape: Shape, *keys: str) -> DataFrame:
    """(keys, value): of values that come with keys, those that the filter of their own key may hold. What grows with values times keys in
    `may_hold` grows with the values here, and only bits that aren't set are gathered by value. Never leaves out one that it holds."""
    asked = values.select(*keys, F.col(column).alias("value")).where("value is not null").distinct()
    bits = asked.select(*keys, "value", F.explode(shape.places(F.col("value"))).alias("bit"))
    bits = bits.select(*keys, "value", F.expr("bit div 32").alias("word"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("m"))
    unset = bits.join(filters, [*keys, "word"], "left").where("coalesce(mask & m, 0) = 0")
    return asked.join(unset, [*keys, "value"], "left_anti")


def may_hold(filters: DataFrame, values: DataFrame, column: str, shape: Shape, *keys: str) -> DataFrame:
    """(keys, value): the values that each key's filter may hold, each value asked of all keys. Never leaves out one that it holds."""
    asked = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    bits = asked.select("value", F.explode(F.array_distinct(shape.places(F.col("value")))).alias("bit"), F.size(F.array_distinct(shape.places(F.col("value")))).alias("need"))
    bits = bits.select("value", "need", F.expr("bit div 32").alias("word"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("m"))
    hits = filters.join(bits, "word").where("(mask & m) <> 0")
    return hits.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n = need").select(*keys, "value")


def united(filters: list[DataFrame], *keys: str) -> DataFrame:
    """Filters of one shape as one; filters of different shapes must not be united."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))


def dumped(shape: Shape, words: list[tuple[int, int]]) -> str:
    """A filter as text: its shape, then all its words, little-endian, in base 64."""
    full = [0] * (-(-shape.bits // 32))
    for k, m in words:
        full[k] = m
    return base64.b64encode(struct.pack(f"<QI{len(full)}I", shape.bits, shape.hashes, *full)).decode()


def loaded(text: str) -> tuple[Shape, list[tuple[int, int]]]:
    """The filter of a text."""
    data = base64.b64decode(text)
    bits, hashes = struct.unpack_from("<QI", data)
    words = struct.unpack_from(f"<{-(-bits // 32)}I", data, 12)
    return Shape(bits, hashes), [(k, m) for k, m in enumerate(words) if m]
