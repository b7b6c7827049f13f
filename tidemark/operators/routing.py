"""Partition keys: by time, by tenant or by a hash, and how large a file should become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MB = 1 << 20
#: Target file size once a key holds so many bytes.
STEPS = ((0, 64 * MB), (1 << 30, 128 * MB), (10 << 30, 192 * MB), (100 << 30, 256 * MB))


def by_time(micros: Column) -> Column:
    """The UTC day, yyyyMMdd, of microseconds since the epoch."""
    return F.date_format(F.timestamp_micros(micros), "yyyyMMdd")


def by_tenant(tenant: Column) -> Column:
    """The tenant itself; an empty one is an error when it is met."""
    return F.when((tenant.isNull()) | (tenant == ""), F.raise_error(F.lit("tenant_id is empty"))).otherwise(tenant)


def by_hash(user: Column, buckets: int) -> Column:
    """hash_<bucket>: equal users share a bucket."""
    return F.concat(F.lit("hash_"), F.pmod(F.xxhash64(user), F.lit(buckets)).cast("string"))


def routed(rows: DataFrame, strategy: str = "time", buckets: int = 64) -> DataFrame:
    """rows with partition_key."""
    keys = {"time": lambda: by_time(F.col("event_time")), "tenant": lambda: by_tenant(F.col("tenant_id")), "hash": lambda: by_hash(F.col("user_id"), buckets)}
    return rows.withColumn("partition_key", keys[strategy]())


def target_bytes(total: int, least: int = 16 * MB, most: int = 256 * MB) -> int:
    """The file size to aim at for a key of so many bytes."""
    return min(most, max(least, [size for start, size in STEPS if total >= start][-1]))
