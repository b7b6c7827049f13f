"""Sources: event data with an explicit, versioned schema, and the plain tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Event row, version 1. event_time is microseconds since the epoch.
EVENTS = S.StructType(
    [
        S.StructField("event_id", S.BinaryType()),
        S.StructField("tenant_id", S.StringType(), False),
        S.StructField("user_id", S.LongType(), False),
        S.StructField("event_time", S.LongType(), False),
        S.StructField("event_type", S.StringType(), False),
        S.StructField("payload", S.StringType(), False),
    ]
)
#: What one second, millisecond and nanosecond is in event_time's unit, as (factor, divisor).
UNITS = {"s": (1_000_000, 1), "ms": (1_000, 1), "us": (1, 1), "ns": (1, 1_000)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the plain Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical event view over the plain `events` table."""
    e = table(spark, sf_dir, "events")
    tenant = F.concat(F.lit("tenant_"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"))
    return e.select(
        "event_id",
        tenant.alias("tenant_id"),
        "user_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("event_time"),
        "event_type",
        F.col("props").alias("payload"),
        F.date_format("ts", "yyyyMMdd").alias("partition_key"),
        "value",
        "ts",
    )


def to_micros(column, unit: str):
    """A long time in any known unit as microseconds, without passing through a double."""
    factor, divisor = UNITS[unit]
    c = column.cast("long")
    return c * F.lit(factor) if divisor == 1 else F.call_function("div", c, F.lit(divisor))


def read_files(spark: SparkSession, paths: Iterable[str], schema: S.StructType) -> DataFrame:
    """Data files under the latest schema: columns that a file lacks read as null; no paths give an empty table."""
    paths = list(paths)
    nullable = S.StructType([S.StructField(f.name, f.dataType, True) for f in schema])
    return spark.read.schema(nullable).parquet(*paths) if paths else spark.createDataFrame([], nullable)


def json_batch(spark: SparkSession, rows: list[dict], schema: S.StructType = EVENTS) -> DataFrame:
    """Rows of a JSON request as a DataFrame of the schema; numbers stay integers of 64 bits; payloads become JSON text."""
    import json

    def cell(row: dict, f: S.StructField) -> object:
        x = row.get(f.name)
        if f.name == "payload":
            return json.dumps({} if x is None else x, separators=(",", ":")) if not isinstance(x, str) else x
        return x.encode() if isinstance(f.dataType, S.BinaryType) and isinstance(x, str) else x

    loose = S.StructType([S.StructField(f.name, f.dataType, True) for f in schema])
    return spark.createDataFrame([tuple(cell(r, f) for f in loose) for r in rows], loose)


def json_rows(lines: DataFrame, column: str = "value", schema: S.StructType = EVENTS) -> DataFrame:
    """Rows of JSON text, one object each, parsed where they lie: numbers stay integers of 64 bits, objects in a text column become JSON text,
    and what a row lacks or can't be read is null, to be told by validation."""
    loose = S.StructType([S.StructField(f.name, S.StringType() if isinstance(f.dataType, S.BinaryType) else f.dataType, True) for f in schema])
    rows = lines.select(F.from_json(column, loose, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
