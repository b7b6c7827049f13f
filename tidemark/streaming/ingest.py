"""Streams into the store: files that land in a folder are taken in micro-batches, each committed once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.storage import Store
from tidemark.sources import shared
from tidemark.sources.tables import EVENTS


def landed(spark: SparkSession, folder: str, schema: S.StructType = EVENTS, kind: str = "json", per_batch: int = 1000) -> DataFrame:
    """Rows of files as they land; lines that can't be read become nulls and fail validation later instead of the stream."""
    loose = S.StructType([S.StructField(f.name, f.dataType, True) for f in schema])
    reader = spark.readStream.schema(loose).option("maxFilesPerTrigger", per_batch)
    return (reader.option("mode", "PERMISSIVE").json(folder)) if kind == "json" else reader.format(kind).load(folder)


def append(rows: DataFrame, folder: str) -> str:
    """Put rows where a stream picks them up: they are written beside the landing folder and moved in file by file, each whole. A crash
    leaves the files that were not moved among the drafts, for `land`. Returns the name that the files begin with."""
    name = f"append-{uuid.uuid4().hex}"
    rows.write.json(f"{folder.rstrip('/')}.drafts/{name}")
    land(rows.sparkSession, folder)
    return name


def land(spark: SparkSession, folder: str) -> int:
    """Move files of finished drafts into the landing folder; the number of them. Moving a file twice is impossible, so any process may call it."""
    drafts, path, moved = f"{folder.rstrip('/')}.drafts", spark._jvm.org.apache.hadoop.fs.Path, 0
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for name in shared.names(spark, drafts):
        inside = shared.names(spark, f"{drafts}/{name}")
        if "_SUCCESS" in inside:
            moved += sum(bool(fs.rename(path(f"{drafts}/{name}/{n}"), path(f"{folder}/{name}-{n}"))) for n in inside if n.startswith("part-"))
            shared.remove(spark, f"{drafts}/{name}")
    return moved


def drain(query: StreamingQuery) -> None:
    """Wait until everything that has landed so far is committed."""
    if query.isActive:
        query.processAllAvailable()
    if failed := query.exception():
        raise failed


def into_store(rows: DataFrame, store: Store, name: str, checkpoint: str, every: str | None = None, on_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Write each micro-batch to the store under the batch name `<name>-<number>`: one that is replayed after a crash adds nothing again.
    `every`: a trigger like `1 second`; without it, all that has landed is taken and the query ends."""

    def take(batch: DataFrame, number: int) -> None:
        store.ingest(batch, f"{name}-{number}")
        if on_commit:
            on_commit(number)

    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed(rows: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events for each window and type; rows later than the watermark allows are left out."""
    times = rows.withColumn("at", F.timestamp_micros("event_time")).withWatermark("at", late)
    return times.groupBy(F.window("at", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "event_type", "n")


def into_table(rows: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """The result of an aggregating stream over all that has landed, whole after each micro-batch; a replayed batch writes its result again."""
    last: list[str] = []

    def take(batch: DataFrame, number: int) -> None:
        last[:] = [f"{folder}/result-{number}"]
        batch.write.mode("overwrite").parquet(last[0])

    rows.writeStream.outputMode("complete").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(*last) if last else rows.sparkSession.createDataFrame([], rows.schema)
