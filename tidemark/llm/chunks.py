"""Chunks of documents: what a chunk asks for is gathered, answered by joins with sharded tables, and meets its texts again in one task.

A chunk is the rows of one split of a file, so of spark.sql.files.maxPartitionBytes at most; what is moved grows with the texts and not
with an answer table times the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T

#: Bytes of text that are packed at a time.
PACK = 4 << 20
ROWS = "chunk long, kind int, data binary"


def parts_of(docs: DataFrame) -> int:
    return max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """doc_id, text, the chunk that the row belongs to, and more columns as text. The chunk is told by the split of a file that the row is read
    from, which is the same whenever it is read; rows that come from no file are dealt by their ids and texts."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).cast("string").alias(c) for c in more), F.input_file_name().alias("_file"), F.expr("input_file_block_start()").alias("_block"))
    chunk = F.when(F.col("_file") == "", F.xxhash64(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts_of(docs))))).otherwise(F.xxhash64("_file", "_block"))
    return rows.withColumn("chunk", chunk).select("doc_id", "text", "chunk", *more)


def shares(batch: pa.RecordBatch, at: int = 2) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows) of a batch."""
    chunks = batch.column(at).to_numpy()
    if len(batch) and (chunks == chunks[0]).all():
        yield int(chunks[0]), batch
        return
    for chunk in np.unique(chunks).tolist():
        yield chunk, batch.filter(pa.array(chunks == chunk))


def packed(docs: DataFrame) -> DataFrame:
    """(chunk, kind 1, data): the rows of a task's share of a chunk, compressed, PACK bytes of text at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for chunk, part in shares(b):
                for block in T.blocks(part.column(1), PACK):
                    rows = part.slice(block.row, len(block))
                    with pa.BufferOutputStream() as out:
                        with pa.ipc.new_stream(out, rows.schema) as writer:
                            writer.write_batch(rows)
                        data = squeeze.compress(out.getvalue())
                    yield T.batch(schema, chunk=[chunk], kind=[1], data=[data])

    return docs.mapInArrow(T.lean(run), ROWS)


def replies(answers: DataFrame, pack: Callable[[pa.RecordBatch], bytes]) -> DataFrame:
    """(chunk, kind 0, data): answers(chunk, ...) of a batch, packed for each chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
        for b in batches:
            out = [(chunk, pack(part)) for chunk, part in shares(b, 0)] if len(b) else []
            yield T.batch(schema, chunk=[k for k, _ in out], kind=[0] * len(out), data=[d for _, d in out])

    return answers.mapInArrow(T.lean(run), ROWS)


def meet(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Each chunk's answers, then its texts, in one task."""
    return answers.unionByName(packed(docs)).repartition(parts_of(docs), "chunk").sortWithinPartitions("chunk", "kind")


def met(batches: Iterable[pa.RecordBatch], load: Callable[[list[bytes]], object]) -> Iterator[tuple[object, pa.RecordBatch]]:
    """(what `load` makes of the chunk's answers, rows) of what `meet` gives."""
    loose = zstandard.ZstdDecompressor()
    now, waiting, table = None, [], None
    for b in batches:
        for k in range(len(b)):
            chunk, kind, data = (b.column(c)[k].as_py() for c in range(3))
            if chunk != now:
                now, waiting, table = chunk, [], None
            if kind == 0:
                waiting.append(data)
                continue
            if table is None:
                table, waiting = load(waiting), []
            for rows in pa.ipc.open_stream(loose.decompressobj().decompress(data)):
                yield table, rows
