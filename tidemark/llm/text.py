"""Vectorised views of text in Arrow batches: blocks of whole documents, words, their hashes, n-grams.

All classes of bytes used here are unions of ASCII characters and of all non-ASCII bytes, so UTF-8 can be cut into words
byte by byte. Memory is bounded by BLOCK bytes of text, or by one document if that is longer.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession

BLOCK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the bytes in the spans, ends included."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Bytes of words between white space, and of words of digits, lower-case letters and non-ASCII characters.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out = np.full(max(n, 1), base & 0xFFFFFFFFFFFFFFFF, U)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U)


@dataclass
class Block:
    """Whole documents: rows of a batch from `row` on, their bytes, and where each one begins and the last ends."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """A string column in blocks of at most `limit` bytes; a longer document is a block of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Block(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a block in order: begin, end (byte offsets), hash; `first[i]` is the number of words before document i."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(block: Block, member: np.ndarray, fold: bool = False) -> Words:
    """Words of the block: maximal runs of member bytes inside a document; `fold` lower-cases A-Z first."""
    data = LOWER[block.data] if fold else block.data
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts - 1] & inside[cuts]]  # a document ends inside a run: one end and one begin there
    at = np.flatnonzero(edge)
    begin, end = at[0::2], at[1::2]
    if len(cuts):
        cuts = np.unique(cuts)
        begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
    first = np.searchsorted(begin, block.offsets)
    if not len(begin):
        return Words(begin, end, np.zeros(0, U), first)
    size = end - begin
    start = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(start, size)
    value = (data[inside].astype(U) + U(1)) * powers(_BASE, int(size.max()))[place]
    return Words(begin, end, mix(np.add.reduceat(value, start) + size.astype(U)), first)


def ngrams(w: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start word) of each n consecutive words inside a document."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    count = total - n + 1
    power = powers(0xD6E8FEB86659FD93 + 2 * seed, n)
    out = np.zeros(count, U)
    for k in range(n):
        out += w.hash[k : k + count] * power[k]
    stop = np.repeat(w.first[1:], np.diff(w.first))[:count]
    start = np.flatnonzero(np.arange(count) + n <= stop)
    return mix(out[start] ^ U(seed)), start


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as the signed ones that Spark holds."""
    return x.view(np.int64)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order and types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def read(batches: Iterable[pa.RecordBatch], key: str = "doc_id", text: str = "text") -> Iterator[tuple[pa.Array, Block]]:
    """Blocks of all batches, each with its keys."""
    for b in batches:
        keys = b.column(b.schema.get_field_index(key))
        for block in blocks(b.column(b.schema.get_field_index(text))):
            yield keys.slice(block.row, len(block)), block


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving what its task has freed back to the machine when it ends: Python workers outlive their tasks, and several wait beside
    those at work, each with all that its allocators have kept."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def changed(column: pa.Array, new: dict[int, str]) -> pa.Array:
    """The column with new texts in some rows; the others are not taken apart."""
    if not new:
        return column
    rows = sorted(new)
    mask = np.zeros(len(column), bool)
    mask[rows] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in rows], column.type))


class Sent:
    """An object broadcast with its classes, so that workers need no copy of this library; it is rebuilt once in each task."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.data, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"data": self.data, "held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = pickle.loads(self.data.value)
            if getattr(self.data, "_path", None):
                self.data.__dict__.pop("_value", None)  # the bytes lie in a file; a worker needs the object only
        return self.held
