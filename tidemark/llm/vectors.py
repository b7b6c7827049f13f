"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets BITS signs of random projections, joined to one key, and vectors are ordered by label, dimension, pass and
key, dealt over tasks by ranges of that order. A window is a run of neighbours that share the first `width` signs. `width` grows with the
logarithm of the largest label, so that unlike vectors rarely meet; the number of passes follows from it so that a pair at the threshold
misses every pass with a chance below MISS. A window holds at most TILE neighbours; a denser run is cut in tiles, each two of which meet,
so that it is compared whole without meeting in one task.

Only keys are moved in the passes. The signs of the first passes are a sketch: a pair whose sketches differ in more signs than a pair at
the threshold does but once in 10 million times is no candidate, nor is one that met in one of those passes before. Vectors are fetched
once, for those that have a candidate, and compared in double precision; the links found in any pass are united.

A pair counts in the first pass whose window holds it, so link counts add up over windows, and no list of pairs is made: a window
gives each vector's number of new links and one edge towards the least vector that it reaches there. Equal vectors of a label, told by
a digest of 128 bits, are one class with a multiplicity.

Only vectors of one label and dimension are compared. Null ids, null labels, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing. Rows of one id, label and vector count as one vector; an id that comes with several vectors is one node;
every row gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm import text as T
from tidemark.llm.neardup import groups

COSINE = 0.98
BITS, MISS, FILL = 60, 1e-5, 64
#: Passes whose signs are the sketch, and how seldom a pair at the threshold is told apart by it.
SKETCH, STRAY = 3, 1e-7
TILE = 1024


def passes_needed(largest: int, cosine: float = COSINE) -> tuple[int, int]:
    """(width, passes) for a largest label of so many vectors."""
    width = min(40, max(4, math.ceil(math.log2(max(largest, 2) / FILL))))
    meet = (1 - math.acos(cosine) / math.pi) ** width
    return width, max(SKETCH, math.ceil(math.log(MISS) / math.log(1 - meet)))


def apart(cosine: float = COSINE) -> int:
    """The most signs of a sketch in which a candidate may differ."""
    n, p = SKETCH * BITS, math.acos(cosine) / math.pi
    rest = 1.0
    for k in range(n + 1):
        rest -= math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if rest < STRAY:
            return k
    return n


def unit(x: list | None) -> np.ndarray | None:
    """The vector in double precision; None if it can link with nothing. One that is too large or small to square is scaled."""
    v = np.array([math.nan if c is None else c for c in x or ()], np.float64)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    if not 0 < float(v @ v) < math.inf:
        v = v / np.abs(v).max()
    return v + 0.0


def keyed(vectors: DataFrame, key: str, label: str, embedding: str, passes: int) -> DataFrame:
    """vec_id, label, dimension, the vector's bytes (doubles; null where it can link with nothing) and its key in each pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vec", pa.binary()), ("keys", pa.list_(pa.int64()))])
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for whole in batches:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                vec = [unit(x) if known else None for x, known in zip(b.column(2).to_pylist(), b.column(1).is_valid().to_pylist(), strict=True)]
                dims = np.array([0 if v is None else len(v) for v in vec], np.int32)
                keys: list[np.ndarray | None] = [None] * len(vec)
                for dim in np.unique(dims[dims > 0]).tolist():
                    if dim not in planes:
                        planes = {dim: np.random.default_rng(17).standard_normal((passes, dim, BITS))}
                    own = np.flatnonzero(dims == dim)
                    x = np.stack([vec[i] for i in own])
                    for i, k in zip(own, np.stack([((x @ p) > 0) @ weights for p in planes[dim]], 1), strict=True):
                        keys[i] = k
                yield T.batch(schema, vec_id=b.column(0), label=b.column(1), dim=dims, vec=[None if v is None else v.tobytes() for v in vec], keys=keys)

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.mapInArrow(T.lean(run), "vec_id long, label string, dim int, vec binary, keys array<long>")


#: A tile's columns: those that tell it, then its rows'.
_TILE = "label string, dim int, pass int, window long, i int, j int, salt int, digest binary"


def active(tiles: DataFrame, width: int, cosine: float) -> DataFrame:
    """The rows of tiles that have a candidate there; tiles are sorted by label, dim, pass, window, i, j, and hold the sketch."""
    most = apart(cosine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, step, _, i, j), t in groups(batches, 6):
            n = len(t)
            if n < 2:
                continue
            t = t.combine_chunks()
            salt = t.column(6).to_numpy()
            sketch = np.stack([t.column(9 + k).to_numpy() for k in range(SKETCH)], 1)
            windows = sketch >> (BITS - width)
            keep = np.zeros(n, bool)
            for at in range(0, n, 128):
                here = slice(at, at + 128)
                near = np.bitwise_count(sketch[here, None, :] ^ sketch[None, :, :]).sum(2) <= most
                for k in range(min(step, SKETCH)):
                    near &= windows[here, None, k] != windows[None, :, k]
                if i != j:
                    near &= salt[here, None] != salt[None, :]
                rows = np.arange(at, min(n, at + 128))
                near[rows - at, rows] = False
                keep[here] |= near.any(1)
                keep |= near.any(0)
            if keep.any():
                yield from t.select(range(8)).filter(pa.array(keep)).combine_chunks().to_batches()

    return tiles.mapInArrow(T.lean(run), _TILE)


def compared(tiles: DataFrame, width: int, cosine: float) -> DataFrame:
    """label, digest, new links, the own id and the least id reached, from tiles sorted by label, dim, pass, window, i, j that hold id, m, keys
    and vectors besides."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.string()), ("digest", pa.binary()), ("links", pa.int64()), ("id", pa.int64()), ("least", pa.int64())])
        for (label, dim, step, _, i, j), t in groups(batches, 6):
            n = len(t)
            if n < 2:
                continue
            t = t.combine_chunks()
            salt, ids, m = (t.column(k).to_numpy() for k in (6, 8, 9))
            windows = np.array(t.column(10).to_pylist(), np.int64).reshape(n, -1) >> (BITS - width)
            x = np.frombuffer(b"".join(t.column(11).to_pylist()), np.float64).reshape(n, dim)
            x = x / np.sqrt((x * x).sum(1))[:, None]
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= salt[:, None] != salt[None, :]
            rows, cols = np.nonzero(linked)
            if not len(rows):
                continue
            new = ~(windows[rows, :step] == windows[cols, :step]).any(1) if step else np.ones(len(rows), bool)
            count = np.bincount(rows[new], m[cols[new]], n).astype(np.int64)
            least = ids.copy()
            while True:
                low = least.copy()
                np.minimum.at(low, rows, least[cols])
                if (low == least).all():
                    break
                least = low
            own = np.flatnonzero((count > 0) | (least != ids))
            if len(own):
                yield T.batch(schema, label=[label] * len(own), digest=t.column(7).combine_chunks().take(pa.array(own)), links=count[own], id=ids[own], least=least[own])

    return tiles.mapInArrow(T.lean(run), "label string, digest binary, links long, id long, least long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", label: str = "label", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    largest = vectors.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).count().agg(F.max("count")).first()[0] or 0
    width, passes = passes_needed(largest, cosine)
    rows = store.written(keyed(vectors, key, label, embedding, passes).withColumn("digest", F.unhex(F.md5("vec"))), "vectors")
    parts = max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    single = rows.where("vec is not null and vec_id is not null").groupBy("label", "dim", "digest", "vec_id").agg(F.min("keys").alias("keys"))
    classes = single.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.min("keys").alias("keys"))
    classes = store.written(classes, "classes")

    place = ["label", "dim", "pass", "window"]
    sketch = [F.get("keys", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)]
    every = classes.select("label", "dim", "digest", *sketch, F.posexplode("keys").alias("pass", "key"))
    window = F.shiftright("key", BITS - width)
    spot = F.xxhash64("label", "dim", "pass", window)
    large = every.groupBy(spot.alias("spot")).count().where(F.col("count") > TILE).select("spot", F.ceil(F.col("count") / TILE).cast("int").alias("salts"))
    found = every.withColumn("spot", spot).join(large, "spot", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    found = found.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts").cast("long")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    tiles = found.select("label", "dim", "pass", window.alias("window"), F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "digest", "key", *(f"s{k}" for k in range(SKETCH)))
    tiles = tiles.repartitionByRange(parts, *place, "i", "j").sortWithinPartitions(*place, "i", "j", "key", "digest")
    tiles = store.written(active(tiles, width, cosine), "tiles")

    wanted = tiles.select("label", "dim", "digest").distinct()
    fetched = rows.select("label", "dim", "digest", "vec").join(wanted, ["label", "dim", "digest"], "left_semi").groupBy("label", "dim", "digest").agg(F.min("vec").alias("vec"))
    fetched = classes.join(fetched, ["label", "dim", "digest"])
    full = tiles.join(fetched, ["label", "dim", "digest"]).select(*place, "i", "j", "salt", "digest", "id", "m", "keys", "vec")
    full = full.repartition(parts, *place, "i", "j").sortWithinPartitions(*place, "i", "j", "id", "digest")
    links = store.written(compared(full, width, cosine), "links")

    counts = links.groupBy("label", "digest").agg(F.sum("links").alias("links"))
    parent = store.components(links.select(F.col("id").alias("a"), F.col("least").alias("b")).where("a <> b")).withColumnRenamed("node", "id")
    named = classes.select("label", "digest", "id", "m").join(counts, ["label", "digest"], "left").join(parent, "id", "left")
    named = named.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    known = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(known, F.col("n_links")).alias("n_links"), F.when(known, F.col("component_id")).alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
