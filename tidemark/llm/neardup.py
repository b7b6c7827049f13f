"""Near-duplicate documents by SetSketch.

Registers. A document's shingles are hashed by m linear hash functions; for each, the least hash becomes an exponential variate x
and the register floor(1 - log_B x), cut to 16 bits: exponentially spaced truncated minima. Registers of a union are the maxima.

Search. Documents with equal shingle sets are one class, shown by its smallest id. Each class puts bands of its registers into
buckets; two documents with a Jaccard index of the threshold share no bucket at most MISS times. Inside a bucket every two
classes are estimated jointly: the likelihood of the registers that are equal, larger and smaller, given both set sizes, is maximal
at some index, and pairs of at least a floor that one at the threshold falls below at most MISS times are verified on their full sets.
The number of registers, their rows in a band and the floor follow from the threshold (`search`).
A bucket that is too large for one tile is first compared with a middle member, its hub, and while more than a tile is still apart, with
one of those: rows in proportion to the bucket, which join a group of near copies of any size. What the hub's links have joined most of need not meet itself again; all others meet everyone in tiles
of bounded size. So a bucket of any size is compared whole, without meeting in one task. Pairs are never rows: a tile passes on its rows
that have a partner, gets their full sets, and gives links that join what was apart.

Links and components. Two classes are linked when 100 * intersection >= percent * union. Components are found by joins.

Words are runs without ASCII white space, A-Z lower-cased; shingles are W consecutive words, or all words of a shorter text. Texts that
are null, empty or blank have no shingles and link with nothing. Repeated rows of one id give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm import text as T

W, PERCENT = 5, 85
BASE = 1.001
#: How often a pair at the threshold may share no band, or be estimated below the floor; registers at least, and at most while bands can be shorter.
MISS, LEAST, MOST = 1e-5, 100, 128
TILE_ROWS, TILE_SHINGLES = 2048, 1 << 20
MAP_BITS = 23
#: Members that all others of a big bucket are compared with before what is still apart meets.
HUBS = 2


class Search(NamedTuple):
    """m registers in bands of `rows`; pairs of less than `equal` equal registers or estimated below `floor` are no candidates."""

    m: int
    rows: int
    equal: int
    floor: float


def search(percent: int) -> Search:
    """The longest bands of up to five registers that keep MISS with about MOST registers, and the cuts for that many."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not from 1 to 100")
    j = min(percent / 100, 1 - 1e-9)
    for rows in (5, 4, 3, 2, 1):
        m = rows * max(math.ceil(math.log(MISS) / math.log1p(-(j**rows))), -(-LEAST // rows))
        if m <= MOST:
            break

    def least(chance: float) -> int:
        """The most equal registers that a pair at the threshold falls short of at most `chance` times."""
        total = 0.0
        for k in range(m + 1):
            total += math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(j) + (m - k) * math.log1p(-j))
            if total > chance:
                return k
        return m

    return Search(m, rows, least(MISS / 1000), max(0.0, least(MISS) / m - 0.01))  # a step of the estimate's grid lower


M = search(PERCENT).m


def _constants(m: int) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of m hash functions."""
    k = np.arange(1, m + 1, dtype=T.U)
    return (T.mix(k * T.U(0x9E3779B97F4A7C15)) | T.U(1)).tolist(), T.mix(k * T.U(0xC2B2AE3D27D4EB4F)).tolist()


def _keys(regs: np.ndarray, s: Search) -> np.ndarray:
    """(documents, bands) buckets."""
    power = T.powers(0xD6E8FEB86659FD93, s.rows)
    key = ((regs.reshape(len(regs), -1, s.rows).astype(T.U) + T.U(1)) * power).sum(2, dtype=T.U)
    return T.signed(T.mix(key ^ T.mix(np.arange(s.m // s.rows, dtype=T.U) * T.U(0xA0761D6478BD642F))))


def shingles(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, each document's sorted, and where each document's begin."""
    w = T.words(block, T.NOT_SPACE, fold=True)
    count = np.diff(w.first)
    hashes, start = T.ngrams(w, W)
    doc = w.doc[start] if len(start) else start
    for n in range(1, W):  # shorter texts are one shingle
        for i in np.flatnonzero(count == n):
            whole = T.Words(w.begin[:0], w.end[:0], w.hash[w.first[i] : w.first[i + 1]], np.array([0, n]))
            hashes, doc = np.concatenate([hashes, T.ngrams(whole, n, seed=n)[0]]), np.concatenate([doc, [i]])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(block) + 1))


def registers(hashes: np.ndarray, first: np.ndarray, m: int = M) -> np.ndarray:
    """(documents, m) registers; zeros for empty sets."""
    out = np.zeros((len(first) - 1, m), np.uint16)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        least = np.empty((len(full), m))
        for k, (times, plus) in enumerate(zip(*_constants(m), strict=True)):
            least[:, k] = np.minimum.reduceat(hashes * T.U(times) + T.U(plus), first[full])
        x = -np.log1p(-np.clip((least + 1) * 2.0**-64, 1e-19, 1 - 1e-15))
        out[full] = np.clip(np.floor(1 - np.log(x / 20) / np.log(BASE)), 0, 65535).astype(np.uint16)
    return out


def jaccard(equal: np.ndarray, more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood index from the numbers of registers that are equal, larger in the first and larger in the second."""
    u, v = (n1 / (n1 + n2))[:, None], (n2 / (n1 + n2))[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * grid), p(v - u * grid)
    a, b, c = (np.log(np.maximum(x, 1e-9)) for x in (a, b, 1 - a - b))
    fit = more[:, None] * a + less[:, None] * b + equal[:, None] * c
    return grid[np.arange(len(fit)), fit.argmax(1)]


def sketches(docs: DataFrame, s: Search) -> DataFrame:
    """doc_id, n, the set's digest (h1, h2) and its registers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("registers", pa.binary())])
        for keys, block in T.read(batches):
            hashes, first = shingles(block)
            total = [np.concatenate([np.zeros(1, T.U), np.cumsum(x, dtype=T.U)]) for x in (hashes, T.mix(hashes ^ T.U(0x5BD1E995)))]
            h1, h2 = (T.signed(x[first[1:]] - x[first[:-1]]) for x in total)
            rows = registers(hashes, first, s.m)
            yield T.batch(schema, doc_id=keys, n=np.diff(first), h1=h1, h2=h2, registers=[r.tobytes() for r in rows])

    return docs.mapInArrow(T.lean(run), "doc_id long, n long, h1 long, h2 long, registers binary")


def bands(sketch: DataFrame, s: Search) -> DataFrame:
    """A row for each class and band: the bucket, the class and its size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
        for b in batches:
            if not len(b):
                continue
            for bucket in _keys(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(len(b), s.m), s).T:
                yield T.batch(schema, bucket=np.ascontiguousarray(bucket), doc_id=b.column(0), n=b.column(1))

    return sketch.select("doc_id", "n", "registers").mapInArrow(T.lean(run), "bucket long, doc_id long, n long")


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal values in the first `keys` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(len(b), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[i] for c in cols)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def candidates(bucket: int, i: int, j: int, t: pa.Table, s: Search) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a tile's pairs that may be linked and whose first shared band this is. Columns from the third on: salt, id, size, registers."""
    salt, ids, n = (t.column(k).to_numpy() for k in (3, 4, 5))
    regs = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(len(ids), s.m)
    right = np.flatnonzero(salt == j)
    right = right[np.argsort(n[right], kind="stable")]
    sizes = n[right]
    for x in np.flatnonzero(salt == i):
        near = right[np.searchsorted(sizes, n[x] * s.floor, "left") : np.searchsorted(sizes, n[x] / max(s.floor, 1e-9), "right")]
        near = near[ids[near] > ids[x]] if i == j else near
        equal = (regs[near] == regs[x]).sum(1)
        near, equal = near[equal >= s.equal], equal[equal >= s.equal]
        if len(near):
            more = (regs[x] > regs[near]).sum(1)
            good = near[jaccard(equal, more, s.m - equal - more, np.full(len(near), n[x], float), n[near].astype(float)) >= s.floor]
            same = (regs[good] == regs[x]).reshape(-1, s.m // s.rows, s.rows).all(2)
            good, band = good[same.any(1)], same[same.any(1)].argmax(1)
            good = good[_keys(regs[x : x + 1], s)[0][band] == bucket]
            if len(good):
                yield int(x), good


_TILE = "bucket long, i int, j int, salt int, doc_id long, n long, registers binary"


def active(tiles: DataFrame, s: Search) -> DataFrame:
    """The rows of tiles that have a partner there; tiles are sorted by bucket, i, j."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), t in groups(batches, 3):
            keep = np.zeros(len(t), bool)
            for x, others in candidates(bucket, i, j, t, s):
                keep[x] = True
                keep[others] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    return tiles.mapInArrow(T.lean(run), _TILE)


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its sorted shingle hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
        for keys, block in T.read(batches):
            hashes, first = shingles(block)
            yield T.batch(schema, doc_id=keys, shingles=[hashes[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)])

    return docs.mapInArrow(T.lean(run), "doc_id long, shingles binary")


def verified(tiles: DataFrame, percent: int, s: Search) -> DataFrame:
    """Links (a, b) of each tile that join what is not joined there yet; tiles hold the full sets besides. Pairs that are already
    joined need no link, so a tile gives fewer links than rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for (bucket, i, j), t in groups(batches, 3):
            ids = t.column(4).to_numpy()
            sets = [np.frombuffer(x, T.U) for x in t.column(7).to_pylist()]
            size = np.array([len(x) for x in sets])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            begin = np.cumsum(size) - size
            mark = np.zeros(int(flat.max()) + 1, bool)
            part = np.arange(len(ids))
            links = []
            for x, others in candidates(bucket, i, j, t, s):
                others = others[part[others] != part[x]]
                if not len(others):
                    continue
                own = flat[begin[x] : begin[x] + size[x]]
                mark[own] = True
                n = size[others]
                at = np.repeat(begin[others] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                both = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(n) - n)
                mark[own] = False
                for y in others[100 * both >= percent * (size[x] + n - both)].tolist():
                    if part[y] != part[x]:
                        part[part == part[y]] = part[x]
                        links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
            if links:
                yield T.batch(schema, a=[x[0] for x in links], b=[x[1] for x in links])

    return tiles.mapInArrow(T.lean(run), "a long, b long")


def thinned(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most of the rows whose id isn't wanted, by a bit map of 2 ** MAP_BITS bits, whatever the number of ids."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    words = wanted.select(spot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int)))").alias("m"))
    table = np.zeros(1 << (MAP_BITS - 5), np.int64)
    for r in words.collect():  # at most 2 ** (MAP_BITS - 5) rows
        table[r.w] = r.m
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(2).to_numpy()
            yield b.filter(pa.array((sent.value[s >> 5] >> (s & 31)) & 1 == 1))

    return docs.where("doc_id is not null").select("doc_id", "text", spot.alias("s")).mapInArrow(T.lean(run), "doc_id long, text string, s long").drop("s")


def star_tiles(large: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(bucket, i, j, salt, doc_id) from large(bucket, salts, doc_id, degree), the members of big buckets: in slices, each with the bucket's hub in
    front (i = salt = -1). The hub is the member that lies in most big buckets, so a middle one; once there are roots, of those outside
    the bucket's largest root. Members that are joined with the hub already are left out."""
    rows = large.withColumn("root", F.col("doc_id")) if roots is None else large.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    each = rows.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.max(F.struct("degree", (-F.col("doc_id")).alias("less"))).alias("best"))
    if roots is None:
        hubs = each.groupBy("bucket").agg(F.max(F.struct("best.degree", "best.less", "root")).alias("h"))
    else:
        top = each.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("top")).select("bucket", F.col("top.root").alias("largest"))
        hubs = each.join(top, "bucket").where("root <> largest").groupBy("bucket").agg(F.max(F.struct("best.degree", "best.less", "root")).alias("h"))
    hubs = hubs.select("bucket", (-F.col("h.less")).alias("hub"), F.col("h.root").alias("own"))
    rows = rows.join(hubs, "bucket")
    slices = rows.where("root <> own" if roots is not None else "doc_id <> hub").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts").cast("long")).cast("int"))
    first = rows.where("doc_id = hub").select("bucket", "doc_id", F.lit(-1).alias("salt"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("j"))
    return slices.select("bucket", F.lit(-1).alias("i"), F.col("salt").alias("j"), "salt", "doc_id").unionByName(first.select("bucket", F.lit(-1).alias("i"), "j", "salt", "doc_id"))


def grid_tiles(members: DataFrame, sizes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(bucket, i, j, salt, doc_id): each bucket's members in tiles in which all meet that aren't known to be joined.

    A bucket is dealt in salts by its size, and each two salts meet. roots(doc_id, root): what the hubs have joined; the members of a big
    bucket that lie in its largest root need not meet each other, so they are salted apart and meet the salts of the rest only."""
    rows = members.select("bucket", "doc_id", "n").join(sizes.select("bucket", "salts"), "bucket")
    if roots is None:
        rows = rows.withColumn("most", F.lit(0)).withColumn("rest", F.col("salts")).withColumn("major", F.lit(False))
    else:
        big = rows.where("salts > 1").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        each = big.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        whole = each.groupBy("bucket").agg(F.max(F.struct("c", "root", "s")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        cut = lambda c, s: F.greatest(F.ceil(c / TILE_ROWS), F.ceil(s / TILE_SHINGLES)).cast("int")
        plan = whole.select("bucket", F.col("top.root").alias("largest"), cut(F.col("top.c"), F.col("top.s")).alias("most"), cut(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("rest"))
        plan = plan.where("rest > 0")  # else all are joined
        big = big.join(plan, "bucket").withColumn("major", F.col("root") == F.col("largest"))
        small = rows.where("salts = 1").select("bucket", "doc_id", F.lit(0).alias("most"), F.lit(1).alias("rest"), F.lit(False).alias("major"))
        rows = small.unionByName(big.select(small.columns))
    own = F.xxhash64("doc_id")
    salt = F.when(F.col("major"), F.col("rest") + F.pmod(own, F.greatest("most", F.lit(1)).cast("long"))).otherwise(F.pmod(own, F.col("rest").cast("long"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("major"), F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1)
    rows = rows.withColumn("salt", salt).withColumn("other", F.explode(others))
    return rows.select("bucket", F.least("salt", "other").cast("int").alias("i"), F.greatest("salt", "other").cast("int").alias("j"), "salt", "doc_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept, for every row of docs."""
    s = search(percent)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sketch = store.written(sketches(docs, s), "sketches")
    classes = sketch.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "registers")).alias("r"))
    classes = store.written(classes.select("h1", "h2", "n", "r.doc_id", "r.registers"), "classes")

    members = store.written(bands(classes, s), "bands")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("c"), F.sum("n").alias("s")).where("c > 1")
    sizes = store.written(sizes.withColumn("salts", F.greatest(F.ceil(F.col("c") / TILE_ROWS), F.ceil(F.col("s") / TILE_SHINGLES)).cast("int")), "sizes")

    def linked(tiles: DataFrame) -> DataFrame:
        """Verified links of the tiles: their rows get registers, those with a partner their full sets."""
        place = ["bucket", "i", "j"]
        rows = tiles.join(classes.select("doc_id", "n", "registers"), "doc_id").select(*place, "salt", "doc_id", "n", "registers")
        rows = store.written(active(rows.repartition(parts, *place).sortWithinPartitions(*place, "doc_id"), s), "tiles")
        wanted = rows.select("doc_id").distinct()
        sets = full_sets(thinned(docs, wanted)).join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("shingles").alias("shingles"))
        full = rows.join(sets, "doc_id").select(*place, "salt", "doc_id", "n", "registers", "shingles")
        return store.written(verified(full.repartition(parts, *place).sortWithinPartitions(*place, "doc_id"), percent, s), "links")

    big = sizes.where("salts > 1")
    roots = links = None
    if not big.isEmpty():
        large = members.select("bucket", "doc_id").join(big.select("bucket", "salts"), "bucket")
        large = store.written(large.join(large.groupBy("doc_id").agg(F.count("*").alias("degree")), "doc_id"), "large")
        for _ in range(HUBS):
            if roots is not None:  # only buckets in which more than a tile is still apart from the largest root
                each = large.join(roots, "doc_id", "left").groupBy("bucket", F.coalesce("root", "doc_id").alias("root")).agg(F.count("*").alias("c"))
                apart = each.groupBy("bucket").agg((F.sum("c") - F.max("c")).alias("rest")).where(F.col("rest") > TILE_ROWS)
                large = large.join(apart.select("bucket"), "bucket", "left_semi")
                if large.isEmpty():
                    break
            found = linked(star_tiles(large, roots))
            links = found if links is None else links.unionByName(found)
            roots = store.written(store.components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("root")), "roots")
    more = linked(grid_tiles(members, sizes, roots))
    links = more if links is None else links.unionByName(more)

    joined = store.components(links).withColumnRenamed("node", "rep")
    owners = classes.select("h1", "h2", "n", F.col("doc_id").alias("rep")).join(joined, "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n", "h1", "h2").join(owners, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
