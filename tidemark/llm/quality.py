"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of byte N-grams, cut at quantiles for each language.

Train. The model counts every N-gram of all trusted texts (labelled as of good quality). Orders below N use continuation counts; each
order has the three discounts that its counts of counts give; below one byte all 256 bytes are equally likely. Every table is a DataFrame,
sharded by its N-gram: contexts, discounted counts and the interpolated probabilities of one order after the other come by joins.

Score. Documents are dealt in chunks: the rows of one split of a file, so of spark.sql.files.maxPartitionBytes at most. A chunk's distinct N-grams are joined with the sharded tables, falling back
order by order where one was never seen, and the answers meet the chunk's texts, packed and compressed, in one task, which sums
them for each document. What is moved grows with the texts, not with the model times the number of tasks.

Threshold. For each language, the QUANTILE of the perplexities of its trusted documents, counted in steps of 1 / STEPS bits a byte so that
counts add up in any order, times SLACK; languages without any use that of all. A document is kept if its perplexity is no higher than that, raised by EVIDENCE / sqrt(bytes) bits for what a short text leaves open. Null and empty texts have no perplexity and are not kept.

Trusted ids thin out the texts before they are joined with the labels through a bit map of fixed size, which only saves work.
Null languages are one group. Repeated rows give repeated results, and an id labelled twice is trusted if one label says so. Without
any trusted text there is no model: perplexities are those of equally likely bytes, and everything with a text is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import chunks, store
from tidemark.llm import text as T
from tidemark.llm.langid import codes
from tidemark.llm.neardup import thinned
from tidemark.llm.substrings import pack, unpack

N = 5
QUANTILE, SLACK = 0.99, 1.1
#: Bits a byte, times the root of the bytes, that a short text may lie above the threshold by chance.
EVIDENCE = 4.0
#: Steps of a bit a byte in which perplexities are counted.
STEPS = 4096
#: Grams that a task holds before it sends them.
FLUSH = 2_000_000


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of several counts."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(gram, c): how often each N-gram occurs in the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("c", pa.int64())])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, block in T.read(batches):
            held.append(np.unique(codes(block, N - 1), return_counts=True))
            if len(held) >= 4:
                held = [merged(held)]
            if len(held) == 1 and len(held[0][0]) > 2_000_000:
                yield T.batch(schema, gram=T.signed(held[0][0]), c=held[0][1])
                held = []
        if held:
            keys, c = merged(held)
            yield T.batch(schema, gram=T.signed(keys), c=c)

    return docs.mapInArrow(T.lean(run), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def lower(column: str, n: int):
    """The last n bytes of an N-gram."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * n) - 1))


class Tables:
    """seen[k]: (gram, p) of order k; backoff[k]: (context, g) of contexts of k - 1 bytes: what is left for the order below."""

    def __init__(self, counts: DataFrame) -> None:
        self.seen: dict[int, DataFrame] = {}
        self.backoff: dict[int, DataFrame] = {}
        by = {N: store.written(counts, "counts")}
        for k in range(N - 1, 0, -1):  # continuation counts: how many bytes stand before
            by[k] = store.written(by[k + 1].groupBy(lower("gram", k).alias("gram")).agg(F.count("*").alias("c")), "counts")
        below: DataFrame | None = None
        for k in range(1, N + 1):
            n = [by[k].where(F.col("c") <= 4).groupBy("c").count().collect()]
            n = {r["c"]: r["count"] for r in n[0]}
            n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            d = [max(0.05, min(0.95 * i, i - (i + 1) * y * b / a)) if a and b else 0.5 * min(i, 2) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
            cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            rows = by[k].select("gram", F.shiftright("gram", 8).alias("context"), "c", cut.alias("d"))
            left = rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
            rows = rows.join(left, "context")
            own = (F.col("c") - F.col("d")) / F.col("total")
            if below is None:
                seen = rows.select("gram", (own + F.col("g") / 256).alias("p"))
            else:
                rows = rows.withColumn("suffix", lower("gram", k - 1))
                seen = rows.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix").select("gram", (own + F.col("g") * F.col("q")).alias("p"))
            self.seen[k] = below = store.written(seen, f"order{k}")
            self.backoff[k] = store.written(left.select("context", "g"), f"context{k}")

    def log2(self, grams: DataFrame) -> DataFrame:
        """(gram, bits) for distinct N-grams: the interpolated probability at the longest order that was seen, times what longer contexts left."""
        p, scale = F.lit(None).cast("double"), F.lit(1.0)
        rows = grams.select("gram")
        for k in range(N, 0, -1):
            mine = self.seen[k].select(F.col("gram").alias(f"gram{k}"), F.col("p").alias(f"p{k}"))
            rows = rows.withColumn(f"gram{k}", lower("gram", k)).join(mine, f"gram{k}", "left")
            left = self.backoff[k].select(F.col("context").alias(f"context{k}"), F.col("g").alias(f"g{k}"))
            rows = rows.withColumn(f"context{k}", F.shiftright(f"gram{k}", 8)).join(left, f"context{k}", "left")
            p = F.coalesce(p, F.col(f"p{k}") * scale)
            scale = scale * F.coalesce(F.col(f"g{k}"), F.lit(1.0))
        return rows.select("gram", (-F.log2(F.coalesce(p, scale / 256))).alias("bits"))


def distinct_grams(docs: DataFrame) -> DataFrame:
    """(chunk, gram), nearly distinct: each task gives each of a chunk's grams once, again only after FLUSH others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("gram", pa.int64())])
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, own in held.items():
                grams = np.unique(np.concatenate(own))
                for k in range(0, len(grams), 1 << 16):
                    part = grams[k : k + (1 << 16)]
                    yield T.batch(schema, chunk=np.full(len(part), chunk), gram=T.signed(part))
            held.clear()

        for b in batches:
            for chunk, part in chunks.shares(b):
                for block in T.blocks(part.column(1)):
                    own = held.setdefault(chunk, [])
                    own.append(np.unique(codes(block, N - 1)))
                    size += len(own[-1])
                    if len(own) >= 4:
                        size -= sum(map(len, own))
                        held[chunk] = [np.unique(np.concatenate(own))]
                        size += len(held[chunk][0])
                    if size >= FLUSH:
                        yield from flush()
                        size = 0
        yield from flush()

    return docs.mapInArrow(T.lean(run), "chunk long, gram long")


class Answers:
    """Bits of grams, looked up in their sorted order."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.bits = keys[order], bits[order]

    def get(self, grams: np.ndarray) -> np.ndarray:
        """Bits of grams that are all there, each distinct one looked up once."""
        grams, back = np.unique(grams, return_inverse=True)
        return self.bits[np.searchsorted(self.keys, grams)][back]


def summed(rows: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes and bits of every document, from chunks that have met their answers."""

    def load(data: list[bytes]) -> Answers:
        parts = [unpack(d, T.U, np.float32) for d in data]
        keys, bits = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, T.U), np.zeros(0, np.float32))
        return Answers(keys, bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("bits", pa.float64())])
        for table, batch in chunks.met(batches, load):
            for block in T.blocks(batch.column(1)):
                size = np.diff(block.offsets)
                total = np.zeros(len(block))
                if len(block.data):
                    full = np.flatnonzero(size)
                    total[full] = np.add.reduceat(table.get(codes(block, N - 1)), block.offsets[full], dtype=np.float64)
                yield T.batch(schema, doc_id=batch.column(0).slice(block.row, len(block)), lang=batch.column(3).slice(block.row, len(block)), n_bytes=size, bits=total)

    return rows.mapInArrow(T.lean(run), "doc_id long, lang string, n_bytes long, bits double")


def quantiles(rows: DataFrame, quantile: float) -> DataFrame:
    """(group, step): the least step that at least the quantile of a group's rows(group, step) don't exceed, told from counts by step, of
    which a group has at most 8 * STEPS."""
    counts = rows.groupBy("group", "step").count()
    order = Window.partitionBy("group").orderBy("step")
    seen = counts.select("group", "step", F.sum("count").over(order).alias("seen"), F.sum("count").over(Window.partitionBy("group")).alias("all"))
    return seen.where(F.col("seen") >= quantile * F.col("all")).groupBy("group").agg(F.min("step").alias("step"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and kept for every row of docs(doc_id, text, lang); trusted: ids of trusted documents."""
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    train = thinned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), trusted).join(trusted, "doc_id", "left_semi")
    tables = Tables(counted(train))

    rows = chunks.chunked(docs, "doc_id", "text", "lang")
    wanted = store.written(distinct_grams(rows), "wanted")
    answers = wanted.join(tables.log2(wanted.select("gram").distinct()), "gram").groupBy("chunk", "gram").agg(F.first("bits").alias("bits"))
    replies = chunks.replies(answers, lambda b: pack(b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.float32)))
    texts = chunks.meet(replies, rows)
    scored = summed(texts).withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))))
    scored = store.written(scored.select("doc_id", "lang", "n_bytes", "bits", "perplexity"), "scored")

    good = scored.join(trusted, "doc_id", "left_semi").where("perplexity is not null")
    step = F.ceil(F.col("bits") * STEPS / F.col("n_bytes")).alias("step")
    each = quantiles(good.select(F.coalesce("lang", F.lit("")).alias("group"), step), quantile)
    total = quantiles(good.select(F.lit("").alias("group"), step), quantile).select("step").first()
    out = scored.withColumn("group", F.coalesce("lang", F.lit(""))).join(F.broadcast(each), "group", "left")
    at = F.pow(F.lit(2.0), F.coalesce("step", F.lit(total[0] if total else None).cast("long")) / STEPS) * slack
    kept = F.coalesce(F.col("perplexity") <= F.coalesce(at, F.lit(256.0)) * F.pow(F.lit(2.0), EVIDENCE / F.sqrt("n_bytes")), F.lit(False))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", at.alias("threshold"), kept.alias("kept"))
