"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ORDER bytes holds how often each byte followed; the statistics are frozen after
the fit. A byte's code length starts at the longest context: with n occurrences and q different followers, a follower seen c
times has probability c / (n + q), any other one escapes with q / (n + q) to the context that is one byte shorter; unknown
contexts cost nothing, and below the empty context all 256 bytes are equally likely (escape method C, without exclusions).
A text's code length is the exact sum over all its bytes; the language with the shortest one is predicted, ties going to the
name that sorts first, and the score is that language's posterior under equal priors.

The trees of all languages share one table for each order: sorted (context, byte) codes with a code length for each language,
so a block of text is scored by a few gathers. They are fitted on at most SAMPLE documents of a language, those of at most
SAMPLE_BYTES bytes first and then by a hash of the id: a bound on the model's size and on what comes to the driver. If all languages
have more than SAMPLE * MAX_LANGUAGES such documents, the fit raises an error and leaves none out.

Null texts and texts without a letter are `und` with score 0, and so is everything if nothing could be learned; rows with
a null id are scored, never learned from, and not held out. Every row gives one row, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as T

ORDER = 4
SAMPLE, SAMPLE_BYTES = 200, 1 << 15
MAX_LANGUAGES = 256


def codes(block: T.Block, order: int = ORDER) -> np.ndarray:
    """For each byte, the bytes from `order` places before it up to itself as a number; zero bytes stand before a document."""
    data = block.data.astype(np.uint64)
    out = data.copy()
    for k in range(1, order + 1):
        out[k:] |= data[:-k] << np.uint64(8 * k)
    begin, size = block.offsets[:-1], np.diff(block.offsets)
    for t in range(order):
        out[begin[size > t] + t] &= np.uint64((1 << 8 * (t + 1)) - 1)
    return out


class Trees:
    """Frozen statistics. grams[d], bits[d]: sorted codes of d + 1 bytes, and their code lengths by language, started at
    order d. contexts[d], escapes[d]: sorted contexts of d bytes and what an escape costs in them by language."""

    def __init__(self, names: list[str], samples: list[list[bytes]], order: int = ORDER) -> None:
        self.names, self.order = names, order
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for texts in samples:
            sizes = np.array([0, *map(len, texts)], np.int64)
            block = T.Block(0, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes))
            full = codes(block, order)
            counts.append([np.unique(full & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(order + 1)])
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        for d in range(order + 1):
            grams = np.unique(np.concatenate([c[d][0] for c in counts])) if counts else np.zeros(0, np.uint64)
            contexts = np.unique(grams >> np.uint64(8))
            bits = np.full((len(grams), len(names)), np.nan)
            escapes = np.zeros((len(contexts), len(names)))
            for k, c in enumerate(counts):
                own, times = c[d]
                at = np.searchsorted(contexts, own >> np.uint64(8))
                total = np.bincount(at, times, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                bits[np.searchsorted(grams, own), k] = np.log2((total + kinds)[at] / times)
                seen = kinds > 0
                escapes[seen, k] = np.log2((total + kinds)[seen] / kinds[seen])
            lower = self._lower(grams, d, len(names))
            up = escapes[np.searchsorted(contexts, grams >> np.uint64(8))] + lower
            bits = np.where(np.isnan(bits), up, bits)
            self.grams.append(grams), self.bits.append(bits.astype(np.float32)), self.contexts.append(contexts), self.escapes.append(escapes.astype(np.float32))
        self._slots: tuple | None = None

    def _lower(self, grams: np.ndarray, d: int, n: int) -> np.ndarray:
        return self.cost(grams & np.uint64((1 << 8 * d) - 1), d - 1) if d else np.full((len(grams), n), 8.0)

    def cost(self, grams: np.ndarray, d: int) -> np.ndarray:
        """Code lengths of the codes' last byte by language, from order d on."""
        out = np.zeros((len(grams), len(self.names)))
        left = np.arange(len(grams))
        while len(left):
            if d < 0:
                out[left] += 8.0
                break
            code = grams[left] & np.uint64((1 << 8 * (d + 1)) - 1)
            at = np.minimum(np.searchsorted(self.grams[d], code), len(self.grams[d]) - 1)
            hit = self.grams[d][at] == code
            out[left[hit]] += self.bits[d][at[hit]]
            left, code = left[~hit], code[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[d], code), len(self.contexts[d]) - 1)
            hit = self.contexts[d][at] == code
            out[left[hit]] += self.escapes[d][at[hit]]
            d -= 1
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slots": None}

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._slots[0])).astype(np.int64)

    def block_bits(self, block: T.Block) -> np.ndarray:
        """(documents, languages) code lengths of whole texts. The longest order's table is met through slots by hash; where
        two codes share a slot, and for codes that were never seen, the sorted tables answer."""
        n = len(self.names)
        out = np.zeros((len(block), n))
        if not len(block.data) or not n:
            return out
        grams = self.grams[-1]
        if self._slots is None:
            width = max(10, int(len(grams)).bit_length() + 2)
            self._slots = (width, None, None)
            keys, where = np.full(1 << width, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << width, np.int32)
            s = self._slot(grams)
            keys[s], where[s] = grams, np.arange(len(grams))
            self._slots = (width, keys, where)
        code = codes(block, self.order)
        s = self._slot(code)
        hit = self._slots[1][s] == code
        bits = self.bits[-1][self._slots[2][s]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            odd, back = np.unique(code[miss], return_inverse=True)
            bits[miss] = self.cost(odd, self.order)[back]
        full = np.flatnonzero(np.diff(block.offsets) > 0)
        out[full] = np.add.reduceat(bits, block.offsets[full], axis=0, dtype=np.float64)
        return out


_LETTER = T.byte_class((0x41, 0x5A), (0x61, 0x7A))


def lettered(block: T.Block) -> np.ndarray:
    """Which documents hold a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[block.data], dtype=np.int64)])
    out = ascii_letters[block.offsets[1:]] > ascii_letters[block.offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in block.text(i).decode("utf-8", "replace"))
    return out


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(key.cast("string")) % modulus


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Trees from at most `sample` of the given labelled documents for each language; an error if they are more than sample * MAX_LANGUAGES."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy((F.octet_length("text") > sample_bytes), F.xxhash64("doc_id"), "doc_id")
    pick = rows.select("lang", "doc_id", F.row_number().over(order).alias("n")).where(F.col("n") <= sample).select("lang", "doc_id")
    taken = pick.limit(sample * MAX_LANGUAGES + 1).collect()
    if len(taken) > sample * MAX_LANGUAGES:
        raise ValueError(f"the languages have more than {sample * MAX_LANGUAGES} documents to learn from, {sample} each at most; learn from fewer of each")
    known = docs.sparkSession.createDataFrame(taken, pick.schema)
    texts = rows.join(F.broadcast(known), ["lang", "doc_id"], "left_semi").select("lang", "doc_id", "text")
    by: dict[str, list[bytes]] = {}
    for row in sorted(texts.collect(), key=lambda r: (r.lang, r.doc_id, r.text)):
        by.setdefault(row.lang, []).append(row.text.encode())
    names = sorted(by)
    return Trees(names, [by[k] for k in names])


def predict(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for each row."""
    model = T.Sent(docs.sparkSession, trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
        trees = model.value
        names = np.array([*trees.names, "und"], object)
        for keys, block in T.read(batches):
            bits = trees.block_bits(block)
            if trees.names:
                best = bits.argmin(1)
                least = bits[np.arange(len(block)), best]
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                best[~lettered(block)] = -1
                score[best < 0] = 0
            else:
                best, score, least = np.full(len(block), -1), np.zeros(len(block)), np.zeros(len(block))
            yield T.batch(schema, doc_id=keys, lang_pred=names[best].tolist(), score=score, bits_per_byte=least / np.maximum(1, np.diff(block.offsets)))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(T.lean(run), "doc_id long, lang_pred string, score double, bits_per_byte double")
