"""Benchmark decontamination with an FM-index per training shard.

Phrases. Each benchmark item is cut into windows of WINDOW words (all its words, if it has fewer), named by their places in one array of
word numbers; equal windows, told by 128 bits, are one. The benchmark is dealt in parts of about PART_BYTES of text, each broadcast by
itself and loaded one at a time: some 40 bytes in a worker and 200 on the driver for each word of a part. Its total size is checked: every
shard is searched for all parts, so beyond MOST_BYTES `load` refuses.

Shard. A task reads documents until a shard holds SHARD words that matter. Words are numbered by the benchmark's own vocabulary, all
others being a separator; stretches in which two neighbours never follow each other in the benchmark, or that are shorter than the
shortest window, can hold no occurrence and are left out. The FM-index is built over what remains: suffixes sorted by prefix doubling,
the Burrows-Wheeler transform in a wavelet tree whose bit vectors answer rank, and every SAMPLE-th text position's suffix sampled.

Search. All windows step backward together, one word and one rank in each level of the tree at a time; occurrences are located by walking
to the next sampled suffix. Occurrences give removal spans, which are merged for each document.

Words: A-Z lower-cased, runs of digits, lower-case letters and non-ASCII characters. Null and empty texts have no words; items without
words have no windows; rows of one item_id count as one item. An empty benchmark hits nothing. Every document gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T

WINDOW = 13
PART_BYTES, MOST_BYTES = 4 << 20, 1 << 30
SHARD, SAMPLE = 1 << 20, 8


class Wavelet:
    """A sequence of numbers below 2 ** levels: for each level, from the highest bit, its bits stably parted by the bits before."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        for k in reversed(range(levels)):
            bit = (values >> k) & 1
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(values) - int(count[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before each place."""
        begin, end = np.zeros_like(at), at
        for level, (count, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((value >> (self.levels - 1 - level)) & 1).astype(bool)
            b, e = count[begin], count[end]
            begin, end = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, end - e)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at the places."""
        out = np.zeros_like(at)
        for count, zeros in zip(self.ones, self.zeros, strict=True):
            one = count[at + 1] - count[at]
            out = out * 2 + one
            at = np.where(one == 1, zeros + count[at], at - count[at])
        return out


def suffixes(text: np.ndarray) -> np.ndarray:
    """Places of the text's suffixes in order; a suffix that ends sorts before its extensions. Only places in groups that still tie are
    sorted again, by the group of the suffix twice as far on."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    group = np.zeros(n + 1, np.int64)
    head = np.flatnonzero(np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]]))
    size = np.diff(np.concatenate([head, [n]]))
    group[order] = np.repeat(head, size) + 1  # 0 is the end
    tied = np.repeat(size > 1, size)
    step = 1
    while tied.any():
        slots = np.flatnonzero(tied)
        places = order[slots]
        first, second = group[places], group[np.minimum(places + step, n)]
        by = np.lexsort((second, first))
        places, first, second = places[by], first[by], second[by]
        order[slots] = places
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head = np.flatnonzero(new)
        size = np.diff(np.concatenate([head, [len(slots)]]))
        group[places] = np.repeat(slots[head], size) + 1
        tied[slots] = np.repeat(size > 1, size)
        step *= 2
    return order


class FMIndex:
    """Backward search over one shard of numbers from 0 to sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        order = suffixes(text)
        rows = np.concatenate([[len(text)], order])  # the empty suffix is row 0
        self.sentinel = int(np.flatnonzero(rows == 0)[0])  # its predecessor is the end mark, which no phrase holds
        last = np.where(rows > 0, text[np.maximum(rows - 1, 0)], 0)
        self.tree = Wavelet(last, max(1, int(sigma - 1).bit_length()))
        counts = np.bincount(text, minlength=sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:sigma] + 1
        self.sampled = rows % SAMPLE == 0
        self.index = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = rows[self.sampled]

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of value in the transform before each row; the end mark stands there as 0 and is taken off."""
        return self.tree.rank(value, at) - ((value == 0) & (at > self.sentinel))

    def ranges(self, words: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with each phrase, which is `sizes` of the words from `begin` on."""
        k = len(begin)
        low, high = np.zeros(k, np.int64), np.full(k, len(self.sampled), np.int64)
        live = np.arange(k)
        for step in range(int(sizes.max(initial=0))):
            live = live[(sizes[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = words[begin[live].astype(np.int64) + sizes[live] - 1 - step].astype(np.int64)
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of the rows: steps back to a sampled suffix."""
        out, walked = np.zeros(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.sampled[at]
            out[left[hit]] = self.places[self.index[at[hit]]] + walked
            left, at = left[~hit], at[~hit]
            if len(left):
                c = self.tree.access(at)
                at = self.before[c] + self.rank(c, at)
                walked += 1
        return out


class Phrases:
    """One part of the benchmark: its vocabulary, its pairs of neighbours, its distinct windows and the items that hold each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        names = sorted({item for item, _ in items})
        hashes, count = [np.zeros(0, T.U)], [np.zeros(0, np.int64)]
        for block in T.blocks(pa.array([t for _, t in items], pa.large_string())):
            w = T.words(block, T.ALNUM, fold=True)
            hashes.append(w.hash), count.append(np.diff(w.first))
        hashes, count = np.concatenate(hashes), np.concatenate(count)
        self.names = names
        self.vocabulary = np.unique(hashes)
        self.sigma = len(self.vocabulary) + 1
        self.words = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        del hashes
        stop = np.cumsum(count)
        size = np.minimum(count, window)
        each = np.where(count > 0, count - size + 1, 0)  # windows of each row
        row = np.repeat(np.arange(len(items)), each)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + (stop - count)[row]
        size = size[row]
        hash_ = [np.zeros(len(row), T.U) for _ in range(2)]
        for k in range(window):
            here = np.flatnonzero(size > k)
            word = self.words[begin[here] + k].astype(T.U)
            for seed, h in enumerate(hash_):
                h[here] = T.mix(h[here] * T.U(0x9E3779B97F4A7C15) + word + T.U(1 + 2 * seed))
        order = np.lexsort((hash_[1], hash_[0], size))
        new = np.ones(len(order), bool)
        new[1:] = (size[order][1:] != size[order][:-1]) | (hash_[0][order][1:] != hash_[0][order][:-1]) | (hash_[1][order][1:] != hash_[1][order][:-1])
        kept = order[new]
        self.begin, self.sizes = begin[kept].astype(np.int32), size[kept].astype(np.int32)
        number = {n: k for k, n in enumerate(names)}
        owner = np.array([number[item] for item, _ in items], np.int64)[row[order]] if len(row) else np.zeros(0, np.int64)
        held = np.unique((np.cumsum(new) - 1) * max(1, len(names)) + owner)
        self.owner = (held % max(1, len(names))).astype(np.int32)
        self.owned = np.searchsorted(held // max(1, len(names)), np.arange(len(kept) + 1)).astype(np.int32)
        inner = np.ones(max(0, len(self.words) - 1), bool)
        inner[stop[(stop > 0) & (stop < len(self.words))] - 1] = False  # a row ends between the two
        self.pairs = np.unique(self.words[:-1].astype(np.int64)[inner] * self.sigma + self.words[1:][inner])
        self.shortest = int(self.sizes.min()) if len(kept) else 0
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocabulary & T.U(0xFFFF)).astype(np.int64)] = True
        self.following = np.zeros(1 << 20, bool)
        self.following[T.mix(self.pairs.astype(T.U)) >> T.U(44)] = True

    def items(self, window: int) -> list[str]:
        """The items that hold a window."""
        return [self.names[k] for k in self.owner[self.owned[window] : self.owned[window + 1]].tolist()]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary, 0 for others."""
        out = np.zeros(len(hashes), np.int64)
        near = np.flatnonzero(self.sieve[(hashes & T.U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
        out[near] = np.where(self.vocabulary[at] == hashes[near], at + 1, 0)
        return out

    def stretches(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of stretches of words that can hold a window, never over a document's end."""
        n = len(ids)
        if not n or not self.shortest:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        joined = np.zeros(n + 1, bool)  # whether word i continues the stretch of word i - 1
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        pair = ids[both - 1] * self.sigma + ids[both]
        near = self.following[T.mix(pair.astype(T.U)) >> T.U(44)]
        both, pair = both[near], pair[near]
        if len(both):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[at] == pair]] = True
        joined[first[first < n]] = False
        begin = np.flatnonzero(known & ~joined[:n])
        end = np.flatnonzero(known & ~joined[1:]) + 1
        long = end - begin >= self.shortest
        return begin[long], end[long]


class Shard:
    """Stretches of several blocks as one text with separators, and where each place of it lies."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.parts, self.docs, self.words, self.size = phrases, [], [], [], 0

    def add(self, w: T.Words, doc: int) -> None:
        """Add a block's words; `doc` numbers its first document."""
        ids = self.phrases.ids(w.hash)
        docs = w.doc
        for b, e in zip(*self.phrases.stretches(ids, w.first), strict=True):
            zero = np.zeros(1, np.int64)
            self.parts.append(np.concatenate([ids[b:e], zero]))
            self.docs.append(np.full(e - b + 1, docs[b] + doc))
            self.words.append(np.concatenate([np.arange(b, e) - w.first[docs[b]], zero]))
            self.size += e - b + 1

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of each occurrence."""
        if not self.size:
            return (np.zeros(0, np.int64),) * 3
        docs, words = np.concatenate(self.docs), np.concatenate(self.words)
        index = FMIndex(np.concatenate(self.parts), self.phrases.sigma)
        low, high = index.ranges(self.phrases.words, self.phrases.begin, self.phrases.sizes)
        count = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(rows)
        return docs[at], words[at], window


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans, sorted and joined where they overlap or touch."""
    out: list[list[int]] = []
    for b, e in sorted(zip(begin.tolist(), end.tolist(), strict=True)):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def load(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> list[T.Sent]:
    """The benchmark's parts, broadcast one by one."""
    rows = benchmark.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MOST_BYTES:
        raise ValueError(f"the benchmark holds {total} bytes of text, more than {MOST_BYTES}")
    n = max(1, -(-total // part_bytes))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        phrases = Phrases(sorted((r.item, r.text) for r in part.collect()), window)
        if phrases.shortest:
            out.append(T.Sent(benchmark.sparkSession, phrases))
    return out


class Hits:
    """What one shard's documents gathered from all parts: spans of words and items."""

    def __init__(self, parts: list[T.Sent]) -> None:
        self.parts, self.blocks, self.n, self.kept = parts, [], 0, 0

    def add(self, w: T.Words) -> None:
        self.blocks.append((w, self.n))
        self.n += len(w.first) - 1
        self.kept += len(w.hash)

    def find(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for part in self.parts:
            phrases = part.value
            shard = Shard(phrases)
            for w, doc in self.blocks:
                shard.add(w, doc)
            docs, at, window = shard.occurrences()
            if len(self.parts) > 1:
                part.held = None  # one part at a time
            for d, a, k in zip(docs.tolist(), at.tolist(), window.tolist(), strict=True):
                spans.setdefault(d, []).append((a, a + int(phrases.sizes[k])))
                items.setdefault(d, set()).update(phrases.items(k))
        return {d: merged(*np.array(s).T) for d, s in spans.items()}, items


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, parts: list[T.Sent], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: how many of its words lie in a benchmark window, and whose."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
        none = hashlib.sha256(b"").hexdigest()
        shard, keys, counts = Hits(parts), [], []

        def rows() -> pa.RecordBatch:
            spans, items = shard.find()
            n = np.concatenate(counts)
            hit, number, digest = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [none] * len(n)
            for d, s in spans.items():
                hit[d] = sum(e - b for b, e in s)
                number[d], digest[d] = len(items[d]), hashlib.sha256(",".join(sorted(items[d])).encode()).hexdigest()
            return T.batch(schema, doc_id=pa.concat_arrays(keys), n_words=n, n_hit=hit, n_items=number, items_sha256=digest, contaminated=(hit > 0) & (20 * hit >= n))

        for k, block in T.read(batches):
            w = T.words(block, T.ALNUM, fold=True)
            shard.add(w), keys.append(k), counts.append(np.diff(w.first))
            if shard.kept >= SHARD:
                yield rows()
                shard, keys, counts = Hits(parts), [], []
        if keys:
            yield rows()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(T.lean(run), REPORT)


def cleaned(docs: DataFrame, parts: list[T.Sent], text: str = "text", drop: bool = True) -> DataFrame:
    """docs, all columns kept, without the merged spans from the first to the last byte of benchmark words; with `drop`, without
    the documents that count as contaminated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.schema.get_field_index(text)
            cut: dict[int, str] = {}
            out = np.zeros(len(batch), bool)
            for block in T.blocks(batch.column(c)):
                w = T.words(block, T.ALNUM, fold=True)
                shard = Hits(parts)
                shard.add(w)
                for d, spans in shard.find()[0].items():
                    first, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
                    if contaminated(sum(e - b for b, e in spans), n):
                        out[block.row + d] = True
                        if drop:
                            continue
                    raw, at, kept = block.text(d), 0, []
                    for b, e in spans:
                        kept.append(raw[at : w.begin[first + b] - block.offsets[d]])
                        at = int(w.end[first + e - 1] - block.offsets[d])
                    cut[block.row + d] = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            if cut:
                batch = batch.set_column(c, batch.schema.field(c), T.changed(batch.column(c), cut))
            yield batch.filter(pa.array(~out)) if drop and out.any() else batch

    return docs.mapInArrow(T.lean(run), docs.schema)
