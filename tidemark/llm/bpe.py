"""Byte-level BPE with a given rank file: encoding folds ranked merges over distinct words, decoding concatenates byte pieces.

A text is cut by the vocabulary's pattern. A word that is a piece itself is that piece; any other word is folded: of all neighbouring parts
whose joined bytes have a rank, the pair with the lowest rank, the leftmost of equals, is merged, until none is left.

The fold is an aggregate of Spark's higher-order functions over the word's bytes. It runs once for each distinct word of all documents. A
task cuts its texts in words, numbers them and writes texts as numbers; the words that are no pieces are dealt in packets, one for each
chunk of texts and bucket of words, a bucket's distinct words are folded as arrays, and the ids meet the numbers again in one task for each
chunk, which puts them together. The rank map stands beside the words that are folded, as columns: a literal would be printed, logged and
kept by the driver with every plan. A chunk ends at CHUNK bytes of text or FLUSH words, so that its words fit a task; buckets are as many
as shuffle partitions. A word of over LONG bytes would cost the square of its length in the fold; it is folded where it is met, with a
heap, in n log n steps, to the same ids.

Null texts are empty and have no ids. Special tokens are never made. Every row gives one row. Decoding the ids of a text gives its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm import text as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of words that are folded by Spark; bytes of text and words that end a chunk; bytes of text whose numbers are packed at a time;
#: words that are folded in one row.
LONG, CHUNK, FLUSH, PACK, FOLD = 256, 64 << 20, 500_000, 4 << 20, 1 << 15


def ranks(data: str) -> dict[bytes, int]:
    """Pieces and their ranks from the lines of a rank file."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(str.split, data.splitlines()) if piece}


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The rank file, read on the driver and broadcast: its size is the vocabulary's, whatever the texts."""
    with open(path or public_tokenizers.path(VOCABULARY)) as f:
        return spark.sparkContext.broadcast(f.read())


class Codec:
    def __init__(self, data: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks(data)
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.words = regex.compile(pattern).findall

    def fold(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        whole = self.ranks.get(word)
        return self.fold_long(word) if whole is None else (whole,)

    def fold_long(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word that is no piece, with a heap of pairs and links between parts."""
        n, rank = len(word), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank(word[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := rank(word[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return tuple(self.ranks[word[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        words = self.words(text)
        known = {w: self.fold(w.encode()) for w in set(words)}
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of ids."""
        return b"".join(map(self.pieces.__getitem__, ids))


#: Bits of an id in a pair's name, and what stands for no rank.
ID_BITS, NONE = 20, (1 << 31) - 1
#: Multipliers of a pair's ids for its two places in the rank map.
PLACES = ((40503, 30103), (92821, 7919))


class RankMap(NamedTuple):
    """The ranks of joined pieces. Pieces a and b are named a << ID_BITS | b; their name stands in one of two places of `names` that the ids
    tell, and the rank of the joined piece in the same place of `ranks`; other places hold -1. single: ids of the 256 bytes. There are a
    power of two of places."""

    single: list[int]
    names: list[int]
    ranks: list[int]


def rank_map(known: dict[bytes, int]) -> RankMap:
    """Every way to cut a piece in two pieces. A pair takes its first place, and a pair that was there goes to its other one; when that
    doesn't end, the places are doubled."""
    pairs = [(known[piece[:k]], known[piece[k:]], rank) for piece, rank in known.items() for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    while True:
        held: dict[int, tuple[int, int, int]] = {}
        for pair in pairs:
            at = (pair[0] * PLACES[0][0] + pair[1] * PLACES[0][1]) & (size - 1)
            for _ in range(200):
                pair, held[at] = held.get(at), pair
                if pair is None:
                    break
                one, two = ((pair[0] * x + pair[1] * y) & (size - 1) for x, y in PLACES)
                at = two if at == one else one
            else:
                break
        else:
            break
        size *= 2
    return RankMap([known.get(bytes([k]), -1) for k in range(256)], [held[k][0] << ID_BITS | held[k][1] if k in held else -1 for k in range(size)], [held[k][2] if k in held else -1 for k in range(size)])


def literal(values: list[int]) -> Column:
    """An array literal: one string, whose split and cast are folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _let(value: Column, then) -> Column:
    """`then` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _folded(word: Column, names: Column, ranks_: Column, single: Column, size: int) -> Column:
    """Ids of a word by the arrays of a RankMap with `size` places."""
    none, empty = F.lit(NONE).cast("bigint"), F.array().cast("array<bigint>")

    def rank(a: Column, b: Column) -> Column:
        name = F.shiftleft(a, ID_BITS) + b
        one, two = ((a * x + b * y).bitwiseAND(size - 1).cast("int") for x, y in PLACES)
        return F.when(F.get(names, one) == name, F.get(ranks_, one)).when(F.get(names, two) == name, F.get(ranks_, two)).otherwise(none)

    def merge(state: Column, _: Column) -> Column:
        ids, pairs = state["ids"], state["pairs"]

        def join(low: Column) -> Column:
            def put(at: Column) -> Column:
                n = F.size(ids)
                left = F.when(at > 1, F.array(rank(F.get(ids, at - 2), low))).otherwise(empty)
                right = F.when(at < n - 1, F.array(rank(low, F.get(ids, at + 1)))).otherwise(empty)
                return F.struct(
                    F.concat(F.slice(ids, F.lit(1), at - 1), F.array(low), F.slice(ids, at + 2, n)).alias("ids"),
                    F.concat(F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(pairs, at + 2, n)).alias("pairs"),
                )

            return F.when(low == none, state).otherwise(_let(F.array_position(pairs, low).cast("int"), put))

        return _let(F.coalesce(F.array_min(pairs), none), join)

    def start(ids: Column) -> Column:
        n = F.size(ids)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.get(ids, i - 1), F.get(ids, i)))).otherwise(empty)
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.struct(ids.alias("ids"), pairs.alias("pairs")), merge, lambda s: s["ids"])

    return _let(F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.get(single, F.ascii(c))), start)


def folded(word: Column, ranks_: RankMap) -> Column:
    """Ids of a word (binary) that is no piece itself: an aggregate whose state is the ids of the word's parts, at first its bytes, and the ranks
    of neighbouring pairs; each step merges the pair with the lowest rank, whose rank is the new part's id, and ranks the two pairs that
    it makes with its neighbours. The rank map becomes a literal."""
    size = len(ranks_.names)
    return _let(literal(ranks_.names), lambda n: _let(literal(ranks_.ranks), lambda r: _let(literal(ranks_.single), lambda s: _folded(word, n, r, s, size)))).cast("array<int>")


def folded_all(words: Column, names: Column, ranks_: Column, single: Column, size: int) -> Column:
    """Ids of each word of an array, like `folded`, by a rank map of `size` places whose arrays are columns."""
    return _let(names, lambda n: _let(ranks_, lambda r: _let(single, lambda s: F.transform(words, lambda w: _folded(w, n, r, s, size))))).cast("array<array<int>>")


class Numbers(dict):
    """Words and their numbers, in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values from each begin on, one after the other."""
    return values[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 24 as their low, middle and high bytes, which pack better apart; larger ones as they are."""
    if len(numbers) and int(numbers.max()) >= 1 << 24:
        return b"4" + numbers.tobytes()
    return b"3" + np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    """The numbers of `planes`."""
    if data[:1] == b"4":
        return np.frombuffer(data, np.int32, offset=1)
    low, middle, high = np.frombuffer(data, np.uint8, offset=1).reshape(3, -1).astype(np.int32)
    return low | middle << 8 | high << 16


#: Numbers that take one byte, and pages of 256 numbers after them that take two.
ONE, PAGES = 160, 95


def paged(numbers: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Numbers of which small ones are frequent, in streams that pack well: each one's first byte (itself, or its page, or 255), the places in
    the pages, and the numbers beyond."""
    rest = numbers - np.int32(ONE)
    near, far = (rest >= 0) & (rest < PAGES << 8), rest >= PAGES << 8
    first = np.where(far, 255, np.where(near, ONE + (rest >> 8), numbers)).astype(np.uint8)
    return first.tobytes(), (rest[near] & 255).astype(np.uint8).tobytes(), planes(rest[far])


def unpaged(first: bytes, places: bytes, beyond: bytes) -> np.ndarray:
    """The numbers of `paged`."""
    out = np.frombuffer(first, np.uint8).astype(np.int32)
    near, far = (out >= ONE) & (out < 255), out == 255
    out[near] = ONE + ((out[near] - ONE) << 8 | np.frombuffer(places, np.uint8))
    out[far] = unplaned(beyond) + np.int32(ONE)
    return out


NUMBERED = "chunk long, kind int, bucket int, data binary"
ANSWERS, TEXTS, WORDS = range(3)


def packet(numbers: list[int], words: list[bytes]) -> bytes:
    """Words and their numbers, which rise, compressed."""
    gaps = np.diff(np.array(numbers, np.int32), prepend=np.int32(0))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((planes(gaps), planes(np.array(list(map(len, words)), np.int32)), b"".join(words)), protocol=5))


def words_of(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers and words of `packet`."""
    gaps, size, joined = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    ends = np.cumsum(unplaned(size), dtype=np.int64).tolist()
    return np.cumsum(unplaned(gaps), dtype=np.int32), [joined[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def numbered(docs: DataFrame, data: Broadcast, key: str, text: str, parts: int = 12) -> DataFrame:
    """TEXTS rows: ids of documents, their numbers of words, and the numbers of these; ANSWERS rows: ids of words that are pieces or too long;
    WORDS rows: a packet of other words for each of `parts` buckets. Frequent words of a chunk have small numbers, so its texts pack better.
    A chunk is a task's; a task that runs again gives all its rows again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
        codec, numbers, squeeze = Codec(data.value), Numbers(), zstandard.ZstdCompressor(level=3)
        chunk, total = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []

        def given() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            order = np.argsort(-np.bincount(np.concatenate([x for _, _, x in held]), minlength=len(words)), kind="stable")
            new = np.empty(len(order), np.int32)
            new[order] = np.arange(len(order), dtype=np.int32)
            for ids, many, own in held:
                packed = pickle.dumps((ids, many, paged(new[own])), protocol=5)
                yield T.batch(schema, chunk=[chunk], kind=[TEXTS], bucket=[None], data=[squeeze.compress(packed)])
            here: list[tuple[int, tuple[int, ...]]] = []
            rest: dict[int, tuple[list[int], list[bytes]]] = {}
            for n, k in enumerate(order.tolist()):
                raw = words[k].encode()
                if raw in codec.ranks or len(raw) > LONG:
                    here.append((n, codec.fold(raw)))
                else:
                    own, others = rest.setdefault(zlib.crc32(raw) % parts, ([], []))
                    own.append(n)
                    others.append(raw)
            yield T.batch(schema, chunk=[chunk], kind=[ANSWERS], bucket=[None], data=[answered([n for n, _ in here], [x for _, x in here])])
            if rest:
                yield T.batch(schema, chunk=[chunk] * len(rest), kind=[WORDS] * len(rest), bucket=list(rest), data=[packet(*x) for x in rest.values()])

        for b in batches:
            for block in T.blocks(b.column(1), PACK):
                found = [np.fromiter(map(numbers.__getitem__, codec.words(block.text(i).decode())), np.int32) for i in range(len(block))]
                ids = b.column(0).slice(block.row, len(block))
                held.append((ids.to_pylist(), np.array(list(map(len, found)), np.int32), np.concatenate(found)))
                total += len(block.data)
                if total >= CHUNK or len(numbers) >= FLUSH:
                    yield from given()
                    numbers, chunk, total, held = Numbers(), chunk + 1, 0, []
        if held:
            yield from given()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(T.lean(run), NUMBERED)


def answered(numbers: list[int] | np.ndarray, ids: list | None = None, size: np.ndarray | None = None, values: np.ndarray | None = None) -> bytes:
    """Numbers of words in order, how many ids each has, and the ids, compressed; ids as lists, or their sizes and values."""
    if ids is not None:
        size, values = np.array(list(map(len, ids)), np.int64), np.fromiter(chain.from_iterable(ids), np.int32)
    numbers, size = np.asarray(numbers, np.int32), np.asarray(size, np.int64)
    order = np.argsort(numbers, kind="stable")
    values = ragged(values, (np.cumsum(size) - size)[order], size[order]).astype(np.int32)
    gaps = np.diff(numbers[order], prepend=np.int32(0))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((planes(gaps), planes(size[order].astype(np.int32)), planes(values)), protocol=5))


def answers_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, sizes and ids of `answered`."""
    gaps, size, values = map(unplaned, pickle.loads(zstandard.ZstdDecompressor().decompress(data)))
    return np.cumsum(gaps, dtype=np.int64), size.astype(np.int64), values


def distinct(packets: DataFrame, ranks_: Broadcast) -> DataFrame:
    """From a bucket's packets, sorted by bucket: rows of its distinct words, each beside the rank map, then a row for each packet: its chunk,
    and its numbers and which of the words they stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()), ("words", pa.list_(pa.binary())), ("names", longs), ("ranks", longs), ("single", longs)])
        now, known, held = None, Numbers(), []

        def given() -> Iterator[pa.RecordBatch]:
            words = list(known)
            for k in range(0, len(words), FOLD):
                single, names, ranks = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in ranks_.value)
                yield T.batch(schema, bucket=[now], chunk=[None], data=[None], words=[words[k : k + FOLD]], names=names, ranks=ranks, single=single)
            if held:
                none = [None] * len(held)
                yield T.batch(schema, bucket=[now] * len(held), chunk=[k for k, _ in held], data=[d for _, d in held], words=none, names=none, ranks=none, single=none)

        for b in batches:
            for bucket, chunk, packed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now:
                    yield from given()
                    now, known, held = bucket, Numbers(), []
                numbers, words = words_of(packed)
                held.append((chunk, pickle.dumps((numbers, np.fromiter(map(known.__getitem__, words), np.int32, len(words))), protocol=5)))
        yield from given()

    return packets.mapInArrow(T.lean(run), "bucket int, chunk long, data binary, words array<binary>, names array<bigint>, ranks array<bigint>, single array<bigint>")


def chunks_of(docs: DataFrame, data: Broadcast, key: str, text: str) -> DataFrame:
    """(chunk, kind, data): each chunk's answers before its texts, in one task."""
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = store.written(numbered(docs, data, key, text, parts), "numbered")
    known = rank_map(ranks(data.value))
    size, sent = len(known.names), docs.sparkSession.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in known))
    packets = rows.where(F.col("kind") == WORDS).select("bucket", "chunk", "data").repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket")
    words = distinct(packets, sent)
    found = words.select("bucket", "chunk", "data", folded_all(F.col("words"), F.col("names"), F.col("ranks"), F.col("single"), size).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
        now, waiting, table = None, [], None
        for b in batches:
            for row in range(len(b)):
                bucket, chunk, packed = (b.column(c)[row].as_py() for c in range(3))
                if bucket != now:
                    now, waiting, table = bucket, [], None
                if packed is None:
                    own = b.column(3).slice(row, 1).flatten()
                    waiting.append((np.diff(own.offsets.to_numpy().astype(np.int64)), own.flatten().to_numpy()))
                    continue
                if table is None:
                    size, values = (np.concatenate(x) for x in zip(*waiting, strict=True))
                    table, waiting = (np.cumsum(size) - size, size, values), []
                numbers, which = pickle.loads(packed)
                begin, size, values = table
                yield T.batch(schema, chunk=[chunk], kind=[ANSWERS], data=[answered(numbers, size=size[which], values=ragged(values, begin[which], size[which]))])

    answers = found.mapInArrow(T.lean(run), "chunk long, kind int, data binary")
    known = rows.where(F.col("kind") != WORDS).select("chunk", "kind", "data")
    return answers.unionByName(known).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")


def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(documents, how many ids each has, the ids) from what `chunks_of` gives."""
    loose = zstandard.ZstdDecompressor()
    now, waiting, table = None, [], None
    for b in batches:
        for row in range(len(b)):
            chunk, kind, data = (b.column(c)[row].as_py() for c in range(3))
            if chunk != now:
                now, waiting, table = chunk, [], None
            if kind == ANSWERS:
                waiting.append(answers_of(data))
                continue
            if table is None:
                number, size, ids = (np.concatenate(x) for x in zip(*waiting, strict=True))
                begin, many = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
                begin[number], many[number] = np.cumsum(size) - size, size
                table, waiting = (begin, many, ids), []
            docs, words, numbers = pickle.loads(loose.decompress(data))
            numbers = unpaged(*numbers)
            begin, many, ids = table
            size = many[numbers]
            ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(words)]
            yield docs, np.diff(np.concatenate([[0], ends])), ragged(ids, begin[numbers], size)


def encoded(docs: DataFrame, data: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for keys, size, ids in tokens(batches):
            cuts = np.concatenate([[0], np.cumsum(size)])
            yield T.batch(schema, doc_id=keys, ids=[ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])

    return chunks_of(docs, data, key, text).mapInArrow(T.lean(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, data: Broadcast) -> DataFrame:
    """doc_id and text of each row of ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        codec = Codec(data.value)
        for b in batches:
            yield T.batch(schema, doc_id=b.column(0), text=[codec.decode(x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()])

    return rows.select("doc_id", "ids").mapInArrow(T.lean(run), "doc_id long, text string")


def digests(docs: DataFrame, data: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, number and digest of the ids, and digest of what they decode to. The ids stay in the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        codec = Codec(data.value)
        names = {i: str(i) for i in codec.pieces}
        for keys, size, ids in tokens(batches):
            told, back, at = [], [], 0
            for n in size.tolist():
                own = ids[at : at + n].tolist()
                at += n
                told.append(hashlib.sha256(",".join(map(names.__getitem__, own)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(own)).hexdigest())
            yield T.batch(schema, doc_id=keys, n_tokens=size, ids_sha256=told, decoded_sha256=back)

    return chunks_of(docs, data, key, text).mapInArrow(T.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
