"""Substring dedup: words of passages that an earlier document holds are removed, by suffix automata of reference shards.

A window is WINDOW consecutive words of a document; its words are removed if the same window starts in a document with a smaller id.

Survey. One pass gives every text's number of words, the digest of its words and a hash of 128 bits of their sequence, by which copies of
a whole text are told: of a text that comes several times, only that of the smallest id is looked at further, and the others are
repeats from end to end. The same pass counts samples, so that frequent ones are known.

Route. Every window's sample is the least of its GRAM-word hashes, so equal windows have equal samples. Samples are gathered by hash; those
that only one text holds cannot belong to a shared window. For the rest, the stretch of words under each sample is sent to the reference
shard that owns the sample. There, for each sample, the automaton of all stretches from smaller ids is built in order of the ids: each
stretch is first streamed through it for its matching statistics, and every place where the longest match is WINDOW words or more ends
a removed window; then it is added. Maximal removed spans go back to their documents. (Broadcasting every shard's automaton to every
document would cost shards times documents; owning shards by sample gives each stretch the only automaton that can match it.)

Hot passages. A sample that many texts hold in different surroundings would be one task's. Samples that hold more than a HOT-th of a task's
fair share are not gathered (they are shared), and the windows under them are dealt one by one by a hash of all their words, which keeps
equal windows together. Equal stretches are combined before each exchange: only the smallest id's needs the automaton; in all others every
window is known to be repeated. Texts that more than a HOT-th of a fair share of documents have in common are told to all tasks, which then
send one of them. There are at most HOT hot samples and texts for each part, so what is broadcast grows with the number of parts only, and
being called hot changes no result. Numbers travel packed, so a passage in a third of all documents costs each task one stretch.

Words are runs without ASCII white space, unchanged. Null, empty and blank texts have no words. Rows with equal ids are not earlier than
each other; a null id is neither earlier nor later than any. Every row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm import text as T

WINDOW, GRAM = 13, 7
#: Samples and stretches that a task holds before it sends them.
FLUSH_SAMPLES, FLUSH_STRETCHES = 2_000_000, 200_000
#: A sample or text is hot from 1 / HOT of a part's fair share on, but not below LEAST_HOT.
HOT, LEAST_HOT = 16, 128

_PLACE = T.powers(0x8CB92BA72F3D8DD7, GRAM)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one string of bytes."""
    return b"".join(x for a in arrays for x in (np.int64(a.nbytes).tobytes(), np.ascontiguousarray(a).tobytes()))


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(np.frombuffer(data[at + 8 : at + 8 + n], t))
        at += 8 + n
    return out


def classes(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole sequence of words."""
    n = np.diff(w.first)
    place = T.mix((np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)).astype(T.U))
    out = []
    for seed in (0, 0xA0761D6478BD642F):
        total = np.concatenate([np.zeros(1, T.U), np.cumsum(T.mix((w.hash ^ T.U(seed)) + place), dtype=T.U)])
        out.append(T.mix(total[w.first[1:]] - total[w.first[:-1]] + n.astype(T.U)))
    return out[0], out[1]


def samples(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each run of windows with one sample; windows are named by their first word."""
    n = len(w.hash)
    if n < WINDOW:
        return np.zeros(0, T.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = n - GRAM + 1
    grams = np.zeros(m, T.U)
    for k in range(GRAM):
        grams += w.hash[k : k + m] * _PLACE[k]
    grams = T.mix(grams)
    count = n - WINDOW + 1
    best, at = grams[:count].copy(), np.zeros(count, np.int64)
    for k in range(1, WINDOW - GRAM + 1):
        other = grams[k : k + count]
        less = other < best
        best[less], at[less] = other[less], k
    stop = np.repeat(w.first[1:], np.diff(w.first))[:count]
    windows = np.flatnonzero(np.arange(count) + WINDOW <= stop)
    if not len(windows):
        return np.zeros(0, T.U), windows, windows
    place = windows + at[windows]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    return best[windows[first]], windows[first], windows[last]


def dealt(number: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of the numbers that belong to it)."""
    part = (number % T.U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def distinct(sample: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, each once."""
    order = np.lexsort((sample, cls))
    sample, cls = sample[order], cls[order]
    new = np.concatenate([[True], (sample[1:] != sample[:-1]) | (cls[1:] != cls[:-1])]) if len(sample) else np.zeros(0, bool)
    return sample[new], cls[new]


INFO, SAMPLE, TOTAL = range(3)
SURVEY = "kind int, doc_id long, class long, class2 long, n_words long, sha256 string"


def surveyed(docs: DataFrame, parts: int) -> DataFrame:
    """INFO rows: each document's class, words and digest. SAMPLE rows: samples (in `class`) that many of a task's texts hold, and how many;
    TOTAL rows: how many pairs of samples and texts the task has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("class", pa.int64()), ("class2", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string())])
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            many = count >= max(2, total // (2 * HOT * parts))
            found, count, none = found[many], count[many], [None] * (int(many.sum()) + 1)
            held.clear()
            return T.batch(schema, kind=[SAMPLE] * len(found) + [TOTAL], doc_id=none, **{"class": np.append(T.signed(found), 0)}, class2=none, n_words=np.append(count, total), sha256=none)

        for keys, block in T.read(batches):
            w = T.words(block, T.NOT_SPACE)
            cls, second = classes(w)
            n = len(block)
            digests = [hashlib.sha256(b" ".join(block.text(i).split())).hexdigest() for i in range(n)]
            yield T.batch(schema, kind=np.full(n, INFO, np.int32), doc_id=keys, **{"class": T.signed(cls)}, class2=T.signed(second), n_words=np.diff(w.first), sha256=digests)
            sample, first, _ = samples(w)
            if len(first):
                held.append(distinct(sample, cls[w.doc[first]])[0])
                total += len(held[-1])
            if total >= FLUSH_SAMPLES:
                yield flush()
                total = 0
        if total:
            yield flush()

    return docs.mapInArrow(T.lean(run), SURVEY)


class Hot:
    """Hot samples, sorted; hot texts' classes, sorted, and the smallest id of each."""

    def __init__(self, samples_: list[int], texts: list[tuple[int, int, int]]) -> None:
        self.samples = np.sort(np.array(samples_, np.int64).view(T.U))
        texts = sorted(texts)
        self.classes = np.array([c for c, _, _ in texts], np.int64)
        self.rest = np.array([[c2, least] for _, c2, least in texts], np.int64).reshape(-1, 2)

    def holds(self, sample: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.samples, sample), max(0, len(self.samples) - 1))
        return self.samples[at] == sample if len(self.samples) else np.zeros(len(sample), bool)

    def copy(self, cls: int, second: int, doc: int) -> bool:
        """Whether the text is a hot one and the document not the first that has it."""
        at = int(np.searchsorted(self.classes, cls))
        while at < len(self.classes) and self.classes[at] == cls:
            if self.rest[at, 0] == second:
                return bool(doc != self.rest[at, 1])
            at += 1
        return False


def hot(survey: DataFrame, firsts: DataFrame, parts: int) -> Hot:
    """What is hot: at most 2 * HOT samples and HOT texts for each part."""
    total = survey.where(F.col("kind") == TOTAL).agg(F.sum("n_words")).first()[0] or 0
    counts = survey.where(F.col("kind") == SAMPLE).groupBy("class").agg(F.sum("n_words").alias("c"))
    many = counts.where(F.col("c") >= max(LEAST_HOT, total // (HOT * parts))).select("class")
    texts = survey.where(F.col("kind") == INFO).count()
    copied = firsts.where(F.col("c") >= max(LEAST_HOT, texts // (HOT * parts))).select("class", "class2", "least")
    return Hot([r[0] for r in many.collect()], [tuple(r) for r in copied.collect()])


def gathered(docs: DataFrame, parts: int, sent: T.Sent) -> DataFrame:
    """(part, data): distinct (sample, class) pairs of samples that aren't hot, the sample cut to 32 bits besides those that the part
    tells: samples that then look equal only cost a needless comparison."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            sample, cls = np.concatenate(held), np.concatenate(owner)
            held.clear(), owner.clear()
            rows = [(k, pack((sample[at] // T.U(parts)).astype(np.uint32), cls[at])) for k, at in dealt(sample, parts)]
            return T.batch(schema, part=[k for k, _ in rows], data=[d for _, d in rows])

        total = 0
        for _, block in T.read(batches):
            w = T.words(block, T.NOT_SPACE)
            sample, first, _ = samples(w)
            cold = ~sent.value.holds(sample)
            sample, cls = distinct(sample[cold], classes(w)[0][w.doc[first[cold]]])
            held.append(sample), owner.append(cls)
            total += len(sample)
            if total >= FLUSH_SAMPLES:
                yield flush()
                total = 0
        if total:
            yield flush()

    return docs.mapInArrow(T.lean(run), "part int, data binary")


def name(sample: np.ndarray, parts: int) -> np.ndarray:
    """How a sample is named after it has been gathered: by what was sent of it, and its part."""
    return (sample // T.U(parts)).astype(np.uint32).astype(T.U) * T.U(parts) + sample % T.U(parts)


def by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows (key, data) with one key."""
    now, held = None, []
    for b in batches:
        for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(d)
    if held:
        yield now, held


def shared(rows: DataFrame, parts: int) -> DataFrame:
    """(part of the class, data): for each class, its samples that another class holds too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
        for part, data in by_key(batches):
            sample, cls = (np.concatenate(x) for x in zip(*(unpack(d, np.uint32, T.U) for d in data), strict=True))
            sample = sample.astype(T.U)
            order = np.lexsort((cls, sample))
            sample, cls = sample[order], cls[order]
            new = np.concatenate([[True], (sample[1:] != sample[:-1]) | (cls[1:] != cls[:-1])])
            sample, cls = sample[new], cls[new]
            head = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]]))
            size = np.diff(np.concatenate([head, [len(sample)]]))
            many = np.repeat(size > 1, size)
            sample, cls = sample[many] * T.U(parts) + T.U(part), cls[many]
            out = [(k, pack(cls[at], sample[at])) for k, at in dealt(cls, parts)]
            if out:
                yield T.batch(schema, part=[k for k, _ in out], data=[d for _, d in out])

    return rows.mapInArrow(T.lean(run), "part int, data binary")


KEYED = "part int, kind int, class long, class2 long, doc_id long, data binary"


def keyed(docs: DataFrame, parts: int, sent: T.Sent) -> DataFrame:
    """(part, kind 1, class, doc_id, data): the texts that have a window, by class; of hot ones the first document's only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("class", pa.int64()), ("class2", pa.int64()), ("doc_id", pa.int64()), ("data", pa.binary())])
        for keys, block in T.read(batches):
            w = T.words(block, T.NOT_SPACE)
            cls, second = classes(w)
            ids, known = keys.to_numpy(zero_copy_only=False), sent.value
            one, two = T.signed(cls), T.signed(second)
            own = [i for i in np.flatnonzero(np.diff(w.first) >= WINDOW) if not known.copy(int(one[i]), int(two[i]), int(ids[i]))]
            if own:
                at = np.array(own)
                yield T.batch(schema, part=(cls[at] % T.U(parts)).astype(np.int32), kind=np.ones(len(own), np.int32), **{"class": one[at]}, class2=two[at], doc_id=ids[at], data=[block.text(i) for i in own])

    return docs.mapInArrow(T.lean(run), KEYED)


_MIXED = [("kind", pa.int32()), ("part", pa.int32()), ("class", pa.int64()), ("class2", pa.int64()), ("doc_id", pa.int64()), ("data", pa.binary())]
MIXED = "kind int, part int, class long, class2 long, doc_id long, data binary"
PENDING, STRETCHES, SPANS = range(3)


def rows_of(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    none = [None] * n
    return T.batch(pa.schema(_MIXED), kind=[kind] * n, part=[k for k, _ in rows], **{"class": none}, class2=none, doc_id=none, data=[d for _, d in rows])


class Stretches:
    """Stretches under shared samples: content hash, sample, class, id, first word, and the words cut to 32 bits."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, sample: np.ndarray, cls: int, doc: int, first: np.ndarray, last: np.ndarray, hashes: np.ndarray, whole: bool = False) -> None:
        """Add a document's stretches; `whole`: dealt by all their words, not by the sample."""
        if not len(first):
            return
        size = last - first + WINDOW
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        words = hashes[np.repeat(first, size) + at]
        content = T.mix(np.add.reduceat(T.mix(words + T.mix(at.astype(T.U))), np.cumsum(size) - size) ^ (T.U(0) if whole else sample))
        sample = content if whole else sample
        n = len(sample)
        self.parts.append((content, sample, np.full(n, cls, np.int64), np.full(n, doc, np.int64), first, size, (words >> T.U(32)).astype(np.uint32)))
        self.n += n

    def combined(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Stretches that are still open: those of the smallest id for each content, each content once for a document, then where it
        occurs there; and spans (class, id, begin, end) of all others, which are repeats."""
        content, sample, cls, doc, first, size, words = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        begin = np.cumsum(size) - size
        order = np.lexsort((first, cls, doc, content))
        c, d = content[order], doc[order]
        head = np.concatenate([[True], c[1:] != c[:-1]])
        least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
        late = order[d > least]
        repeats = [cls[late], doc[late], first[late], first[late] + size[late]]
        own = order[d == least]
        c, d, k = content[own], doc[own], cls[own]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
        one = own[new]
        times = np.diff(np.concatenate([np.flatnonzero(new), [len(own)]]))
        n = size[one]
        pick = np.repeat(begin[one], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return [content[one], sample[one], cls[one], doc[one], n, words[pick], times, first[own]], repeats

    TYPES = (T.U, T.U, np.int64, np.int64, np.int64, np.uint32, np.int64, np.int64)


def chosen(open_: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """The open stretches at the places, with their words and occurrences."""
    content, sample, cls, doc, size, words, times, first = open_
    ragged = []
    for n, values in ((size, words), (times, first)):
        begin, m = np.cumsum(n) - n, n[at]
        ragged.append(values[np.repeat(begin[at], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)])
    return [content[at], sample[at], cls[at], doc[at], size[at], ragged[0], times[at], ragged[1]]


def split(rows: DataFrame, parts: int, sent: T.Sent) -> DataFrame:
    """Of the first document of each class: its text, if it waits for spans, its stretches under shared samples, and spans that are known."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_MIXED)
        found: dict[int, np.ndarray] = {}
        waiting: list[bytes] = []
        stretches = Stretches()
        part_now = cls_now = None

        def flush() -> Iterator[pa.RecordBatch]:
            open_, repeats = stretches.combined()
            rows = [(k, pack(*chosen(open_, at))) for k, at in dealt(open_[1], parts)]
            yield rows_of(STRETCHES, rows)
            rows = [(k, pack(*(x[at] for x in repeats))) for k, at in dealt(repeats[0].view(T.U), parts)]
            if rows:
                yield rows_of(SPANS, rows)

        for b in batches:
            out: list[tuple] = []
            for part, kind, cls, second, doc, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if part != part_now:
                    part_now, cls_now, found, waiting = part, None, {}, []
                if kind == 0:
                    waiting.append(data)
                    continue
                if waiting:
                    c, s = (np.concatenate(x) for x in zip(*(unpack(d, np.int64, T.U) for d in waiting), strict=True))
                    order = np.argsort(c, kind="stable")
                    c, s, waiting = c[order], s[order], []
                    cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
                    found = {int(c[i]): s[i:j] for i, j in zip(cuts, cuts[1:], strict=False)}
                if (cls, second) == cls_now:  # a copy
                    continue
                cls_now, mine, known = (cls, second), found.get(cls), sent.value
                if mine is None and not len(known.samples):
                    continue
                w = T.words(T.Block(0, np.frombuffer(data, np.uint8), np.array([0, len(data)])), T.NOT_SPACE)
                sample, first, last = samples(w)
                often = known.holds(sample)
                if often.any():  # each window under a hot sample by itself
                    n = last[often] - first[often] + 1
                    each = np.repeat(first[often], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    stretches.add(np.zeros(len(each), T.U), cls, doc, each, each, w.hash, whole=True)
                own = np.zeros(len(sample), bool)
                if mine is not None:
                    short = name(sample, parts)
                    own = np.isin(short, mine) & ~often
                    stretches.add(short[own], cls, doc, first[own], last[own], w.hash)
                if own.any() or often.any():
                    out.append((PENDING, part, cls, second, doc, data))
            if out:
                yield T.batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
            if stretches.n >= FLUSH_STRETCHES:
                yield from flush()
                stretches = Stretches()
        if stretches.n:
            yield from flush()

    return rows.mapInArrow(T.lean(run), MIXED)


class Automaton:
    """A suffix automaton of several sequences: states with transitions, suffix links and longest lengths."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.longest = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        """Put all suffixes of all prefixes of the sequence in."""
        next_, link, longest = self.next, self.link, self.longest
        last = 0
        for c in sequence:
            p, known = last, next_[last].get(c)
            if known is not None and longest[known] == longest[last] + 1:
                last = known
                continue
            if known is None:
                new = len(next_)
                next_.append({}), link.append(0), longest.append(longest[last] + 1)
                while p >= 0 and c not in next_[p]:
                    next_[p][c] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                q = next_[p][c]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                    last = new
                    continue
            else:
                q, new = known, -1
            clone = len(next_)
            next_.append(dict(next_[q])), link.append(link[q]), longest.append(longest[p] + 1)
            while p >= 0 and next_[p].get(c) == q:
                next_[p][c] = clone
                p = link[p]
            link[q] = clone
            if new >= 0:
                link[new] = clone
                last = new
            else:
                last = clone

    def matches(self, sequence: list[int]) -> list[int]:
        """Matching statistics: for each place, the length of the longest match that ends there."""
        next_, link, longest = self.next, self.link, self.longest
        state = length = 0
        out = []
        for c in sequence:
            while state and c not in next_[state]:
                state = link[state]
                length = longest[state]
            if c in next_[state]:
                state = next_[state][c]
                length += 1
            out.append(length)
        return out


def judged(rows: DataFrame, parts: int) -> DataFrame:
    """(part of the class, data): spans (class, id, begin, end) that each shard's automata find."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
        for _, data in by_key(batches):
            open_ = [np.concatenate(x) for x in zip(*(unpack(d, *Stretches.TYPES) for d in data), strict=True)]
            content, sample, cls, doc, size, words, times, first = open_
            word_at, first_at = np.cumsum(size) - size, np.cumsum(times) - times
            order = np.lexsort((cls, doc, content, sample))
            s, c, d = sample[order], content[order], doc[order]
            head = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
            least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
            spans: list[tuple[int, int, int]] = []  # stretch, begin and end in it
            late = order[d > least]
            kept = order[d == least]
            order = kept[np.lexsort((cls[kept], doc[kept], sample[kept]))]
            s = sample[order]
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])).tolist()
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j - i < 2 or doc[order[i]] == doc[order[j - 1]]:
                    continue
                automaton, fresh = Automaton(), []
                now = None
                for k in order[i:j].tolist():
                    if doc[k] != now:
                        for x in fresh:
                            automaton.add(x)
                        now, fresh = doc[k], []
                    sequence = words[word_at[k] : word_at[k] + size[k]].tolist()
                    ends = [e for e, n in enumerate(automaton.matches(sequence)) if n >= WINDOW]
                    for e in ends:
                        if spans and spans[-1][0] == k and spans[-1][2] >= e - WINDOW + 1:
                            spans[-1] = (k, spans[-1][1], e + 1)
                        else:
                            spans.append((k, e - WINDOW + 1, e + 1))
                    if len(ends) < len(sequence) - WINDOW + 1:
                        fresh.append(sequence)
            k, b, e = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
            k, b, e = np.concatenate([k, late]), np.concatenate([b, np.zeros(len(late), np.int64)]), np.concatenate([e, size[late]])
            n = times[k]
            begin = first[np.repeat(first_at[k], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            k, b, e = np.repeat(k, n), np.repeat(b, n) + begin, np.repeat(e, n) + begin
            out = [(p, pack(cls[k[at]], doc[k[at]], b[at], e[at])) for p, at in dealt(cls[k].view(T.U), parts)]
            if out:
                yield T.batch(schema, part=[p for p, _ in out], data=[x for _, x in out])

    return rows.mapInArrow(T.lean(run), "part int, data binary")


def finished(rows: DataFrame) -> DataFrame:
    """Results of the texts that waited: rows (part, kind, class, class2, doc_id, data), spans (kind 0) before texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("class", pa.int64()), ("class2", pa.int64()), ("removed", pa.int64()), ("kept", pa.string())])
        part_now, waiting = None, []
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            out = []
            for part, kind, cls, second, doc, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if part != part_now:
                    part_now, waiting, found = part, [], {}
                if kind == 0:
                    waiting.append(data)
                    continue
                if waiting:
                    c, d, begin, end = (np.concatenate(x) for x in zip(*(unpack(x, *[np.int64] * 4) for x in waiting), strict=True))
                    order = np.lexsort((d, c))
                    c, d, spans, waiting = c[order], d[order], np.stack([begin, end], 1)[order], []
                    cuts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1]), [True]]))
                    found = {(int(c[i]), int(d[i])): spans[i:j] for i, j in zip(cuts, cuts[1:], strict=False)}
                if (spans := found.get((cls, doc))) is None:
                    continue  # nothing is removed
                words = data.split()
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, spans[:, 0], 1)
                np.add.at(depth, spans[:, 1], -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((cls, second, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield T.batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    return rows.mapInArrow(T.lean(run), "class long, class2 long, removed long, kept string")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, for every row of docs."""
    every = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    survey = store.written(surveyed(every, parts), "survey")
    info = survey.where(F.col("kind") == INFO).select("doc_id", "class", "class2", "n_words", "sha256")
    same = ["class", "class2", "n_words"]
    firsts = info.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()).groupBy(*same).agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    docs, sent_hot = every.where("doc_id is not null"), T.Sent(docs.sparkSession, hot(survey, firsts, parts))

    def sent(rows: DataFrame, *sort: str) -> DataFrame:
        return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", *sort)

    none = F.lit(None).cast("long")
    order = ("kind", "class", "class2", "doc_id")

    def first(rows: DataFrame) -> DataFrame:
        return rows.select("part", F.lit(0).alias("kind"), none.alias("class"), none.alias("class2"), none.alias("doc_id"), "data")

    answers = first(shared(sent(gathered(docs, parts, sent_hot)), parts))
    mixed = store.written(split(sent(answers.unionByName(keyed(docs, parts, sent_hot)), *order), parts, sent_hot), "split")

    spans = judged(sent(mixed.where(F.col("kind") == STRETCHES).select("part", "data")), parts)
    spans = first(spans.unionByName(mixed.where(F.col("kind") == SPANS).select("part", "data")))
    pending = mixed.where(F.col("kind") == PENDING).select("part", F.lit(1).alias("kind"), "class", "class2", "doc_id", "data")
    done = finished(sent(spans.unionByName(pending), *order))
    each = firsts.select(*same, "least").join(done, ["class", "class2"], "left")
    out = info.join(each, same, "left")
    late = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    removed = F.when(late, F.col("n_words")).when(F.col("doc_id").isNotNull(), F.coalesce("removed", F.lit(0))).otherwise(F.lit(0))
    kept = F.when(late, F.lit(hashlib.sha256(b"").hexdigest())).when(F.col("doc_id").isNotNull(), F.coalesce("kept", "sha256")).otherwise(F.col("sha256"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
