"""Secret scan: patterns of known secrets, and credential values whose cheapest guess is still dear.

`find` gives the spans of one text. Three base kinds are plain patterns. The fourth, `guess`, takes the value after a
credential word (`passphrase: ...`, `pwd=...`) and segments it at minimum cost into words, dates, repeats, keyboard walks,
sequences and brute-force characters; a value that takes at least GUESSES guesses and does not touch a base span is a secret.

Words cost by their rank in a dictionary: frequent parts of passwords, then the most frequent words of the documents themselves, WORDS at
most, counted over all of them, ties by spelling; it is broadcast, and its size is that parameter. So that prose is left alone where the
dictionary ends, a value all of whose pieces between marks are plain words in shape (letters only, lower case, upper case or capitalised) is
no secret, however rare the words: random letters of one case alone are not found.

A text costs one pass over its bytes for the few substrings that any span needs; only texts that hold one are decoded and
matched. Null and empty texts have no spans. Spans are in code points, ends exclusive. Repeated rows give repeated results.
The segmentation takes time in proportion to the value's length, however long it is. Without documents the dictionary is the fixed part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm import text as T

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of [0-9a-f]+ that is long enough
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)["']?[\x20\t]*(?:=>|[:=])[\x20\t]*["'`]?([^\s"'`<>,;]+)""", re.I | re.A)
#: Lower-case substrings one of which every credential context holds.
HINTS = (b"passw", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"api", b"key", b"credential", b"bearer")
#: log10 of the guesses from which a value counts as a secret, and its least length.
GUESSES, LEAST = 10.0, 6
#: Words of the documents that the dictionary holds at most, and how long they are.
WORDS, SHORTEST, LONGEST = 30_000, 3, 20
#: Runs up to this length are cut anywhere; longer ones count whole.
RUN = 32

# Frequent parts of passwords, the most frequent first.
COMMON = """password the and 123456 qwerty letmein admin welcome monkey dragon master login hello shadow sunshine princess
football baseball superman batman iloveyou trustno secret token access key test guest root user pass changeme default
example sample dummy none null true false your my here value string text insert replace placeholder redacted hidden
company service server client public private system database mysql postgres oracle local host mail email account
summer winter spring autumn january february march april june july august september october november december
monday tuesday wednesday thursday friday saturday sunday love money power magic orange apple banana cookie coffee
computer internet google windows linux apache tomcat jenkins docker kubernetes hunter tiger ranger soccer hockey
michael jordan jennifer thomas robert daniel charlie andrew joshua matthew george harley pepper ginger maggie buster""".split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@310$57", "aaeiosst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d\d")

_RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
_SPOT = {c: (row, k) for row, keys in enumerate(KEYBOARD) for k, c in enumerate(keys)}


def _single(c: str) -> float:
    """log10 of the characters that brute force tries in this one's place."""
    size = 10 if c in "0123456789" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000
    return math.log10(size)


def _near(a: str, b: str) -> bool:
    """Whether two keys touch on the keyboard."""
    p, q = _SPOT.get(a), _SPOT.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _runs(value: str, joined) -> list[int]:
    """For each position, how many characters before it, itself included, form a run in which each follows the last."""
    out = [1] * len(value)
    for i in range(1, len(value)):
        if joined(value[i - 1], value[i]):
            out[i] = out[i - 1] + 1
    return out


def ranked(words: Iterable[str] = ()) -> dict[str, int]:
    """The dictionary: the fixed words, then others, each with its rank."""
    out = dict(_RANK)
    for w in words:
        out.setdefault(w, len(out) + 1)
    return out


def frequent(docs: DataFrame, text: str = "text", most: int = WORDS) -> list[str]:
    """The most frequent words of all documents, from the most frequent on, `most` at most: those whose number of occurrences, in steps of a
    sixteenth of a power of two, lies above the first step that would bring more. Only they come to the driver."""
    found = F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(r"\p{L}{%d,%d}" % (SHORTEST, LONGEST)), F.lit(0))
    counts = docs.select(F.explode(found).alias("w")).groupBy("w").count().withColumn("step", F.floor(F.log2("count") * 16))
    counts = store.written(counts, "words")
    total, least = 0, 1 << 20
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):  # some hundred steps
        total += r.n
        if total > most:
            break
        least = r.step
    return [r.w for r in counts.where(F.col("step") >= least).orderBy(F.desc("count"), "w").collect()]


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of the value needs; empty: 0."""
    low = value.lower()
    low = low if len(low) == len(value) else value
    plain = low.translate(LEET)
    walk = _runs(low, _near)
    same = _runs(value, lambda a, b: a == b)
    up = _runs(value, lambda a, b: ord(b) - ord(a) == 1)
    down = _runs(value, lambda a, b: ord(a) - ord(b) == 1)
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        cost = best[j - 1] + _single(value[j - 1])
        for i in range(max(0, j - LONGEST), j - SHORTEST + 1):
            for word, extra in ((low[i:j], 0.0), (plain[i:j], 0.3)):
                if rank := ranks.get(word):
                    cost = min(cost, best[i] + math.log10(rank + 1) + extra + (0.3 if value[i:j] != low[i:j] else 0))
        if value[j - 1] in "0123456789":
            for i in range(max(0, j - 10), j - 3):
                if value[i] in "0123456789" and DATE.fullmatch(value, i, j):
                    cost = min(cost, best[i] + math.log10(365 * 120 if j - i > 4 else 120))
        for run, first in ((walk, 47 * 4), (same, 94), (up, 94), (down, 188)):
            longest = run[j - 1]
            for n in {*range(3, min(longest, RUN) + 1), *([longest] if longest > RUN else [])}:
                cost = min(cost, best[j - n] + math.log10(first * n) + (0.5 * (n - 3) ** 0.5 if run is walk else 0))
        for n in range(2, min(9, j // 2 + 1)):  # a block that was just typed is typed again
            if value[j - n : j] == value[j - 2 * n : j - n]:
                cost = min(cost, best[j - n] + math.log10(n + 1))
        best[j] = cost
    return best[-1]


def prose(value: str) -> bool:
    """Whether all pieces of the value between marks are plain words in shape."""
    return all(p.isalpha() and (p.islower() or p.isupper() or p.istitle()) for p in re.findall(r"[^\W_]+", value))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern kinds, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, base: list[tuple[int, int, int]], guesses: float = GUESSES, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, int]]:
    """(start, kind, end) of credential values that are dear to guess and touch no base span; marks that end a sentence are no part of a value."""
    found = []
    for m in CONTEXT.finditer(text):
        a = m.start(1)
        b = a + len(m[1].rstrip(".!?:)]}"))
        if b - a >= LEAST and not prose(text[a:b]) and not any(s < b and a < e for s, _, e in base) and guess_cost(text[a:b], ranks) >= guesses:
            found.append((a, 3, b))
    return found


def find(text: str | None, guesses: float = GUESSES, ranks: dict[str, int] = _RANK) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    base = base_spans(text or "")
    return base, sorted(base + guess_spans(text or "", base, guesses, ranks))


_HEXES = T.byte_class((0x30, 0x39), (0x61, 0x66))


def suspects(block: T.Block) -> list[int]:
    """Documents of the block that may hold a span: with a hint, AKIA, or eight hex bytes in a row at a stride of four."""
    raw = block.data.tobytes()
    at = []
    for source, needles in ((raw.lower(), HINTS), (raw, (b"AKIA",))):
        for needle in needles:
            k = source.find(needle)
            while k >= 0:
                i = int(np.searchsorted(block.offsets, k, "right")) - 1
                at.append(i)
                k = source.find(needle, int(block.offsets[i + 1]))
    h = _HEXES[block.data[::4]]
    if len(h) >= 8:
        n = len(h) - 7
        run = h[:n].copy()
        for k in range(1, 8):
            run &= h[k : k + n]
        at += (np.searchsorted(block.offsets, np.unique(np.flatnonzero(run) * 4), "right") - 1).tolist()
    return sorted(set(at))


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of each span, by start and then kind."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def sent(docs: DataFrame, text: str, words: Iterable[str] | None) -> T.Sent:
    """The dictionary for the tasks; words: its words besides the fixed ones, by default the documents' most frequent."""
    return T.Sent(docs.sparkSession, ranked(frequent(docs, text) if words is None else words))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", guesses: float = GUESSES, words: Iterable[str] | None = None) -> DataFrame:
    """One row for each row of docs: its key, counts by kind, a digest of the base spans, and all spans."""
    known = sent(docs, text, words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
        none = hashlib.sha256(b"").hexdigest()
        for keys, block in T.read(batches):
            n = len(block)
            counts, digests, spans = np.zeros((4, n), np.int64), [none] * n, [""] * n
            for i in suspects(block):
                base, found = find(block.text(i).decode("utf-8", "replace"), guesses, known.value)
                for _, k, _ in found:
                    counts[k, i] += 1
                if found:
                    digests[i], spans[i] = hashlib.sha256(written(base).encode()).hexdigest(), written(found)
            yield T.batch(schema, doc_id=keys, **{f"n_{k}": counts[j] for j, k in enumerate(KINDS)}, base_sha256=digests, spans=spans)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(T.lean(run), SCHEMA)


def redact(text: str | None, mark: str = "[SECRET]", ranks: dict[str, int] = _RANK) -> str | None:
    """The text with every span replaced; touching or overlapping spans give one mark."""
    if text is None:
        return None
    out, at = [], 0
    for a, _, b in find(text, ranks=ranks)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", words: Iterable[str] | None = None) -> DataFrame:
    """docs, all columns kept, with secrets in the text replaced by a mark."""
    names, known = docs.columns, sent(docs, text, words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text)
            masked: dict[int, str] = {}
            for block in T.blocks(b.column(k)):
                for i in suspects(block):
                    old = block.text(i).decode("utf-8", "replace")
                    if (new := redact(old, ranks=known.value)) != old:
                        masked[block.row + i] = new
            yield b.set_column(k, b.schema.field(k), T.changed(b.column(k), masked)) if masked else b

    return docs.mapInArrow(T.lean(run), docs.schema).select(*names)


def spans_column(spans: str | Column) -> Column:
    """The spans string as an array of (kind, start, end)."""
    parts = F.filter(F.split(F.col(spans) if isinstance(spans, str) else spans, ","), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.split(x, ":")[0].alias("kind"), F.split(x, ":")[1].cast("long").alias("start"), F.split(x, ":")[2].cast("long").alias("end")))
