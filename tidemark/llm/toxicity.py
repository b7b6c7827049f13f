"""Toxicity by weak supervision: many voters, a generative label model over them, a linear classifier on its posteriors.

Voters. Lexicon voters look for a word or the beginning of a word: a fixed list of insults, and terms mined from labelled rows
(those that toxic rows hold far more often than others). Pattern voters look at the text as a whole: shouting, exclamation
marks, several lexicon hits. Each votes 1 or 0 on each text.

Label model. A two-class latent model is fitted by expectation maximisation: the class prior and, for each voter, how often it
votes 1 in either class. A row's own label is one more voter, of fixed accuracy LABEL. Correlations between voters are estimated
from the residuals of their votes given the posterior; a voter's evidence is divided by its summed squared correlations, so that
voters that repeat each other count about once.

Classifier. A logistic regression on the same voters' signals, trained on the posterior labels with ridge weights; scores are
its probabilities. Scoring takes one pass over all words of each text, of any length.

The fit takes at most SAMPLE toxic and 2 * SAMPLE other labelled rows of at most SAMPLE_BYTES bytes, chosen by a hash of the id:
a bound on what comes to the driver. Scoring covers every row. Null and empty texts have no hits and so score the model's base
rate for such texts. Without any labelled rows the fixed list decides. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T

SAMPLE, SAMPLE_BYTES = 2500, 1 << 14
#: Mined terms: least toxic rows that hold one, and least ratio of the smoothed rates. All that pass are kept.
SUPPORT, RATIO = 4, 30.0
LABEL = 0.98
PREFIXES = (4, 5, 6, 7)

# Insults in several languages.
INSULTS = """idiot moron stupid dumb loser scum trash clown worthless pathetic disgusting garbage imbecile retard freak pig
bastard bitch asshole dickhead jerk creep fool vermin filth
dumm trottel arschloch abschaum versager wertlos ekelhaft dreck schwein
imbécile crétin débile ordure minable connard salaud abruti
estúpido imbécil basura escoria asqueroso inútil cabrón payaso""".split()


def terms(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word and each of its beginnings of 4 to 7 bytes, lower-cased."""
    w = T.words(block, T.ALNUM, fold=True)
    if not len(w.hash):
        return np.zeros(0, T.U), np.zeros(0, np.int64)
    data = np.concatenate([T.LOWER[block.data], np.zeros(8, np.uint8)])
    doc, size = w.doc, w.end - w.begin
    hashes, docs = [w.hash], [doc]
    head = np.zeros(len(size), T.U)
    for k in range(max(PREFIXES)):
        head |= data[w.begin + k].astype(T.U) << T.U(8 * k)
        if k + 1 in PREFIXES:
            long = size > k + 1
            hashes.append(T.mix(head[long] + T.U(k + 1)))
            docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def pack(texts: list[bytes]) -> T.Block:
    return T.Block(0, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


_UPPER = T.byte_class((0x41, 0x5A))
_LOWER = T.byte_class((0x61, 0x7A))
PATTERNS = ("two lexicon hits", "three lexicon hits", "shouting", "exclamations")


@dataclass
class Model:
    """terms: sorted hashes of lexicon voters; weights: of terms, then of PATTERNS; bias."""

    terms: np.ndarray
    weights: np.ndarray
    bias: float

    def votes(self, block: T.Block) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document, voter), each once."""
        n, m = len(block), len(self.terms)
        hashes, docs = terms(block)
        sieve = np.zeros(1 << 16, bool)
        sieve[(self.terms & T.U(0xFFFF)).astype(np.int64)] = True
        near = np.flatnonzero(sieve[(hashes & T.U(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.terms, hashes[near])
        hit = self.terms[np.minimum(at, m - 1)] == hashes[near] if m else np.zeros(len(near), bool)
        pairs = np.unique(docs[near[hit]].astype(np.int64) * (m + len(PATTERNS)) + at[hit])
        doc, voter = pairs // (m + len(PATTERNS)), pairs % (m + len(PATTERNS))
        count = np.bincount(doc, minlength=n)

        def summed(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[block.data], dtype=np.int64)])
            return total[block.offsets[1:]] - total[block.offsets[:-1]]

        upper, lower, marks = summed(_UPPER), summed(_LOWER), summed(T.byte_class((0x21, 0x21)))
        size = np.diff(block.offsets)
        for k, flag in enumerate((count >= 2, count >= 3, (upper > lower) & (upper > 20), marks * 50 > size)):
            doc = np.concatenate([doc, np.flatnonzero(flag)])
            voter = np.concatenate([voter, np.full(int(flag.sum()), m + k)])
        return doc, voter

    def scores(self, block: T.Block) -> np.ndarray:
        doc, voter = self.votes(block)
        z = np.bincount(doc, self.weights[voter], len(block)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def mined(toxic: list[bytes], other: list[bytes]) -> np.ndarray:
    """Hashes of terms that toxic texts hold far more often than others."""

    def counted(texts: list[bytes], only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.zeros(0, T.U), np.zeros(0, np.int64)
        for i in range(0, len(texts), 256):
            h, d = terms(pack(texts[i : i + 256]))
            if only is not None:
                at = np.minimum(np.searchsorted(only, h), len(only) - 1)
                own = only[at] == h
                h, d = h[own], d[own]
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            k, c = np.unique(h[new], return_counts=True)
            merged, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, c]), len(merged)).astype(np.int64)
            keys = merged
        return keys, counts

    if not toxic:
        return np.zeros(0, T.U)
    keys, yes = counted(toxic, None)
    keys, yes = keys[yes >= SUPPORT], yes[yes >= SUPPORT]
    if not len(keys):
        return keys
    seen, times = counted(other, keys)
    no = np.zeros(len(keys))
    no[np.searchsorted(keys, seen)] = times
    ratio = ((yes + 0.2) / (len(toxic) + 1)) / ((no + 0.2) / (len(other) + 1))
    return keys[ratio >= RATIO]


def fixed() -> np.ndarray:
    """Hashes of the fixed list."""
    block = pack([" ".join(INSULTS).encode()])
    return np.unique(T.words(block, T.ALNUM, fold=True).hash)


class Votes:
    """A sparse 0/1 matrix of texts and voters: sorted pairs (text, voter), each once."""

    def __init__(self, row: np.ndarray, voter: np.ndarray, shape: tuple[int, int]) -> None:
        order = np.lexsort((voter, row))
        self.row, self.voter, self.shape = row[order], voter[order], shape
        self.first = np.searchsorted(self.row, np.arange(shape[0] + 1))

    @staticmethod
    def of(votes: Votes | np.ndarray) -> Votes:
        return votes if isinstance(votes, Votes) else Votes(*np.nonzero(votes), votes.shape)

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The matrix by a vector of voters."""
        return np.bincount(self.row, vector[self.voter], self.shape[0])

    def back(self, vector: np.ndarray) -> np.ndarray:
        """The transposed matrix by a vector of texts."""
        return np.bincount(self.voter, vector[self.row], self.shape[1])

    def together(self, some: slice) -> np.ndarray:
        """How many texts each of some voters shares with every voter."""
        own = np.flatnonzero((self.voter >= some.start) & (self.voter < some.stop))
        out = np.zeros((some.stop - some.start) * self.shape[1])
        for k in range(0, len(own), 4096):
            at = own[k : k + 4096]
            begin, n = self.first[self.row[at]], np.diff(self.first)[self.row[at]]
            other = self.voter[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            keys, times = np.unique(np.repeat(self.voter[at] - some.start, n) * self.shape[1] + other, return_counts=True)
            out[keys] += times
        return out.reshape(-1, self.shape[1])


def shares(votes: Votes, p: np.ndarray, a: np.ndarray, b: np.ndarray, width: int = 256) -> np.ndarray:
    """The weight of each voter: 1 by the summed squared correlations of what the classes don't explain, `width` voters at a time."""
    n, m = votes.shape
    classes, rates = np.stack([p, 1 - p], 1), np.stack([a, b])
    seen = np.stack([votes.back(p), votes.back(1 - p)], 1)
    gram = classes.T @ classes
    total = np.bincount(votes.voter, minlength=m)
    square = total - 2 * (seen * rates.T).sum(1) + np.einsum("im,ij,jm->m", rates, gram, rates)
    mean = (total - classes.sum(0) @ rates) / n
    deviation = np.sqrt(np.maximum(square / n - mean**2, 0)) + 1e-6
    out = np.empty(m)
    for k in range(0, m, width):
        some = slice(k, min(k + width, m))
        corr = votes.together(some) - seen[some] @ rates - rates[:, some].T @ (seen.T - gram @ rates)
        corr /= n * deviation[some, None] * deviation
        out[some] = 1 / np.maximum(1, (np.where(np.abs(corr) > 0.1, corr, 0) ** 2).sum(1))
    return out


def label_model(votes: Votes | np.ndarray, labels: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of class 1 for each row of a 0/1 vote matrix; labels: 1, 0, or -1 where unknown."""
    votes = Votes.of(votes)
    n, m = votes.shape
    known = labels >= 0
    lexical = votes.times((np.arange(m) < m - len(PATTERNS)).astype(float)) > 0
    p = np.where(known, np.where(labels == 1, LABEL, 1 - LABEL), np.where(lexical, 0.6, 0.1))
    share = np.ones(m)
    for step in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        one, zero = p.sum(), (1 - p).sum()
        a = (votes.back(p) + 0.5) / (one + 1)
        b = (votes.back(1 - p) + 0.05) / (zero + 1)
        on, off = np.log(a / b) * share, np.log((1 - a) / (1 - b)) * share
        z = np.log(prior / (1 - prior)) + votes.times(on - off) + off.sum()
        z += np.where(known, np.where(labels == 1, 1, -1) * np.log(LABEL / (1 - LABEL)), 0)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if step == 4:  # correlations of what the classes don't explain
            share = shares(votes, p, a, b)
    return p


def linear(votes: Votes, p: np.ndarray, ridge: float = 0.3, rounds: int = 300, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels: batch gradient steps with a decaying rate."""
    n, m = votes.shape
    w, b = np.zeros(m), float(np.log(max(p.mean(), 1e-3) / max(1 - p.mean(), 1e-3)))
    scale = 4 / np.maximum(np.bincount(votes.voter, minlength=m) / n, 4 / n) / max(1.0, len(votes.row) / n)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(votes.times(w) + b, -40, 40)))
        g = votes.back(q - p) / n + ridge * w / n
        w -= rate * np.clip(scale * g, -0.5, 0.5)
        b -= rate * np.clip(4 * (q - p).mean(), -0.5, 0.5)
    return w, b


def train(texts: list[bytes], labels: np.ndarray) -> Model:
    """A model from a bounded sample of texts and their labels (1, 0, or -1 where unknown)."""
    base = fixed()
    toxic = [t for t, y in zip(texts, labels, strict=True) if y == 1]
    other = [t for t, y in zip(texts, labels, strict=True) if y == 0]
    if not toxic or not other:
        return Model(base, np.concatenate([np.full(len(base), 5.0), np.zeros(len(PATTERNS))]), -3.0)
    lexicon = np.union1d(base, mined(toxic, other))
    model = Model(lexicon, np.zeros(len(lexicon) + len(PATTERNS)), 0.0)
    doc, voter = [], []
    for i in range(0, len(texts), 256):
        d, v = model.votes(pack(texts[i : i + 256]))
        doc.append(d + i), voter.append(v)
    doc, voter = np.concatenate(doc), np.concatenate(voter)
    used = np.unique(np.concatenate([voter, np.arange(len(lexicon), len(lexicon) + len(PATTERNS))]))  # voters that vote at all
    votes = Votes(doc, np.searchsorted(used, voter), (len(texts), len(used)))
    weights, bias = linear(votes, label_model(votes, np.asarray(labels)))
    model.weights[: len(lexicon)] = np.where(np.isin(lexicon, base), max(0.0, float(np.median(weights))), 0)  # of voters never heard
    model.weights[used] = weights
    model.bias = bias
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled documents: `labels` holds doc_id and toxic, for the rows that may be learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(2 * sample))
    texts = docs.where(F.octet_length("text") <= sample_bytes).select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    rows = sorted(texts.collect(), key=lambda r: (r.doc_id, r.text))
    return train([r.text.encode() for r in rows], np.array([r.toxic for r in rows], np.int64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    sent = T.Sent(docs.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for keys, block in T.read(batches):
            yield T.batch(schema, doc_id=keys, score=sent.value.scores(block))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(T.lean(run), "doc_id long, score double")


def kept(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7) -> DataFrame:
    """docs, all columns kept, without the rows that score `least` or more."""
    sent = T.Sent(docs.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [sent.value.scores(block) for block in T.blocks(b.column(b.schema.get_field_index(text)))]
            yield b.filter(pa.array(np.concatenate(scores) < least)) if scores else b

    return docs.mapInArrow(T.lean(run), docs.schema)
