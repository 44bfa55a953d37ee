"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are counted over whole texts: words and runs of three characters, each hashed to a fixed number of places, and the
surface of the text (neighbouring kinds of characters, letters, repeated and shouted words).  Counts of a bounded sample
of labelled documents give inverse document frequencies, a truncated singular value decomposition of the three kinds
together, and labelled vectors; these are broadcast.  Every document is projected in the same way and compared with all
labelled vectors by exact blocked cosine products, and its k nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, free

WORDS, RUNS = 1 << 15, 1 << 12
_classes = np.zeros(256, np.int64)  # 0 lower-case letters, then kinds of characters, each ASCII sign by itself
_classes[ord("A") : ord("Z") + 1] = 1
_classes[ord("0") : ord("9") + 1] = 2
_classes[:33] = 3
_classes[ord(" ")], _classes[ord("\n")] = 4, 5
_classes[128:] = 6
_signs = [c for c in range(33, 127) if not chr(c).isalnum()]
_classes[_signs] = np.arange(7, 7 + len(_signs))
_n_classes = 7 + len(_signs)
_letters = np.full(256, 26, np.int64)
_letters[97:123] = _letters[65:91] = np.arange(26)
SURFACE = _n_classes**2 + 26 + 5
TERMS = WORDS + RUNS + SURFACE
#: Where the three kinds of terms begin and end.
KINDS = np.array([0, WORDS, WORDS + RUNS, TERMS])


def _surface(raw: np.ndarray, words: list[bytes], kinds: int) -> np.ndarray:
    """Counts of neighbouring kinds of characters, of letters, and of words doubled, shouted, titled, repeated and in all."""
    out = np.zeros(SURFACE)
    n = _n_classes**2
    of = _classes[raw]
    out[:n] = np.bincount(of[:-1] * _n_classes + of[1:], minlength=n)
    out[n : n + 26] = np.bincount(_letters[raw], minlength=27)[:26]
    out[n + 26 :] = (sum(map(bytes.__eq__, words, words[1:])), sum(map(bytes.isupper, words)), sum(map(bytes.istitle, words)), len(words) - kinds, len(words))
    return out


def counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places, ascending, and counts of the terms of UTF-8 text."""
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    words, low = text.split(), text.lower()
    seen = Counter(low.split())
    place = np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)) % WORDS
    dense = np.zeros(TERMS - WORDS)
    if len(raw) > 2:
        c = np.frombuffer(low, np.uint8).astype(np.uint32)
        run = ((c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        dense[:RUNS] = np.bincount(run, minlength=RUNS)
    dense[RUNS:] = _surface(raw, words, len(set(words)))
    word = np.bincount(place, np.fromiter(seen.values(), float, len(seen)), minlength=1) if len(seen) else np.zeros(1)
    at, more = np.flatnonzero(word), np.flatnonzero(dense)
    return np.r_[at, more + WORDS].astype(np.int32), np.r_[word[at], dense[more]].astype(np.float32)


def weigh(place: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights; each kind of terms that a text has counts the same."""
    w = np.sqrt(count) * idf[place]
    cuts = np.searchsorted(place, KINDS)
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            w[a:b] /= max(float(np.linalg.norm(w[a:b])), 1e-12)
    return w


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def latent_space(terms: list[tuple[np.ndarray, np.ndarray]], rank: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(idf, directions): the leading right singular vectors of the weighted terms of a sample, by subspace iteration on sparse rows."""
    n = len(terms)
    often = np.zeros(TERMS)
    for place, _ in terms:
        often[place] += 1
    idf = (np.log((1 + n) / (1 + often)) + 1).astype(np.float32)
    rows = [(place, weigh(place, count, idf)) for place, count in terms]

    def times(q: np.ndarray) -> np.ndarray:
        return np.stack([w @ q[place] for place, w in rows])

    rank = min(rank, n)
    q = np.random.default_rng(seed).standard_normal((TERMS, min(rank + 8, n))).astype(np.float32)
    for _ in range(6):
        y = times(q)
        q = np.zeros_like(q)
        for (place, w), v in zip(rows, y):
            q[place] += w[:, None] * v
        q, _ = np.linalg.qr(q)
    _, _, v = np.linalg.svd(times(q), full_matrices=False)
    return idf, (q @ v.T)[:, :rank].astype(np.float32)


def project(terms: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return unit(np.stack([weigh(place, count, idf) @ directions[place] for place, count in terms]))


def vote(z: np.ndarray, known: np.ndarray, labels: np.ndarray, k: int, prior: float, power: int = 8) -> np.ndarray:
    """Share of label 1 among the k most similar known vectors, weighted by similarity to a power; the prior where all are unlike."""
    cos = z @ known.T
    k = min(k, len(known))
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** power
    total = w.sum(axis=1)
    return np.where(total > 1e-9, (w * labels[near]).sum(axis=1) / np.maximum(total, 1e-9), prior)


class Model:
    """Arrays that score texts; made of them alone, so that they can be broadcast."""

    def __init__(self, idf, directions, known, labels, k: int):
        self.idf, self.directions, self.known, self.labels, self.k = idf, directions, known, labels, k
        self.prior = float(labels.mean())

    @property
    def parts(self) -> tuple:
        return self.idf, self.directions, self.known, self.labels, self.k

    @classmethod
    def fitted(cls, terms: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int, k: int) -> Model:
        idf, directions = latent_space(terms, rank)
        return cls(idf, directions, project(terms, idf, directions), labels.astype(np.float64), k)

    def score(self, texts: list[bytes | None], block: int = 256) -> np.ndarray:
        out = np.empty(len(texts))
        for i in range(0, len(texts), block):
            part = texts[i : i + block]
            out[i : i + block] = vote(project([counts(t) for t in part], self.idf, self.directions), self.known, self.labels, self.k, self.prior)
            out[i : i + block][[not t for t in part]] = self.prior
        return out


def held_out(doc_id):
    return crc_of_id(doc_id) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, rank: int = 16, k: int = 9) -> Model | None:
    """Fit on the documents of at most ``sample_rows`` labels that are not held out, those with the smallest hash of their id.

    Labels of a repeated id are averaged, and of rows that repeat an id one is taken, so each id counts once; null labels
    and labels without a document are left aside.  None if no labelled document remains.  One task fits the bounded
    sample, and the driver receives the model's arrays alone.
    """
    picked = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    picked = picked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches):
        for b in batches:
            got = [counts(t) for t in b.column("text").to_pylist()]
            packed = [place.tobytes() + count.tobytes() for place, count in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality").cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "quality", "x"])

    def fit_one(batches):
        """The model of a sample of at most ``sample_rows`` rows, in one task; only its arrays leave it."""
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        if rows:
            terms = [(np.frombuffer(x, np.int32, len(x) // 8), np.frombuffer(x, np.float32, len(x) // 8, len(x) // 2)) for _, _, x in rows]
            idf, directions, known, labels, _ = Model.fitted(terms, np.array([y for _, y, _ in rows]), rank, k).parts
            arrays = [idf, directions, known.astype(np.float32), labels.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in arrays], pa.binary())], ["part", "data"])

    sample = rows.mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.max("x").alias("x"))
    got = sample.repartition(1).mapInArrow(fit_one, "part int, data binary").orderBy("part").toArrow()
    if not got.num_rows:
        return None
    idf, directions, known, labels = (np.frombuffer(x, np.float32) for x in got["data"].to_pylist())
    return Model(idf, directions.reshape(TERMS, -1), known.reshape(len(labels), -1), labels.astype(np.float64), k)


def score(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher for quality.  Empty and null texts score the share of label 1 in the sample; so does
    everything, at 1, when there was nothing to learn from.  Only the text is read.  A column named ``out`` is replaced, all others stay."""
    docs = docs.withColumn(out, F.lit(1.0))
    if model is None:
        return docs
    spot, text_at = docs.columns.index(out), docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model.parts)  # TERMS x rank and sample_rows x rank floats, whatever the input

    def run(batches):
        model = Model(*sent.value)
        for b in batches:
            texts = b.column(text_at).cast(pa.binary()).to_pylist()
            yield b.set_column(spot, b.schema.field(spot).name, pa.array(model.score(texts), pa.float64()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Repeated rows are scored alike; a null doc_id counts as the empty text when rows are held out; texts of any length are
    read whole, as bytes, so that odd encodings do no harm.  An empty table gives no rows; other columns are ignored.
    """
    scored = score(docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")), fit(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows and columns of docs whose score reaches the threshold; rows are treated as by classify, and columns of any name stay."""
    name = free(docs, "_quality")
    return score(docs, fit(docs, labels, **options), name).where(F.col(name) >= threshold).drop(name)
