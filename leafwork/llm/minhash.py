"""Document fingerprints by MinHash, what they say of edited texts, and near copies found through them.

A text is lower-cased (A-Z), cut into words, and its shingles of five words (the whole sequence, if fewer) are hashed to 64 bits.
Each of 128 universal hash functions keeps its least value over the shingles; the share of functions on which two texts
agree estimates the Jaccard similarity of their shingles.  Near copies agree on a whole band of functions: bands are joined in
Spark, and what they propose is verified on the shingles themselves.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, cut, drop, passes
from .simhash import components

FUNCTIONS, BAND = 128, 6
EMPTY = 0xFFFFFFFF  # what every function has for a text without words


class Sketcher:
    """Shingles and signatures of texts.

    A word's hash is a polynomial of a random value for each byte (one for both cases of A-Z), mod 2^64; those of all words
    come from one running sum over the text.
    """

    def __init__(self, functions: int = FUNCTIONS, width: int = 5, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 31, functions, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 1 << 32, functions, np.uint32)
        self.value = draw.integers(0, 1 << 64, 256, np.uint64)
        self.value[ord("A") : ord("Z") + 1] = self.value[ord("a") : ord("z") + 1]
        self.base = int(draw.integers(0, 1 << 61)) * 8 + 5
        self.power = self.back = np.ones(1, np.uint64)  # powers of the base and of its inverse
        self.inner = np.ones(256, bool)
        self.inner[list(b" \t\n\r\x0b\x0c")] = False
        self.room, self.width = np.empty((1024, functions), np.uint32), width

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ends): of each word of a text, in order."""
        b, u = np.frombuffer(text, np.uint8), np.uint64
        inner = self.inner[b]
        edges = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(b) >= len(self.power):
            steps = np.full(2 * len(b), self.base, u), np.full(2 * len(b), pow(self.base, -1, 1 << 64), u)
            self.power, self.back = (np.concatenate([np.ones(1, u), np.cumprod(s)]) for s in steps)
        sums = np.zeros(len(b) + 1, u)
        np.cumsum(self.value[b] * self.power[: len(b)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.back[starts]
        h ^= h >> u(32)
        h *= u(0xD6E8FEB86659FD93)
        h ^= h >> u(32)
        return h, ends

    def runs(self, h: np.ndarray) -> np.ndarray:
        """The shingles of hashed words as 64-bit hashes, in order, repeats included."""
        n, width = len(h), min(self.width, len(h))
        if not n:
            return h
        out, u = np.full(n - width + 1, width, np.uint64), np.uint64
        for j in range(width):
            out *= u(0x9E3779B97F4A7C15)
            out += h[j : n - width + 1 + j]
            out ^= out >> u(29)
        out *= u(0xBF58476D1CE4E5B9)
        return out

    def shingles(self, text: bytes) -> np.ndarray:
        """The distinct shingles of a text as sorted 64-bit hashes."""
        return distinct(self.runs(self.words(text)[0]))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Each function's least value: a x + b mod 2^32, a permutation as a is odd, x being the upper half of a shingle.

        Repeats do no harm, and the signature of a union is the least of the signatures.
        """
        out = np.full(len(self.a), EMPTY, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), len(self.room)):
            part = x[i : i + len(self.room)]
            room = self.room[: len(part)]
            np.multiply(part[:, None], self.a, out=room)
            room += self.b
            np.minimum(out, room.min(axis=0), out=out)
        return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of functions on which two signatures agree."""
    return float((a == b).mean())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingles; texts without words are alike."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the head of another."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _bounds(ids: DataFrame, parts: int) -> np.ndarray:
    """At most parts - 1 ids that cut the rows about evenly."""
    probabilities = [k / parts for k in range(1, parts)]
    found = ids.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", probabilities, 0.25 / parts) if parts > 1 else []
    return np.unique(np.array(found, float))


def with_edits(docs: DataFrame, classes: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", runs_per_partition: int = 4) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    jaccard_edited, jaccard_next, class_id.

    Each document is compared with its edited text, whose last quarter is the head of the next document, and with the next
    document itself, by ascending doc_id, a null one first, and rows of one id by the hash of their text; after the last
    comes the first.  ``class_id`` is what ``classes`` (same, class_id; see ``near_copies``) has for the text, else the doc_id itself.
    Null texts count as empty, and texts without words are alike.  Repeated rows are documents each.  An empty table gives no
    rows; other columns are ignored.

    The ids are cut into runs of about equal size; texts move once, compressed, to their run, and go through a task in order, two at
    a time.  The first text of each run goes to the run before it as well, and classes go to the run of their document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).withColumn("same", F.xxhash64("text"))
    bounds = spark.sparkContext.broadcast(_bounds(rows.select("doc_id"), runs_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    told = rows.select("doc_id", "same", "text", F.lit(None).cast("long").alias("class_id"), F.lit(1).alias("kind"))
    if classes is not None:
        named = rows.select("doc_id", "same").join(classes, "same")
        told = told.unionByName(named.select("doc_id", "same", F.lit(None).cast("binary").alias("text"), "class_id", F.lit(0).alias("kind")))

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            ids = b.column(0).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            run = pa.array(np.searchsorted(bounds.value, ids, side="right").astype(np.int32))
            text = pa.array([None if t is None else pack(t) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([run, *b.columns[:2], text, *b.columns[3:]], ["run", "doc_id", "same", "text", "class_id", "kind"])

    kind = "run int, doc_id long, same long, text binary, class_id long, kind int"
    dealt = told.mapInArrow(deal, kind)
    firsts = rows.select("doc_id", "same", "text", F.lit(None).cast("long").alias("class_id"), F.lit(2).alias("kind")).mapInArrow(deal, kind)
    heads = cut(firsts.groupBy("run").agg(F.min_by("text", F.struct("doc_id", "same")).alias("text")))
    last = heads.agg(F.max("run")).first()[0]
    before = F.coalesce(F.lag("run").over(Window.orderBy("run")), F.lit(last))  # of as many rows as there are runs
    heads = heads.join(heads.select("run", before.alias("before")), "run")
    none = F.lit(None).cast("long")
    dealt = dealt.unionByName(heads.select(F.col("before").alias("run"), none.alias("doc_id"), none.alias("same"), "text", none.alias("class_id"), F.lit(2).alias("kind")))
    return _compared(dealt.repartition("run").sortWithinPartitions("run", F.col("kind") == 2, "doc_id", "same", "kind"))


def _compared(rows: DataFrame) -> DataFrame:
    """Each text against the one after it; a run ends in the first text of the next one, and a class comes before its text."""
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double, class_id long"
    names = [p.split()[0] for p in kind.split(", ")]
    as_rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "fingerprint" in n or n == "edited_sha256" else pa.float64() if "_" in n and n.split("_")[0] in ("near", "jaccard") else pa.int64()) for c, n in zip(zip(*out), names)], names)

    def run(batches):
        sketch, unpack, held, out, known = Sketcher(), zstandard.ZstdDecompressor().decompress, None, [], (None, None, None)
        for b in batches:
            for doc_id, same, raw, class_id, what in zip(*(c.to_pylist() for c in b.columns)):
                if what == 0:
                    known = (doc_id, same, class_id)
                    continue
                now = _sketched(sketch, unpack(raw)) | {"doc_id": doc_id, "class_id": known[2] if known[:2] == (doc_id, same) and known[2] is not None else doc_id, "last": what == 2}
                if held is not None and not held["last"]:
                    out.append(_against(sketch, held, now))
                held = now
                if len(out) >= 512:
                    yield as_rows(out)
                    out = []
        if out:
            yield as_rows(out)

    return rows.select("doc_id", "same", "text", "class_id", "kind").mapInArrow(run, kind)


def _sketched(sketch: Sketcher, raw: bytes) -> dict:
    """A text, its shingles and signature, and how many shingles, with what signature, stay as they are when its end is edited."""
    text = raw.decode("utf-8", "replace")
    kept = text[: len(text) - len(text) // 4].encode()
    h, ends = sketch.words(raw)
    whole = int(np.searchsorted(ends, len(kept))) if raw.startswith(kept) else 0  # words with a gap after them before the cut
    runs, stay = sketch.runs(h), max(0, whole - sketch.width + 1)
    head = sketch.signature(runs[:stay])
    return {"text": text, "own": distinct(runs), "stay": stay, "head": head, "signature": np.minimum(head, sketch.signature(runs[stay:]))}


def _against(sketch: Sketcher, this: dict, after: dict) -> tuple:
    data = edited(this["text"], after["text"]).encode()
    runs, own, signature = sketch.runs(sketch.words(data)[0]), this["own"], this["signature"]
    changed = np.minimum(this["head"], sketch.signature(runs[this["stay"] :]))
    return (
        this["doc_id"], len(this["text"]), sha256(data).hexdigest(), as_text(signature), as_text(changed),
        likeness(signature, changed), likeness(signature, after["signature"]), jaccard(own, distinct(runs)), jaccard(own, after["own"]), this["class_id"],
    )


def bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: int = BAND) -> DataFrame:
    """(key, same, size): for every band of every text the key of its values, once for equal texts, all rows of a key in one
    partition, with the text's count of shingles, repeats included; rows without an id are left out."""
    def run(batches):
        sketch = Sketcher()
        for b in batches:
            same, first = np.unique(b.column(0).to_numpy(), return_index=True)
            for at in np.array_split(first, len(first) // 1024 + 1):
                runs = [sketch.runs(sketch.words(b.column(1)[i].as_py())[0]) for i in at.tolist()]
                signs = np.array([sketch.signature(r) for r in runs]).reshape(len(at), -1)
                count = signs.shape[1] // band
                keys = [xxhash.xxh64_intdigest(s[j * band : (j + 1) * band].tobytes(), j) for s in signs for j in range(count)]
                own, size = b.column(0).take(pa.array(np.repeat(at, count))), np.repeat(np.array([len(r) for r in runs], np.int64), count)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), own, pa.array(size)], ["key", "same", "size"])

    return _texts(docs, id_col, text_col).select("same", "text").mapInArrow(run, "key long, same long, size long").repartition("key").distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).where("doc_id is not null")
    return rows.withColumn("same", F.xxhash64("text"))


def near_copies(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", band: int = BAND, leaders: int = 1, room: int = 1 << 18) -> DataFrame:
    """(same, class_id) of all texts that have a copy or near copy: ``same`` is the hash of the text (xxhash64), class_id the smallest
    id of the rows whose texts verified links connect.  Null texts count as empty, texts without words are copies of each other's
    shingles, and rows without an id take no part.  An empty table gives no rows.

    Links are pairs with a Jaccard similarity of ``least`` or more that share a band.  Buckets of the same texts count once.  A
    bucket is cut into blocks of at most about ``room`` shingles, and its texts travel, compressed, to a group for every two of its
    blocks, where ``leaders`` texts at a time are compared with all others, until those left are connected.
    """
    ids = _texts(docs, id_col, text_col).groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    by_key = Window.partitionBy("key")
    shared = bands(docs, id_col, text_col, band).withColumns({"n": F.count(F.lit(1)).over(by_key), "all": F.bit_xor(F.xxhash64("same")).over(by_key)}).where("n > 1")
    open_ = cut(shared.select(F.xxhash64("n", "all").alias("key"), "same", "size").distinct())
    names = cut(open_.select("same").distinct())
    edges = cut(_verified(_candidates(docs, names, text_col), _dealt(open_, room), least, leaders))
    labels = cut(names.join(components(edges).withColumnRenamed("node", "same"), "same", "left").select("same", F.coalesce("component", "same").alias("component")))
    ids = ids.join(labels, "same", "left").withColumn("component", F.coalesce("component", "same"))
    classes = ids.where("copies > 1 or component <> same").select("component").union(labels.where("component <> same").select("component")).distinct()
    ids = cut(ids.join(classes, "component", "left_semi").select("same", "component", "doc_id"))
    out = cut(ids.join(ids.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component").select("same", "class_id"))
    drop(open_, edges)
    return out


def _dealt(buckets: DataFrame, room: int) -> DataFrame:
    """(part, same): buckets (key, same, size) as groups of one block, if that holds all, else of every two blocks."""
    by_key = Window.partitionBy("key")
    before = F.sum(F.least(F.col("size"), F.lit(room)) + 1).over(by_key.orderBy("same").rowsBetween(Window.unboundedPreceding, -1))
    rows = buckets.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / (room + 1))).withColumn("last", F.max("block").over(by_key))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda b: b != F.col("block"))
    other = F.explode(F.when(F.col("last") == 0, F.array(F.col("block"))).otherwise(others))
    return rows.select("key", "same", "block", other.alias("other")).select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("part"), "same")


def _candidates(docs: DataFrame, wanted: DataFrame, text_col: str, log_bits: int = 27) -> DataFrame:
    """(same, text) of the wanted texts, compressed, once each; a filter of constant size leaves most of the others behind, not all."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, log_bits))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            same = b.column(0).to_numpy()
            _, first = np.unique(same, return_index=True)
            at = first[passes(same[first].view(np.uint64), bits.value, log_bits)]
            for i in np.array_split(at, len(at) // 1024 + 1):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array([pack(b.column(1)[j].as_py()) for j in i.tolist()], pa.binary())], ["same", "text"])

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.xxhash64(text).alias("same"), text.alias("text")).mapInArrow(run, "same long, text binary").dropDuplicates(["same"])


def _verified(texts: DataFrame, dealt: DataFrame, least: float, leaders: int) -> DataFrame:
    """(u, v): links that connect what all pairs of a group with a Jaccard similarity of ``least`` or more would connect, fewer than its texts."""
    def run(batches):
        sketch, unpack = Sketcher(), zstandard.ZstdDecompressor().decompress
        part, names, sets, out = None, [], [], []
        as_rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])
        found = lambda: [(names[i], names[j]) for i, j in linked(sets, least, leaders)]
        for b in batches:
            for this, same, raw in zip(*(c.to_pylist() for c in b.columns)):
                if this != part:
                    out += found()
                    part, names, sets = this, [], []
                    if len(out) >= 4096:
                        yield as_rows()
                        out = []
                names.append(same)
                sets.append(sketch.shingles(unpack(raw)))
        out += found()
        if out:
            yield as_rows()

    return texts.join(dealt, "same").select("part", "same", "text").repartition("part").sortWithinPartitions("part", "same").mapInArrow(run, "u long, v long")


def linked(sets: list[np.ndarray], least: float, leaders: int = 1) -> list[tuple[int, int]]:
    """Links (i, j) of sets of shingles, a forest that connects what all pairs with a Jaccard similarity of ``least`` or more connect.

    A set is compared with all others at once, through the places of its shingles; sets of the smallest components come first,
    and none is left to compare when those not yet taken are connected.
    """
    n, out = len(sets), []
    if n < 3:
        return [(0, 1)] if n == 2 and jaccard(*sets) >= least else out
    sizes, label, left = np.array([len(s) for s in sets]), np.arange(n), np.arange(n)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    while len(left):
        own, count = label[left], np.bincount(label[left])
        if count[own[0]] == len(left):
            break
        order = np.argsort(count[own], kind="stable")
        for i in left[order[:leaders]].tolist():
            low, high = np.searchsorted(every, sets[i]), np.searchsorted(every, sets[i], "right")
            skip = np.repeat(high - np.cumsum(high - low), high - low)
            both = np.bincount(owner[skip + np.arange(len(skip))], minlength=n)
            alike = both / (sizes[i] + sizes - both) >= least if sizes[i] else sizes == 0
            labels, first = np.unique(label[alike], return_index=True)
            out += [(i, int(j)) for l, j in zip(labels.tolist(), np.flatnonzero(alike)[first].tolist()) if l != label[i]]
            label[np.isin(label, labels)] = labels.min()
        left = left[order[leaders:]]
        left.sort()
    return out
