"""Near copies by the Jaccard similarity of word shingles, none left out.

SimHash links within three bits come first, but texts at the similarity asked for may differ in ten bits and more, and
a Hamming budget that wide deals fingerprints by so few bits that the join grows with the square of the table.  So
the rest comes from a prefix join: in any fixed order of all shingles, two sets that are similar enough share one among
the first few of each.  The order puts shingles last that a sample found common, or that stand in many prefixes of a
first round, and follows the hash otherwise; it decides how long the lists get, never what is found.  Candidates whose shingle counts in 256 buckets differ
by more than the sets may differ are dropped, which loses none, and the others are checked on whole shingle sets.

Lists are first linked as stars and then, where their members still lie in different components, pair by pair, so
that a large group of near copies costs what its members cost, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, drop, passes
from .simhash import components, keep_smallest, links, shingle_hashes, simhash

ENTRY = np.dtype([("token", "<i8"), ("key", "<i8"), ("n", "<i4"), ("pos", "<i4")])
LISTS = "token long, key long, n int, pos int, center long, near boolean"


def text_key(text: bytes | None) -> int:
    """Hash of the words of a text, equal for texts with equal words; signed."""
    return xxhash.xxh3_64_intdigest(b" ".join((text or b"").lower().split())) - (1 << 63)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def _similar(common, a, b, num: int, den: int):
    """Whether sets of a and b shingles with so many in common reach num / den."""
    return common * (num + den) >= num * (a + b)


def _sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of 256 buckets of their hash, 255 at most."""
    return np.minimum(np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)


def _sketches_allow(a, b, n, m, num: int, den: int):
    """False only where the sets must differ too much: they differ in at least what the counts differ in."""
    return np.abs(a - b).sum(axis=1) * (num + den) <= (den - num) * (n + m)


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _prints(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            keys, fps, sizes, sketches = [], [], [], []
            for t in texts:
                h = shingle_hashes(t, width)
                own = np.unique(h)
                keys.append(text_key(t))
                fps.append(simhash(h))
                sizes.append(len(own))
                sketches.append(_sketch(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], ["doc_id", "key", "fp", "n", "sketch"])

    return _ids_and_texts(docs).mapInArrow(run, "doc_id long, key long, fp long, n int, sketch binary")


def _common(docs: DataFrame, rows: int, width: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of documents holds three times and more, ascending, and how often; at most ``most``."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["token"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1_000_000, sample * 1_000_000 // max(rows, 1)))
    got = _ids_and_texts(part).mapInArrow(run, "token long").groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(most).toArrow()
    token, count = (got.column(k).to_numpy() for k in range(2))
    order = np.argsort(token)
    return token[order], count[order]


def _prefix(shingles: np.ndarray, token: np.ndarray, count: np.ndarray, num: int, den: int, often: np.ndarray | None = None, log_bits: int = 0) -> np.ndarray:
    """The shingles, rare ones first, of which two similar sets share one at least."""
    rank = np.zeros(len(shingles), np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, shingles), len(token) - 1)
        rank = np.where(token[at] == shingles, count[at], 0)
    if often is not None:
        rank = np.maximum(rank, passes(shingles.view(np.uint64), often, log_bits))
    n = len(shingles)
    return shingles[np.lexsort((shingles, rank))[: n + num * n // -den + 1]]


def _often(docs: DataFrame, common, width: int, num: int, den: int, above: int, log_bits: int) -> np.ndarray:
    """A filter of the shingles that stand in more than ``above`` prefixes when only the sample orders them."""

    def run(batches):
        token, count = common.value
        for b in batches:
            texts = {text_key(t): t for t in b.column(1).to_pylist()}.values()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *[_prefix(shingle_set(t, width).view(np.int64), token, count, num, den) for t in texts]]))], ["token"])

    counted = _ids_and_texts(docs).mapInArrow(run, "token long").groupBy("token").count()
    return bit_filter(counted.where(F.col("count") > above).select("token"), log_bits)


def _lists(docs: DataFrame, rows: int, width: int, num: int, den: int, sample: int, most: int, above: int, log_bits: int) -> DataFrame:
    """Shingles that stand in the prefixes of two texts and more, with these texts' keys, sizes and positions; ``center``
    is the least key of each, and ``near`` whether sizes and positions allow a link to it."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_common(docs, rows, width, sample, most))
    often = spark.sparkContext.broadcast(_often(docs, sent, width, num, den, above, log_bits))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts

    def deal(batches):
        token, count = sent.value
        for b in batches:
            seen, out = set(), [np.empty(0, ENTRY)]
            for t in b.column(1).to_pylist():
                key, own = text_key(t), shingle_set(t, width).view(np.int64)
                if key in seen or not len(own):
                    continue
                seen.add(key)
                first = _prefix(own, token, count, num, den, often.value, log_bits)
                e = np.empty(len(first), ENTRY)
                e["token"], e["key"], e["n"], e["pos"] = first, key, len(own), np.arange(len(first))
                out.append(e)
            e = np.concatenate(out)
            bucket = e["token"] % buckets
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(e) else np.empty(0, np.int64)
            rows = [x.tobytes() for x in np.split(e, cuts[1:])] if len(e) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(rows, pa.binary())], ["bucket", "entries"])

    def gather(batches):
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(k, []).append(x)
        for k in list(by):
            e = np.frombuffer(b"".join(by.pop(k)), ENTRY)
            e = e[np.lexsort((e["key"], e["token"]))]
            e = e[np.r_[True, (e["token"][1:] != e["token"][:-1]) | (e["key"][1:] != e["key"][:-1])]]
            start = np.flatnonzero(np.r_[True, e["token"][1:] != e["token"][:-1]])
            size = np.diff(np.r_[start, len(e)])
            head = e[np.repeat(start, size)]
            near = _may_link(e, head, num, den)
            keep = np.repeat(size > 1, size)
            cols = [e["token"], e["key"], e["n"], e["pos"], head["key"], near]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[keep])) for x in cols], ["token", "key", "n", "pos", "center", "near"])

    dealt = _ids_and_texts(docs).mapInArrow(deal, "bucket long, entries binary")
    return dealt.repartition(parts, "bucket").mapInArrow(gather, LISTS)


def _may_link(a, b, num: int, den: int):
    """Whether sizes and positions of one shingle, if it is the first that both share, leave room for enough others."""
    n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
    return _similar(np.minimum(n - a["pos"], m - b["pos"]), n, m, num, den)


def _pairs_between(lists: DataFrame, num: int, den: int, leaders: int | None = None) -> DataFrame:
    """Pairs (u, v) that share a list, may link and lie in different components; lists has token, key, n, pos, component, sketch.

    ``leaders``: only pairs of a list's first member of each of so many components.
    """

    def run(batches):
        got = [x for x in batches if len(x)]
        if not got:
            return
        token, key, n, pos, comp = (np.concatenate([x.column(k).to_numpy() for x in got]) for k in range(5))
        order = np.argsort(token, kind="stable")
        sketch = np.concatenate([_sketches(x.column(5)).astype(np.uint8) for x in got])[order]
        token, key, comp = token[order], key[order], comp[order]
        e = np.empty(len(token), ENTRY)
        e["n"], e["pos"] = n[order], pos[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)]
        found: set[tuple[int, int]] = set()
        for a, b in zip(cuts, cuts[1:]):
            if (comp[a:b] == comp[a]).all():
                continue
            for i in range(a, b - 1) if leaders is None else a + np.sort(np.unique(comp[a:b], return_index=True)[1])[:leaders]:
                to = i + 1 if leaders is None else a
                j = to + np.flatnonzero((comp[to:b] != comp[i]) & _may_link(e[i : i + 1], e[to:b], num, den))
                j = j[_sketches_allow(sketch[j].astype(np.int16), sketch[i].astype(np.int16), e["n"][j].astype(np.int64), int(e["n"][i]), num, den)]
                found.update(zip(np.maximum(key[i], key[j]).tolist(), np.minimum(key[i], key[j]).tolist()))
            if len(found) > 1_000_000:
                yield _pairs(found)
                found = set()
        yield _pairs(found)

    return lists.select("token", "key", "n", "pos", "component", "sketch").repartition("token").mapInArrow(run, "u long, v long").distinct()


def _pairs(found) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _sets(docs: DataFrame, needed: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """Rows (key, shingles) of the texts that ``needed`` (doc_id, key) names, and of texts without a doc_id."""
    ids = None
    if needed.count() <= broadcast_rows:  # saves hashing the other texts; the join decides in either case
        ids = docs.sparkSession.sparkContext.broadcast(np.unique(needed.where("doc_id is not null").select("doc_id").toArrow().column(0).to_numpy()))

    def run(batches):
        for b in batches:
            id_, texts = b.column(0), b.column(1)
            if ids is not None:
                hit = np.isin(id_.fill_null(0).to_numpy(zero_copy_only=False), ids.value) | id_.is_null().to_numpy(zero_copy_only=False)
                texts = texts.filter(pa.array(hit))
            texts = texts.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(text_key, texts), pa.int64()), pa.array([shingle_set(t, width).tobytes() for t in texts], pa.binary())], ["key", "shingles"])

    made = _ids_and_texts(docs).mapInArrow(run, "key long, shingles binary")
    return made.join(needed.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sketches allow a link."""

    def run(batches):
        for b in batches:
            if len(b):
                n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                ok = _sketches_allow(_sketches(b.column(4)), _sketches(b.column(5)), n, m, num, den)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok))

    u, v = (nodes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets reach the similarity."""

    def run(batches):
        for b in batches:
            a, c = ([np.frombuffer(x, np.uint64) for x in b.column(k).to_pylist()] for k in (2, 3))
            ok = [bool(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), num, den)) for x, y in zip(a, c)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, budget: int = 3, sample: int = 10_000, most: int = 1_000_000, above: int = 8, log_bits: int = 27, broadcast_rows: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable over links of similarity num / den or more).

    Texts with equal words are equal; a text of fewer than ``width`` words is one shingle.  A row with a null doc_id
    takes part through its text, and its component is null if no other row shares it.
    """
    prints = cut(_prints(docs, width))
    nodes = cut(prints.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    lists = cut(_lists(docs, prints.count(), width, num, den, sample, most, above, log_bits))
    # Equal fingerprints are one node of the trie; their texts are linked to the least of them.
    by_fp = cut(nodes.groupBy("fp").agg(F.min("key").alias("node")))
    same_fp = nodes.join(by_fp, "fp").where("key <> node").select(F.col("key").alias("u"), F.col("node").alias("v"))
    stars = lists.where("near and key <> center").select(F.col("key").alias("u"), F.col("center").alias("v"))
    first = stars.unionByName(same_fp).unionByName(links(by_fp, budget).select("u", "v")).distinct()

    def checked(pairs):
        pairs = cut(pairs)
        named = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
        needed = cut(nodes.join(named, "key", "left_semi").select("doc_id", "key"))
        sets = cut(_sets(docs, needed, width, broadcast_rows))
        out = cut(_verified(pairs, sets, num, den))
        drop(pairs, needed, sets)  # whole shingle sets are as large as the texts
        return out

    edges = checked(_possible(first, nodes, num, den))
    comps = cut(components(edges))
    for leaders in (4, None):
        placed = lists.join(nodes.select("key", "sketch"), "key").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        more = checked(_pairs_between(placed, num, den, leaders))
        edges = edges.unionByName(more)
        if not more.isEmpty():
            comps = cut(components(edges))
    root = nodes.join(comps.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("root"))
    least = root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", "key").join(cut(root.join(least, "root").select("key", "component_id")), "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, one document of each component of near copies: the one with the smallest doc_id."""
    return keep_smallest(docs, near_copies(docs, **options))
