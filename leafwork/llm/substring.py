"""Exact removal of repeated word windows, within and across documents, by suffix automata of reference shards.

Every document is a reference, so references are routed instead of broadcast whole.  A window of ``width`` words has an
anchor, the smallest hash among its 8-word grams; equal windows have equal anchors.  A run of windows under one anchor is a
piece: at most 28 windows and the words they cover.  Pass one counts anchors; a filter of fixed size, built from those that
stand in two places, is broadcast.  Pass two sends the pieces whose anchor passes it to the shard of their anchor, equal
pieces as one.  A shard, of bounded size, builds the suffix automaton of its pieces, streams each of them through it and
marks the windows that occur twice.  Pass three removes, document by document, the words that marked windows cover.

Hashes of words and grams only decide where a piece goes; windows are compared word by word in the automaton.  Whole
pieces and texts are told apart by cryptographic digests.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, passes

GRAM, MOST = 8, 28
_word = partial(xxhash.xxh3_64_intdigest, seed=0)
_digest = partial(hashlib.blake2b, digest_size=16)
_u = np.uint64


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x ^ (x >> _u(29))) * _u(0xD6E8FEB86659FD93) + y
    z ^= z >> _u(32)
    return z * _u(0x9E3779B97F4A7C15)


def _grams(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM values."""
    size = 1
    while size < GRAM:
        h = _join(h[:-size], h[size:])
        size *= 2
    return h


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over all runs of n values."""
    size = 1
    while 2 * size <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def anchors(words: list[bytes], width: int, hash_bits: int = 64, level: int = 0):
    """(grams, anchor of each window); None for texts shorter than a window.  Each level has an order of grams of its own."""
    if len(words) < width:
        return None
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    if hash_bits < 64:
        h &= _u((1 << hash_bits) - 1)
    grams = _grams(h)
    if level:
        grams = _join(grams, np.full(len(grams), level, np.uint64))
    return grams, _slide(grams, width - GRAM + 1, np.minimum)


def pieces(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of windows under one anchor, MOST windows at most."""
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[start, len(least)])
    parts = -(-size // MOST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(start, parts) + MOST * nth
    return first, np.minimum(first + MOST, np.repeat(start + size, parts))


def bodies(words: list[bytes], first: np.ndarray, end: np.ndarray, width: int) -> list[bytes]:
    """The words that windows first to end cover, joined by spaces."""
    joined = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.where(first > 0, stop[first - 1], 0)
    return [joined[x:y] for x, y in zip(begin.tolist(), (stop[end + width - 2] - 1).tolist())]


class Automaton:
    """Suffix automaton of a sequence, with the number of places where each state's strings end."""

    def __init__(self, sequence):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]
        nxt, link, length, count, last = self.next, self.link, self.length, self.count, 0
        for c in sequence:
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            count.append(1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    count.append(0)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
            last = new
        for v in np.argsort(-np.array(length), kind="stable")[:-1].tolist():
            count[link[v]] += count[v]

    def repeats(self, sequence, width: int) -> list[bool]:
        """Whether each run of width values of the sequence occurs twice in the automaton's own, from matching statistics."""
        nxt, link, length = self.next, self.link, self.length
        v = matched = 0
        out = []
        for k, c in enumerate(sequence, 1):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v, matched = nxt[v][c], matched + 1
            while v and length[link[v]] >= width:
                v = link[v]
                matched = length[v]
            if k >= width:
                out.append(matched >= width and self.count[v] > 1)
        return out


def marked(group: list[bytes], width: int) -> list[int]:
    """For each of a shard's pieces, all different, a mask of its windows that stand twice in the shard."""
    known: dict[bytes, int] = {}
    split = [[known.setdefault(w, len(known)) for w in x.split(b" ")] for x in group]
    joined: list[int] = []
    for i, x in enumerate(split):
        joined += x
        joined.append(-1 - i)
    machine = Automaton(joined)
    return [sum(1 << j for j, hit in enumerate(machine.repeats(x, width)) if hit) for x in split]


def result(words: list[bytes], starts: np.ndarray, width: int) -> tuple[int, int, str, bytes]:
    """(words, words removed, SHA-256 of what is kept, what is kept) when windows at ``starts`` repeat."""
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    gone = np.cumsum(step[:-1]) > 0
    kept = b" ".join(words if not len(starts) else [w for w, g in zip(words, gone.tolist()) if not g])
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept


def _windows(x: bytes, width: int) -> list[bytes]:
    words = x.split(b" ")
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def _marks(found: DataFrame, width: int, shard_pieces: int, level: int = 1, levels: int = 3) -> DataFrame:
    """Rows (anchor, digest, mask) of the pieces in ``found`` (anchor, digest, n, windows, piece) that hold repeated windows.

    An anchor with more kinds of pieces than a shard holds has its pieces cut again by a second anchor, and so on; what
    is still too much at the last level is counted window by window.
    """
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    many = cut(found.join(kinds, "anchor").select("anchor", "digest", "n", "piece", "kinds"))

    def shard(batches):
        """Shards of whole anchors: closed as soon as they hold shard_pieces pieces, so never twice as many."""
        held: list[tuple] = []

        def close():
            masks = marked([x[2] for x in held], width)
            cols = list(zip(*[(a, d, m) for (a, d, _), m in zip(held, masks) if m])) or [(), (), ()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["anchor", "digest", "mask"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(3))):
                if len(held) >= shard_pieces and held[-1][0] != row[0]:
                    yield close()
                held.append(row)
        if held:
            yield close()

    few = many.where(F.col("kinds") <= shard_pieces).select("anchor", "digest", "piece").repartition(parts, "anchor").sortWithinPartitions("anchor")
    small = few.mapInArrow(shard, "anchor long, digest binary, mask long")

    def alone(batches):
        for b in batches:
            masks = [marked([x], width)[0] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int64())], ["anchor", "digest", "mask"])

    # A window that stands twice in one piece of w windows repeats its words after fewer than w.
    loops = found.where("n = 1").where(F.size(F.array_distinct(F.split(F.col("piece").cast("string"), " "))) < F.col("windows"))
    loops = loops.select("anchor", "digest", "piece").mapInArrow(alone, "anchor long, digest binary, mask long")

    def finer(batches):
        names = ["up", "whole", "at", "anchor", "digest", "n", "windows", "piece"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for up, whole, n, x in zip(*(b.column(k).to_pylist() for k in range(4))):
                words = x.split(b" ")
                _, least = anchors(words, width, level=level)
                first, end = pieces(least)
                body = bodies(words, first, end, width)
                key = _join(least[first], np.full(len(first), up, np.int64).view(np.uint64))
                for column, more in zip(out, ([up] * len(body), [whole] * len(body), first.tolist(), key.view(np.int64).tolist(), [_digest(y).digest() for y in body], [n] * len(body), (end - first).tolist(), body)):
                    column += more
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()))], names)

    def windows(batches):
        for b in batches:
            out = [(a, d, n, j, _digest(w).digest()) for a, d, n, x in zip(*(b.column(k).to_pylist() for k in range(4))) for j, w in enumerate(_windows(x, width))]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()))], ["anchor", "digest", "n", "j", "window"])

    hot = many.where(F.col("kinds") > shard_pieces).select("anchor", "digest", "n", "piece")
    if hot.isEmpty():
        hot = hot.select("anchor", "digest", F.lit(0).cast("long").alias("mask"))
    elif level < levels:
        cuts = cut(hot.mapInArrow(finer, "up long, whole binary, at int, anchor long, digest binary, n long, windows int, piece binary"))
        kinds = cut(cuts.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("piece").alias("piece")))
        below = _marks(kinds, width, shard_pieces, level + 1, levels)
        hot = cuts.select("up", "whole", "at", "anchor", "digest").join(below, ["anchor", "digest"]).select(F.col("up").alias("anchor"), F.col("whole").alias("digest"), F.expr("shiftleft(mask, at)").alias("mask"))
    else:
        each = cut(hot.mapInArrow(windows, "anchor long, digest binary, n long, j int, window binary"))
        twice = each.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
        hot = each.join(twice, "window").select("anchor", "digest", F.expr("shiftleft(1L, j)").alias("mask"))
    whole = found.where("n > 1").select("anchor", "digest", F.expr("shiftleft(1L, windows) - 1").alias("mask"))
    return small.unionByName(loops).unionByName(hot).unionByName(whole).groupBy("anchor", "digest").agg(F.bit_or("mask").alias("mask"))


def dedup(docs: DataFrame, width: int = 35, log_bits: int = 27, shard_pieces: int = 256, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Each word goes that lies in a window of ``width`` words whose sequence starts anywhere else too, in the same document
    or another.  Null and empty texts have no words; texts shorter than a window stay whole; repeated rows repeat each
    other's windows and so lose all words of texts of ``width`` words or more.  Words that are not UTF-8 are compared as bytes
    and kept text shows them as Spark does.  An empty table gives no rows; columns other than the two read are ignored.

    ``log_bits`` sets the size of the anchor filter (2 ** 27 bits are 16 MB): a fuller filter lets more pieces through, never fewer.
    """
    if not GRAM <= width or not 6 < log_bits < 34 or shard_pieces < 1:
        raise ValueError(f"width must be at least {GRAM}, log_bits from 7 to 33 and shard_pieces positive")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("key")
    span = width - GRAM + 1

    def count_anchors(batches):
        edge = np.zeros(span - 1, np.uint64)
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                got = anchors(t.split(), width, hash_bits)
                if got:
                    grams, least = got
                    found.append(grams[_slide(np.concatenate([edge, least, edge]), span, np.maximum) == grams])
            if found:
                a, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["anchor", "n"])

    common = rows.select("text").mapInArrow(count_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(common, log_bits))
    names = ["anchor", "digest", "piece", "windows", "key", "start", "n"]

    def send_pieces(batches):
        known = sent.value
        for b in batches:
            copies = Counter(b.column(0).to_pylist())
            texts = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            out: list[list] = [[] for _ in names]
            for k, t in texts.items():
                words = t.split()
                got = anchors(words, width, hash_bits)
                if not got:
                    continue
                first, end = pieces(got[1])
                at = np.flatnonzero(passes(got[1][first], known, log_bits))
                if not len(at):
                    continue
                first, end = first[at], end[at]
                body = bodies(words, first, end, width)
                for column, more in zip(out, (got[1][first].view(np.int64).tolist(), [_digest(x).digest() for x in body], body, (end - first).tolist(), [k] * len(at), first.tolist(), [copies[k]] * len(at))):
                    column += more
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    sent_pieces = cut(rows.select(key, "text").mapInArrow(send_pieces, "anchor long, digest binary, piece binary, windows int, key binary, start int, n long"))
    found = cut(sent_pieces.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("piece").alias("piece")))
    masks = cut(_marks(found, width, shard_pieces))
    hits = sent_pieces.select("anchor", "digest", "key", "start").join(masks, ["anchor", "digest"]).select("key", "start", "mask").distinct()
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("hits"))

    def remove(batches):
        for b in batches:
            found = []
            for t, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                starts = [x["start"] + j for x in at or () for j in range(MOST) if x["mask"] >> j & 1]
                found.append(result(t.split(), np.array(starts, np.int64), width))
            n, gone, sha, kept = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = rows.withColumn("key", key).join(hits, "key", "left").select("doc_id", "text", "hits")
    out = joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
