"""SimHash near-duplicate detection by a binary trie self-join.

A fingerprint links to another when at most ``budget`` of 64 bits differ.  By the pigeonhole principle two
linked fingerprints agree on one of ``budget + 1`` blocks of bits, so each fingerprint is rotated once per block
and dealt by (rotation, leading block): that block is the path from the root of the trie to an inner node, and
each task owns whole subtries.  Within a subtrie the join walks pairs of nodes together, bit by bit, adds up
the differing bits and drops a pair as soon as its budget is spent.  All node pairs of a level move together as
NumPy arrays.  Only a spanning forest of each task's links leaves it, and components are then joined by
alternating large-star and small-star rounds.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """Hashes of the word shingles of UTF-8 text, repeats and all; of the whole text if it has no more words than that."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        shingles = [joined[a:b] for a, b in zip((ends - sizes).tolist(), ends[width - 1 :].tolist())]
    return np.fromiter(map(_hash, shingles), np.uint64, len(shingles))


def simhash(h: np.ndarray) -> int:
    """SimHash of shingle hashes, as a signed 64-bit integer; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the word shingles of UTF-8 text, as a signed 64-bit integer; 0 without words."""
    return simhash(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp).  A null text has no words."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _expand(a0, a1, b0, b1):
    """All index pairs of the ranges; of a range with itself, each pair once."""
    size = (a1 - a0) * (b1 - b0)
    own = np.repeat(np.arange(len(a0)), size)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    wide = (b1 - b0)[own]
    i, j = a0[own] + at // wide, b0[own] + at % wide
    keep = i < j
    return i[keep], j[keep]


def trie_links(group: np.ndarray, fp: np.ndarray, free_bits: int, budget: int, leaf: int = 64, chunk: int = 1 << 17):
    """Yield arrays (i, j) of linked positions, from node pairs walked down together.

    ``group`` is the subtrie of each row and ``fp`` its rotated fingerprint; rows are sorted by both.  The first
    ``64 - free_bits`` bits are equal within a subtrie.  Node pairs with few leaves below are compared directly.  At most
    ``chunk`` node pairs go down a level at once; the others wait, so that memory grows with the rows and not with the pairs.
    """
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    last = np.r_[first[1:], n] if n else first
    a0, a1 = first[last - first > 1], last[last - first > 1]
    ones: dict[int, np.ndarray] = {}
    waiting = [(free_bits - 1, a0, a1, a0, a1, np.full(len(a0), budget, np.int8))]
    while waiting:
        bit, a0, a1, b0, b1, left = waiting.pop()
        if len(a0) > chunk:
            half = len(a0) // 2
            waiting += [(bit, *(x[half:] for x in (a0, a1, b0, b1, left))), (bit, *(x[:half] for x in (a0, a1, b0, b1, left)))]
            continue
        size = (a1 - a0) * (b1 - b0)
        small = (size <= leaf) | (bit < 0)
        for part in np.array_split(np.flatnonzero(small), max(1, int(size[small].sum() // (4 * chunk)))):
            i, j = _expand(a0[part], a1[part], b0[part], b1[part])
            near = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            yield i[near], j[near]
        if bit < 0 or small.all():
            continue
        a0, a1, b0, b1, left = (x[~small] for x in (a0, a1, b0, b1, left))
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)]
        o = ones[bit]
        am, bm = a1 - (o[a1] - o[a0]), b1 - (o[b1] - o[b0])
        same = a0 == b0
        kids = [(a0, am, b0, bm, left), (am, a1, bm, b1, left), (a0, am, bm, b1, left - 1)]
        kids.append(tuple(x[~same] for x in (am, a1, b0, bm, left - 1)))  # of a node with itself, its mirror image
        a0, a1, b0, b1, left = (np.concatenate(x) for x in zip(*kids))
        keep = (a1 > a0) & (b1 > b0) & (left >= 0)
        waiting.append((bit - 1, *(x[keep] for x in (a0, a1, b0, b1, left))))


def _forest(n: int, links) -> np.ndarray:
    """The smallest position in the component of each position."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            i, j = root[i], root[j]
            far = i != j
            i, j = np.maximum(i[far], j[far]), np.minimum(i[far], j[far])
            np.minimum.at(root, i, j)
            while (root != root[root]).any():
                root = root[root]
    return root


def links(nodes: DataFrame, budget: int = 3, task_rows: int = 1_000_000, held_rows: int = 65_536) -> DataFrame:
    """Edges (u, v), u > v, that connect all nodes (fp, node) whose fingerprints differ in at most budget bits.

    Nodes without an id are left aside; an empty table gives no edges.  There are as many tasks as leave each about
    ``task_rows`` dealt fingerprints, and a task holds whole subtries of ``held_rows`` together, or one subtrie, at a time.
    """
    if not 0 <= budget < 16:
        raise ValueError("budget must be from 0 to 15")
    blocks = budget + 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    free = 64 - min(b - a for a, b in zip(cuts, cuts[1:]))

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            node = b.column(1)
            for k in range(blocks):
                s = np.uint64(cuts[k])
                turned = (fp << s) | (fp >> (np.uint64(64) - s)) if cuts[k] else fp
                head = (turned >> np.uint64(64 - (cuts[k + 1] - cuts[k]))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(head * blocks + k), pa.array(turned.view(np.int64)), node], ["subtrie", "fp", "node"])

    def whole_subtries(batches):
        """Arrays (subtrie, fp, node) of whole subtries, from rows sorted by subtrie."""
        held, n = [], 0
        for b in batches:
            part = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if n >= held_rows and len(part[0]):
                edge = np.searchsorted(part[0], held[-1][0][-1], side="right")  # the last subtrie held may go on here
                held.append([x[:edge] for x in part])
                if edge < len(part[0]):
                    yield [np.concatenate(x) for x in zip(*held)]
                    held, n, part = [], 0, [x[edge:] for x in part]
                else:
                    continue
            if len(part[0]):
                held.append(part)
                n += len(part[0])
        if held:
            yield [np.concatenate(x) for x in zip(*held)]

    def join(batches):
        for group, fp, node in whole_subtries(batches):
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, group))
            group, fp, node = group[order], fp[order], node[order]
            root = _forest(len(fp), trie_links(group, fp, free, budget))
            i = np.flatnonzero(root != np.arange(len(root)))
            u, v = node[i], node[root[i]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    nodes = nodes.where("node is not null").select("fp", "node")
    dealt = nodes.mapInArrow(deal, "subtrie long, fp long, node long")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * blocks // task_rows))
    return dealt.repartition(parts, "subtrie").sortWithinPartitions("subtrie").mapInArrow(join, "u long, v long").where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node with an edge (u, v).

    Rounds needed grow with the logarithm of the longest chain; more than ``max_rounds`` are an error, never a partial
    answer.  Repeated edges and loops do no harm; no edges give no rows.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours go to its smallest neighbour (or itself).
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, budget: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (smallest doc_id reachable, itself included).

    Texts without words have fingerprint zero and link like any other.  Repeated rows give repeated rows; a row
    with a null doc_id takes part through its fingerprint, and its component is null if no other row shares it.
    An empty table gives an empty result; columns other than the two read are ignored.
    """
    prints = cut(fingerprints(docs, width, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes, budget))
    known = cut(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = 3, width: int = 3) -> DataFrame:
    """The columns of docs, one document of each component: the one with the smallest doc_id.

    Rows that repeat that doc_id give one row: the one with the smallest text, any of those with equal texts.  Rows
    without a doc_id cannot be named and all stay.  Columns of any type and name are kept.  An empty table stays empty.
    """
    return keep_smallest(docs, near_duplicates(docs, budget, width))


def keep_smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keep_one for components that are known: rows (doc_id, component_id)."""
    classes = found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(classes, "doc_id", "left_anti").select(*docs.columns)
    twice = kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    rest = kept.join(twice, "doc_id", "left_semi").select(F.struct("*").alias("r")).groupBy("r.doc_id").agg(F.min_by("r", F.coalesce("r.text", F.lit(""))).alias("r"))
    return once.unionByName(rest.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))
