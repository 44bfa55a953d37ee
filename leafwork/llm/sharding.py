"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of one size are interchangeable, so the packing needs only the histogram of group sizes: its number of
rows is the number of distinct sizes, at most sqrt(2 x total bytes) and far below the number of groups.  One task
packs the histogram, with the bins in a balanced tree; a run of equal groups enters a bin in one step.  Groups, documents and slots never meet in
one task: they take their places from ranks that are counted bucket by bucket.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_rank


class Tree:
    """Ordered pairs in a balanced tree: a treap whose priorities come from a fixed generator."""

    def __init__(self, items=()):
        self.root, self.random = None, random.Random(1)
        for x in items:
            self.add(x)

    def add(self, item) -> None:
        low, high = self._split(self.root, item)
        self.root = self._merge(self._merge(low, [item, self.random.random(), None, None]), high)

    def remove(self, item) -> None:
        low, rest = self._split(self.root, item)
        _, high = self._split(rest, (item[0], item[1] + 1))
        self.root = self._merge(low, high)

    def at_least(self, item):
        """The least pair not below item; None if there is none."""
        node, best = self.root, None
        while node:
            if node[0] >= item:
                node, best = node[2], node[0]
            else:
                node = node[3]
        return best

    def last(self):
        node = self.root
        while node and node[3]:
            node = node[3]
        return node and node[0]

    def _split(self, node, item):
        """Trees of the pairs below item and of the others."""
        if not node:
            return None, None
        if node[0] < item:
            low, high = self._split(node[3], item)
            node[3] = low
            return node, high
        low, high = self._split(node[2], item)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if not a or not b:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(runs: list[tuple[int, int]], shards: int | None = None, capacity: int | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack runs (size, count), sizes falling, and give (size, [(upto, shard), ...]): groups with rank below upto.

    Bins stand by free space in a balanced tree, which gives the tightest that fits.  With ``shards`` their number is fixed: a group above a fair share takes a shard of its own,
    the capacity is a fair share of the rest, and a group that fits nowhere enters the emptiest bin.  With ``capacity``
    new bins open as needed, and a group above the capacity gets a bin of its own.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    free = Tree()
    total, used, out = sum(s * c for s, c in runs), 0, []
    if shards is not None:
        left = shards
        for size, count in runs:
            while count and left > 1 and size * left > total:
                total, left, count = total - size, left - 1, count - 1
            if count:
                break
        used, capacity = shards - left, -(-total // left)
        free = Tree((capacity, b) for b in range(used, shards))
    alone = used
    for size, count in runs:
        done, places = 0, []
        if alone:
            done = min(alone, count)
            places += [(k + 1, used - alone + k) for k in range(done)]
            alone -= done
        while done < count:
            fit = free.at_least((size, -1))
            if fit is None and shards is not None:
                fit = free.at_least((free.last()[0], -1))
            if fit is not None:
                free.remove(fit)
                room, b = fit
                k = min(count - done, max(1, room // size))
            else:
                room, b, k, used = max(capacity, size), used, min(count - done, max(1, capacity // size)), used + 1
            free.add((room - k * size, b))
            done += k
            places.append((done, b))
        out.append((size, places))
    return out


def measure(docs: DataFrame, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, same) of each row, and the columns in ``keep``: all that packing needs, without the texts.

    Size is the text's UTF-8 bytes plus ``overhead``; ``same`` is a digest of the text; a null text counts as empty.
    """
    if overhead < 1:
        raise ValueError("overhead must be positive")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("same"), *keep)


def place(measured: DataFrame, shards: int | None = 40, capacity: int | None = None, order_col: str | None = None) -> DataFrame:
    """One row per measured document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Documents with equal texts form one group and share a shard.  Repeated rows are documents of their own.  An empty table
    gives no rows.  Slots follow ``order_col``, whole numbers from 0, or else the hash of the id, a null id that of the
    empty text; ties go by content.
    """
    base = cut(measured.select("doc_id", "size", "text_crc32", "same", *([] if order_col is None else [F.col(order_col).cast("long").alias("_order")])))
    groups = base.groupBy("same").agg((F.count(F.lit(1)) * F.first("size")).alias("total"))
    groups = cut(with_rank(groups, ["total"], F.hex("same"), "nth"))

    def pack(frames):
        runs = [(int(s), int(c)) for f in frames for s, c in zip(f["total"], f["n"])]
        if runs:
            runs.sort(reverse=True)
            packed = best_fit_decreasing(runs, shards, capacity)
            yield pd.DataFrame({"total": [s for s, _ in packed], "places": [[{"upto": u, "shard": b} for u, b in p] for _, p in packed]})

    sizes = groups.groupBy("total").agg(F.count(F.lit(1)).alias("n")).repartition(1)
    plan = cut(sizes.mapInPandas(pack, "total long, places array<struct<upto: long, shard: int>>"))
    where = groups.join(plan, "total").select("same", F.expr("filter(places, p -> nth < p.upto)[0].shard").alias("shard"))
    placed = base.join(cut(where), "same").drop("same")  # a large group is one row on the right, and its side can be split
    by = None
    if order_col is not None:  # the leading digits spread the order evenly over with_rank's buckets
        last = base.agg(F.max("_order")).first()[0] or 0
        by = F.concat(F.lpad(F.hex(F.floor(F.col("_order") / (last + 1) * 65536)), 4, "0"), F.lpad(F.hex("_order"), 16, "0"))
    return with_rank(cut(placed), ["shard"], F.col("doc_id"), "slot", [F.col("text_crc32"), F.col("size")], by).drop("_order")


def shard(docs: DataFrame, shards: int | None = 40, capacity: int | None = None, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure and place the rows of docs; columns other than the two read are ignored."""
    return place(measure(docs, overhead, id_col, text_col), shards, capacity)
