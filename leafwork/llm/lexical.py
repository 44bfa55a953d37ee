"""Ranked lexical search: a few query texts (items) against all documents, exactly.

The index is one table of rows (doc_id, length, terms, counts), and for each term the greatest and the k-th greatest impact
that it has on any document.  As k documents have at least the k-th impact of a term, the best of these over the terms of an
item bounds the score of its k-th document from below.  Terms of an item stand by falling greatest impact; those at the
end whose greatest impacts together stay below the bound cannot bring a document among the first k by themselves, so only
documents with one of the other terms are looked at, and of these only such as can still reach the bound are scored in full.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, cut, passes

#: Bytes of terms as they are, A-Z lower-cased, all others blank.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_STEP = 4096  # impacts of a term are counted in steps, and the k-th is rounded down to one
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits; everything that is not ASCII counts as a letter, and only A-Z are lower-cased."""
    return text.translate(_TABLE).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times) of all items; of a repeated id the smallest text counts, and rows without an id do not."""
    def run(batches):
        for b in batches:
            counts = [Counter(terms_of(t)) for t in b.column(1).to_pylist()]
            own = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(own)), pa.array([t for c in counts for t in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["item_id", "term", "times"]
            )

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).where("item_id is not null")
    return rows.groupBy("item_id").agg(F.min("text").alias("text")).mapInArrow(run, "item_id long, term binary, times long")


def forward(docs: DataFrame, wanted: DataFrame, log_bits: int = 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n, terms, counts), one for each document with a term: n terms with repeats, and those of them that are wanted.

    ``wanted`` (one column ``term``) goes to the tasks as a filter of 2 ** log_bits bits, whatever its size; a few other
    terms may pass it.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("term")), log_bits))

    def run(batches):
        known: dict[bytes, bool] = {}
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                counts = [Counter(terms_of(t)) for t in part.column(1).to_pylist()]
                if len(known) > 1 << 20:
                    known = {}
                new = list(set().union(*counts) - known.keys())
                known.update(zip(new, passes(np.array([xxhash.xxh64_intdigest(t, 42) for t in new], np.uint64), bits.value, log_bits).tolist()))
                here = [i for i, c in enumerate(counts) if c]
                kept = [{t: n for t, n in counts[i].items() if known[t]} for i in here]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(here, pa.int64())), pa.array([counts[i].total() for i in here], pa.int64()),
                        pa.array([list(c) for c in kept], pa.list_(pa.binary())), pa.array([list(c.values()) for c in kept], pa.list_(pa.int64())),
                    ], ["doc_id", "n", "terms", "counts"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("octet_length(text) > 0")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<binary>, counts array<long>")


def term_statistics(index: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(term, weight, top, kth) of the wanted terms that documents hold: greatest and k-th greatest share of the weight that a
    document gives, the latter rounded down, and 0 if fewer than k documents hold the term."""
    docs, words = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    posts = index.select("n", F.inline(F.arrays_zip("terms", "counts"))).withColumnRenamed("terms", "term")
    steps = posts.withColumn("share", F.expr(share("counts", docs, words))).groupBy("term", F.expr(f"share div {_STEP}").alias("step")).agg(F.count(F.lit(1)).alias("docs"), F.max("share").alias("top"))
    steps = steps.join(wanted.select("term").distinct(), "term", "left_semi")
    reached = F.sum("docs").over(Window.partitionBy("term").orderBy(F.desc("step")))
    out = steps.withColumn("reached", reached).groupBy("term").agg(F.max("reached").alias("df"), F.max("top").alias("top"), F.max(F.when(F.col("reached") >= k, F.col("step") * _STEP)).alias("kth"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(docs)) + 2) / (2 * F.col("df").cast("double") + 1)))
    return out.select("term", weight.alias("weight"), "top", F.coalesce("kth", F.lit(0)).alias("kth"))


def share(tf: str, docs: int, words: int) -> str:
    """SQL for what ``tf`` occurrences give in a document of n terms, in millionths of the term's weight."""
    return f"(1000000000 * {tf}) div (1000 * {tf} + 12 * (75 + (25 * n * {docs or 0}L) div {words or 1}L))"


class _Search:
    """The items of one block in arrays, and for each item the best documents that a task has seen."""

    def __init__(self, item, term, weight, top, least, k: int):
        order = np.lexsort((term, -(weight * top), item))
        self.item, self.term, self.weight, self.k = item[order], term[order], weight[order], k
        self.items = len(least)
        self.begin = np.searchsorted(self.item, np.arange(self.items + 1))
        run = np.r_[np.cumsum((self.weight * top[order])[::-1])[::-1], 0]  # of this and all later entries
        self.most = run[:-1] - run[self.begin[1:]][self.item]
        self.least = np.maximum(least, 1)
        self.best = tuple(np.empty(0, np.int64) for _ in range(3))  # item, doc_id, score
        self._prune()

    def _prune(self) -> None:
        """Entries from which on an item's terms cannot reach its bound are left out of the search for candidates."""
        needed = self.most >= self.least[self.item]
        self.open = self.begin[:-1] + np.bincount(self.item[needed], minlength=self.items)
        self.rest = np.r_[self.most, 0][np.minimum(self.open, len(self.most))] * (self.open < self.begin[1:])
        at = np.flatnonzero(needed)
        self.by_term = at[np.argsort(self.term[at], kind="stable")]
        self.sorted_terms = self.term[self.by_term]

    def add(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, share: np.ndarray) -> None:
        """Documents ``ids`` with postings (position of the document, term, share), sorted by document and term."""
        lo, hi = np.searchsorted(self.sorted_terms, term, "left"), np.searchsorted(self.sorted_terms, term, "right")
        if len(ids) > 1 and (hi - lo).sum() > 1 << 22:
            half, cut_at = len(ids) // 2, np.searchsorted(doc, len(ids) // 2)
            self.add(ids[:half], doc[:cut_at], term[:cut_at], share[:cut_at])
            self.add(ids[half:], doc[cut_at:] - half, term[cut_at:], share[cut_at:])
            return
        post, at = _ranges(lo, hi)
        entry = self.by_term[at]
        score = np.zeros(len(ids) * self.items, np.int64)
        np.add.at(score, doc[post] * self.items + self.item[entry], self.weight[entry] * share[post])
        score = score.reshape(len(ids), self.items)
        d, i = np.nonzero(score + self.rest >= self.least)
        score = score[d, i]
        vocabulary = int(max(self.term.max(initial=0), term.max(initial=0))) + 1
        keys = np.append(doc * vocabulary + term, np.iinfo(np.int64).max)
        for a in range(0, len(d), 1 << 14):
            c = slice(a, a + (1 << 14))
            own, entry = _ranges(self.open[i[c]], self.begin[i[c] + 1])
            asked = d[c][own] * vocabulary + self.term[entry]
            found = np.searchsorted(keys, asked)
            hit = keys[found] == asked
            np.add.at(score[c], own[hit], self.weight[entry[hit]] * share[found[hit]])
        good = score >= self.least[i]
        new = i[good], ids[d[good]], score[good]
        if len(new[0]):
            item, ids, score = (np.r_[x, y] for x, y in zip(self.best, new))
            order = np.lexsort((ids, -score, item))
            item, ids, score = item[order], ids[order], score[order]
            nth = np.arange(len(item)) - np.searchsorted(item, item)
            last = nth == self.k - 1
            least = self.least.copy()
            np.maximum.at(least, item[last], score[last])
            keep = nth < self.k
            self.best = item[keep], ids[keep], score[keep]
            if (least > self.least).any():
                self.least = least
                self._prune()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, x) with lo[i] <= x < hi[i]."""
    size = np.maximum(hi - lo, 0)
    own = np.repeat(np.arange(len(lo)), size)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + lo[own]


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each item its k best documents with a score above 0, all if fewer.

    Equal scores stand by ascending doc_id, a null one last; repeated rows are documents each.  Null and empty texts have no
    terms and do not count as documents.  Of a repeated item id the smallest text asks, and items without an id do not.
    Empty tables give no rows; other columns are ignored.

    Texts are read once, whatever the number of items.  Tasks hold the terms of a block of items (about ``block_terms``), and the
    index is read once for each block; of what they find, tasks hand on k rows an item.
    """
    asked = cut(item_terms(items, item_id, item_text))
    index = cut(forward(docs, asked.select("term").distinct(), id_col=id_col, text_col=text_col))
    n_docs, n_words = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    known = asked.join(cut(term_statistics(index, asked, k)), "term")
    blocks = max(1, -(-asked.count() // block_terms))
    known = cut(known.select("item_id", "term", (F.col("times") * F.col("weight")).alias("weight"), "top", "kth", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")))
    index = index.select("doc_id", "terms", F.expr(f"transform(counts, c -> {share('c', n_docs, n_words)})").alias("shares"))
    found = [_search_block(index, known.where(F.col("block") == b), k) for b in range(blocks)]
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of each item that each task finds, those of all documents among them."""
    rows = entries.toArrow()
    terms, term = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True)
    ids, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
    weight, top, kth = (rows[c].to_numpy().astype(np.int64) for c in ("weight", "top", "kth"))
    least = np.zeros(len(ids), np.int64)
    np.maximum.at(least, item, weight * kth)
    sent = index.sparkSession.sparkContext.broadcast((ids, dict(zip(terms.tolist(), range(len(terms)))), (item, term, weight, top, least)))

    def run(batches):
        ids, code, entries = sent.value
        job = _Search(*entries, k)
        step = max(1, min(1024, (1 << 22) // max(1, len(ids))))
        for b in batches:
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                docs = part.column(0).fill_null(_NO_ID).to_numpy()
                flat = np.array([code.get(t, -1) for t in part.column(1).flatten().to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(part)), np.diff(part.column(1).offsets.to_numpy()))
                share = part.column(2).flatten().to_numpy()
                have = flat >= 0
                doc, flat, share = doc[have], flat[have], share[have]
                order = np.lexsort((flat, doc))
                job.add(docs, doc[order], flat[order], share[order])
        item, doc, score = job.best
        yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], ["item_id", "doc_id", "score"])

    return index.select("doc_id", "terms", "shares").mapInArrow(run, "item_id long, doc_id long, score long")
