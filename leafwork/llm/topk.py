"""Exact top-k inner products by a pivot-distance index.

All vectors are keyed by their nearest pivot and their distance to it, and each pivot's sorted vectors are cut into annuli.
The triangle inequality keeps a vector at distance r from a pivot at least |d(query, pivot) - r| from the query, which bounds
the inner product.  A query first visits the annulus with the best bound; after that it is sent only to annuli whose
bound reaches the k-th best score it has by then, and inside each it walks finer annuli by falling bound and stops in
the same way.  Pivots and first thresholds come from a bounded sample.  Scores are whole numbers, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def whole(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles; null if the vector or a component is null or not finite."""
    x = F.transform(embedding, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, x)


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal from the first row."""
    if not len(x):
        return x
    chosen, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(count, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _products(q: np.ndarray, x: np.ndarray, safe: bool) -> np.ndarray:
    if safe:
        return (q @ x.T).astype(np.int64)
    return (np.vectorize(int, otypes=[object])(q) @ np.vectorize(int, otypes=[object])(x).T).astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    step = max(1, (1 << 21) // max(1, pivots.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.linalg.norm(x[i : i + step, None] - pivots[None], axis=2)
    return out


def _bound(size, top, gap):
    """No inner product of vectors of these lengths, so far apart at least, is above this; with room for rounding."""
    out = (size**2 + top**2 - gap**2) / 2
    return out + 1 + 1e-9 * np.abs(out) + 1e-9 * (size**2 + top**2)


def search_slice(qid, q, least, ids, x, pivots, k, safe, annulus=512, block=128):
    """Arrays (query_id, vec_id, score): for each query the k best rows of one slice that score ``least`` or more."""
    d = _distances(x, pivots)
    near, dist = d.argmin(axis=1), d.min(axis=1)
    order = np.lexsort((ids, dist, near))
    near, dist, ids, x = near[order], dist[order], ids[order], x[order]
    edges = [0]
    for end in [*(np.flatnonzero(np.diff(near)) + 1), len(near)]:
        edges += list(range(edges[-1] + annulus, end, annulus)) + [int(end)]
    edges = np.unique(edges)
    lo, hi = edges[:-1], edges[1:]
    top = np.maximum.reduceat(np.linalg.norm(x, axis=1), lo)
    ring = near[lo], dist[lo], dist[hi - 1]
    out = []
    for i in range(0, len(q), block):
        qb, ib, low = q[i : i + block], qid[i : i + block], least[i : i + block].copy()
        to = _distances(qb, pivots)[:, ring[0]]
        gap = np.maximum(0, np.maximum(ring[1] - to, to - ring[2]))
        bound = _bound(np.linalg.norm(qb, axis=1)[:, None], top, gap)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ib]
        for a in np.argsort(-bound.max(axis=0), kind="stable"):
            alive = np.flatnonzero(bound[:, a] >= low)
            if not len(alive):
                if bound[:, a].max() < low.min():
                    break
                continue
            part = slice(lo[a], hi[a])
            got = _products(qb[alive], x[part], safe)
            for n, s in zip(alive, got):
                hit = np.flatnonzero((s >= low[n]) & (ids[part] != ib[n]))
                if len(hit):
                    s, v = np.r_[best[n][1], s[hit]], np.r_[best[n][0], ids[part][hit]]
                    keep = np.lexsort((v, -s))[:k]
                    best[n] = v[keep], s[keep]
                    if len(keep) == k:
                        low[n] = max(low[n], s[keep[-1]])
        out += [(np.full(len(v), ib[n]), v, s) for n, (v, s) in enumerate(best)]
    return tuple(np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else ((),) * 3))


class Layout:
    """Pivots, and for each pivot the distances that cut its vectors into annuli, from a sample."""

    def __init__(self, sample: np.ndarray, pivots: int, cells: int):
        self.pivots = choose_pivots(sample, min(pivots, cells))
        near, dist = self.nearest(sample)
        self.edges = []
        for p in range(len(self.pivots)):
            own = dist[near == p]
            rings = max(1, round(cells * len(own) / len(sample)))
            self.edges.append(np.unique(np.quantile(own, np.arange(1, rings) / rings)))
        self.base = np.cumsum([0, *[len(e) + 1 for e in self.edges]])
        self.inner = choose_pivots(sample, 32)  # for the finer annuli of one task

    def parts(self) -> tuple:
        """Plain arrays, which go to tasks that may not have this package on their path."""
        return self.pivots, self.edges, self.base, self.inner

    @classmethod
    def of(cls, parts: tuple) -> "Layout":
        out = cls.__new__(cls)
        out.pivots, out.edges, out.base, out.inner = parts
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(x, self.pivots)
        return d.argmin(axis=1), d.min(axis=1)

    def cell(self, near: np.ndarray, dist: np.ndarray) -> np.ndarray:
        out = np.zeros(len(near), np.int64)
        for p in np.unique(near):
            at = near == p
            out[at] = self.base[p] + np.searchsorted(self.edges[p], dist[at], side="right")
        return out

    def pivot_of(self, cell: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, cell, side="right") - 1


def annuli(layout: Layout, q, least, cell, lo, hi, top, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, annulus): the annulus with the best bound of each query, or all others whose bound reaches ``least``."""
    to = _distances(q, layout.pivots)[:, layout.pivot_of(cell)]
    bound = _bound(np.linalg.norm(q, axis=1)[:, None], top, np.maximum(0, np.maximum(lo - to, to - hi)))
    best = np.arange(len(cell)) == bound.argmax(axis=1)[:, None]
    return np.nonzero(best if first else (bound >= least[:, None]) & ~best)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = 256, sample_rows: int = 2048, cell_rows: int = 16_384, wave_rows: int = 16_384, max_cells: int = 65_536, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query id its k best rows among all rows but its own.

    Rows with a null id, or a vector that is null or holds a null or non-finite component, take no part.  Of a repeated
    query id the smallest vector asks; rows that repeat an id are candidates each.  Shorter vectors count as
    ending in zeros.  An empty table, or one without queries, gives no rows; other columns are ignored.

    Pivots, annuli and first thresholds come from the ``sample_rows`` rows with the smallest hash; every row is indexed.
    An annulus has about ``cell_rows`` rows, and one with more (equal vectors) is dealt out evenly; there are at most about
    ``max_cells``.  A task holds one such part and one wave of queries, so its memory does not grow with the input.
    """
    spark = vectors.sparkSession
    rows = vectors.select(is_query.alias("q"), F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vec_col), scale).alias("x")).where("vec_id is not null and x is not null")
    rows = cut(rows)
    n, n_queries, dim, most = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1)), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    schema = "query_id long, vec_id long, score long"
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, 1)
    safe = dim * (most or 0) ** 2 < 2**53
    known = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample_rows).select("vec_id", "x").toArrow()
    sample_ids, sample = known["vec_id"].to_numpy(), _matrix(known["x"], dim)
    layout = Layout(sample, pivots, min(max_cells, -(-n // cell_rows)))
    sent = spark.sparkContext.broadcast((layout.parts(), sample_ids, sample))

    def key(batches):
        layout = Layout.of(sent.value[0])
        for b in batches:
            x = _matrix(pa.chunked_array([b.column(1)]), dim)
            near, dist = layout.nearest(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (layout.cell(near, dist), dist, np.linalg.norm(x, axis=1)))], [*b.schema.names, "cell", "dist", "norm"])

    keyed = rows.select("vec_id", "x", "q").mapInArrow(key, "vec_id long, x array<double>, q boolean, cell long, dist double, norm double")
    keyed = cut(keyed.withColumn("at", F.monotonically_increasing_id()))
    cells = cut(keyed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("long").alias("parts"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("top")))
    cells_sent = spark.sparkContext.broadcast([c.to_numpy() for c in cells.orderBy("cell").toArrow().columns])
    asked = cut(keyed.where("q").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x")))

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        """Results of the annulus with the best bound or, after that, of all others that can matter."""

        def route(batches):
            plain, sample_ids, sample = sent.value
            layout = Layout.of(plain)
            cell, parts, lo, hi, top = cells_sent.value
            for b in batches:
                for i in range(0, len(b), step := max(1, (1 << 21) // max(len(cell), len(sample)))):
                    part = b.slice(i, step)
                    qid, q, least = part.column(0).to_numpy(), _matrix(pa.chunked_array([part.column(1)]), dim), part.column(2).to_numpy(zero_copy_only=False)
                    if first and len(sample) >= k:
                        s = np.where(sample_ids[None] == qid[:, None], -np.inf, _products(q, sample, safe).astype(float))
                        least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1])
                    who, where = annuli(layout, q, least, cell, lo, hi, top, first)
                    many = parts[where]
                    who, where, nth = np.repeat(who, many), np.repeat(where, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    take = pa.array(who)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(least[who]), pa.array(cell[where]), pa.array(nth)], ["query_id", "x", "least", "cell", "part"])

        copies = cut(queries.select("query_id", "x", "least").mapInArrow(route, "query_id long, x array<double>, least double, cell long, part long"))
        busiest = copies.groupBy("cell", "part").count().agg(F.max("count")).first()[0] or 0
        waves = max(1, -(-busiest // wave_rows))
        right = copies.withColumn("wave", F.pmod(F.xxhash64("query_id"), F.lit(waves)).cast("int"))
        left = keyed.join(F.broadcast(cells.select("cell", "parts")), "cell").join(F.broadcast(copies.select("cell").distinct()), "cell", "left_semi")
        left = left.select("cell", F.pmod("at", "parts").alias("part"), "vec_id", "x").withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))

        def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
            found = (np.empty(0, np.int64),) * 3
            if rows.num_rows and queries.num_rows:
                found = search_slice(queries["query_id"].to_numpy(), _matrix(queries["x"], dim), queries["least"].to_numpy(), rows["vec_id"].to_numpy(), _matrix(rows["x"], dim), Layout.of(sent.value[0]).inner, k, safe)
            return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in found))))

        by = ("cell", "part", "wave")
        return cut(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, schema))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = visit(asked.withColumn("least", F.lit(float("-inf"))), True)
    if cells.count() > 1:
        least = best(found).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).cast("double").alias("least"))
        again = asked.join(least, "query_id", "left").select("query_id", "x", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        found = found.unionByName(visit(again, False))
    return best(found).select("query_id", "rank", "vec_id", "score")
