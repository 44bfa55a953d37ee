"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is split into k + 1 pieces: wherever a document holds the item with at
most k edits, one piece stands there unchanged.  An automaton finds all piece hits in one pass over a text, hits on
nearby diagonals are merged into windows, and Myers' bit-parallel edit distance decides each window.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free

MATCHES = "array<struct<item_id: long, start: long, end: long, distance: int>>"
_matches = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())]))


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the best match of the whole pattern in a substring of text; the first end on ties.

    ``anchored``: the substring must begin where text begins.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1 | anchored) & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """Finds items, as (item_id, text) with a budget of floor(rate x length), in normalised texts.

    Items under ``short`` characters have no budget and count only as whole words: between spaces or the ends of a text.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float, short: int = 32):
        self.items = [(i, t, int(len(t) * rate) if len(t) >= short else -1) for i, t in items]
        self.machine = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            parts = max(k, 0) + 1
            cuts = [len(t) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, a))
        for piece, owners in pieces.items():
            self.machine.add_word(piece, (len(piece), owners))
        if pieces:
            self.machine.make_automaton()

    def find(self, text: str) -> list[dict]:
        """Matches by item and start; where windows overlap, one match for each."""
        if not text or not len(self.machine):
            return []
        hits: dict[int, list[int]] = {}
        for end, (size, owners) in self.machine.iter(text):
            for n, a in owners:
                hits.setdefault(n, []).append(end + 1 - size - a)
        out = []
        for n, starts in hits.items():
            item, t, k = self.items[n]
            if k < 0:
                whole = [s for s in starts if text[s - 1 : s] in ("", " ") and text[s + len(t) : s + len(t) + 1] in ("", " ")]
                out += [{"item_id": item, "start": s, "end": s + len(t), "distance": 0} for s in whole]
                continue
            starts.sort()
            first = last = starts[0]
            windows = []
            for s in starts[1:]:
                if s - last > 2 * k + 1:
                    windows.append((first, last))
                    first = s
                last = s
            for a, b in [*windows, (first, last)]:
                lo, hi = max(0, a - k), b + len(t) + k
                window = text[lo:hi]
                if (at := window.find(t)) >= 0:
                    out.append({"item_id": item, "start": lo + at, "end": lo + at + len(t), "distance": 0})
                    continue
                distance, end = myers(t, window)
                if distance <= k:
                    _, back = myers(t[::-1], window[:end][::-1], True)
                    out.append({"item_id": item, "start": lo + end - back, "end": lo + end, "distance": distance})
        return sorted(out, key=lambda x: (x["item_id"], x["start"]))


def _texts(column) -> list[str]:
    """Strings of a column; null as empty, bytes that are not UTF-8 as replacement characters."""
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _items(benchmark: DataFrame, chunk_chars: int) -> tuple[DataFrame, int]:
    """Rows (item_id, text, chunk) of normalised items, dealt by hash to chunks of about chunk_chars characters; and the number of chunks."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(normal, _texts(b.column(1))), pa.string())], ["item_id", "text"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = cut(rows.mapInArrow(run, "item_id long, text string").where("text <> ''").distinct())
    chunks = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // chunk_chars)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("text"), F.lit(max(chunks, 1)))), chunks


def with_matches(docs: DataFrame, benchmark: DataFrame, out: str = "matches", rate: float = 0.06, short: int = 32, chunk_chars: int = 1_000_000, text_col: str = "text") -> DataFrame:
    """docs with a column of matches: item_id, start and end in the normalised text, edit distance.

    Every item with an id and a word is looked for: items under ``short`` normalised characters exactly, as whole words,
    longer ones with up to rate x length edits.  Null and empty texts have no matches; bytes that are not UTF-8 read as
    replacement characters; repeated rows match alike, repeated items once, and an item id with several texts by each.  An
    empty benchmark matches nothing.  A column named ``out`` is replaced; all other columns stay.

    One automaton holds about ``chunk_chars`` characters of items.  A larger benchmark takes one pass over the texts for
    each chunk, which writes the matches it found by digest of the text, and one join brings them together, so no task
    or driver ever holds more than one chunk.
    """
    if not 0 <= rate < 0.5:
        raise ValueError("rate must be from 0 to 0.5")
    items, chunks = _items(benchmark, chunk_chars)
    sc = docs.sparkSession.sparkContext

    def send(k):
        got = items.where(F.col("chunk") == k).orderBy("item_id", "text").toArrow()
        return sc.broadcast(list(zip(got["item_id"].to_pylist(), got["text"].to_pylist())))

    if chunks <= 1:
        docs = docs.withColumn(out, F.array().cast(MATCHES))
        spot, text_at, sent = docs.columns.index(out), docs.columns.index(text_col), send(0)

        def run(batches):
            matcher = Matcher(sent.value, rate, short)
            for b in batches:
                yield b.set_column(spot, b.schema.field(spot).name, pa.array([matcher.find(normal(t)) for t in _texts(b.column(text_at))], _matches))

        return docs.mapInArrow(run, docs.schema)
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)), 1, 16)
    rows = docs.select(digest.alias("key"), F.col(text_col).cast("binary").alias("text"))
    found = None
    for k in range(chunks):
        sent = send(k)

        def search(batches, sent=sent):
            matcher = Matcher(sent.value, rate, short)
            for b in batches:
                got = [matcher.find(normal(t)) for t in _texts(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _matches)], ["key", "found"]).filter(pa.array(map(bool, got), pa.bool_()))

        part = cut(rows.mapInArrow(search, f"key binary, found {MATCHES}").distinct())
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    key, own = free(docs, "_key"), free(docs, "_found")
    by = found.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.flatten(F.collect_list("found"))).alias(own))
    return docs.withColumn(key, digest).join(by, key, "left").withColumn(out, F.coalesce(own, F.array().cast(MATCHES))).select(*dict.fromkeys([*docs.columns, out]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs without those that hold a test item, as with_matches finds them; repeated rows stay or go together."""
    name = free(docs, "_matches")
    return with_matches(docs, benchmark, name, **options).where(F.size(name) == 0).drop(name)
