"""Merkle manifest, MinHash fingerprints and ranked search against plain Python, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafwork.llm import lexical, manifest, minhash, queries

KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf string, term string, run int"
WORDS = "stone river light cloud amber field north glass paper sound quiet maple ocean table green".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(9, 30_000)
    rows = [
        (5, prose(1, 60), "en", "a", 3, "x", "y", 1), (3, None, None, None, None, None, None, None), (9, "", "en", "b", 0, "", "", 0), (5, prose(1, 60), "en", "a", 3, "x", "y", 1),
        (5, prose(2, 60), "de", "a", 3, "x", "y", 1), (None, "Ünder die Brücke!", "de", None, 4, "", "", 2), (7, long, "en", "c", len(long), "", "", 3), (8, " \t\n ", "", "c", 4, "", "", 3),
        (10, "one", "", "c", 4, "", "", 3), (11, prose(1, 59) + " Stone", "fr", "c", 4, "", "", 3), (12, "ÀÉ日本語 x-1", "fr", "c", 4, "", "", 3),
    ]
    return spark.createDataFrame(rows, KIND)


# ------------------------------------------------------------------ manifest


def H(*xs: str) -> str:
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf_of(*fields) -> str:
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(level: list[str]) -> tuple[str, list[list[str | None]]]:
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            paths[k].append(level[i ^ 1] if i ^ 1 < len(level) else None)
        level, at = [H(*level[i : i + 2]) for i in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], paths


@pytest.mark.parametrize("step", [1, 2, 3, 5])
@pytest.mark.parametrize("n, levels", [(1, 0), (2, 1), (3, 2), (5, 3), (8, 3), (13, 4), (1, 4), (33, 6), (64, 6), (100, 7)])
def test_traversal_gives_all_paths(n, levels, step):
    leaves = [H(str(i)) for i in range(n)]
    out = list(manifest.authentication_paths(leaves, levels, step))
    for i, path in enumerate(out[1:]):
        node, at = leaves[i], i
        for sibling in path:
            node, at = H(node) if sibling is None else H(node, sibling) if at % 2 == 0 else H(sibling, node), at // 2
        assert node == out[0] and len(path) == levels
    if levels == (n - 1).bit_length():
        root, paths = tree(leaves)
        assert out == [root, *paths]


def test_traversal_holds_few_nodes(monkeypatch):
    held = []
    grow = manifest._Growing.grow
    monkeypatch.setattr(manifest._Growing, "grow", lambda self, steps: (grow(self, steps), held.append(len(self.nodes) + len(self.stack)))[0])
    list(manifest.authentication_paths([H(str(i)) for i in range(1024)], 10, 3))
    assert max(held) <= 2 ** (3 + 1) + 11


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    out, subroots = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        members = [(r["doc_id"], leaf_of(*[r[c] for c in manifest.FIELDS]), r) for r in groups[lang]]
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        root, paths = tree([m[1] for m in members])
        subroots.append(root)
        out.append((root, list(zip(members, paths))))
    root, upper = tree(subroots)
    rows = []
    for (sub, members), up in zip(out, upper):
        for (doc_id, leaf, r), path in members:
            rows.append((doc_id, leaf, sub, root, H(*[x for x in path + up if x]), r))
    return rows


def check_manifest(docs, monkeypatch, levels):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    got = manifest.manifest(docs).withColumn("proof", F.sha2(F.concat_ws("", "path", "upper_path").cast("binary"), 256))
    got = got.withColumn("folded", manifest.fold(manifest.fold(F.col("leaf"), F.col("i"), F.col("path")), F.col("g"), F.col("upper_path"))).collect()
    want = brute_manifest([r.asDict() for r in docs.collect()])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got), key=key) == sorted((w[:5] for w in want), key=key)
    assert all(r["folded"] == r["root"] for r in got)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_brute_force(spark, odd, monkeypatch, levels):
    check_manifest(odd, monkeypatch, levels)


def test_manifest_of_the_test_table(spark, sf, monkeypatch):
    check_manifest(spark.read.parquet(f"{sf}/documents.parquet"), monkeypatch, 3)


def test_manifest_of_many_groups(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), (F.col("id") % 13).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    check_manifest(docs, monkeypatch, 2)


def test_manifest_of_nothing(odd):
    assert manifest.manifest(odd.limit(0)).collect() == []


def test_merkle_query_finds_changes(spark, sf):
    rows = queries.op11_merkle(spark, sf).collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
    assert 0 < sum(not r["verified"] for r in rows) < len(rows)


# ------------------------------------------------------------------ fingerprints


def shingles(text: str | None, width: int = 5) -> set:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_against_plain_python(spark, odd, sf):
    for docs in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
        got = {r["doc_id"]: r for r in minhash.with_edits(docs).collect()}
        assert len(got) == len(rows)
        for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
            k = len(text) // 4
            new = text[: len(text) - k] + after[:k]
            r = got[i]
            assert r["n_chars"] == len(text) and r["edited_sha256"] == H(new)
            for name, other in (("edited", new), ("next", after)):
                true = alike(shingles(text), shingles(other))
                assert r[f"jaccard_{name}"] == pytest.approx(true) and abs(r[f"near_{name}"] - true) < 0.25
            assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 8 * minhash.FUNCTIONS


def test_fingerprints_on_odd_input(spark, odd):
    rows = minhash.with_edits(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["class_id"] == r["doc_id"] for r in rows)
    prints = Counter(r["fingerprint"] for r in rows)
    assert prints[minhash.as_text(minhash.Sketcher().signature(minhash.Sketcher().shingles(prose(1, 60).encode())))] == 2
    assert minhash.with_edits(odd.limit(0)).collect() == [] and minhash.near_copies(odd.limit(0)).collect() == []
    one = minhash.with_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 15


def test_signatures_estimate_jaccard():
    sketch, draw = minhash.Sketcher(), random.Random(3)
    errors = []
    for n in (20, 100, 400, 5000):
        words = [f"w{draw.randrange(10**6)}" for _ in range(n)]
        other = [w if draw.random() > 0.03 else "z" for w in words]
        a, b = (sketch.shingles(" ".join(x).encode()) for x in (words, other))
        assert minhash.jaccard(a, b) == pytest.approx(alike(shingles(" ".join(words)), shingles(" ".join(other))))
        errors.append(minhash.likeness(sketch.signature(a), sketch.signature(b)) - minhash.jaccard(a, b))
    assert max(map(abs, errors)) < 0.15


def classes(docs, least):
    """doc_id -> smallest id reachable over all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if alike(s, t) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_near_copies_equal_all_pairs(spark, sf):
    """A group of many texts near each other, copies, texts just above and below the limit, and the test table."""
    draw, docs = random.Random(5), []
    base = [f"b{draw.randrange(10**5)}" for _ in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(draw.randrange(5)):
            words[draw.randrange(120)] = f"c{draw.randrange(10**5)}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, docs[3][1]) for i in range(5)] + [(200 + i, f"lone text number {i} of its own kind {i * i}") for i in range(20)] + [(300, ""), (301, None), (302, " \n")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for rows, leaders in ((table, 1), (table, 8), (real, 1)):
        found = minhash.near_copies(rows, leaders=leaders)
        got = rows.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("same")).join(found, "same", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("c")).collect()
        want = classes([(r["doc_id"], r["text"]) for r in rows.collect()], 0.8)
        right = sum(want[r["doc_id"]] == r["c"] for r in got)
        assert len(got) == len(want) and right >= 0.99 * len(want)


# ------------------------------------------------------------------ search


def brute_search(docs, items, k):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    terms = lambda s: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(s)))
    held = [(i, c) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n_docs, n_words, df, out = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c), []
    first = {}
    for i, text in items:
        if i is not None:
            first[i] = min(first.get(i, text or ""), text or "", key=str.encode)
    for i, text in first.items():
        scores = []
        for doc, c in held:
            m = 75 + (25 * c.total() * n_docs) // n_words
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in terms(text).items() if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(i, r + 1, None if no else doc, -s) for r, (s, no, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, odd, sf):
    items = spark.createDataFrame([(1, "Stone river GLASS stone"), (2, None), (3, ""), (4, "nowhere"), (5, "ünder brücke 日本語"), (None, "stone"), (6, "zzz"), (6, "maple maple x")], "item_id long, text string")
    docs = odd.select("*", F.lit(1).alias("score"), F.lit(2).alias("item_id"))
    for k in (1, 3, 20):
        got = sorted((tuple(r) for r in lexical.search(docs, items, k=k).collect()), key=str)
        assert got == brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()], k)
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 5)
    for block in (1 << 20, 300):
        assert sorted((tuple(r) for r in lexical.search(docs, items, k=5, block_terms=block).collect()), key=str) == want


def test_search_of_nothing(spark, odd):
    items = spark.createDataFrame([(1, "stone")], "item_id long, text string")
    assert lexical.search(odd.limit(0), items).collect() == [] and lexical.search(odd, items.limit(0)).collect() == []


def test_search_leaves_terms_and_documents_out():
    """Bounds rise as documents come, common terms drop out of the search, and nothing changes by that."""
    import numpy as np

    draw = np.random.default_rng(1)
    n, vocabulary = 4000, 300
    weight = (13_000 / np.sqrt(1 + np.arange(vocabulary))).astype(np.int64)[::-1]
    job = lexical._Search(np.repeat([0, 1], 40), np.r_[np.arange(40) * 7, np.arange(40) * 5], np.r_[weight[np.arange(40) * 7], weight[np.arange(40) * 5]], np.full(80, 900_000), np.zeros(2, np.int64), 10)
    before, rows = len(job.by_term), []
    for at in range(0, n, 500):
        terms = [np.unique(draw.integers(0, vocabulary, 30)) for _ in range(500)]
        doc, term = np.repeat(np.arange(500), [len(t) for t in terms]), np.concatenate(terms)
        share = draw.integers(100_000, 900_000, len(term))
        job.add(np.arange(at, at + 500), doc, term, share)
        rows.append((doc + at, term, share))
    doc, term, share = (np.concatenate(x) for x in zip(*rows))
    assert len(job.by_term) < before
    for item, step in ((0, 7), (1, 5)):
        score = np.zeros(n, np.int64)
        own = np.isin(term, np.arange(40) * step)
        np.add.at(score, doc[own], weight[term[own]] * share[own])
        best = np.lexsort((np.arange(n), -score))[:10]
        mine = job.best[0] == item
        assert job.best[1][mine].tolist() == best.tolist() and job.best[2][mine].tolist() == score[best].tolist()
