"""The ten operators against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafwork.llm import decontam, lmscore, mixing, quality, secrets, sharding, simhash, substring, topk, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
DOCS = "doc_id long, text string, source string, lang string"


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def corpus(n=120, seed=3):
    """Texts with copies, near copies, shared passages, nulls, empty, odd and long ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "in", "é", "on", "A"]) for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        text = [word() for _ in range(r.randint(0, 200))]
        if i % 7 == 0:
            text[len(text) // 2 : len(text) // 2] = passage[r.randint(0, 10) :]
        if i % 9 == 0 and rows and rows[-1][1]:
            text = rows[-1][1].split(" ")
            if i % 2:
                text[len(text) // 2] = word()
        rows.append([i, " ".join(text), f"src{i % 3}" if i % 5 else "src0", "en"])
    rows += [[n, None, None, None], [n + 1, "", "src1", "en"], [n + 2, " \t\n ", "src9", None], [n + 3, "one", "src1", "en"], [n + 4, "x " * 40, "src1", "en"], [None, "no id here", "src1", "en"]]
    rows += [[n + 5, " ".join(word() for _ in range(20_000)), "src0", "en"], rows[3], rows[3]]
    return [tuple(x) for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Columns that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("matches", "score", "row", "slot", "position", "shard", "fp", "node", "rank", "n", "size", "total", "nth", "block", "held_out", "word")})


# ---------------------------------------------------------------- mixing


def schedule(w):
    total, done, out = sum(w), [0] * len(w), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // w[i]), i) for i in range(len(w)) if done[i] < w[i] and done[i] * total // w[i] <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("w", [[1], [1, 1], [5, 3, 1], [9, 1, 1], [7, 2, 2, 1, 1]])
def test_schedule_deviates_by_less_than_a_block(spark, w):
    names = {f"s{i}": x for i, x in enumerate(w[:-1])}
    rows = {r["at"]: r for r in mixing.period(spark, names, w[-1]).collect()}
    order = [*names, mixing.OTHER]
    got = [order.index(rows[t]["mix_source"]) for t in range(sum(w))]
    assert got == schedule(w)
    for t in range(1, sum(w) + 1):
        assert all(abs(got[:t].count(i) - x * t / sum(w)) < 1 for i, x in enumerate(w))
        assert rows[t - 1]["before"] == [got[: t - 1].count(i) for i in range(len(w))]


def test_mix_places_every_row(docs, empty):
    weights, other, block = {"src0": 3, "src1": 2}, 1, 4
    got = mixing.mix(clashing(docs), weights, other, block).select("doc_id", "source", "mix_source", "block", "slot", "position").collect()
    rows = docs.collect()
    assert len(got) == len(rows) and sorted(r["position"] for r in got) == list(range(len(rows)))
    groups, w = ["src0", "src1", mixing.OTHER], [3, 2, 1]
    pattern = schedule(w)
    place = {(i, k): t for i in range(3) for k, t in enumerate([t for t, p in enumerate(pattern) if p == i])}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"] if r["source"] in weights else mixing.OTHER].append(r["doc_id"])
    want = []
    for name, ids in by.items():
        g = groups.index(name)
        for n, i in enumerate(sorted(ids, key=lambda i: hashlib.md5(str("" if i is None else i).encode()).hexdigest())):
            b = n // block
            want.append(((b // w[g]) * sum(w) + place[g, b % w[g]], n % block, i, name))
    want.sort(key=lambda x: x[:2])
    assert [(r["doc_id"], r["mix_source"], r["slot"]) for r in sorted(got, key=lambda r: r["position"])] == [(i, name, slot) for slot, _, i, name in want]
    assert mixing.mix(empty, weights, other, block).count() == 0
    ordered = mixing.mixed_order(docs, weights, other, block)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 0})


# ---------------------------------------------------------------- urls

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/1?x=1&y=2#z", "https://www.example.com/en/", "https://a.www.example.com/en/q", "https://com/", "https://example.com", "https://notexample.com/en/1",
    "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/a/b", "http://net/fr/#", "http://a.org?q=://b.com/en/", "ftp://É.Org/Ünï", "https://telecom/", "x://y://z.com/en/", "https://example.com/en\n/x", "http://long.org/" + "a" * 20_000,
]


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path):
    best = None
    for rule, verdict in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(URLS * 3)], "page_id long, url string, html string, score double")
    got = {r["page_id"]: r for r in urls.judge(pages, RULES, trees=3).collect()}
    assert len(got) == 3 * len(URLS)
    for i, u in enumerate(URLS):
        host, path = url_parts(u)
        rule = url_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[0]), u
        assert got[i]["verdict"] == rule[1] if rule else got[i]["verdict"] in ("allow", "block")
        assert [got[i + k * len(URLS)]["verdict"] for k in (1, 2)] == [got[i]["verdict"]] * 2 and 0 <= got[i]["score"] <= 1


def test_urls_learn_from_labels(spark):
    good = [(f"https://site{i}.org/en/page{i}", 0) for i in range(150)]
    bad = [(f"http://w{i}-{i * 7}.win.top/{i}/{i * 13}/{i * 31}?a={i}&b={i}&c=9&d=8", 1) for i in range(150)]
    held = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(good[100:] + bad[100:])], "page_id long, url string, b int")
    labelled = spark.createDataFrame(good[:100] + bad[:100], "url string, block int")
    got = urls.judge(held, [], labelled, trees=5).join(held.select("page_id", "b"), "page_id").collect()
    assert sum((r["verdict"] == "block") == bool(r["b"]) for r in got) >= 0.95 * len(got)
    none = urls.judge(held, [], labelled.limit(0)).collect()
    assert {r["verdict"] for r in none} == {"allow"}
    assert urls.judge(held.limit(0), RULES).count() == 0


def test_url_features(spark):
    got = urls.lexical(spark.createDataFrame([(u,) for u in URLS], "url string")).collect()
    for r in got:
        u = r["url"] or ""
        host, path = url_parts(r["url"])
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        n = collections.Counter(u)
        want = [len(u), len(host), len(path), path.count("/"), sum(c in "0123456789" for c in u) / max(1, len(u)), -sum(k / len(u) * math.log2(k / len(u)) for k in n.values()), query.count("&") + 1 if query else 0, host.count("."), host.count("-"), int("#" in u), ".".join(host.split(".")[-2:])]
        mine = [r[c] for c in (*urls.FEATURES[:10], "suffix")]
        assert mine[:10] == pytest.approx(want[:10]) and mine[10] == want[10], u


# ---------------------------------------------------------------- top-k


def brute_top(vectors, k):
    out = {}
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in whole if i % 100 == 0}):
        own = min(v for i, v in whole if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:k]
        out[q] = [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return out


def test_top_k_is_exact(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((5, 8))
    vs = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.3 * r.standard_normal(8)]) for i in range(700)]
    vs += [(1000 + i, vs[3][1]) for i in range(40)] + [(100, vs[7][1]), (200, vs[200][1])]  # ties and repeated ids
    vs += [(900, None), (800, [1.0, None]), (801, [float("nan")] * 8), (802, [float("inf")] * 8), (None, [1.0] * 8), (803, []), (804, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vs], "vec_id long, embedding array<float>, score int, rank int").repartition(3)
    got = collections.defaultdict(list)
    for x in topk.top_k(df, F.col("vec_id") % 100 == 0, k=10, pivots=7, sample_rows=100, cell_rows=60, wave_rows=3).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    assert {q: sorted(x) for q, x in got.items()} == brute_top(vs, 10)
    few = topk.top_k(df.where("vec_id < 4"), F.col("vec_id") % 100 == 0, k=10).collect()
    assert len(few) == 3
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_queries_visit_few_annuli_of_clustered_vectors():
    r = np.random.default_rng(3)
    centres = 1000 * r.standard_normal((40, 16))
    x = np.floor(centres[r.integers(0, 40, 20_000)] + 30 * r.standard_normal((20_000, 16)))
    layout = topk.Layout(x[:2000], 64, 200)
    near, dist = layout.nearest(x)
    of = layout.cell(near, dist)
    cell = np.unique(of)
    lo, hi, top = (np.array([f(v[of == c]) for c in cell]) for f, v in ((np.min, dist), (np.max, dist), (np.max, np.linalg.norm(x, axis=1))))
    q = x[:200]
    tenth = -np.sort(-(q @ x.T), axis=1)[:, 9]
    who, where = topk.annuli(layout, q, tenth, cell, lo, hi, top, False)
    assert len(cell) > 100 and len(who) < 0.1 * len(q) * len(cell)
    for i in range(len(q)):  # no annulus of a result is left out
        best = set(np.unique(of[(x @ q[i]) >= tenth[i]]))
        assert best <= {*cell[where[who == i]], *cell[topk.annuli(layout, q[i : i + 1], tenth, cell, lo, hi, top, True)[1]]}


# ---------------------------------------------------------------- secrets


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def tlv(tag, body):
    n = len(body)
    return bytes([tag, n] if n < 128 else [tag, 0x82, n >> 8, n & 255]) + body


RSA = tlv(0x30, b"".join(tlv(2, bytes([i]) * 40) for i in range(1, 10)))
TOKEN = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})) + ".c2lnbmF0dXJl"


def test_secrets(spark):
    key = base64.b64encode(RSA).decode()
    field = lambda b: len(b).to_bytes(4, "big") + b
    container = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"pub") + field(b"private")
    broken = bytearray(RSA)
    broken[5] ^= 7
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + key + "\n-----END RSA PRIVATE KEY-----"
    texts = [
        None, "", "é token = \"abcdef12\" x", "token:abc password=token:abcdef", "PASSWORD='x'", "ſecret=abcdef paſſword=abcdefg", "AKIA" + "A" * 16 + " AKIAABC", "xAKIAAKIA" + "Z" * 15, "f" * 23 + " " + "0" * 24 + "g",
        "see " + TOKEN + ".", "eyJhIjoxfQ.eyJhIjoxfQ.x not signed " * 3, pem, "key " + key, "bad " + base64.b64encode(bytes(broken)).decode(), base64.b64encode(container).decode(), RSA.hex(), "plain words " * 9000 + "api_key=abc123",
    ]
    df = clashing(spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], DOCS))
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert ",".join(s for s in got[i]["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")) == want
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
    kinds = {i: {f["kind"] for f in got[i]["findings"]} - {"assign", "access", "hex"} for i in got}
    assert kinds[9] == {"jwt"} and kinds[11] == {"pem"} and kinds[12] == kinds[14] == kinds[15] == {"key"}
    assert not any(kinds[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 16))
    assert secrets.scan(df.limit(0)).count() == 0


# ---------------------------------------------------------------- quality


def test_quality(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "house", "river", "walks", "and", "slowly"]) for _ in range(r.randint(20, 200))).capitalize() + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "###", "now$$$", "| x |", "WIN!!"]) for _ in range(r.randint(20, 200)))
    rows = [(i, good() if i % 3 else bad(), "s", "l") for i in range(600)] + [(600, None, "s", "l"), (601, "", "s", "l"), (602, "w " * 50_000, "s", "l"), (None, "no id", "s", "l")]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)] + [(None, 1, 0), (7, None, 0), (9999, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(docs, labels, sample_rows=200).collect()}
    assert len(got) == len(rows)
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(test)) for i in range(600))
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in test) >= 0.98 * len(test)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got.values())
    assert got[600]["score"] == got[601]["score"]
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {x["doc_id"]: x["score"] for x in quality.classify(docs, flipped, sample_rows=200).collect()} == {i: x["score"] for i, x in got.items()}
    kept = quality.keep_good(docs, labels, sample_rows=200)
    assert kept.columns == docs.columns and kept.count() == sum(x["predicted"] for x in got.values())
    assert {x["score"] for x in quality.classify(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_votes_match_brute_force():
    r = np.random.default_rng(2)
    z, known, labels = r.standard_normal((20, 4)), r.standard_normal((50, 4)), r.integers(0, 2, 50).astype(float)
    z, known = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (z, known))
    got = quality.vote(z, known, labels, 5, 0.5)
    for i in range(20):
        near = sorted(range(50), key=lambda j: -(z[i] @ known[j]))[:5]
        w = [max(z[i] @ known[j], 0) ** 8 for j in near]
        assert got[i] == pytest.approx(sum(a * labels[j] for a, j in zip(w, near)) / sum(w))


# ---------------------------------------------------------------- decontamination


def edit(pattern, text):
    """Least edits between the pattern and any substring of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(30))
def test_myers_is_the_edit_distance(seed):
    r = random.Random(seed)
    a = "".join(r.choice("abé ") for _ in range(r.randint(1, 90)))
    b = "".join(r.choice("abé ") for _ in range(r.randint(0, 120)))
    assert decontam.myers(a, b)[0] == edit(a, b)


def test_decontamination(spark):
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("aeinrst") for _ in range(r.randint(1, 8))) for _ in range(n))
    items = [(i, text(25)) for i in range(12)] + [(50, "short one"), (51, None), (52, ""), (None, text(20)), (3, text(20))]
    rows = []
    for i in range(60):
        body = text(r.randint(0, 60))
        if i % 3 == 0:
            t = list(items[i % 12][1])
            for _ in range(r.randint(0, 14)):
                t[r.randrange(len(t))] = r.choice("xyz")
            cut = len(body) // 2
            body = body[:cut] + " " + "".join(t).upper().replace(" ", "\n ") + " " + body[cut:]
        rows.append((i, body, "s", "l"))
    rows += [(63, "a Short\n ONE here", "s", "l"), (64, "ashort one", "s", "l"), (60, None, "s", "l"), (61, "", "s", "l"), (62, text(20_000) + " " + items[5][1], "s", "l"), (None, items[1][1], "s", "l"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    usable = [(i, decontam.normal(t)) for i, t in items if i is not None and len(decontam.normal(t)) >= 32]
    for chunk in (4_000_000, 300):
        got = decontam.with_matches(docs, benchmark, chunk_chars=chunk).collect()
        assert len(got) == len(rows)
        for x in got:
            if x["doc_id"] == 62:
                assert 5 in {m["item_id"] for m in x["matches"]}
                continue
            t = decontam.normal(x["text"])
            want = {(i, edit(p, t)) for i, p in usable if edit(p, t) <= int(len(p) * 0.06)}
            short = {50} if x["doc_id"] == 63 else set()
            assert {i for i, _ in want} | short == {m["item_id"] for m in x["matches"]}, x["doc_id"]
            for m in x["matches"]:
                if m["item_id"] == 50:
                    assert t[m["start"] : m["end"]] == "short one" and m["distance"] == 0
                    continue
                p = [p for i, p in usable if i == m["item_id"] and edit(p, t[m["start"] : m["end"]]) == m["distance"]]
                assert p and m["distance"] <= int(len(p[0]) * 0.06)
    clean = decontam.decontaminate(clashing(docs), benchmark)
    assert clean.columns == clashing(docs).columns and clean.count() == sum(not x["matches"] for x in got)
    assert decontam.decontaminate(docs, benchmark.limit(0)).count() == len(rows) and decontam.decontaminate(docs.limit(0), benchmark).count() == 0


# ---------------------------------------------------------------- simhash


def slow_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    rows = [r for r in docs.collect()]
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    ids = [i for i in fps if i is not None]
    want = slow_components([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    got = simhash.near_duplicates(clashing(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fp"] % 2**64 == fps[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 3, 5])
def test_trie_join_finds_every_link(spark, budget):
    r = random.Random(budget)
    fps = [r.getrandbits(64) for _ in range(80)]
    for _ in range(300):  # chains of near fingerprints
        x = r.choice(fps)
        for _ in range(r.randint(1, 7)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    want = slow_components([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= budget], range(len(fps)))
    found = {x["node"]: x["component"] for x in simhash.components(simhash.links(nodes, budget)).collect()}
    assert {n: found.get(n, n) for n in range(len(fps))} == want


def test_trie_walk_without_leaf_shortcut():
    r = np.random.default_rng(1)
    fp = np.unique(r.integers(0, 2**12, 900).astype(np.uint64) | (r.integers(0, 4, 900).astype(np.uint64) << np.uint64(48)))
    group = (fp >> np.uint64(48)).astype(np.int64)
    got = {(int(a), int(b)) for i, j in simhash.trie_links(group, fp, 48, 3, leaf=1) for a, b in zip(i, j)}
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert got == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    found = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# ---------------------------------------------------------------- sharding


def slow_best_fit(sizes, shards):
    """One group at a time."""
    total, left, room, out = sum(sizes), shards, {}, []
    for s in sizes:
        if left > 1 and s * left > total:
            out.append(shards - left)
            total, left = total - s, left - 1
            continue
        if not room:
            room = {b: -(-total // left) for b in range(shards - left, shards)}
        fit = [(free, b) for b, free in room.items() if free >= s]
        b = min(fit)[1] if fit else min(room, key=lambda b: (-room[b], b))
        room[b] -= s
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_packing_runs_equals_packing_groups(seed):
    r = random.Random(seed)
    sizes = sorted((r.choice([16, 17, 20, r.randint(16, 400), 16 + r.randint(0, 3000) * (r.random() < 0.1)]) for _ in range(r.randint(1, 200))), reverse=True)
    runs = sorted(collections.Counter(sizes).items(), reverse=True)
    got = []
    for size, places in sharding.best_fit_decreasing(runs, 8):
        done = 0
        for upto, b in places:
            got += [b] * (upto - done)
            done = upto
    assert got == slow_best_fit(sizes, 8)


def test_fixed_capacity_opens_bins():
    packed = sharding.best_fit_decreasing([(120, 1), (60, 3), (40, 3), (10, 2)], capacity=100)
    load = collections.Counter()
    for size, places in packed:
        done = 0
        for upto, b in places:
            load[b] += size * (upto - done)
            done = upto
    assert sum(load.values()) == 440 and max(v for v in load.values() if v != 120) <= 100 and len(load) == 5
    with pytest.raises(ValueError):
        sharding.best_fit_decreasing([(1, 1)])


def test_sharding(docs, empty):
    rows = docs.collect()
    got = sharding.shard(clashing(docs), shards=5).collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    where, slots, load = collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    totals = collections.Counter()
    for r in got:
        totals[r["text_crc32"]] += r["size"]
    assert load == collections.Counter({b: s for b, s in slow_load(sorted(totals.values(), reverse=True), 5).items()})
    assert sharding.shard(empty).count() == 0


def slow_load(sizes, shards):
    out = collections.Counter()
    for s, b in zip(sizes, slow_best_fit(sizes, shards)):
        out[b] += s
    return out


# ---------------------------------------------------------------- language model


def test_lm_base_and_lattice(docs, empty, spark):
    rows = docs.collect()
    tokens = [(r["doc_id"], [*words(r["text"]), None]) for r in rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, t in tokens if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in tokens)
    full = lmscore.score(clashing(docs)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in full) == want
    few = {str(r["doc_id"]): r["score"] for r in lmscore.score(docs, hot_words=5).collect()}
    assert all(r["score"] < 0 and few[str(r["doc_id"])] == pytest.approx(r["score"]) for r in full)
    assert lmscore.score(empty).count() == 0
    alone = lmscore.score(spark.createDataFrame([(23, "unseen words only")], "doc_id long, text string")).collect()
    assert len(alone) == 1


def test_lattice_sums_all_segmentations():
    pieces = {"▁": -1.0, "a": -1.5, "b": -2.0, "▁a": -2.2, "ab": -2.5, "▁ab": -3.0, "aba": -3.5}
    lattice = lmscore.Lattice(pieces, [-9.0] * 256)

    def paths(text):
        if not text:
            yield 0.0
        for k in range(1, len(text) + 1):
            score = pieces.get(text[:k])
            if score is None and k == 1:
                score = -9.0 * len(text[0].encode())
            if score is not None:
                for rest in paths(text[k:]):
                    yield score + rest

    for word in ["", "a", "abab", "aabba", "é", "aéb", "abaabab"]:
        assert lattice.log_probability(word) == pytest.approx(math.log(sum(math.exp(p) for p in paths("▁" + word))))
    uses = {}
    assert lattice.expected("abab", 3, uses)
    assert sum(len(p) * n for p, n in uses.items()) == pytest.approx(3 * 5)
    long = "ab" * 3000
    assert math.isfinite(lattice.log_probability(long)) and lattice.expected(long, 1, {})


def test_piece_scores_sum_to_one():
    with open(lmscore.VOCABULARY, "rb") as f:
        model = f.read()
    pieces, single, end = lmscore.piece_scores(model, [(300, 5.0), (1000, 7.0)], 3)
    assert sum(map(math.exp, [*pieces.values(), *single, end])) == pytest.approx(1)


def test_document_scores_equal_brute_force(spark):
    """Counts, one round of expectation-maximisation and document scores, over all segmentations one by one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lmscore.VOCABULARY)
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(1, 7))) + r.choice(["", "", "é", "\U0001f600"])
    texts = {i: " ".join(word() for _ in range(r.randint(0, 12))) for i in range(40)} | {40: None, 41: ""}
    train = {i: words(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10}
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    known = {sp.id_to_piece(i): i for i in normal if not sp.is_byte(i)}
    byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in normal if sp.is_byte(i)}

    def segmentations(text):
        if not text:
            yield []
            return
        heads = [[known[text[:k]]] for k in range(1, len(text) + 1) if text[:k] in known]
        heads = [(len(sp.id_to_piece(h[0])), h) for h in heads]
        if text[0] not in known:
            heads.append((1, [byte[b] for b in text[0].encode()]))
        for size, head in heads:
            for rest in segmentations(text[size:]):
                yield head + rest

    paths = {w: list(segmentations(lmscore.START + w)) for t in texts.values() for w in words(t)}

    def chances(uses):
        total = sum(uses.values()) + len(train) + 0.1 * (len(normal) + 1)
        return lambda i: (uses[i] + 0.1) / total, (len(train) + 0.1) / total

    count = collections.Counter(w for t in train.values() for w in t)
    first = collections.Counter()
    for w, c in count.items():
        for i in sp.encode(w):
            first[i] += c
    p, _ = chances(first)
    second = collections.Counter()
    for w, c in count.items():
        weight = [math.prod(map(p, path)) for path in paths[w]]
        for path, x in zip(paths[w], weight):
            for i in path:
                second[i] += c * x / sum(weight)
    p, end = chances(second)
    got = lmscore.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for x in got:
        want = math.log10(end) + sum(math.log10(sum(math.prod(map(p, path)) for path in paths[w])) for w in words(texts[x["doc_id"]]))
        assert x["score"] == pytest.approx(want, abs=1e-6)


# ---------------------------------------------------------------- substrings


@pytest.mark.parametrize("width,options", [(35, {}), (35, {"hash_bits": 2, "log_bits": 7}), (12, {"shard_pieces": 1}), (8, {"hash_bits": 6, "shard_pieces": 3})])
def test_substring_dedup(docs, empty, width, options):
    rows = docs.collect()
    tokens = [words(r["text"], False) for r in rows]
    seen = collections.Counter(tuple(t[i : i + width]) for t in tokens for i in range(len(t) - width + 1))
    want = []
    for r, t in zip(rows, tokens):
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[tuple(t[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(w for w, g in zip(t, gone) if not g)
        want.append((str(r["doc_id"]), len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substring.dedup(clashing(docs), width, **options).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got) == sorted(want)
    assert any(w[2] for w in want) and any(not w[2] for w in want)
    assert substring.dedup(empty, width, **options).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_automaton_marks_windows_that_stand_twice(seed):
    r = random.Random(seed)
    group = sorted({b" ".join(r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 30))) for _ in range(12)})
    width = r.randint(1, 6)
    split = [x.split(b" ") for x in group]
    seen = collections.Counter(tuple(x[i : i + width]) for x in split for i in range(len(x) - width + 1))
    assert substring.marked(group, width) == [sum(1 << i for i in range(len(x) - width + 1) if seen[tuple(x[i : i + width])] > 1) for x in split]


def test_pieces_cover_every_window_once():
    least = np.array([5] * 70 + [3, 4, 4], np.uint64)
    first, end = substring.pieces(least)
    assert [i for a, b in zip(first, end) for i in range(a, b)] == list(range(73)) and max(end - first) == substring.MOST
