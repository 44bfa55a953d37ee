"""Near copies of the pipeline against brute-force Jaccard."""

import random

import corpus_pipeline
from leafwork.llm import nearcopy

from .test_operators import slow_components


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(docs):
    """Ids that stay of {id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    near = [(a, b) for a in docs for b in docs if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = slow_components(near, list(docs))
    return sorted(i for i in docs if root[i] == i), near


def made():
    """Chains of near copies about the limit, copies of one text, short and empty texts, and a line that most share."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    docs, line = [], " ".join(word() for _ in range(12))
    for size in (3, 5, 6, 9, 14, 40, 41, 90, 200, 400):
        for _ in range(4):
            w = [word() for _ in range(size)]
            docs.append(" ".join(w))
            for _ in range(5):
                w = list(w)
                for _ in range(rng.randrange(1, 2 + size // 40)):
                    w[rng.randrange(len(w))] = word()
                w = w + [word() for _ in range(rng.randrange(3))] if rng.random() < 0.4 else w
                docs.append(" ".join(w) + (f" {line}" if rng.random() < 0.3 else ""))
    docs += ["", None, " ", docs[30], docs[30].upper(), line, f"{line} {line}"]
    rng.shuffle(docs)
    return dict(enumerate(docs))


def test_near_copies_equal_brute_force(spark):
    docs = made()
    want, near = slow_kept(docs)
    assert len(near) >= 50
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for options in ({}, {"sample": 0, "broadcast_rows": 0}):
        got = nearcopy.keep_one(table, **options)
        assert sorted(r["doc_id"] for r in got.collect()) == want


def test_pipeline_stage_leaves_no_near_copies(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want, near = slow_kept({r["doc_id"]: r["text"] for r in table.collect()})
    assert (1, 177) in near
    assert sorted(r["doc_id"] for r in corpus_pipeline.no_near_copies(spark, table, sf).collect()) == want


def test_links_of_a_bucket_are_a_forest_and_blocks_lose_none(spark):
    """F op12: links of a large group are fewer than its texts, and equal all pairs' also where a bucket is cut into blocks."""
    import random

    import numpy as np

    from leafwork.llm import minhash

    draw, sketch, docs = random.Random(11), minhash.Sketcher(), []
    base = [f"b{draw.randrange(10**5)}" for _ in range(200)]
    for i in range(120):
        words = list(base)
        for _ in range(draw.randrange(1, 4)):
            words[draw.randrange(200)] = f"c{draw.randrange(10**5)}"
        docs.append((i, " ".join(words)))
    docs += [(200, " "), (201, "\n"), (202, "\t\t")]
    sets = [sketch.shingles(t.encode()) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if minhash.jaccard(sets[i], sets[j]) >= 0.8]

    def roots(links):
        root = list(range(len(docs)))
        for _ in range(len(docs)):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    got = minhash.linked(sets, 0.8)
    root = roots(pairs)
    assert roots(got) == root and len(got) < len(docs) < len(pairs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = [{(r["same"], r["class_id"]) for r in minhash.near_copies(table, room=n).collect()} for n in (1 << 18, 2000)]
    assert found[0] == found[1] and {c for _, c in found[0]} == {docs[k][0] for k in np.unique(root) if root.count(k) > 1}
