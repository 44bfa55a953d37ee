"""Boxes of sparse and dense pages against brute force, and a page too full for all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.operators import figures, nearby

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
W, H = 612.0, 792.0


def boxes(r: random.Random, n: int, most: float = 120.0) -> list[dict]:
    out = []
    for _ in range(n):
        x, y, side = round(r.uniform(0, W), 1), round(r.uniform(0, H), r.choice([0, 1])), most if r.random() < 0.8 else most * 4
        out.append({"x0": x, "y0": y, "x1": x + round(r.uniform(0, side), 1), "y1": y + round(r.uniform(0, side), 1)})
    return out


def shared(a, b):
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    return w * h / max((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), 1.0) if w > 0 and h > 0 else 0.0


def within(a, b, by):
    x, y = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return b["x0"] - by <= x <= b["x1"] + by and b["y0"] - by <= y <= b["y1"] + by


def pages(seed, counts):
    r = random.Random(seed)
    return {(doc, page): boxes(r, n) for doc, page, n in counts}, r


@pytest.mark.parametrize("figs", [3, 64, 65, 200])
def test_text_in_figures(spark, figs):
    paras, r = pages(figs, [(1, 1, 150), (1, 2, 40), (2, 1, 1)])
    made = {k: [(f, r.choice([None, *boxes(r, 2, 30)])) for f in [*boxes(r, figs, 60), None]] for k in [(1, 1), (2, 1), (3, 1)]}
    p = spark.createDataFrame([(d, i, 0, pg, b, "paragraph" if i % 7 else "caption") for (d, pg), bs in paras.items() for i, b in enumerate([*bs, None], 1000 * pg)], f"doc_id long, seq long, part int, page int, box {BOX}, kind string")
    f = spark.createDataFrame([(d, pg, a, c) for (d, pg), fs in made.items() for a, c in fs], f"doc_id long, page int, box {BOX}, caption_box {BOX}")
    want = set()
    for (d, pg), bs in paras.items():
        for i, b in enumerate(bs, 1000 * pg):
            if i % 7 and any((a and (shared(b, a) > 0.35 or within(b, a, 8))) or (c and shared(b, c) > 0.45) for a, c in made.get((d, pg), [])):
                want.add((d, i))
    got = figures.mask_figure_text(p, f)
    assert {(x["doc_id"], x["seq"]) for x in got.where("kind = 'non_content'").collect()} == want and want
    assert got.count() == p.count()


def test_captions_crops_and_contents(spark):
    pgs, r = pages(5, [(1, 1, 120), (1, 2, 6), (2, 1, 30), (3, 1, 1)])
    rows = []
    for (d, pg), bs in pgs.items():
        for i, b in enumerate(bs, 1):
            text = f"Figure {i % 50 + 1} | The cell" if i % 3 == 1 else "a text of more than forty characters, which goes on " if i % 3 else "short"
            rows.append((d, pg, i, text, b, W, H))
    df = spark.createDataFrame(rows, f"doc_id long, page int, seq int, text string, box {BOX}, page_w double, page_h double")
    found = figures.captions(df)
    by_page = {}
    for d, pg, i, text, b, *_ in rows:
        by_page.setdefault((d, pg), []).append((i, text, b))
    caps = {(d, pg, i): b for d, pg, i, text, b, *_ in rows if i % 3 == 1}
    assert {(x["doc_id"], x["page"], x["seq"]) for x in found.collect()} == set(caps)

    got = {(x["doc_id"], x["page"], x["seq"]): x["caption"] for x in figures.caption_texts(found, df).collect()}
    for (d, pg, i), c in caps.items():
        parts = []
        for j, text, o in by_page[d, pg]:
            row, below = abs(o["y0"] - c["y0"]) < 8 and o["x0"] > c["x0"], c["y1"] <= o["y0"] <= c["y1"] + 16 and o["x0"] <= c["x1"] + 20 and len(text) > 40
            if j % 3 != 1 and (row or below):
                parts.append((round(o["y0"], 1), round(o["x0"], 1), j, text))
        assert got[d, pg, i] == " ".join([f"Figure {i % 50 + 1} | The cell", *(p[3].strip() for p in sorted(parts))])

    for kind in ("figure", "table"):
        crops = {(x["doc_id"], x["page"], x["seq"]): x["crop"] for x in figures.crop_boxes(found.withColumn("caption_kind", F.lit(kind)), df).collect()}
        known = []
        for (d, pg, i), c in caps.items():
            others = [(j, o) for j, _, o in by_page[d, pg] if j != i]
            known.append((
                d, pg, i, c, max((o["y1"] for _, o in others if o["y1"] < c["y0"] - 8 and o["y1"] > H * 0.12), default=None),
                min((o["y0"] for j, o in others if j % 3 == 1 and o["y0"] > c["y1"] + 30), default=None),
                max((o["y1"] for _, o in others if c["y1"] + 6 < o["y0"] < c["y1"] + H * 0.45), default=None),
            ))
        k = spark.createDataFrame(known, f"doc_id long, page int, seq int, c {BOX}, above double, next double, dense double")
        w, h = F.lit(W), F.lit(H)
        crop = G.table_crop(F.col("c"), w, h, F.col("next"), F.col("dense")) if kind == "table" else G.figure_crop(F.col("c"), w, h, F.col("above"))
        assert crops == {(x["doc_id"], x["page"], x["seq"]): x["crop"] for x in k.withColumn("crop", crop).collect()}

    images, drawings = boxes(r, 90), boxes(r, 90)
    table = lambda bs: spark.createDataFrame([(d, pg, b) for (d, pg) in [(1, 1), (1, 2)] for b in bs], f"doc_id long, page int, box {BOX}")
    got = {(x["doc_id"], x["page"], x["seq"]): (x["content_box"], x["image_source"]) for x in figures.content_boxes(found, table(images), table(drawings)).collect()}
    want = {}
    for (d, pg, i), c in caps.items():
        area = lambda o: (o["x1"] - o["x0"]) * (o["y1"] - o["y0"])
        tier = lambda o, rank: 0 if o["y0"] > H * 0.03 and area(o) > W * H * 0.015 else rank + 1
        ranked = sorted((tier(o, k), -area(o), k, o["y0"], o["x0"], o["y1"]) for k, bs in enumerate([images, drawings]) for o in bs if o["y1"] < c["y0"] + 10 and d == 1)
        if ranked and c["y0"] - ranked[0][5] <= H * 0.4:
            want[d, pg, i] = (max(0.0, ranked[0][4] - 8), max(0.0, ranked[0][3] - 8), ["embedded", "drawing"][ranked[0][2]])
    assert {k: (b["x0"], b["y0"], s) for k, (b, s) in got.items()} == want and len(want) > 5


def test_page_of_50000_boxes(spark):
    n, rng = 50_000, np.random.default_rng(3)
    at = lambda size: np.stack([rng.uniform(0, 2000, n), rng.uniform(0, 2000, n), rng.uniform(1, size, n), rng.uniform(1, size, n)])
    a, b = at(9), at(9)
    a[2:, :20] = 2000  # some boxes as large as the page
    rows = lambda m: [(7, 1, int(i), (float(x), float(y), float(x + w), float(y + h))) for i, (x, y, w, h) in enumerate(m.T)]
    left = spark.createDataFrame(rows(a), f"doc_id long, page int, seq long, box {BOX}").repartition(8)
    right = spark.createDataFrame(rows(b), f"doc_id long, page int, other long, r {BOX}").repartition(8)
    met = nearby.meeting(left, right, "box", "r")
    touch = (F.col("box.x0") <= F.col("r.x1")) & (F.col("r.x0") <= F.col("box.x1")) & (F.col("box.y0") <= F.col("r.y1")) & (F.col("r.y0") <= F.col("box.y1"))
    told = met.select("seq", "other", touch.alias("touch")).groupBy("seq").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(F.when(F.col("touch"), F.col("other"))).alias("n")).collect()
    got = {x["seq"]: x["n"] for x in told}
    assert sum(x["pairs"] for x in told) < 25_000_000  # of 2.5 x 10^9
    for i in [*range(25), *range(100, n, 499)]:
        x, y, w, h = a[:, i]
        assert got.get(i, 0) == int(((b[0] <= x + w) & (x <= b[0] + b[2]) & (b[1] <= y + h) & (y <= b[1] + b[3])).sum())
