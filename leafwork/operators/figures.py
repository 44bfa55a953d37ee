"""Figures: captions, the boxes they belong to, and the text within them.

No join makes all pairs of a page: boxes meet by cells, rows by bands of their height, and what stands next above or below a
caption comes from windows over the page.  Boxes have their upper left corner first.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G, rules, text as T
from ..functions.numbers import round_even
from ..tables import cut
from .nearby import PAGE, band, bands, meeting



def captions(blocks: DataFrame) -> DataFrame:
    """Caption blocks with figure_id and kind."""
    found = blocks.where(rules.is_caption(F.col("text"))).withColumn("figure_id", T.figure_id(F.col("text")))
    return found.withColumn("caption_kind", rules.caption_kind(F.col("figure_id")))


def caption_texts(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Captions with the whole ``caption`` and ``caption_box``: blocks in the same row or wrapped below go with them."""
    others = blocks.where(~rules.is_caption(F.col("text"))).select(*PAGE, F.col("seq").alias("o_seq"), F.col("text").alias("o_text"), F.col("box").alias("o_box"), band(F.col("box.y0")).alias("_band"))
    c, o = F.col("box"), F.col("o_box")
    same_row = (F.abs(o["y0"] - c["y0"]) < 8) & (o["x0"] > c["x0"])
    below = o["y0"].between(c["y1"], c["y1"] + 16) & (o["x0"] <= c["x1"] + 20) & (F.length("o_text") > 40)
    part = F.when(F.col("o_seq").isNotNull(), F.struct(round_even(o["y0"], 1).alias("y"), round_even(o["x0"], 1).alias("x"), F.col("o_seq").alias("s"), F.col("o_text").alias("t"), o.alias("b")))
    # A point more on either side, so that rounding loses nothing.  A caption comes once without a band, whatever it meets; else only what it meets goes on.
    reach = F.array_union(bands(c["y0"] - 9, c["y0"] + 9), bands(c["y1"] - 1, c["y1"] + 17))
    reach = F.concat(F.array(F.lit(None).cast("long")), F.coalesce(reach, F.array().cast("array<bigint>")))
    rows = found.withColumn("_band", F.explode(reach)).join(others, [*PAGE, "_band"], "left").where(F.col("_band").isNull() | same_row | below).select(*found.columns, part.alias("part"))
    keys = [c for c in found.columns if c not in ("text", "box")]
    rows = rows.groupBy(*[F.col(k) for k in keys], "text", "box").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    parts = F.col("parts")
    text = F.array_join(F.concat(F.array("text"), F.transform(parts, lambda p: p["t"])), " ")
    box = F.aggregate(F.transform(parts, lambda p: p["b"]), F.col("box").cast(G.BOX), lambda a, b: G.union(a, b))
    return rows.withColumns({"caption": T.squeeze(text), "caption_box": box}).drop("parts")


def _next_other(events: DataFrame, best, value: str, out: str, order) -> DataFrame:
    """Add ``out``: the last ``value`` (number, seq) before each row of a page in ``order``, of another seq than the row's own.

    Values come in order, so each is the best so far; where the seq changes, the one before it is the best of all other seqs.
    """
    rows = Window.partitionBy(*PAGE).orderBy(order, "tie", "seq")
    before, upto = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({"_before": best(value).over(before), "_first": best(value).over(upto)})
    changed = F.when(F.col(value)["seq"] != F.col("_before.seq"), F.col("_before"))
    events = events.withColumn("_second", best(changed).over(upto))
    found = F.when(F.col("_first.seq") == F.col("seq"), F.col("_second")).otherwise(F.col("_first"))
    number = events.schema[value].dataType.names[0]
    return events.withColumn(out, found[number]).drop("_before", "_first", "_second")


def _lowest_within(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, seq, dense): the lowest bottom of the blocks of other seqs that start between ``low`` and ``high``, neither included.

    Bands wholly within have the lowest bottoms of two seqs ready; only blocks of the two bands at the ends are looked at one by one.
    """
    keys = [*PAGE, "_band"]
    blocks = blocks.select(*PAGE, band(F.col("y0")).alias("_band"), "y0", "y1", F.col("seq").alias("o_seq"))
    first, last = band(F.col("low")), band(F.col("high"))
    asked = asked.where(F.col("low") < F.col("high"))
    ends = asked.withColumn("_band", F.explode(F.array_distinct(F.array(first, last)))).join(blocks, keys)
    ends = ends.where((F.col("y0") > F.col("low")) & (F.col("y0") < F.col("high")) & (F.col("o_seq") != F.col("seq")))
    each = blocks.groupBy(*keys, "o_seq").agg(F.max("y1").alias("y1"))
    two = each.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("y1", "o_seq")), False), 1, 2).alias("two"))
    inner = asked.where(last - first > 1).withColumn("_band", F.explode(F.sequence(first + 1, last - 1))).join(two, keys)
    other = F.get(F.filter("two", lambda x: x["o_seq"] != F.col("seq")), F.lit(0))["y1"]
    both = ends.select(*PAGE, "seq", "y1").union(inner.select(*PAGE, "seq", other))
    return both.groupBy(*PAGE, "seq").agg(F.max("y1").alias("dense"))


def crop_boxes(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``crop``, the region of a figure above or a table below its caption, and ``try_next``, whether it may be on the next page."""
    c, h = F.col("box"), F.col("page_h")
    o = blocks.where(F.col("box").isNotNull()).select(*PAGE, "seq", F.col("box.y0").alias("y0"), F.col("box.y1").alias("y1"), rules.is_caption(F.col("text")).alias("caption"))
    asked = found.where(c.isNotNull()).select(*PAGE, "seq", h.alias("h"), c["y0"].alias("c0"), c["y1"].alias("c1"))
    # One row for each block and each caption; a caption comes before blocks at the same height, which do not count.
    none = F.lit(None).cast("double")
    events = o.select(*PAGE, "seq", none.alias("h"), F.col("y1").alias("up"), F.col("y0").alias("down"), F.lit(1).alias("tie"), F.struct("y1", "seq").alias("_a"), F.when(F.col("caption"), F.struct("y0", "seq")).alias("_n"))
    events = events.unionByName(asked.select(*PAGE, "seq", "h", (F.col("c0") - 8).alias("up"), (F.col("c1") + 30).alias("down"), F.lit(0).alias("tie")), allowMissingColumns=True)
    events = _next_other(events, F.max, "_a", "above", "up")
    events = _next_other(events, F.min, "_n", "next_caption", F.desc("down")).where("tie = 0")
    near = events.groupBy(*PAGE, "seq").agg(F.max(F.when(F.col("above") > F.col("h") * 0.12, F.col("above"))).alias("above"), F.min("next_caption").alias("next_caption"))
    near = near.join(_lowest_within(asked.select(*PAGE, "seq", (F.col("c1") + 6).alias("low"), (F.col("c1") + F.col("h") * 0.45).alias("high")), o), [*PAGE, "seq"], "left")
    out = found.join(near, ["doc_id", "page", "seq"], "left")
    table = G.table_crop(c, F.col("page_w"), h, F.col("next_caption"), F.col("dense"))
    figure = G.figure_crop(c, F.col("page_w"), h, F.col("above"))
    crop = F.when(F.col("caption_kind") == "table", table).otherwise(figure)
    return out.withColumns({"crop": crop, "try_next": c["y0"] > h * 0.72}).drop("above", "next_caption", "dense")


def content_boxes(found: DataFrame, images: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, page, seq, content_box, image_source): the largest image or drawing above each caption, padded.

    Boxes too small or too near the head of the page count only where no other stands above; images come before drawings
    then.  A box that ends more than 40 % of the page above its caption is not its figure.
    """
    boxes = images.select(*PAGE, F.col("box").alias("o"), F.lit("embedded").alias("source"), F.lit(0).alias("rank"))
    boxes = boxes.unionByName(drawings.select(*PAGE, F.col("box").alias("o"), F.lit("drawing").alias("source"), F.lit(1).alias("rank")))
    asked = found.select(*PAGE, "seq", "page_w", "page_h", F.col("box.y0").alias("c0"), (F.col("box.y0") + 10).alias("at"), F.lit(0).alias("tie")).where("at is not null")
    events = asked.unionByName(boxes.select(*PAGE, "o", "source", "rank", F.col("o.y1").alias("at"), F.lit(1).alias("tie")).where("at is not null"), allowMissingColumns=True)
    page = Window.partitionBy(*PAGE)
    events = events.withColumns({"_w": F.max("page_w").over(page), "_h": F.max("page_h").over(page)})
    area = G.area(F.col("o"))
    strict = (F.col("o.y0") > F.col("_h") * 0.03) & (area > F.col("_w") * F.col("_h") * 0.015)
    tier = F.when(strict, 0).otherwise(F.col("rank") + 1)
    candidate = F.when(F.col("tie") == 1, F.struct(tier.alias("tier"), (-area).alias("area"), "rank", F.col("o.y0").alias("y0"), F.col("o.x0").alias("x0"), "o", "source"))
    # The best of all boxes that end higher than ten points below the top of the caption.
    best = events.withColumn("best", F.min(candidate).over(page.orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, 0))).where("tie = 0 and best is not null")
    best = best.where(F.col("c0") - F.col("best.o.y1") <= F.col("page_h") * 0.4)
    return best.select(*PAGE, "seq", G.padded(F.col("best.o"), F.col("page_w"), F.col("page_h")).alias("content_box"), F.col("best.source").alias("image_source"))


def usable_images(images: DataFrame, min_size: float = 150.0) -> DataFrame:
    """Embedded images that are large enough and do not fill the page."""
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    return images.where((w >= min_size) & (h >= min_size) & (w * h <= 0.85 * F.col("page_w") * F.col("page_h")))


def merged_drawings(drawings: DataFrame, min_size: float = 150.0) -> DataFrame:
    """Vector drawings, clipped to the page and merged when one starts within 30 points below another at nearly the same left edge."""
    b = F.col("box")
    clipped = G.box(F.greatest(F.lit(0.0), b["x0"]), F.greatest(F.lit(0.0), b["y0"]), F.least(F.col("page_w"), b["x1"]), F.least(F.col("page_h"), b["y1"]))
    rows = drawings.withColumn("box", clipped)
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    rows = rows.where((w > min_size) & (h > min_size) & (w < F.col("page_w") * 0.95) & (h < F.col("page_h") * 0.9))
    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("box.y0", "box.x0", "box.x1", "box.y1"))).alias("bs"))
    kind = "array<struct<y0: double, x0: double, x1: double, y1: double>>"

    def step(done, b):
        last = F.try_element_at(done, F.lit(-1))
        joins = last.isNotNull() & (b["y0"] <= last["y1"] + 30) & (F.abs(b["x0"] - last["x0"]) < 80)
        grown = F.struct(last["y0"].alias("y0"), last["x0"].alias("x0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        head = F.when(joins, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.concat(head, F.array(F.when(joins, grown).otherwise(b))).cast(kind)

    out = pages.select(*PAGE, F.explode(F.aggregate("bs", F.array().cast(kind), step)).alias("m"))
    return out.select(*PAGE, G.box(F.col("m.x0"), F.col("m.y0"), F.col("m.x1"), F.col("m.y1")).alias("box"))


def legend_only(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Captions with ``legend_only``: under a heading "Figure legends" or within three pages of the first one, or low among three or more."""
    heads = blocks.where(T.has(T.strip(F.col("text")), "^Figure Legends?$")).select(*PAGE, F.col("box.y0").alias("y"))
    on_page = heads.groupBy(*PAGE).agg(F.min("y").alias("head_y"))
    first = heads.groupBy("doc_id").agg(F.min("page").alias("first_page"))
    rows = found.join(on_page, PAGE, "left").join(first, "doc_id", "left")
    many = F.count(F.lit(1)).over(Window.partitionBy(*PAGE)) >= 3
    hit = (F.col("head_y") < F.col("box.y0")) | F.col("page").between(F.col("first_page"), F.col("first_page") + 3)
    return rows.withColumn("legend_only", F.coalesce(hit, F.lit(False)) | (many & (F.col("box.y0") > 250))).drop("head_y", "first_page")


def dedupe_figures(figures: DataFrame) -> DataFrame:
    """One row per document and figure id (A8): an image beats none, a payload over 1.1 times the kept one replaces it, else the first stays.

    Needs figure_id, fig_seq and payload (length of the image, 0 without one).  The rule depends on the order, so it is a fold.
    """
    key = F.replace(F.lower("figure_id"), F.lit(" "), F.lit(""))
    item = F.struct("fig_seq", F.coalesce("payload", F.lit(0)).cast("long").alias("payload"))
    groups = figures.groupBy("doc_id", key.alias("_key")).agg(F.array_sort(F.collect_list(item)).alias("fs"))

    def step(kept, f):
        better = ((f["payload"] > 0) & (kept["payload"] == 0)) | ((kept["payload"] > 0) & (f["payload"] > kept["payload"] * 1.1))
        return F.when(better, f).otherwise(kept)

    keep = groups.select("doc_id", F.aggregate(F.slice("fs", 2, 1 << 30), F.get("fs", F.lit(0)), step)["fig_seq"].alias("fig_seq"))
    return figures.join(keep, ["doc_id", "fig_seq"], "left_semi")


def mask_figure_text(paragraphs: DataFrame, figures: DataFrame) -> DataFrame:
    """Paragraphs within a figure or its caption are not content."""
    p = F.col("box")
    around = F.when(F.col("box").isNotNull(), G.box(F.col("box.x0") - 8, F.col("box.y0") - 8, F.col("box.x1") + 8, F.col("box.y1") + 8))
    region = lambda b, r, figure: F.struct(b.cast(G.BOX).alias("b"), r.cast(G.BOX).alias("r"), F.lit(figure).alias("figure"))
    both = F.array(region(F.col("box"), around, True), region(F.col("caption_box"), F.col("caption_box"), False))
    regions = figures.select(*PAGE, F.inline(both)).where("b is not null").distinct()
    asked = paragraphs.where((F.col("kind") != "caption") & p.isNotNull()).select(*PAGE, "seq", "part", "box")
    shared = G.overlap_ratio(p, F.col("b"))
    inside = F.when(F.col("figure"), (shared > 0.35) | G.centre_inside(p, F.col("b"), 8.0)).otherwise(shared > 0.45)
    hits = meeting(asked, regions, "box", "r").where(inside).select("doc_id", "seq", "part").distinct()
    rows = paragraphs.join(hits.withColumn("_hit", F.lit(True)), ["doc_id", "seq", "part"], "left")
    return rows.withColumn("kind", F.when(F.col("_hit"), "non_content").otherwise(F.col("kind"))).drop("_hit")


class Renderer(Protocol):
    """Cuts pixels from a file; a library that is not here.  Must be picklable; it is used inside tasks."""

    def pixels(self, content: bytes, page: int, box: tuple[float, float, float, float], zoom: float) -> np.ndarray:
        """Rows x columns x 3 of the part of a page."""

    def encode(self, pixels: np.ndarray, mime: str, compress: bool) -> bytes: ...


def region_score(pixels: np.ndarray, most: int = 120_000) -> float:
    """How much there is to see: shares of pixels that are not white, coloured (1.8 times) and dark (a quarter), of every n-th pixel."""
    flat = np.asarray(pixels).reshape(-1, 3)
    flat = flat[:: max(1, len(flat) // most)].astype(int)
    if not len(flat):
        return 0.0
    high, low = flat.max(axis=1), flat.min(axis=1)
    return float((high < 245).mean() + 1.8 * (high - low > 25).mean() + 0.25 * (high < 120).mean())


def _by_document(figures: DataFrame, files: DataFrame, columns: list[str], one, schema: str) -> DataFrame:
    """one(content, row) for each figure, file by file; ``columns`` of the figure go with it.  Rows are joined as one array per file."""
    def run(frames):
        for pdf in frames:
            rows = [one(None if c is None else bytes(c), r) | {"doc_id": d, "fig_seq": r["fig_seq"]} for d, c, rs in zip(pdf["doc_id"], pdf["content"], pdf["rows"]) for r in rs]
            if rows:
                yield pd.DataFrame(rows)

    grouped = figures.groupBy("doc_id").agg(F.collect_list(F.struct("fig_seq", *columns)).alias("rows"))
    return grouped.join(files.select("doc_id", "content"), "doc_id", "left").select("doc_id", "content", "rows").mapInPandas(run, f"{schema}, doc_id long, fig_seq int")


def _corners(box) -> tuple[float, float, float, float]:
    return tuple(box[k] for k in ("x0", "y0", "x1", "y1"))


def swapped(figures: DataFrame, files: DataFrame | None, renderer: Renderer | None) -> DataFrame:
    """Figures low on a page move to the head of the next one where that has more than 1.35 times as much to see."""
    if renderer is None or files is None:
        return figures

    def score(content, page, box):
        x0, y0, x1, y1 = box
        if content is None or x1 - x0 < 50 or y1 - y0 < 50:
            return 0.0
        try:
            return region_score(renderer.pixels(content, page, box, 0.55))
        except Exception:  # a renderer may fail in any way
            return 0.0

    def one(content, r):
        return {"swap": score(content, r["page"] + 1, _corners(r["next_box"])) > 1.35 * score(content, r["page"], _corners(r["box"]))}

    asked = figures.where(F.col("try_next") & F.col("next_box").isNotNull())
    found = _by_document(asked, files, ["page", "box", "next_box"], one, "swap boolean")
    out = figures.join(found, ["doc_id", "fig_seq"], "left")
    return out.withColumns({"box": F.when(F.col("swap"), F.col("next_box")).otherwise(F.col("box")), "page": F.when(F.col("swap"), F.col("page") + 1).otherwise(F.col("page"))}).drop("swap")


def cropped(figures: DataFrame, files: DataFrame | None, renderer: Renderer | None, mime: str = "image/png", compress: bool = True, zoom: float = 2.5) -> DataFrame:
    """Add image, image_mime and payload; captions among legends get no crop, and what cannot be cut leaves a warning."""
    legend, small = "legend without an image", "the box is too small to be a figure"
    if renderer is None or files is None:
        warning = F.when(F.col("legend_only"), legend).otherwise("")
        return figures.withColumns({"image": F.lit(None).cast("binary"), "image_mime": F.lit(None).cast("string"), "payload": F.lit(0), "warning": warning})

    def one(content, r):
        x0, y0, x1, y1 = _corners(r["box"])
        if x1 - x0 < 20 or y1 - y0 < 20:
            return {"image": None, "why": small}
        try:
            return {"image": renderer.encode(renderer.pixels(content, r["page"], (x0, y0, x1, y1), zoom), mime, compress), "why": ""}
        except Exception as e:
            return {"image": None, "why": str(e) or type(e).__name__}

    found = _by_document(figures.where(~F.col("legend_only")), files, ["page", "box"], one, "image binary, why string")
    out = figures.join(found, ["doc_id", "fig_seq"], "left")
    size = F.coalesce(F.length("image"), F.lit(0))
    return out.withColumns({"image_mime": F.when(F.col("image").isNotNull(), mime), "payload": size, "warning": F.when(F.col("legend_only"), legend).otherwise(F.coalesce("why", F.lit("")))}).drop("why")


def extract(blocks: DataFrame, images: DataFrame | None = None, drawings: DataFrame | None = None, files: DataFrame | None = None, renderer: Renderer | None = None, mime: str = "image/png", zoom: float = 2.5, compress: bool = True) -> DataFrame:
    """Figures of a corpus: id, page, caption, box, caption box, image, image source and warning.

    Boxes come from content where there is some, else from the layout.  With ``files`` (doc_id, content) and a renderer
    figures may move to the next page and pixels are cut; without, figures have no image.
    """
    found = legend_only(caption_texts(captions(blocks), blocks), blocks)
    found = crop_boxes(found, blocks)
    if images is not None and drawings is not None:
        found = found.join(content_boxes(found, usable_images(images), merged_drawings(drawings)), ["doc_id", "page", "seq"], "left")
    else:
        found = found.withColumns({"content_box": F.lit(None).cast(G.BOX), "image_source": F.lit(None).cast("string")})
    heads = blocks.groupBy("doc_id", (F.col("page") - 1).alias("page")).agg(F.max("page_w").alias("nw"), F.max("page_h").alias("nh"), F.min(F.when(rules.is_caption(F.col("text")), F.col("box.y0"))).alias("nc"))
    found = found.join(heads, PAGE, "left").withColumn("next_box", F.when(F.col("nw").isNotNull(), G.next_page_crop(F.col("nw"), F.col("nh"), F.col("nc"))))
    use = F.when(F.col("caption_kind") == "table", F.lit(None)).otherwise(F.col("content_box"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq"))
    out = found.select(
        "doc_id", order.alias("fig_seq"), "figure_id", "page", "caption", F.coalesce(use, F.col("crop")).alias("box"), "caption_box",
        F.when(use.isNotNull(), F.col("image_source")).otherwise("heuristic").alias("image_source"), "legend_only", "try_next", "next_box",
    )
    if renderer is not None:
        out = cut(out)
    out = cropped(swapped(out, files, renderer), files, renderer, mime, compress, zoom).drop("legend_only", "try_next", "next_box")
    return dedupe_figures(cut(out) if renderer is not None else out)
