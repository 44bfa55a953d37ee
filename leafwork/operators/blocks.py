"""From layout blocks to classified paragraphs.

Keys are (doc_id, page, block_no); every shuffle is by doc_id, so one hash partitioning serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text as T
from ..functions.numbers import round_even
from ..functions.rules import is_caption
from ..tables import cut

DOC = ["doc_id"]


def blocks_from_layout(layout: DataFrame) -> DataFrame:
    """Text, font size and weight of each block from the spans of its lines.

    Lines are joined by newlines; the font size is the mean over spans above half a point, weighted by their
    characters, to one decimal; a block is bold if a span's font says so or bit 16 of its flags is set.
    """
    spans = F.flatten(F.transform("lines", lambda line: line["spans"]))
    spans = F.filter(F.coalesce(spans, F.array()), lambda s: s["text"] != "")
    joined = F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")), "\n")
    sized = F.filter(spans, lambda s: s["size"] > 0.5)
    add = lambda f: F.aggregate(sized, F.lit(0.0), lambda a, s: a + f(s))
    weight = add(lambda s: F.length(s["text"]).cast("double"))
    size = F.when(weight > 0, round_even(add(lambda s: s["size"] * F.length(s["text"])) / weight, 1))
    bold = F.exists(spans, lambda s: F.coalesce(F.contains(s["font"], F.lit("Bold")), F.lit(False)) | (s["flags"].bitwiseAND(16) != 0))
    image = F.col("block_type") == 1
    return layout.select(
        "doc_id", "page", "block_no", "box", "page_w", "page_h",
        F.when(image, "").otherwise(F.coalesce(joined, F.lit(""))).alias("text"), "block_type",
        F.when(~image, size).alias("font_size"), F.when(image, False).otherwise(bold).alias("is_bold"),
    )


def body_font(layout: DataFrame, pages: int = 5, min_chars: int = 30) -> DataFrame:
    """(doc_id, body_font): the upper median size of long spans on the first pages (A3)."""
    spans = layout.where((F.col("page") <= pages) & (F.col("block_type") == 0)).select("doc_id", F.explode(F.flatten(F.transform("lines", lambda line: line["spans"]))).alias("s"))
    sizes = spans.where(F.length(T.strip(F.col("s.text"))) > min_chars).groupBy(*DOC).agg(F.array_sort(F.collect_list("s.size")).alias("v"))
    return sizes.select("doc_id", upper_median(F.col("v")).alias("body_font"))


def upper_median(ordered: Column) -> Column:
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def upper_median_by(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out): the upper median of each key's values, from how often each value comes, so that no key's rows ever meet."""
    each = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)
    each = each.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    return each.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(key).agg(F.min(value).alias(out))


def preview_documents(blocks: DataFrame, pages: int = 5) -> DataFrame:
    """(doc_id, preview): whether the banner of an early version stands on the first pages (F1)."""
    return blocks.where(F.col("page") <= pages).groupBy(*DOC).agg(F.coalesce(F.max(rules.is_preview_banner(F.col("text"))), F.lit(False)).alias("preview"))


def reading_rank(box: Column, width: Column, height: Column) -> Column:
    """0 full width at the top, 1 left column, 2 right column, 3 other full-width blocks at the bottom or head."""
    wide = box["x1"] - box["x0"] > width * 0.72
    top = wide & (box["y0"] < height * 0.18)
    low = wide & ((box["y0"] > height * 0.86) | (box["y1"] < height * 0.22))
    return F.when(top, 0).when(low, 3).when((box["x0"] + box["x1"]) / 2 < width / 2, 1).otherwise(2)


def reading_order(blocks: DataFrame, preview: Column | None = None, out: str = "seq") -> DataFrame:
    """Number the blocks of a page in reading order, from 1; an early version has one column."""
    rank = reading_rank(F.col("box"), F.col("page_w"), F.col("page_h"))
    if preview is not None:
        rank = F.when(preview, 0).otherwise(rank)
    w = Window.partitionBy("doc_id", "page").orderBy(rank, round_even(F.col("box.y0"), 1), round_even(F.col("box.x0"), 1), "block_no")
    return blocks.withColumn(out, F.row_number().over(w))


def repeated_exact(blocks: DataFrame, min_pages: int = 3, max_spread: float = 30.0) -> DataFrame:
    """(doc_id, key) of texts on three pages or more at nearly one height (A1).  Numbers are left aside."""
    keyed = blocks.select("doc_id", "page", T.repeat_key(F.col("text")).alias("key"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("y"))
    keyed = keyed.where((F.col("key") != "") & ~F.col("key").rlike(r"(?U)^\d+$"))
    groups = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages"), (F.max("y") - F.min("y")).alias("spread"))
    return groups.where((F.col("pages") >= min_pages) & (F.col("spread") < max_spread)).select("doc_id", "key")


def _keyed(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, y, key, fuzzy, head, edge): the keys of each text, and whether it stands at an edge of the first page's height, long enough
    to be a running head, and of its own page's.  It lies by document, and what follows groups it there."""
    first = F.first("page_h").over(Window.partitionBy("doc_id").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    y = (F.col("box.y0") + F.col("box.y1")) / 2
    rows = blocks.select("doc_id", "page", "seq", "page_h", y.alias("y"), "text").withColumn("h0", first)
    rows = rows.select("doc_id", "page", "y", "page_h", "h0", T.squeeze(F.col("text")).alias("flat"))
    rows = rows.withColumns({"fuzzy": T.fuzzy_key(F.col("flat")), "key": T.repeat_key(F.col("flat"))}).where("key <> ''")
    edge = lambda h: (F.col("y") < h * 0.12) | (F.col("y") > h * 0.88)
    head = F.col("doc_id").isNotNull() & (F.length("flat") > 5) & edge(F.col("h0")) & (F.length("fuzzy") > 3)
    return rows.select("doc_id", "page", "y", "key", "fuzzy", F.coalesce(head, F.lit(False)).alias("head"), F.coalesce(edge(F.col("page_h")), F.lit(False)).alias("edge"))


def repeated_fuzzy(blocks: DataFrame, min_pages: int = 3) -> DataFrame:
    """(doc_id, key) of running heads and feet that differ in the numbers at their ends (A2)."""
    groups = _keyed(blocks).where("head or edge").groupBy("doc_id", "fuzzy").agg(F.size(F.collect_set(F.when(F.col("head"), F.col("page")))).alias("pages"), F.collect_set(F.when(F.col("edge"), F.col("key"))).alias("keys"))
    return groups.where(F.col("pages") >= min_pages).select("doc_id", F.explode("keys").alias("key")).distinct()


def repeated(blocks: DataFrame, min_pages: int = 3, max_spread: float = 30.0) -> DataFrame:
    """Exact and fuzzy repeats together (U4), from one pass: each text goes to the group of its key and to that of its fuzzy key."""
    exact = F.when(~F.col("key").rlike(r"(?U)^\d+$"), F.struct(F.lit(True).alias("exact"), F.col("key").alias("by")))
    fuzzy = F.when(F.col("head") | F.col("edge"), F.struct(F.lit(False).alias("exact"), F.col("fuzzy").alias("by")))
    rows = _keyed(blocks).withColumn("to", F.explode(F.array_compact(F.array(exact, fuzzy)))).select("*", "to.*")
    pages = F.size(F.collect_set(F.when(F.col("exact") | F.col("head"), F.col("page"))))
    keys = F.collect_set(F.when(~F.col("exact") & F.col("edge"), F.col("key")))
    groups = rows.groupBy("doc_id", "exact", "by").agg(pages.alias("pages"), (F.max("y") - F.min("y")).alias("spread"), keys.alias("keys"))
    groups = groups.where((F.col("pages") >= min_pages) & (~F.col("exact") | (F.col("spread") < max_spread)))
    return groups.select("doc_id", F.explode(F.when(F.col("exact"), F.array("by")).otherwise(F.col("keys"))).alias("key")).distinct()


def classify(blocks: DataFrame, body: DataFrame, preview: DataFrame) -> DataFrame:
    """Clean each block and give it a kind and a heading level; later rules override earlier ones.

    Adds clean text as ``text``, ``seq`` (reading order within the document), ``kind`` and ``heading_level``.
    """
    rows = blocks.where((F.col("block_type") != 1) & (T.strip(F.col("text")) != ""))
    rows = rows.join(body, DOC, "left").join(preview, DOC, "left").withColumn("preview", F.coalesce("preview", F.lit(False)))
    rows = reading_order(rows, F.col("preview"), "page_seq")
    # Dealt out of an array, so that the test for blank texts does not clean each text once more.
    clean = F.filter(F.array(T.clean_text(F.col("text"), F.col("preview") & (F.col("page") > 1))), lambda t: t != "")
    rows = rows.withColumn("text", F.explode(clean))
    t, b, w, h = F.col("text"), F.col("box"), F.col("page_w"), F.col("page_h")
    rows = rows.withColumn("is_caption", is_caption(t))
    rows = rows.withColumn("is_heading", rules.is_heading(t, F.col("is_caption")))
    rows = rows.withColumns({"is_noise": rules.is_non_content(t, F.col("is_caption"), F.col("is_heading")), "inline": rules.split_inline_heading(t)})
    non = F.lit("non_content")
    kind = F.when(rules.is_margin(t, b, w, h), non).when(F.col("is_caption"), "caption").when(F.col("is_heading"), "heading").otherwise("paragraph")
    barred = rules.is_watermark(t, b, w, h, F.col("font_size")) | (F.col("preview") & (F.col("page") <= 2) & rules.is_preview_front(t))
    rows = rows.withColumn("kind", F.when(barred, non).otherwise(kind))
    level = lambda x: rules.heading_level(x, F.col("font_size"), F.col("is_bold"), F.col("body_font"), F.col("is_caption"), F.col("is_noise"))
    lead = (F.col("kind") == "paragraph") & F.col("is_bold") & (F.col("font_size") >= F.col("body_font") * 0.9) & (F.col("inline.rest") != "") & (F.length("inline.title") > 10)
    lead = F.coalesce(lead, F.lit(False))
    rows = rows.withColumns({
        "heading_level": F.when(F.col("kind") == "heading", level(t)).when(lead, F.greatest(level(F.col("inline.title")), F.lit(1))).otherwise(0),
        "kind": F.when(lead, "heading").otherwise(F.col("kind")),
    })
    kind = F.col("kind")
    noise = (kind != "caption") & F.col("is_noise")
    axis = (kind == "paragraph") & rules.is_axis_label(t)
    author = (F.col("page") == 1) & (b["y0"] < h * 0.35) & rules.is_author_line(t)
    rows = rows.withColumn("kind", F.when(noise | axis | author, non).otherwise(kind))
    seq = F.row_number().over(Window.partitionBy(*DOC).orderBy("page", "page_seq"))
    return rows.withColumn("seq", seq.cast("long")).drop("page_seq", "is_noise", "inline", "is_heading", "is_caption")


def mask_repeats(paragraphs: DataFrame, keys: DataFrame) -> DataFrame:
    """Paragraphs whose text repeats across pages are not content."""
    marked = paragraphs.withColumn("key", T.repeat_key(F.col("text"))).join(keys.withColumn("_hit", F.lit(True)), ["doc_id", "key"], "left")
    return marked.withColumn("kind", F.when(F.col("_hit"), "non_content").otherwise(F.col("kind"))).drop("key", "_hit")


def mask_tiny(paragraphs: DataFrame) -> DataFrame:
    """Short texts in a font under 62 % of the body's are not content."""
    tiny = ~F.col("kind").isin("non_content", "caption") & (F.col("font_size") > 0) & (F.col("font_size") < F.col("body_font") * 0.62) & (F.length("text") < 90)
    return paragraphs.withColumn("kind", F.when(F.coalesce(tiny, F.lit(False)), "non_content").otherwise(F.col("kind")))


def mask_title(paragraphs: DataFrame, info: DataFrame) -> DataFrame:
    """On the first two pages, paragraphs that hold the title are not content; those equal to the abstract are of kind abstract."""
    rows = paragraphs.join(info.select("doc_id", T.squeeze(F.col("title")).alias("_t"), T.squeeze(F.col("abstract")).alias("_a")), DOC, "left")
    flat = T.squeeze(F.col("text"))
    titled = (F.col("page") <= 2) & (F.col("_t") != "") & F.contains(flat, F.col("_t"))
    kind = F.when((F.col("_a") != "") & (flat == F.col("_a")), "abstract").when(titled, "non_content").otherwise(F.col("kind"))
    return rows.withColumn("kind", kind).drop("_t", "_a")


def repeated_lines(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(key, docs, uses) of lines that stand in three documents or more: A1 over plain text, documents for pages."""
    keyed = docs.select("doc_id", F.explode(T.line_keys(F.col("text"))).alias("key"))
    keyed = keyed.where((F.col("key") != "") & ~F.col("key").rlike(r"^\d+$"))
    # One row per (document, line) first: a line that every document holds meets few rows in the second step.
    once = keyed.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("uses"))
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("uses").alias("uses")).where(F.col("docs") >= min_docs)


def without_repeated_lines(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(doc_id, text): documents rebuilt from their lines without those repeated across documents, each line cleaned."""
    repeats = cut(repeated_lines(docs, min_docs).select("key"))  # written, so that its size decides how it is joined
    both = F.arrays_zip(F.split("text", "\n").alias("line"), T.line_keys(F.col("text")).alias("key"))
    lines = docs.select("doc_id", F.posexplode(both).alias("pos", "b")).select("doc_id", "pos", F.col("b.line").alias("line"), F.col("b.key").alias("key"))
    kept = lines.where("key <> ''").join(repeats, "key", "left_anti")
    rows = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    cleaned = F.transform("x", lambda v: T.clean_text(v["line"]))
    text = F.array_join(F.filter(cleaned, lambda v: v != ""), "\n")
    return rows.select("doc_id", text.alias("text")).where("text <> ''")
