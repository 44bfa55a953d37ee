"""Sections and merged paragraphs.

Section ids are a running count of headings.  Whether two paragraphs merge depends on their texts, which a window over the
document compares, and on the box gathered so far, which is folded over the few rows in a row whose texts go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import any_of
from ..functions import geometry as G, rules, text as T


def _doc():
    return Window.partitionBy("doc_id").orderBy("seq", "part")


def split_headings(paragraphs: DataFrame) -> DataFrame:
    """Rows with ``part``: a heading and the text that stands in its line, or the parts around a heading within a paragraph.

    After a heading of references nothing is split until the next heading, and what follows is not content.
    """
    rows = paragraphs.where("kind <> 'abstract'").withColumn("part", F.lit(0))
    heading = F.col("kind") == "heading"
    title = F.when(heading, rules.split_inline_heading(F.col("text"))["title"])
    mark = F.when(heading, rules.is_references(title)).when((F.col("kind") == "non_content") & rules.is_references(F.col("text")), True)
    rows = rows.withColumn("in_references", F.coalesce(F.last(mark, ignorenulls=True).over(_doc()), F.lit(False)))
    rows = rows.where("kind <> 'non_content'")
    row = lambda part, kind, text, level: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), text.alias("text"), level.cast("int").alias("heading_level"))
    zero, one = F.lit(0), F.lit(1)
    inline, embedded = rules.split_inline_heading(F.col("text")), rules.split_embedded_heading(F.col("text"))
    level = F.greatest(F.col("heading_level"), one)
    rows = rows.withColumns({"_in": F.when(heading, inline), "_em": F.when(~heading & ~F.col("in_references"), embedded)})
    as_heading = F.array(row(0, "heading", F.col("_in.title"), level), row(1, "paragraph", F.when(F.col("in_references"), "").otherwise(F.col("_in.rest")), zero))
    around = F.array(row(0, F.col("kind"), F.col("_em.before"), zero), row(1, "heading", F.col("_em.title"), one), row(2, "paragraph", F.col("_em.after"), zero))
    plain = F.array(row(0, F.when(F.col("in_references"), F.lit("non_content")).otherwise(F.col("kind")), F.col("text"), F.col("heading_level")))
    parts = F.when(heading, as_heading).when(F.col("_em").isNotNull(), around).otherwise(plain)
    rows = rows.withColumn("_p", F.explode(parts)).where("_p.text <> ''")
    return rows.withColumns({c: F.col("_p")[c] for c in ("part", "kind", "text", "heading_level")}).drop("_p", "_in", "_em", "in_references")


def with_sections(parts: DataFrame) -> DataFrame:
    """Add section_id (running count of headings, from 0 before the first) and section_title."""
    heading = F.col("kind") == "heading"
    title = F.last(F.when(heading, F.col("text")), ignorenulls=True).over(_doc())
    return parts.withColumns({"section_id": F.sum(heading.cast("long")).over(_doc()), "section_title": F.coalesce(title, F.lit(fixed.DEFAULT_SECTION))})


_GOES_ON_SMALL = r"^[a-z0-9),;/%±~<>≥≤]"


def _before(column: str) -> Column:
    return F.lag(column).over(_doc())


def _near(open_: Column, cur: Column) -> Column:
    """Whether two boxes can belong to one paragraph: on one page close together, or the head of the next page."""
    a, b = open_["box"], cur["box"]
    wraps = (a["x1"] < b["x0"]) & (a["y1"] > 500) & (b["y0"] < 140)
    far = (b["y0"] < a["y0"] - 8) | (b["y0"] - a["y1"] > 80) | (F.greatest(a["y1"], b["y1"]) - F.least(a["y0"], b["y0"]) > 320)
    head = (cur["page"] == open_["page"] + 1) & (b["y0"] <= 180) & cur["_full"]
    return a.isNull() | b.isNull() | F.when(open_["page"] == cur["page"], wraps | ~far).otherwise(head)


def _grown(open_: Column, cur: Column) -> Column:
    """The box of an open paragraph with one more block: only blocks of its own page that do not stand above it count."""
    a, b = open_["box"], cur["box"]
    return F.when((open_["page"] == cur["page"]) & a.isNotNull() & b.isNotNull() & (b["y0"] >= a["y0"]), G.union(a, b)).otherwise(a)


def _pieces(rows: DataFrame, joinable: Column, fits, grow, alone: Column | None = None) -> DataFrame:
    """(doc_id, piece): rows that belong together, in order, as arrays of structs of the other columns.

    ``joinable`` says from a row and the one before whether they can join at all.  It cuts a document into runs, and only within
    a run is ``fits(open, row)`` asked in order, where open holds the page and box gathered so far; most runs are one row.
    Rows with a value of ``alone`` are runs by themselves.  Everything stays on the partitioning by document.
    """
    rows = rows.withColumn("_run", F.sum(F.when(F.coalesce(joinable, F.lit(False)), 0).otherwise(1)).over(_doc()))
    columns = [c for c in rows.columns if c not in ("doc_id", "seq", "part", "_run")]
    extra = [] if alone is None else [alone.alias("_alone")]
    runs = rows.groupBy("doc_id", "_run", *extra).agg(F.array_sort(F.collect_list(F.struct("seq", "part", F.struct(*columns).alias("r")))).alias("xs"))
    opened = lambda r, box: F.struct(r["page"].alias("page"), box.alias("box"))

    def step(s, x):
        cur, joins = x["r"], F.coalesce(fits(s["open"], x["r"]), F.lit(False))
        at = s["n"] + 1
        return F.struct(
            F.when(joins, s["heads"]).otherwise(F.concat(s["heads"], F.array(at))).alias("heads"), at.alias("n"),
            F.when(joins, opened(s["open"], grow(s["open"], cur))).otherwise(opened(cur, grow(cur, cur))).alias("open"),
        )

    first = F.get("xs", F.lit(0))["r"]
    start = F.struct(F.array(F.lit(1)).alias("heads"), F.lit(1).alias("n"), opened(first, grow(first, first)).alias("open"))
    heads = F.aggregate(F.slice("xs", 2, 1 << 30), start, step, lambda s: s["heads"])
    runs = runs.withColumn("heads", F.when(F.size("xs") == 1, F.array(F.lit(1))).otherwise(heads))
    after = lambda i: F.coalesce(F.get("heads", i + 1), F.size("xs") + 1)
    return runs.select("doc_id", F.explode(F.transform("heads", lambda h, i: F.slice("xs", h, after(i) - h))).alias("piece"))


def _joined(piece: Column) -> Column:
    """The text of a piece: blocks side by side with one space between."""
    last = F.size(piece) - 1
    ends = lambda x, i: F.when(i == 0, T.rstrip(x["r"]["text"])).when(i == last, T.lstrip(x["r"]["text"])).otherwise(T.strip(x["r"]["text"]))
    return F.when(last == 0, F.get(piece, F.lit(0))["r"]["text"]).otherwise(F.array_join(F.transform(piece, ends), " "))


def merge_paragraphs(rows: DataFrame, ascii_words: bool = False) -> DataFrame:
    """Merge paragraphs of one section that go on in the next block (W2); headings, captions and blank texts stand apart.

    ``ascii_words``: words end where SQL lets them end, so that an "a" after a letter with an accent is one.
    """
    before, after = T.rstrip(_before("text")), T.lstrip(F.col("text"))
    open_end = T.has(before, r"[.!?。！？:]\z", False)
    goes_on = T.has(before, rf"\b{any_of(fixed.JOINING_WORDS)}\z", True, ascii_words) | T.has(after, r"^(?:[A-Z]{2,}\b|[a-z0-9(),;/%±~<>≥≤])", False, ascii_words) | T.has(before, r"[,;]\z", False)
    paragraphs = (_before("kind") == "paragraph") & (F.col("kind") == "paragraph") & (_before("section_id") == F.col("section_id"))
    joinable = paragraphs & (before != "") & (after != "") & ~open_end & goes_on & ~rules.starts_subheading(F.col("text"), fixed.PARSER_NOUNS, [], ascii_words)
    full = (F.length(T.strip(F.col("text"))) >= 50) | T.has(after, _GOES_ON_SMALL, False)
    pieces = _pieces(rows.withColumn("_full", full), joinable, _near, _grown)
    first = F.get("piece", F.lit(0))
    box = F.aggregate(F.slice("piece", 2, 1 << 30), F.struct(first["r"]["page"].alias("page"), first["r"]["box"].alias("box")), lambda s, x: F.struct(s["page"].alias("page"), _grown(s, x["r"]).alias("box")), lambda s: s["box"])
    new = {"seq": first["seq"], "part": first["part"], "text": _joined(F.col("piece")), "box": box}
    return pieces.select("doc_id", *[new.get(c, first["r"][c]).alias(c) for c in rows.columns if c != "doc_id"]).select(*rows.columns)


def merge_fragments(rows: DataFrame, ascii_words: bool = False) -> DataFrame:
    """A fragment that begins in the middle of a sentence goes to the body paragraph before it (W4), after text within figures is masked.

    Between the two there may be captions and text that is not content, but no heading.
    """
    body = ~F.col("kind").isin("non_content", "caption", "heading")
    earlier = _doc().rowsBetween(Window.unboundedPreceding, -1)
    state = F.struct(F.col("text").alias("text"), F.col("kind").alias("kind"), F.col("section_id").alias("section_id"), F.col("_headings").alias("headings"))
    marked = rows.withColumn("_headings", F.sum((F.col("kind") == "heading").cast("int")).over(_doc()))
    marked = marked.withColumn("_last", F.last(F.when(body, state), ignorenulls=True).over(earlier)).withColumn("_body", body)
    last, before, after = F.col("_last"), T.rstrip(F.col("_last.text")), T.lstrip(F.col("text"))
    same = (last["kind"] == "paragraph") & (F.col("kind") == "paragraph") & (last["section_id"] == F.col("section_id")) & (last["headings"] == F.col("_headings"))
    joinable = same & (before != "") & T.has(after, _GOES_ON_SMALL, False) & ~T.has(before, r"[.!?。！？]\z", False) & ~rules.starts_subheading(F.col("text"), [], ["Meanwhile"], ascii_words)
    marked = marked.withColumn("_joinable", ~F.col("_body") | joinable).drop("_last", "_headings")
    fits = lambda open_, cur: cur["_body"] & (cur["page"] - open_["page"]).between(0, 1)
    nothing = lambda open_, cur: F.lit(None).cast(G.BOX)
    pieces = _pieces(marked, F.col("_joinable"), fits, nothing, F.when(~F.col("_body"), F.struct("seq", "part")))
    out = pieces.select("doc_id", F.posexplode("piece").alias("_at", "x"), _joined(F.col("piece")).alias("_text"))
    new = {"seq": F.col("x.seq"), "part": F.col("x.part"), "text": F.when(F.col("_at") == 0, F.col("_text")).otherwise(F.col("x.r.text")), "kind": F.when(F.col("_at") == 0, F.col("x.r.kind")).otherwise("non_content")}
    return out.select("doc_id", *[new.get(c, F.col("x.r")[c]).alias(c) for c in rows.columns if c != "doc_id"]).select(*rows.columns)


def build_sections(parts: DataFrame) -> DataFrame:
    """Parts of ``split_headings`` with their sections, paragraphs merged; text under references is of kind non_content."""
    rows = with_sections(parts)
    return merge_paragraphs(rows.select("doc_id", "seq", "part", "page", "section_id", "section_title", "heading_level", "text", "box", "kind", "font_size", "is_bold"))
