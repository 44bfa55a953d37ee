"""Markdown, HTML, JSON and spreadsheet reports.

A report is a table of lines (doc_id, a, b, c, line): a is the part of the report, b and c the place within it.
Lines of all parts are united and joined per document at the very end.  Lines that stay together travel as one row, and what
is the same in every document (headings, and what is said where a list is empty) is put in only there.
"""

from __future__ import annotations

import html
import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import rules, text as T


def lines(df: DataFrame, part: int, b, c, text: Column) -> DataFrame:
    """Lines of one part; null lines are left out."""
    rows = df.select("doc_id", F.lit(part).alias("a"), (b if isinstance(b, Column) else F.lit(b)).cast("long").alias("b"), (c if isinstance(c, Column) else F.lit(c)).cast("long").alias("c"), text.alias("line"))
    return rows.where("line is not null")


def joined(rows: DataFrame, out: str = "markdown") -> DataFrame:
    """(doc_id, text): the lines of each document in order."""
    ordered = F.sort_array(F.collect_list(F.struct("a", "b", "c", "line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(out))


def _told(xs: Column, known: Column, part: int, heading: list[str], missing: str) -> Column:
    """The lines of a list among the rows of a document: a heading, and a line that says so where there are none.

    Only documents that are ``known``, and not just named by a stray row of the list, have these two.
    """
    own = F.transform(F.filter(xs, lambda x: x["a"] == part), lambda x: x["line"])
    return F.when(known, F.concat(F.array(*map(F.lit, heading)), F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(missing))))).otherwise(own)


def page_suffix(page: Column, figure: Column | None = None) -> Column:
    parts = [F.when(page > 0, F.concat(F.lit("p."), page.cast("string")))]
    if figure is not None:
        parts.append(T.nullif(figure))
    inner = F.concat_ws("，", *parts)
    return F.when(inner == "", "").otherwise(F.concat(F.lit("（"), inner, F.lit("）")))


def plain(text: Column) -> Column:
    return T.strip(T.squeeze(F.coalesce(text, F.lit(""))), " ;.。")


def _label(labels: dict[str, str], value: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), value), value)


def _bullets(rows: DataFrame, part: int, order: list[Column], text: Column, limit: int) -> DataFrame:
    """At most ``limit`` bullets for each document, as lines."""
    kept = rows.withColumns({"_l": text, "_k": F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))}).where(F.col("_k") <= limit)
    return kept.select("doc_id", F.lit(part).alias("a"), F.lit(1).cast("long").alias("b"), F.col("_k").cast("long").alias("c"), F.concat(F.lit("- "), F.col("_l")).alias("line"))


SUMMARY = 90
_summary_head = ["", "## 自动结构化总结"]


def _summary_lists(facts: dict[str, DataFrame]) -> list[tuple[int, list[str], str, DataFrame, DataFrame]]:
    """(part, heading, what is said where there are none, rows, bullets) of the structured summary: five lists with their caps of 8, 10, 20, 20 and 15 rows (K2)."""
    p, f = F.col("source_page"), F.col("source_figure")
    src = F.left(plain(F.col("source_text")), F.lit(180))
    text = lambda v: v.cast("string")
    metric = lambda name, col, unit: F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{name}="), text(F.col(col)), F.lit(unit)))
    metrics = F.concat_ws("，", metric("PCE", "pce_percent", "%"), metric("认证PCE", "certified_pce_percent", "%"), metric("稳态PCE", "steady_state_pce_percent", "%"), metric("VOC", "voc_v", " V"), metric("JSC", "jsc_ma_cm2", " mA cm-2"), metric("FF", "ff_percent", "%"))
    metrics = F.when(metrics == "", "检测到性能描述").otherwise(metrics)
    device = F.concat(metrics, F.lit("；角色："), _label(fixed.ROLE_LABELS, F.col("sample_role")), F.lit("；来源："), src, page_suffix(p, f))
    length = F.coalesce(F.concat(text(F.col("duration_h")), F.lit(" h")), F.concat(text(F.col("cycles")), F.lit(" cycles")), F.lit(""))
    kept = F.coalesce(F.concat(F.lit("，保持率="), F.col("retained_pce_operator"), text(F.col("retained_pce_percent")), F.lit("%")), F.lit(""))
    stable = F.concat(_label(fixed.TEST_LABELS, F.col("test_type")), F.lit("，"), length, kept, F.lit("；"), F.coalesce("qualitative_result", F.lit("")), F.lit("；来源："), src, page_suffix(p, f))
    said = lambda *cols: plain(F.coalesce(*[T.nullif(F.col(c)) for c in cols], F.lit("")))
    parts = [
        ("key_innovations", "核心创新点", [F.col("source_page"), F.col("source_text")], said("innovation", "explanation", "source_text"), 8, "未自动识别到明确创新点。"),
        ("experimental_methods", "实验方法", [F.col("source_page"), F.col("description")], F.concat(F.col("method_name"), F.lit("："), plain(F.col("description")), page_suffix(p)), 10, "未自动识别到明确实验方法。"),
        ("device_performance", "器件性能", [F.col("source_page"), F.col("pce_percent").desc(), F.col("source_text")], device, 20, "未自动识别到明确器件性能数据。"),
        ("stability_tests", "稳定性测试", [F.col("source_page"), F.col("source_text"), F.col("duration_h"), F.col("retained_pce_percent")], stable, 20, "未自动识别到明确稳定性测试数据。"),
        ("characterization_methods", "表征手段", [F.col("source_page"), F.col("method"), F.col("source_text")], F.concat(F.col("method"), F.lit("："), F.left(said("purpose", "key_finding", "source_text"), F.lit(180)), page_suffix(p)), 15, "未自动识别到明确表征手段。"),
    ]
    return [(SUMMARY + n, ["", f"### {heading}", ""], f"- {missing}", facts[name], _bullets(facts[name], SUMMARY + n, order, body, limit)) for n, (name, heading, order, body, limit, missing) in enumerate(parts, 1)]


def summary_appendix(docs: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Lines of the structured summary, one row each."""
    texts = lambda xs: F.posexplode(F.array(*map(F.lit, xs))).alias("p", "l")
    out = lines(docs.select("doc_id", texts(_summary_head)), SUMMARY, 0, F.col("p"), F.col("l"))
    for part, heading, missing, rows, bullets in _summary_lists(facts):
        none = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
        out = out.unionByName(lines(docs.select("doc_id", texts(heading)), part, 0, F.col("p"), F.col("l")))
        out = out.unionByName(bullets.where("line is not null")).unionByName(lines(none, part, 1, 0, F.lit(missing)))
    return out


def figure_lines(caption: Column, image: Column, mime: Column, warning: Column) -> Column:
    """Image (or why there is none) and caption, as an array of lines (K3)."""
    picture = F.concat(F.lit("!["), F.left(F.replace(caption, F.lit("\n"), F.lit(" ")), F.lit(120)), F.lit("](data:"), mime, F.lit(";base64,"), T.base64(image), F.lit(")"))
    failed = F.concat(F.lit("> 图片裁切失败："), F.coalesce(T.nullif(warning), F.lit("未识别到图片区域")))
    return F.array(F.coalesce(picture, failed), F.concat(F.lit("*"), caption, F.lit("*")), F.lit(""))


def body_references(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, seq, part, pos, ref): figures that body paragraphs refer to, in order."""
    rows = paragraphs.where(~F.col("kind").isin("caption", "non_content", "heading"))
    return rows.select("doc_id", "seq", "part", F.posexplode(_body_refs()).alias("pos", "ref"))


def _body_refs() -> Column:
    return T.figure_refs(F.concat_ws("\n", "text", "text_zh"))


def _placed(paragraphs: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, fig_seq, at) of the figures that have a place in the text.

    Texts, captions and figures of one reference key meet in one group; of each, only its first (and last) place goes there.
    """
    mark = lambda ref, pos, said: F.struct(ref.alias("ref"), pos.alias("pos"), F.lit(said).alias("said"))
    said = F.transform(_body_refs(), lambda ref, i: mark(ref, i, True))
    own = F.array(mark(T.ref_key(T.figure_id(F.col("text"))), F.lit(0), False))
    marks = paragraphs.select("doc_id", "seq", "part", F.explode(F.when(F.col("kind") == "caption", own).when(~F.col("kind").isin("non_content", "heading"), said)).alias("m"))
    at = F.struct("seq", "part", F.col("m.pos").alias("pos"))
    marks = marks.where("m.ref <> ''").select("doc_id", "m.ref", F.when(F.col("m.said"), at).alias("said"), F.when(~F.col("m.said"), at).alias("own"))
    rows = marks.unionByName(figures.select("doc_id", T.ref_key(F.col("figure_id")).alias("ref"), "fig_seq"), allowMissingColumns=True)
    met = rows.groupBy("doc_id", "ref").agg(F.min("said").alias("said"), F.min("own").alias("own"), F.min("fig_seq").alias("first"), F.max("fig_seq").alias("last"))
    met = met.select("doc_id", F.when(F.col("said").isNotNull(), F.col("last")).otherwise(F.col("first")).alias("fig_seq"), F.coalesce("said", "own").alias("at"))
    return met.where("fig_seq is not null and at is not null").groupBy("doc_id", "fig_seq").agg(F.min("at").alias("at"))


def figure_places(paragraphs: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, fig_seq, seq, part, pos): where each figure goes.

    The first body paragraph that refers to it; else its own caption paragraph; else nowhere, with nulls.  Of figures
    with one reference key the last is meant by text and the first by a caption.
    """
    return figures.select("doc_id", "fig_seq").join(_placed(paragraphs, figures), ["doc_id", "fig_seq"], "left").select("doc_id", "fig_seq", "at.*")


def split_subheading(section: Column, text: Column, rendered: Column) -> Column:
    """Struct (title, body) of a leading subheading in results, methods or an unnamed section; title "" if there is none."""
    nouns = [n for n in fixed.TECHNICAL_NOUNS if n not in ("filling", "effect")] + fixed.HEADING_ABBREVIATIONS + ["devices?", "cells?", "modules?", "films?", "layers?"]
    p = rf"^([A-Z][A-Za-z0-9\-–\s]{{3,100}}?{fixed.any_of(nouns)})\s+(?:[A-Z\"(']|\d)"
    title = T.strip(T.find(text, p, 1, False))
    ok = F.lower(section).isin("results", "methods", fixed.DEFAULT_SECTION) & F.size(F.split(title, r"(?U)\s+")).between(2, 12) & (title != "")
    return F.when(ok, F.struct(title.alias("title"), T.strip(F.substr(rendered, F.length(title) + 1)).alias("body"))).otherwise(F.struct(F.lit("").alias("title"), rendered.alias("body")))


def translated_markdown(info: DataFrame, paragraphs: DataFrame, figures: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, markdown): title, data, abstract, sections with figures where they are first referred to, the rest of the figures, summary (K1)."""
    item = lambda label, col: F.when(F.col(col) != "", F.concat(F.lit(f"- {label}："), F.col(col)))
    title = F.coalesce(T.nullif(F.col("title_zh")), T.nullif(F.col("title")), F.lit("未命名论文"))
    abstract = F.coalesce(T.nullif(F.col("abstract_zh")), T.nullif(F.col("abstract")))
    names = F.when(F.size("authors") > 0, F.concat(F.lit("- 作者："), F.array_join("authors", ", ")))
    head = F.filter(F.array(F.concat(F.lit("# "), title), F.lit(""), F.lit("## 论文基本信息"), item("原文标题", "title"), names, item("DOI", "doi"), item("期刊", "journal"), item("卷", "volume"), item("期", "issue"), item("页码/文章编号", "pages"), item("年份", "year"), F.lit("")), lambda x: x.isNotNull())
    head = F.concat(head, F.when(abstract.isNotNull(), F.array(F.lit("## 摘要"), abstract, F.lit(""))).otherwise(F.array().cast("array<string>")))
    # Each kind of rows is dealt by document on its own, so that rows which lie so already (as paragraphs of merged blocks do) stay where they are.
    row = lambda df, part, b, c, text, *more: df.repartition("doc_id").select("doc_id", part.alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), F.array_join(text, "\n").alias("line"), *more)
    out = row(info, F.lit(0), F.lit(0), F.lit(0), head, T.squeeze(F.col("abstract")).alias("abstract"))

    where = F.col("seq") * 4 + F.col("part")
    body = paragraphs.where("kind <> 'non_content' and kind <> 'caption'")
    flat = F.when(F.length("text") > rules.ABSTRACT_CHARS, T.squeeze(F.col("text")))  # what may stand in the abstract
    shown = F.coalesce(T.nullif(F.col("text_zh")), F.col("text"))
    sub = split_subheading(F.col("section_title"), F.col("text"), shown)
    marks = F.repeat(F.lit("#"), F.least(F.col("heading_level") + 1, F.lit(5)))
    text = F.when(F.col("kind") == "heading", F.array(F.concat(marks, F.lit(" "), shown), F.lit(""))).when(
        sub["title"] != "", F.concat(F.array(F.concat(F.lit("### "), sub["title"]), F.lit("")), F.when(sub["body"] != "", F.array(sub["body"], F.lit(""))).otherwise(F.array().cast("array<string>")))
    )
    out = out.unionByName(row(body, F.lit(1), where, F.lit(0), text.otherwise(F.array(shown, F.lit(""))), flat.alias("flat")), allowMissingColumns=True)

    images = [c for c in ("image", "image_mime") if c not in figures.columns]
    figures = figures.withColumns({c: F.lit(None).cast("binary" if c == "image" else "string") for c in images})
    caption = F.coalesce(T.nullif(F.col("caption_zh")), F.col("caption")) if "caption_zh" in figures.columns else F.col("caption")
    # Null-safe: an equality would put a filter for nulls below one of the two uses of the paragraphs, which then share no shuffle.
    places = _placed(paragraphs, figures).withColumnsRenamed({"doc_id": "_doc", "fig_seq": "_seq"})
    here = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("fig_seq").eqNullSafe(F.col("_seq"))
    placed = figures.where("doc_id is not null and fig_seq is not null").join(places, here, "left").withColumns({n: F.col("at")[n] for n in ("seq", "part", "pos")})
    own = figure_lines(caption, F.col("image"), F.col("image_mime"), F.col("warning"))
    lost = F.concat(F.array(F.lit(""), F.lit("<!-- 未能准确定位，按页面顺序补充的图 -->")), own)
    found = F.col("at").isNotNull()
    order = (F.coalesce("pos", F.lit(0)) + 1) * 1_000_000 + F.col("fig_seq") * 10
    at = row(placed, F.when(found, 1).otherwise(2), F.when(found, where).otherwise(F.col("fig_seq")), F.when(found, order).otherwise(0), F.when(found, own).otherwise(lost))
    out = out.unionByName(at, allowMissingColumns=True)

    lists = _summary_lists(facts)
    for *_, bullets in lists:
        out = out.unionByName(bullets.repartition("doc_id"), allowMissingColumns=True)
    docs = out.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "c", "line", "flat"))).alias("xs"), F.max("abstract").alias("abstract"))
    xs, known = F.col("xs"), F.get("xs", F.lit(0))["a"] == 0
    told = F.filter(xs, lambda x: (x["a"] < SUMMARY) & ~rules.stands_in_abstract(x["flat"], F.col("abstract")))
    summary = [F.when(known, F.array(*map(F.lit, _summary_head))).otherwise(F.array().cast("array<string>"))]
    summary += [_told(xs, known, part, heading, missing) for part, heading, missing, _, _ in lists]
    return docs.select("doc_id", F.array_join(F.concat(F.transform(told, lambda x: x["line"]), *summary), "\n").alias("markdown"))


def fallback_summary(info: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, summary): the fixed outline of seven headings, filled from the tables."""
    none = F.lit(fixed.NOT_FOUND)
    field = lambda label, col: F.concat(F.lit(f"- {label}："), F.coalesce(T.nullif(F.col(col)), none))
    abstract = F.coalesce(T.nullif(F.col("abstract_zh")), T.nullif(F.col("abstract")), none)
    head = F.array(F.lit("# 论文结构化总结"), F.lit(""), F.lit("## 论文基本信息"), field("标题", "title"), field("DOI", "doi"), field("期刊", "journal"), field("卷", "volume"), field("期", "issue"), field("页码/文章编号", "pages"), field("年份", "year"), F.lit(""), F.lit("## 研究背景与核心问题"), abstract)
    # Dealt by document before rows are gathered, so that no task sorts what it reads first.
    out = info.repartition("doc_id").select("doc_id", F.lit(0).alias("a"), F.lit(None).cast("long").alias("b"), F.array_join(head, "\n").alias("line"))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    src = F.left("source_text", F.lit(180))
    device = F.concat(F.lit("PCE="), value("pce_percent"), F.lit("%，VOC="), value("voc_v"), F.lit(" V，JSC="), value("jsc_ma_cm2"), F.lit(" mA cm-2，FF="), value("ff_percent"), F.lit("%，证据："), src)
    length = F.coalesce(F.col("duration_h").cast("string"), F.col("cycles").cast("string"), F.lit("None"))
    stable = F.concat(F.col("test_type"), F.lit("，"), length, F.lit("，保持率"), F.col("retained_pce_operator"), value("retained_pce_percent"), F.lit("%，证据："), src)
    purpose = F.coalesce(T.nullif(F.col("purpose")), T.nullif(F.col("key_finding")), F.lit("作用" + fixed.NOT_FOUND))
    parts = [
        ("核心创新点", "key_innovations", F.coalesce(T.nullif(F.col("innovation")), F.col("explanation"))),
        ("不同材料 / 不同结构 / 不同尺寸电池的效率", "device_performance", device),
        ("稳定性测试条件和保持率", "stability_tests", stable),
        ("核心表征手段及其作用", "characterization_methods", F.concat(F.col("method"), F.lit("："), purpose)),
    ]
    for n, (_, name, text) in enumerate(parts, 1):
        page = F.coalesce(F.col("source_page").cast("long"), F.lit(-(1 << 63)))
        out = out.unionByName(facts[name].repartition("doc_id").select("doc_id", F.lit(n).alias("a"), page.alias("b"), F.concat(F.lit("- "), text).alias("line")))
    docs = out.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "line"))).alias("xs"))
    xs, known = F.col("xs"), F.get("xs", F.lit(0))["a"] == 0
    told = [F.transform(F.filter(xs, lambda x: x["a"] == 0), lambda x: x["line"])]
    told += [_told(xs, known, n, ["", f"## {heading}"], "- " + fixed.NOT_FOUND) for n, (heading, _, _) in enumerate(parts, 1)]
    last = F.array(F.lit(""), F.lit("## 局限性与后续研究方向"), F.concat(F.lit("- "), none))
    told.append(F.when(known, last).otherwise(F.array().cast("array<string>")))
    return docs.select("doc_id", F.array_join(F.concat(*told), "\n").alias("summary"))


def prompt_text(paragraphs: DataFrame, titles: list[str] | None, max_chars: int) -> DataFrame:
    """(doc_id, prompt): the body text of the named sections, page by page, cut to a model's input."""
    rows = paragraphs.where(~F.col("kind").isin("non_content", "caption", "heading"))
    if titles is not None:
        rows = rows.where(rules.in_sections(F.col("section_title"), titles))
    line = F.concat(F.lit("[page "), F.col("page"), F.lit("] "), T.strip(F.col("text")))
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part", line.alias("l")))).alias("x"))
    return got.select("doc_id", F.left(F.array_join(F.transform("x", lambda v: v["l"]), "\n"), F.lit(max_chars)).alias("prompt"))


def _view(paragraphs: DataFrame, sections: list[str] | None, heads: list[DataFrame], figures: DataFrame | None, limit: int, skip: list[str] = ("non_content", "heading"), page: str = "[p.") -> DataFrame:
    rows = paragraphs.where(~F.col("kind").isin(*skip) & (T.strip(F.col("text")) != ""))
    if sections is not None:
        rows = rows.where(rules.in_sections(F.col("section_title"), sections))
    out = lines(rows, 2, F.col("seq") * 4 + F.col("part"), 0, F.concat(F.lit(page), F.col("page"), F.lit("] "), T.strip(F.col("text"))))
    for h in heads:
        out = out.unionByName(h)
    if figures is not None:
        told = figures.where("coalesce(caption, '') <> ''")
        out = out.unionByName(lines(told, 3, F.col("fig_seq"), 0, F.concat(F.lit(page), F.col("page"), F.lit(", "), F.col("figure_id"), F.lit("] "), F.col("caption"))))
    return joined(out, "prompt").select("doc_id", F.left("prompt", F.lit(limit)).alias("prompt"))


def prompts(info: DataFrame, paragraphs: DataFrame, figures: DataFrame, max_chars: int = 70_000, summary_chars: int = 60_000) -> dict[str, DataFrame]:
    """(doc_id, prompt) for each question to a model: the parts of a document that it is about, cut to its input."""
    of = lambda label, col, n: lines(info.where(F.coalesce(col, F.lit("")) != ""), 1, n, 0, F.concat(F.lit(label), F.col(col)))
    title, abstract = of("标题：", "title", 0), of("摘要：", "abstract", 1)
    names = paragraphs.where("kind <> 'non_content'").groupBy("doc_id", "section_id", "section_title").agg(F.min(F.col("seq") * 4 + F.col("part")).alias("at"))
    heads = lines(names, 2, F.col("at"), -1, F.concat(F.lit("\n## "), F.col("section_title")))
    return {
        "performance": _view(paragraphs, fixed.PERFORMANCE_SECTIONS, [abstract], figures, max_chars),
        "methods": _view(paragraphs, fixed.METHOD_SECTIONS, [], None, max_chars // 2),
        "insights": _view(paragraphs, fixed.RESULT_SECTIONS, [abstract], None, max_chars),
        "evidence": _view(paragraphs, None, [title, abstract, heads], figures, max_chars),
        "summary": _view(paragraphs, None, [of("", "title", 0), of("", "abstract", 1), heads], figures, summary_chars, ("non_content", "heading", "caption"), "[page "),
    }


def summary_prompts(info: DataFrame, nested: DataFrame, views: DataFrame) -> DataFrame:
    """(doc_id, prompt): title, abstract, the fact tables as JSON, the text, and the outline that the summary must follow."""
    rows = info.join(nested, "doc_id").join(views.withColumnRenamed("prompt", "view"), "doc_id", "left")
    outline = "\n".join(f"- {h}" for h in fixed.SUMMARY_OUTLINE)
    parts = [F.lit("论文标题："), F.col("title"), F.lit("\n摘要："), F.col("abstract"), F.lit("\n\n已抽取结构化数据：\n"), F.col("json"), F.lit("\n\n全文片段：\n"), F.coalesce("view", F.lit("")), F.lit(f"\n\n请按以下标题输出：\n{outline}")]
    return rows.select("doc_id", F.concat(*parts).alias("prompt"))


def nested_json(info: DataFrame, facts: dict[str, DataFrame], paragraphs: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): one document's data and fact tables as one JSON object.

    Devices come by page and falling efficiency, tests by page, other rows by their fields.  With ``paragraphs`` the titles of the
    sections are listed, and with ``warnings`` what went wrong.
    """
    out = info.select("doc_id", F.struct(*[c for c in info.columns if c != "doc_id"]).alias("paper_info"))
    tables = dict(facts)
    if paragraphs is not None:
        titles = paragraphs.groupBy("doc_id", "section_id", "section_title").agg(F.min("seq").alias("at"))
        tables = {"sections": titles.select("doc_id", "section_title", T.glossary_replace(F.col("section_title")).alias("section_title_zh"), F.col("at").alias("_at"))} | tables
    for name, rows in tables.items():
        cols = [c for c in rows.columns if c not in ("doc_id", "_at")]
        if name == "device_performance":
            key = F.struct(F.coalesce("source_page", F.lit(0)), -F.coalesce("pce_percent", F.lit(0.0)), "source_text").alias("k")
        elif name == "stability_tests":
            key = F.struct(F.coalesce("source_page", F.lit(0)), F.col("source_text"), F.coalesce("duration_h", F.lit(0.0))).alias("k")
        else:
            key = F.struct("_at" if "_at" in rows.columns else F.lit(0)).alias("k")
        nested = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(key, F.struct(*cols).alias("v")))).alias("x"))
        nested = nested.select("doc_id", F.transform("x", lambda x: x["v"]).alias(name))
        out = out.join(nested, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    names = ["paper_info", *tables]
    if warnings is not None:
        said = warnings.groupBy("doc_id").agg(F.sort_array(F.collect_list("warning")).alias("warnings"))
        out = out.join(said, "doc_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
        names.append("warnings")
    return out.select("doc_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))


def pretty_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def indent(values: pd.Series) -> pd.Series:
        return values.map(lambda v: json.dumps(json.loads(v), ensure_ascii=False, indent=2))

    return indent(text)


def redacted(image: Column) -> Column:
    """An image in a table that people read (K8)."""
    return F.when(image.isNotNull() & (F.length(image) > 0), F.concat(F.lit("<base64 length="), F.length(T.base64(image)), F.lit(">"))).otherwise("")


_page = "<!doctype html>\n<html lang=\"zh\"><head><meta charset=\"utf-8\"><title>{title}</title><style>body{{max-width:60rem;margin:auto;font-family:sans-serif}}img{{max-width:100%}}</style></head><body>\n{body}\n</body></html>"


def _inline(text: str) -> str:
    text = html.escape(text, quote=False)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img alt="\1" src="\2">', text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', text)
    text = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"\*([^*]+)\*", r"<em>\1</em>", text)
    return re.sub(r"`([^`]+)`", r"<code>\1</code>", text)


def markdown_to_html(markdown: str, title: str = "") -> str:
    """Headings, lists, quotes, tables, fenced code, images and paragraphs of Markdown as a page (K5)."""
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        if not block:
            return
        if all(x.startswith("- ") for x in block):
            out.append("<ul>" + "".join(f"<li>{_inline(x[2:])}</li>" for x in block) + "</ul>")
        elif all(x.startswith("> ") for x in block):
            out.append("<blockquote>" + "<br>".join(_inline(x[2:]) for x in block) + "</blockquote>")
        elif len(block) > 1 and all(x.startswith("|") for x in block) and re.fullmatch(r"[|:\-\s]+", block[1]):
            cells = [[c.strip() for c in x.strip("|").split("|")] for x in block]
            row = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{_inline(x)}</{tag}>" for x in xs) + "</tr>"
            out.append("<table>" + row("th", cells[0]) + "".join(row("td", c) for c in cells[2:]) + "</table>")
        else:
            out.append("<p>" + "\n".join(map(_inline, block)) + "</p>")
        block.clear()

    def kind(line: str) -> str:
        return next((k for k in ("- ", "> ", "|") if line.startswith(k)), "")

    code: list[str] | None = None
    for line in markdown.split("\n"):
        if line.startswith("```"):
            if code is None:
                close()
                code = []
            else:
                out.append("<pre><code>" + html.escape("\n".join(code), quote=False) + "</code></pre>")
                code = None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif not line.strip() or line.startswith("<!--"):
            close()
        else:
            if block and kind(block[-1]) != kind(line):
                close()
            block.append(line)
    close()
    return _page.format(title=html.escape(title), body="\n".join(out))


def as_html(markdown: Column, title: Column) -> Column:
    @F.pandas_udf("string")
    def convert(text: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([markdown_to_html(t or "", n or "") for t, n in zip(text, name)])

    return convert(markdown, title)


def workbook(sheets: dict[str, list[dict]]) -> bytes:
    """A spreadsheet file of one sheet per table (K7): names up to 31 characters, columns as they come, lists as JSON; an empty table is one empty row."""
    def column(n: int) -> str:
        name = ""
        while n >= 0:
            name, n = chr(65 + n % 26) + name, n // 26 - 1
        return name

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, (list, dict, tuple)):
            v = json.dumps(v, ensure_ascii=False)
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
            return f'<c r="{ref}"><v>{v}</v></c>'
        text = html.escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)), quote=False)
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    xml, main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org"
    files, names = {}, [n[:31] for n in sheets]
    for i, rows in enumerate(sheets.values(), 1):
        heads = list(dict.fromkeys(k for r in rows for k in r))
        table = [heads, *[[r.get(h) for h in heads] for r in rows]] if heads else [[]]
        body = "".join(f'<row r="{r}">' + "".join(cell(f"{column(c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(table, 1))
        files[f"xl/worksheets/sheet{i}.xml"] = f'{xml}<worksheet xmlns="{main}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'
    ids = range(1, len(names) + 1)
    files["xl/workbook.xml"] = f'{xml}<workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{html.escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, names)) + "</sheets></workbook>"
    files["xl/_rels/workbook.xml.rels"] = f'{xml}<Relationships xmlns="{main}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{main}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>"
    files["_rels/.rels"] = f'{xml}<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files["[Content_Types].xml"] = f'{xml}<Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in ids) + "</Types>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def workbooks(json_rows: DataFrame) -> DataFrame:
    """(doc_id, xlsx) from nested JSON: each document's tables as a spreadsheet file, made where the row is."""
    @F.pandas_udf("binary")
    def make(values: pd.Series) -> pd.Series:
        rows = lambda k, x: [r if isinstance(r, dict) else {k: r} for r in (x if isinstance(x, list) else [x])]
        return values.map(lambda v: workbook({k: rows(k, x) for k, x in json.loads(v).items()}))

    return json_rows.select("doc_id", make("json").alias("xlsx"))
