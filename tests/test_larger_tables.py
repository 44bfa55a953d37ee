"""What was found on tables larger than those of the tests: work that grew too fast, and results that parted from SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from leafwork import fixed
from leafwork.functions import rules, text as T
from leafwork.operators import bibliography, blocks as B, figures, report
from leafwork.plans import catalogue
from leafwork.streaming import jobs, lifecycle


def against_sql(spark, folder, name):
    """The rows of a query and of its SQL over the tables of a folder, sorted."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = ", ".join(df.columns)
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"SELECT {columns} FROM ({catalogue.SQL[name]})").fetchall())


def test_jobs_share_states(spark, tmp_path, monkeypatch):
    """A state, and a call of Python, is for a part of all jobs and not for one."""
    monkeypatch.setattr(lifecycle, "PARTS", 8)
    (tmp_path / "in").mkdir()
    rows = [dict(job_id=f"j{i}", status="completed" if i % 3 == 0 else "running", progress=0.5, updated_at=1000.0 + i) for i in range(300)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    source = spark.readStream.schema(lifecycle.RECORD).json(str(tmp_path / "in"))
    query = jobs.stream_status(source, str(tmp_path / "table"), str(tmp_path / "cp"), buckets=2, once=True, silence=100.0, by_clock=False)
    query.awaitTermination(120)
    assert query.exception() is None and query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 8
    got = {r["job_id"]: (r["status"], r["silent"]) for r in jobs.read_status(spark, str(tmp_path / "table")).collect()}
    late = lambda i: i % 3 and 1000 + i + 100 <= 1299
    assert got == {f"j{i}": ("failed", True) if late(i) else ("completed", False) if i % 3 == 0 else ("running", False) for i in range(300)}


WORDS = ["Viele Wörter stehen hier SSñ und noch mehr ABé. " * 20, "ñSS 5 %" * 40, "a aüb 10.1234/xé " * 30]
LINES = ["Hier endet es chllaía\nCiónued hier weiter. Und so", "So geht es í\nABé weiter gerade", "Der Rest, stabilityé nun\nThé Device Wort", "ein Ding ía\nThé Wörter Dinge"]


@pytest.mark.parametrize("name, texts", [("truncation_flags", [w[:n] for w in WORDS for n in range(150, 700, 13)]), ("merge_paragraphs", LINES), ("merge_fragments", LINES), ("subheading_test", LINES)])
def test_words_end_where_sql_lets_them_end(spark, tmp_path, name, texts):
    rows = [(i, t, "a", "de", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = against_sql(spark, tmp_path, name)
    assert got == want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_title_is_cleaned_once(spark):
    """And not anew in each of the tests that look at it."""
    rows = spark.createDataFrame([(1, 1, "Article: On the making of many kinds of cells")], "doc_id long, seq long, text string")
    df = bibliography.title(rows)
    assert plan(df).count("^Nature Communications Article in Press") <= 3  # 74 times before
    assert [r["title"] for r in df.collect()] == ["On the making of many kinds of cells"]


def test_texts_without_its_words_are_not_searched_for_a_citation(spark):
    texts = ["IEEE JOURNAL OF THINGS, VOL. 7, NO. 3, MAY 2021", "ieee journal of things", "Joule | 2020 | 4(3): 55", "ACS Energy Lett. 2019, 4, 12", "Accepted: 3 May 2018"]
    df = bibliography.publication(spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string"))
    assert plan(df).count("Contains(_low") >= 10
    got = {r["doc_id"]: (r["journal"], r["volume"], r["year"]) for r in df.collect()}
    assert got == {0: ("IEEE JOURNAL OF THINGS", "7", "2021"), 1: ("ieee journal of things", "", ""), 2: ("Joule", "4", "2020"), 3: ("ACS Energy Letters", "4", "2019"), 4: ("", "", "2018")}


NO_FACTS = {
    "device_performance": "pce_percent double, certified_pce_percent double, steady_state_pce_percent double, voc_v double, jsc_ma_cm2 double, ff_percent double, sample_role string, source_figure string",
    "stability_tests": "test_type string, duration_h double, cycles int, retained_pce_operator string, retained_pce_percent double, qualitative_result string, source_figure string", "key_innovations": "innovation string, explanation string",
    "experimental_methods": "method_name string, description string", "characterization_methods": "method string, purpose string, key_finding string",
}


def no_facts(spark):
    return {name: spark.createDataFrame([], f"doc_id long, source_page int, source_text string, {columns}") for name, columns in NO_FACTS.items()}


def info_of(spark, *docs):
    names = ["title", "title_zh", "doi", "journal", "volume", "issue", "pages", "year", "abstract", "abstract_zh"]
    rows = [(d, [], *[f"T{d}" if n == "title" else ABSTRACT if n == "abstract" else "" for n in names]) for d in docs]
    return spark.createDataFrame(rows, "doc_id long, authors array<string>, " + ", ".join(f"{n} string" for n in names))


ABSTRACT = "A text of many words that is longer than the limit below which nothing is looked for. " * 2


def test_lines_that_stay_together_travel_as_one_row(spark):
    """And lines that all reports have do not travel at all."""
    paragraphs = [(1, 1, "Other", 1, "paragraph", "See Fig. 1 here."), (1, 2, "Other", 1, "paragraph", ABSTRACT.replace(". ", ".  ")), (1, 3, "Other", 1, "heading", "Next"), (3, 1, "Other", 1, "paragraph", "Stray")]
    paragraphs = spark.createDataFrame([(*p, 0, 1, "") for p in paragraphs], "doc_id long, seq long, section_title string, heading_level int, kind string, text string, part int, page int, text_zh string")
    figs = spark.createDataFrame([(1, 1, "Fig. 1", 1, "Fig. 1 | a", ""), (2, 1, "Fig. 1", 1, "Fig. 1 | b", "small")], "doc_id long, fig_seq long, figure_id string, page int, caption string, warning string")
    facts = no_facts(spark) | {"key_innovations": spark.createDataFrame([(2, 5, "s", "new", ""), (4, 1, "s", "stray", "")], "doc_id long, source_page int, source_text string, innovation string, explanation string")}
    df = report.translated_markdown(info_of(spark, 1, 2), paragraphs, figs, facts)
    assert "LeftAnti" not in plan(df) and "posexplode" not in plan(df)
    got = {r["doc_id"]: r["markdown"].split("\n") for r in df.collect()}
    head = lambda d: [f"# T{d}", "", "## 论文基本信息", f"- 原文标题：T{d}", "", "## 摘要", ABSTRACT, ""]
    told = lambda new: ["", "## 自动结构化总结", "", "### 核心创新点", "", new] + [x for n, m in [("实验方法", "实验方法"), ("器件性能", "器件性能数据"), ("稳定性测试", "稳定性测试数据"), ("表征手段", "表征手段")] for x in ("", f"### {n}", "", f"- 未自动识别到明确{m}。")]
    assert got == {
        1: [*head(1), "See Fig. 1 here.", "", "> 图片裁切失败：未识别到图片区域", "*Fig. 1 | a*", "", "## Next", "", *told("- 未自动识别到明确创新点。")],
        2: [*head(2), "", "<!-- 未能准确定位，按页面顺序补充的图 -->", "> 图片裁切失败：small", "*Fig. 1 | b*", "", *told("- new")], 3: ["Stray", ""], 4: ["- stray"],
    }


def test_an_outline_takes_one_shuffle(spark):
    told = [(1, 2, "s", "late", ""), (1, None, "s", "early", ""), (1, 2, "s", "at", ""), (2, 1, "s", None, None), (4, 1, "s", "stray", "")]
    facts = no_facts(spark) | {"key_innovations": spark.createDataFrame(told, "doc_id long, source_page int, source_text string, innovation string, explanation string")}
    df = report.fallback_summary(info_of(spark, 1, 2, 3), facts)
    assert "LeftAnti" not in plan(df) and "Window" not in plan(df) and "posexplode" not in plan(df)
    got = {r["doc_id"]: r["summary"].split("\n") for r in df.collect()}
    part = lambda d: got[d][got[d].index("## 核心创新点") + 1 : got[d].index("## 不同材料 / 不同结构 / 不同尺寸电池的效率") - 1]
    assert [part(d) for d in (1, 2, 3)] == [["- early", "- at", "- late"], [], ["- " + fixed.NOT_FOUND]] and got[4] == ["- stray"]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_label_of_a_caption_is_looked_for_once(spark):
    texts = ["\x1cFig. 1 | A cell", "  Fig.\n2 | A cell", "This is a line", None, "Figure 3a. Overview of it", "ſcheme 4 | A path", "Extended  Data Fig. 5 | It", "Table 99 | Too many", "Supplementary Fig. 1 | A", "Fig. 1, shown"]
    df = figures.captions(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    asked = df._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1]
    assert asked.count("Extended\\s+Data") == 1  # many times before
    assert sorted(r["doc_id"] for r in df.collect()) == [1, 4, 5, 6]


def heads(spark):
    at = lambda y: (50.0, y, 300.0, y + 12)
    rows = [(1, p, 1, f"Science 14 May 2026 {p}", at(20.0)) for p in range(1, 5)] + [(1, p, 2, "Plain  head", at(400.0)) for p in range(1, 4)] + [(1, 4, 3, "  ", at(10.0)), (1, 5, 1, "77", at(20.0)), (2, 1, 1, "Science 14 May 2026 1", at(20.0)), (2, 2, 1, "Science 14 May 2026 2", at(390.0))]
    return spark.createDataFrame([(*r, 612.0, 792.0) for r in rows], "doc_id long, page int, seq int, text string, box struct<x0: double, y0: double, x1: double, y1: double>, page_w double, page_h double")


def test_repeats_take_one_shuffle(spark):
    """And no join: what is needed of each document lies together."""
    fuzzy, both = B.repeated_fuzzy(heads(spark)), B.repeated(heads(spark))
    assert [shuffles(df) for df in (fuzzy, both)] == [1, 1] and "Join" not in plan(fuzzy) + plan(both)
    running = {(1, f"science 14 may 2026 {p}") for p in range(1, 5)}
    assert sorted(map(tuple, fuzzy.collect())) == sorted(running) and sorted(map(tuple, both.collect())) == sorted(running | {(1, "plain head")})


def test_a_text_is_put_right_once_for_all_its_lines(spark, tmp_path):
    long = "Ein langer Satz mit  vielen Wörtern, der weiter geht. " * 3
    texts = [f"{long}\nkurz\n{long[::-1]}", long, "", None, f"{long} \n\n{long}"]
    rows = [(i, t, "a", "de", 1) for i, t in enumerate(texts)] + [(1, "kurz\n" + long, "a", "de", 1), (None, long, "a", "de", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = against_sql(spark, tmp_path, "duplicate_abstract")
    assert got == want and any(hit for *_, hit in got)
    told = plan(catalogue.QUERIES["duplicate_abstract"](spark, str(tmp_path)))
    assert told.index("posexplode") < told.index("Join")  # the plan's top comes first: lines are dealt out after the join


def test_titles_of_layouts_come_from_one_row_a_document(spark, sf):
    df = catalogue.QUERIES["layout_abstract_synth"](spark, sf)
    assert plan(df).count("Relation [") <= 4  # 8 before


def test_a_text_without_commas_is_not_searched_for_names(spark):
    texts = ["Ann Lee, Bob Fox", "Ann Lee & Bob Fox", "ann, bob", "Ann Lee Bob Fox", "It is. Ann, Bob", "It is. Ann, Bob, Cy", None, "", "accelerated article, Preview", "A C C elerated Article\nPreview"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")
    df = rows.where(rules.is_author_line(F.col("text")))
    asked = plan(df)
    assert asked.index("Contains(text") < asked.index("RLIKE") and [r["n"] for r in df.collect()] == [0, 1, 5, 8]
    assert [r["n"] for r in rows.where(rules.is_preview_noise(F.col("text"))).collect()] == [9]


def test_a_block_is_cleaned_once(spark, sf):
    df = catalogue.QUERIES["corpus_blocks"](spark, sf)
    assert plan(df).count("sqrt($1)") == 2  # with line numbers and without; 4 before, again for the test whether it is blank


def test_patterns_are_searched_where_their_letters_stand(spark):
    assert [T.core(p) for p in (r"https?://", r"publisher'?s note", r"references\b", r"www\.", "a.c", "(?:a|b)c", r"\d+ pages")] == ["http", "publisher", "references", "www.", "", "", ""]
    texts = ["HTTPS://x", "Publishers Note", "preference", "Referenceſ", "bıbliography", "a www.b", "www b", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")
    found = rows.where(T.mentions(F.col("text"), fixed.BOILERPLATE))
    assert "Contains" in plan(found) and sorted(r["n"] for r in found.collect()) == [0, 1, 3, 4, 5]
