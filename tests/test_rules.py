"""Golden cases of the text functions and rules: positive, negative and boundary values."""

import pytest
from pyspark.sql import functions as F

from leafwork import fixed
from leafwork.functions import geometry as G, rules, text as T
from leafwork.operators import report, translation

from .plain_facts import sentence_around

@pytest.fixture(scope="module")
def column(spark):
    def run(values, f, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in df.select(f(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]

    return run


CASES = [
    (rules.is_caption, {
        "Fig. 1 | Current and voltage": True, "Figure 2: the cell": True, "Table IV. Summary of devices": True, "Fig. 3 - the stack": True, "Fig. 4 Schematic of it": True, "图 5：结构": True,
        "Fig. 81 | Too many": False, "Supplementary Fig. 1 | x": False, "Fig. 1, as shown": False, "Fig. 1 a, shows": False, "Fig. 2. This shows": False, "Fig. 2. Something": False, "As in Fig. 1 | x": False, "": False,
    }),
    (lambda t: rules.is_heading(t, rules.is_caption(t)), {
        "Introduction": True, "Results and discussion": True, "Methods We did": True, "3. Discussion": True, "IV. Results": True, "Device Fabrication": True, "Abstract: text": True,
        "Abstract text": False, "introduction": False, "Supporting information": False, "Author contributions": False, "Supplementary Note 1": False, "Something else": False,
    }),
    (lambda t: rules.is_non_content(t, rules.is_caption(t), rules.is_heading(t, rules.is_caption(t))), {
        "© 2020 by us": True, "Check for updates": True, "SOLAR CELLS": True, "ISSN 1234-5678": True, "12": True, "10.1234/abc": True, "Page of 3": True, "RESEARCH ARTICLES": True, "Science 14 May 2026 724": True, "+ - 3": True,
        "A plain sentence of text.": False, "Fig. 1 | www.x": False,
    }),
    (rules.is_author_line, {"Anna Smith, Bob Jones, Carl Fox": True, "Ann Lee & Bo Li": True, "Ann Lee, Bo": True, "A sentence, with one comma.": False, "Published, May, 2020": False, "no capitals, here, at all": False, "Abstract, A, B": False, "x" * 651: False}),
    (rules.is_axis_label, {"Voltage (V)": True, "It was the end": False, "Ends here.": False, "x" * 55: False}),
    (rules.is_preview_noise, {"ACCELERATED ARTICLE PREVIEW": True, "All legal disclaimers apply": True, "An article": False}),
    (rules.is_preview_front, {"Department of Things": True, "department": False, "https://doi.org/x": True}),
    (rules.is_title_noise, {"Received: today": False, "Keywords of it": True, "Published online": True, "A title": False}),
    (rules.is_journal, {"Journal of Tests": True, "": False, "Results of it": False, "x" * 101: False}),
    (rules.skips_translation, {"": True, "12": True, "Volume 3": True, "© us": True, "Volume of text that is longer than that": False}),
    (rules.is_stability_sentence, {"It retained 95% after 10 h": True, "stability of its initial value": True, "the stability of it": False, "It lost": False}),
    (rules.is_retention, {"It retained 95 % of its initial PCE": True, "retain 95% of the value": False}),
    (rules.is_environment, {"at a temperature of 25%": True, "temperature and PCE": False}),
    (rules.is_finding, {"We demonstrate that the improved layer gives the highest voltage of all.": True, "We demonstrate that the layer has a gap of 1.5 eV in all of the samples here.": True, "We show it.": False, "The improved layer gives the highest voltage of all the samples that were made.": False}),
    (rules.is_innovation, {"Here, we propose a new way of making such cells for all.": True, "We have developed a new way of making such cells here.": True, "They have a new way of making such cells for everyone.": False}),
    (lambda t: rules.starts_subheading(t, fixed.PARSER_NOUNS), {"Device performance": True, "2.1 Materials used": True, "Relative Dielectric Constant": True, "The device performance": False, "performance": False, "Ends here.": False, "One": False}),
    (rules.is_references, {"References": True, "Notes and references": True, "My references": False}),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_rules(column, n):
    rule, cases = CASES[n]
    assert dict(zip(cases, column(list(cases), rule))) == cases


def test_text_functions(column):
    assert column(["eﬃcient ﬁlm", "at 25°C for 3h", "per-\novskite", "a\xadb\x00c", "x ðyÞ"], T.clean_text) == ["efficient film", "at 25 °C for 3 h", "perovskite", "ab c", "x (y)"]
    assert column(["one 12\ntwo 3"], lambda t: T.clean_text(t, True)) == ["one two"]
    assert column(["Science 14 May 2026 724", "12 Head"], T.fuzzy_key) == ["science 14 may 2026", "head"]
    assert column([">95", "≈ 25.3", "abc"], lambda t: T.operator_number(t)["op"]) == [">", "~", ""]
    assert column([">95", "≈ 25.3", "abc"], lambda t: T.operator_number(t)["value"]) == [95.0, 25.3, None]
    assert column(["at 65 °C and 85% RH"], T.temperature) == [65.0] and column(["at 65 °C and 85% RH"], T.humidity) == [85.0]
    assert column(["control and target", "treated", "none"], T.role) == ["control", "target", "unknown"]
    assert column(["MPP light", "slight", "reverse bias", "damp", "x"], T.test_type) == ["MPP", "illumination", "reverse_bias", "thermal", "other"]
    assert column(["slight"], lambda t: T.test_type(t, True)) == ["other"]
    assert column(["Ann Lee; Bob Fox and Cy Day, x"], T.author_names) == [["Ann Lee", "Bob Fox", "Cy Day"]]
    assert column(["Ann Lee1,2, Bob Fox3*"], T.author_marks_removed) == ["Ann Lee, Bob Fox"]
    assert column(["Extended Data Fig. 3", "Figure 2a", "Table 1", "Box"], T.ref_key) == ["extendeddatafig.3", "fig.2", "table.1", "box"]
    assert column(["Table 1"], lambda t: T.ref_key(t, True)) == ["fig.1"]
    assert column(["Fig. 2 and Fig. 1b, Supplementary Fig. 9, Extended Data Fig. 2, Figure 1, 图 4"], T.figure_refs) == [["extendeddatafig.2", "fig.2", "fig.1", "fig.4"]]
    assert column(["a/b:c.pdf", "dir/.pdf", "x/"], T.safe_slug) == ["b_c", ".pdf", "x"]
    assert column(['```json\n{"a":1}\n```', 'x {"a":1} y', "nope"], lambda t: T.json_object(t).cast("string")) == ['{"a":1}', '{"a":1}', None]
    assert column(["<<<1>>> b <<<0>>> a", "none", "<<<0>>> x <<<0>>> y <<<7>>> z"], lambda t: T.marked_parts(t, 3)) == [["a", "b", ""], None, ["y", "", ""]]
    assert column(["PCE of perovskite Solar cells"], T.glossary_replace) == ["PCE of 钙钛矿太阳能电池"]
    assert column(["The PCE and fill factor"], T.glossary_relevant) == ["PCE=PCE; fill factor=填充因子"]
    assert column(["Article: A  title. ", "SOLAR CELLS Wide gaps"], T.clean_title) == ["A title", "Wide gaps"]
    assert column([" Nat Commun, ", "Article Joule"], T.clean_journal) == ["Nature Communications", "Joule"]


def test_truncation(spark):
    cases = [("a" * 400, "b" * 100, True), ("a" * 400, "b" * 200, False), ("ends", "ends…", True), ("ends...", "x...", False), ("", "", False), ("x", "", True), ("a" * 200, "b" * 45, False), ("a" * 200, "b" * 30, True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, t string, w boolean")
    assert all(r["g"] == r["w"] for r in df.withColumn("g", T.looks_truncated(F.col("s"), F.col("t"))).collect())


def test_splits(column):
    split = lambda t: F.concat_ws("|", rules.split_inline_heading(t)["title"], rules.split_inline_heading(t)["rest"])
    assert column(["Results and discussion: We show", "Supplementary things", "Stability Tests. Cells were", "Device performance and stability assessment For designing such a thing one needs care.", "Plain text"], split) == [
        "Results and discussion|We show", "Supplementary things|", "Stability Tests|Cells were", "Device performance and stability assessment|For designing such a thing one needs care.", "Plain text|",
    ]
    long = "This is a long sentence before the heading of it. Device Fabrication. And this is the text that follows it."
    got = column([long, "Short. Conclusion. Short.", "None here."], rules.split_embedded_heading)
    assert (got[0]["title"], got[0]["after"]) == ("Device Fabrication", "And this is the text that follows it.") and got[1:] == [None, None]


def test_sentences():
    text = "First one. The value is 3.5 in it! Next"
    assert sentence_around(text, text.index("3.5")) == "The value is 3.5 in it!"
    long = "A sentence that is long enough to stand by itself here. Another one follows it."
    assert sentence_around(long, 3) == long.split(". ")[0]
    assert sentence_around("a\n\nb c", 4) == "b c" and sentence_around("", 0) == ""


def test_boxes(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    b = G.box
    assert get(G.overlap_ratio(b(0, 0, 10, 10), b(5, 0, 15, 10))) == 0.5
    assert get(G.overlap_ratio(b(0, 0, 0.5, 0.5), b(0, 0, 10, 10))) == 0.25
    assert get(G.overlap_ratio(b(0, 0, 1, 1), F.lit(None).cast(G.BOX))) == 0.0
    assert get(G.centre_inside(b(0, 0, 10, 10), b(12, 0, 20, 10), 8.0)) and not get(G.centre_inside(b(0, 0, 10, 10), b(14, 0, 20, 10), 8.0))
    assert tuple(get(G.padded(b(4, 4, 100, 100), F.lit(104.0), F.lit(200.0)))) == (0, 0, 104, 108)
    w, h = F.lit(600.0), F.lit(800.0)
    assert tuple(get(G.figure_crop(b(100, 400, 500, 412), w, h, F.lit(200.0)))) == (9.0, 182.0, 591.0, 396.0)
    assert tuple(get(G.figure_crop(b(100, 700, 500, 712), w, h, F.lit(200.0)))) == (9.0, 40.0, 591.0, 696.0)
    assert tuple(get(G.table_crop(b(100, 400, 500, 412), w, h, F.lit(None).cast("double"), F.lit(600.0)))) == (9.0, 415.0, 591.0, 608.0)
    assert tuple(get(G.next_page_crop(w, h, F.lit(300.0)))) == (8, 40, 592, 296) and tuple(get(G.next_page_crop(w, h, F.lit(None).cast("double")))) == (8, 40, 592, 756)


def test_batches_and_chunks(spark):
    one = spark.range(1)
    ids = lambda xs, n, c: one.select(translation.batches(F.array(*map(F.lit, xs)), n, c).alias("x")).first()["x"]
    assert ids([5000, 2000, 6500, 10], 6, 6000) == [0, 1, 2, 3] and ids([1] * 13, 6, 6000) == [0] * 6 + [1] * 6 + [2]
    text = "aaaa\n\nbbbbbb\n \nc"
    assert one.select(translation.chunk_lines(F.lit(text), 10).alias("x")).first()["x"] == ["aaaa\n\nbbbbbb", "c"]


def test_writers():
    html = report.markdown_to_html("# T\n\n- a\n- *b*\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```\n<c>\n```\ntext <b>", "T & U")
    for part in ("<title>T &amp; U</title>", "<h1>T</h1>", "<li>a</li><li><em>b</em></li>", "<td>2</td>", "<code>&lt;c&gt;</code>", "<p>text &lt;b&gt;</p>"):
        assert part in html
    import io
    import zipfile
    from xml.etree import ElementTree

    book = zipfile.ZipFile(io.BytesIO(report.workbook({"one": [{"a": 1, "b": "x & y"}, {"c": [1, 2]}], "n" * 40: []})))
    sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert "x &amp; y" in sheet and "[1, 2]" in sheet and '<c r="A2"><v>1</v></c>' in sheet
    for name in book.namelist():
        ElementTree.fromstring(book.read(name))
    assert f'name="{"n" * 31}"' in book.read("xl/workbook.xml").decode()
