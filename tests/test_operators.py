"""Operators over small tables: repeats, order, sections, merging, figures, facts, bibliography, translation, reports."""

import random

import pytest
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.functions import geometry as G
from leafwork.operators import bibliography, blocks as B, facts, figures, report, sections, translation

PAGE = dict(page_w=612.0, page_h=792.0)


def line(text, size=10.0, font="Times", flags=0):
    return {"spans": [{"text": text, "size": size, "font": font, "flags": flags}]}


def layout(spark, rows):
    """rows: (page, y0, texts, options)."""
    out = []
    for n, (page, y0, texts, *more) in enumerate(rows):
        o = more[0] if more else {}
        x0, x1 = o.get("x", (72.0, 300.0))
        out.append(dict(doc_id=o.get("doc", 1), page=page, block_no=n, box=dict(x0=float(x0), y0=float(y0), x1=float(x1), y1=float(y0 + o.get("h", 12 * len(texts)))), block_type=o.get("type", 0), lines=[line(t, o.get("size", 10.0), o.get("font", "Times")) for t in texts], **PAGE))
    return spark.createDataFrame(out, schemas.LAYOUT_BLOCKS)


def blocks(spark, rows):
    """rows: (doc, page, seq, (x0, y0, x1, y1), text)."""
    data = [(d, p, s, tuple(map(float, b)), t, 612.0, 792.0) for d, p, s, b, t in rows]
    return spark.createDataFrame(data, f"doc_id long, page int, seq long, box {G.BOX}, text string, page_w double, page_h double")


def test_blocks_from_layout(spark):
    df = spark.createDataFrame(
        [
            dict(doc_id=1, page=1, block_no=0, box=None, block_type=0, lines=[{"spans": [dict(text="abcd", size=10.0, font="X", flags=0), dict(text="ab", size=13.0, font="Y-Bold", flags=0)]}, line("z", 0.1)], **PAGE),
            dict(doc_id=1, page=1, block_no=1, box=None, block_type=1, lines=[], **PAGE),
            dict(doc_id=1, page=1, block_no=2, box=None, block_type=0, lines=[line("f", 9.0, "F", 16)], **PAGE),
            dict(doc_id=1, page=1, block_no=3, box=None, block_type=0, lines=None, **PAGE),
        ],
        schemas.LAYOUT_BLOCKS,
    )
    got = [(r["text"], r["font_size"], r["is_bold"]) for r in B.blocks_from_layout(df).orderBy("block_no").collect()]
    assert got == [("abcdab\nz", 11.0, True), ("", None, False), ("f", 9.0, True), ("", None, False)]


def test_body_font_is_the_upper_median(spark):
    long = "x" * 31
    df = layout(spark, [(1, 0, [long], {"size": s}) for s in (1.0, 2.0, 3.0, 4.0)] + [(1, 0, ["short"], {"size": 99.0}), (6, 0, [long], {"size": 50.0})])
    assert B.body_font(df).first()["body_font"] == 3.0


@pytest.mark.parametrize("last,repeats", [(49, True), (50, False)])
def test_exact_repeats(spark, last, repeats):
    rows = [(1, p, p, (0, y - 5, 10, y + 5), "Running  HEAD") for p, y in ((1, 20), (2, 25), (3, last))] + [(1, p, 9, (0, 700, 10, 710), str(p)) for p in (1, 2, 3)]
    assert [r["key"] for r in B.repeated_exact(blocks(spark, rows)).collect()] == (["running head"] if repeats else [])


def test_fuzzy_repeats(spark):
    rows = [(1, p, 1, (0, 20, 100, 30), f"Science 14 May 2026 {700 + p}") for p in (1, 2, 3)] + [(1, p, 2, (0, 300, 100, 310), f"Middle text {p}") for p in (1, 2, 3)]
    assert sorted(r["key"] for r in B.repeated(blocks(spark, rows)).collect()) == [f"science 14 may 2026 {700 + p}" for p in (1, 2, 3)]


def test_reading_order(spark):
    rows = [(1, 1, 0, (320, 100, 560, 200), "right"), (1, 1, 1, (40, 300, 280, 400), "left 2"), (1, 1, 2, (40, 100, 280, 200), "left 1"), (1, 1, 3, (20, 50, 590, 80), "top"), (1, 1, 4, (20, 700, 590, 720), "bottom")]
    df = blocks(spark, rows).withColumn("block_no", F.col("seq"))
    assert [r["text"] for r in B.reading_order(df).orderBy("seq").collect()] == ["top", "left 1", "left 2", "right", "bottom"]
    assert [r["text"] for r in B.reading_order(df, F.lit(True)).orderBy("seq").collect()] == ["top", "left 1", "right", "left 2", "bottom"]


def test_classify(spark):
    text = "This is a body of text that has the words of a sentence in it and goes on."
    df = layout(spark, [
        (1, 10, ["Header"]), (1, 60, ["Ann Lee, Bob Fox, Cy Day"]), (1, 200, [text]), (1, 300, ["Introduction"]), (1, 320, ["Voltage"]), (1, 340, ["Fig. 1 | The cell of it"]), (1, 400, ["a draft of it that is long enough to be a sentence."]),
        (1, 420, ["Device performance and stability assessment For designing such a thing one needs care."], {"font": "Times-Bold"}), (2, 100, ["2.1 Results"], {"size": 14.0}), (2, 120, [text], {"type": 1}), (2, 140, ["   "]), (2, 160, [text, text]),
    ])
    raw = B.blocks_from_layout(df)
    got = B.classify(raw, spark.createDataFrame([(1, 10.0)], "doc_id long, body_font double"), B.preview_documents(raw)).orderBy("seq").collect()
    assert [r["kind"] for r in got] == ["non_content", "non_content", "paragraph", "heading", "non_content", "caption", "non_content", "heading", "paragraph", "paragraph"]
    assert [r["seq"] for r in got] == list(range(1, len(got) + 1)) and got[3]["heading_level"] == 1 and got[7]["heading_level"] == 1


def paragraphs(spark, rows):
    """rows: (seq, page, kind, text, (x0, y0, x1, y1) or None)."""
    data = [(1, s, 0, p, k, t, None if b is None else tuple(map(float, b)), 1 if k == "heading" else 0, 10.0, False) for s, p, k, t, b in rows]
    return spark.createDataFrame(data, f"doc_id long, seq long, part int, page int, kind string, text string, box {G.BOX}, heading_level int, font_size double, is_bold boolean")


def sectioned(spark, rows):
    out = sections.build_sections(sections.split_headings(paragraphs(spark, rows)))
    return [(r["section_id"], r["section_title"], r["kind"], r["text"]) for r in out.orderBy("seq", "part").collect()]


def test_sections(spark):
    got = sectioned(spark, [(1, 1, "heading", "Introduction", None), (2, 1, "paragraph", "First text.", None), (3, 1, "heading", "Results and discussion: We show it.", None), (4, 1, "abstract", "gone", None), (5, 1, "non_content", "gone too", None)])
    assert got == [(1, "Introduction", "heading", "Introduction"), (1, "Introduction", "paragraph", "First text."), (2, "Results and discussion", "heading", "Results and discussion"), (2, "Results and discussion", "paragraph", "We show it.")]


def test_reference_mode(spark):
    long = "Words that stand before the heading in this text. Device Fabrication. And words that follow it in the same text."
    got = sectioned(spark, [(1, 1, "paragraph", long, None), (2, 1, "heading", "References", None), (3, 1, "paragraph", long, None), (4, 1, "heading", "Methods", None), (5, 1, "paragraph", "More.", None)])
    assert [(s, k) for s, _, k, _ in got] == [(0, "paragraph"), (1, "heading"), (1, "paragraph"), (2, "heading"), (2, "non_content"), (3, "heading"), (3, "paragraph")]


def test_merging(spark):
    box = lambda y, h=20, x=72: (x, y, x + 200, y + h)
    rows = [
        (1, 1, "paragraph", "The first goes on in the", box(100)), (2, 1, "paragraph", "Second block, which", box(125)), (3, 1, "paragraph", "ends here.", box(150)), (4, 1, "paragraph", "lower after an end", box(175)),
        (5, 1, "caption", "Fig. 1 | x", box(200)), (6, 1, "paragraph", "and so on", box(225)), (7, 1, "paragraph", "(far away)", box(400)), (8, 2, "paragraph", "going on over the page, and it is long enough to count", box(100)), (9, 4, "paragraph", "not two pages on", box(100)),
    ]
    assert [t for _, _, _, t in sectioned(spark, rows)] == [
        "The first goes on in the Second block, which ends here.", "lower after an end", "Fig. 1 | x", "and so on", "(far away) going on over the page, and it is long enough to count", "not two pages on",
    ]


def test_merging_stops_at_its_height(spark):
    rows = [(n, 1, "paragraph", "goes on with", (72, 100 + 70 * n, 272, 160 + 70 * n)) for n in range(8)]
    assert [t.count("goes") for _, _, _, t in sectioned(spark, rows)] == [4, 4]


def test_fragments(spark):
    rows = sections.with_sections(paragraphs(spark, [(1, 1, "paragraph", "It begins", None), (2, 1, "non_content", "masked", None), (3, 1, "paragraph", "and ends.", None), (4, 1, "paragraph", "but not this", None), (5, 3, "paragraph", "nor this", None)]))
    got = sections.merge_fragments(rows).orderBy("seq").collect()
    assert [(r["kind"], r["text"]) for r in got][:4] == [("paragraph", "It begins and ends."), ("non_content", "masked"), ("non_content", "and ends."), ("paragraph", "but not this")]


def test_figures(spark):
    rows = [
        (1, 1, 1, (72, 80, 300, 92), "Text above it"), (1, 1, 2, (72, 400, 200, 412), "Fig. 1 | Cells of the"), (1, 1, 3, (210, 402, 300, 412), "kind shown"), (1, 1, 4, (72, 420, 300, 432), "a long line that wraps below the caption of it"),
        (1, 1, 5, (72, 600, 300, 612), "Table 1. Summary of it"), (1, 2, 6, (72, 700, 200, 712), "Figure 2: low one"),
    ]
    df = blocks(spark, rows)
    image = spark.createDataFrame([(1, 1, (80.0, 120.0, 280.0, 380.0), 612.0, 792.0), (1, 1, (0.0, 0.0, 612.0, 792.0), 612.0, 792.0), (1, 1, (80.0, 120.0, 120.0, 380.0), 612.0, 792.0)], f"doc_id long, page int, box {G.BOX}, page_w double, page_h double")
    got = {r["figure_id"]: r for r in figures.extract(df, image, image.limit(0)).collect()}
    assert set(got) == {"Fig. 1", "Table 1", "Fig. 2"}
    assert got["Fig. 1"]["caption"] == "Fig. 1 | Cells of the kind shown a long line that wraps below the caption of it"
    assert tuple(got["Fig. 1"]["caption_box"]) == (72, 400, 300, 432) and tuple(got["Fig. 1"]["box"]) == (72, 112, 288, 388)
    assert got["Fig. 1"]["image_source"] == "embedded" and got["Table 1"]["image_source"] == "heuristic" and got["Table 1"]["box"]["y0"] == 615
    crops = {r["figure_id"]: r["try_next"] for r in figures.crop_boxes(figures.captions(df), df).collect()}
    assert crops == {"Fig. 1": False, "Table 1": True, "Fig. 2": True}


@pytest.mark.parametrize("payloads,kept", [([100, 105, 120], 120), ([100, 111, 120], 111), ([0, 5, 0], 5), ([0, 0], 0)])
def test_figure_dedupe_is_a_fold(spark, payloads, kept):
    df = spark.createDataFrame([(1, i, "Fig. 1" if i else "fig.1", p) for i, p in enumerate(payloads)], "doc_id long, fig_seq int, figure_id string, payload int")
    assert [r["payload"] for r in figures.dedupe_figures(df).collect()] == [kept]


def test_drawings_merge(spark):
    data = [(1, 1, b, 612.0, 792.0) for b in ((50.0, 50.0, 250.0, 250.0), (60.0, 270.0, 300.0, 480.0), (300.0, 60.0, 500.0, 260.0), (-10.0, 600.0, 200.0, 900.0), (0.0, 0.0, 100.0, 100.0))]
    df = spark.createDataFrame(data, f"doc_id long, page int, box {G.BOX}, page_w double, page_h double")
    got = sorted(tuple(r["box"]) for r in figures.merged_drawings(df).collect())
    assert got == [(0, 600, 200, 792), (50, 50, 250, 250), (60, 270, 300, 480), (300, 60, 500, 260)] or got == [(0, 600, 200, 792), (50, 50, 300, 480), (300, 60, 500, 260)]


def test_legends(spark):
    low = [(1, 1, n, (72, 300 + 20 * n, 300, 310 + 20 * n), f"Fig. {n} | The cell") for n in (1, 2, 3)]
    df = blocks(spark, [*low, (2, 5, 1, (72, 100, 300, 110), "Figure Legends"), (2, 7, 2, (72, 100, 300, 110), "Fig. 1 | The cell"), (2, 9, 3, (72, 100, 300, 110), "Fig. 2 | The cell")])
    got = {(r["doc_id"], r["page"], r["seq"]): r["legend_only"] for r in figures.legend_only(figures.captions(df), df).collect()}
    assert got == {(1, 1, 1): True, (1, 1, 2): True, (1, 1, 3): True, (2, 7, 2): True, (2, 9, 3): False}


def evidence(spark, rows):
    return spark.createDataFrame([(1, i, p, s, "", t) for i, (p, s, t) in enumerate(rows)], "doc_id long, item long, page int, section string, figure_id string, text string")


def test_device_facts(spark):
    text = "A certified PCE of 25.3% was achieved with VOC of 1.18 V."
    found = facts.matches(evidence(spark, [(5, "results", text), (2, "results", text), (5, "results", "It retained 90% PCE of its initial PCE after 5 h."), (6, "results", "An efficiency of ≈ 20.5 % at a fill factor of 81.5% in the control device.")]))
    got = {r["source_page"]: r for r in facts.device_performance(found).collect()}
    assert set(got) == {5, 6}
    assert (got[5]["device_label"], got[5]["pce_percent"], got[5]["certified_pce_percent"], got[5]["voc_v"]) == ("certified", 25.3, 25.3, 1.18)
    assert (got[6]["sample_role"], got[6]["pce_percent"], got[6]["ff_percent"]) == ("control", 20.5, 81.5) and got[6]["source_text"].endswith("[operator for PCE: ~]")


@pytest.mark.parametrize("compat,kept", [(False, 90.0), (True, None)])
def test_stability_facts(spark, compat, kept):
    rows = [(5, "results", "The device retained 95% of its initial PCE after 1,000 h."), (6, "results", "After 500 h, the device shows a loss of 10%."), (7, "results", "After 20 cycles at 65 °C and 85% RH it maintained >80%.")]
    got = {r["source_page"]: r for r in facts.stability_tests(facts.matches(evidence(spark, rows)), compat).collect()}
    assert (got[5]["duration_h"], got[5]["retained_pce_percent"], got[5]["cycles"]) == (1000.0, 95.0, None)
    assert (got[6]["duration_h"], got[6]["retained_pce_percent"]) == (500.0, kept)
    assert (got[7]["cycles"], got[7]["retained_pce_operator"], got[7]["retained_pce_percent"], got[7]["temperature_c"], got[7]["relative_humidity_percent"]) == (20, ">", 80.0, 65.0, 85.0)


def test_device_dedupe_prefers_metrics(spark):
    cols = "doc_id long, o int, pce_percent double, source_page int, sample_role string, voc_v double, jsc_ma_cm2 double, ff_percent double, active_area_cm2 double, source_text string"
    df = spark.createDataFrame([(1, 1, 25.34, 3, "target", None, None, None, None, "x" * 50), (1, 2, 25.31, 3, "target", 1.1, None, None, None, "x"), (1, 3, None, 3, "target", None, None, None, None, "x")], cols)
    assert sorted(r["o"] for r in facts.dedupe_devices(df, [F.col("o")]).collect()) == [2, 3]


def test_claims_and_methods(spark):
    claim = "Here we demonstrate that the improved layer gives the highest voltage of all the samples."
    rows = [(1, "results", claim), (1, "results", claim), (2, "methods", "Films were fabricated and measured by XPS and SEM."), (2, "other", claim)]
    items = facts.first_sentences(evidence(spark, rows))
    assert facts.key_innovations(items).count() == 1 and facts.new_knowledge(items).count() == 1
    assert [r["method_name"] for r in facts.experimental_methods(items).collect()] == ["器件制备"]
    assert sorted(r["method"] for r in facts.characterization_methods(items).collect()) == ["SEM", "XPS"]


PUBLICATIONS = [
    ("Journal of Tests 12 (2020) 345-350 more", dict(journal="Journal of Tests", volume="12", year="2020", pages="345-350")),
    ("Energy Letters, 2021, 9, 1234 and", dict(journal="Energy Letters", volume="9", year="2021", pages="1234")),
    ("IEEE TRANSACTIONS ON TESTS, VOL. 7, NO. 3, MAY 2019", dict(journal="IEEE TRANSACTIONS ON TESTS", volume="7", issue="3", year="2019")),
    ("See ACS Energy Lett. 2022, 7, 100−110", dict(journal="ACS Energy Letters", year="2022", volume="7", pages="100-110")),
    ("Nat Commun (2023) and", dict(journal="Nature Communications", year="2023")),
    ("Joule | 2024 | 8(2): 55-60 of", dict(journal="Joule", year="2024", volume="8", issue="2", pages="55-60")),
    ("nothing here, accepted: 5 May 2018", dict(journal="", year="2018", volume="")),
]


@pytest.mark.parametrize("text,want", PUBLICATIONS)
def test_publication(spark, text, want):
    got = bibliography.publication(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")).first().asDict()
    assert {k: got[k] for k in want} == want


def test_subject_comes_first(spark):
    pages, meta = spark.createDataFrame([(1, 1, "words")], "doc_id long, page int, text string"), spark.createDataFrame([(1, "Science 2026.392:724-728")], "doc_id long, subject string")
    got = bibliography.publication(pages, meta).first()
    assert (got["journal"], got["year"], got["volume"], got["pages"]) == ("Science", "2026", "392", "724-728")


def test_doi_and_abstract(spark):
    pages = spark.createDataFrame([(1, 1, "none"), (1, 2, "10.1000/a 10.5281/zenodo.5"), (2, 1, "x 10.1000/first y"), (2, 2, "10.1000/last")], "doc_id long, page int, text string")
    assert {r["doc_id"]: r["doi"] for r in bibliography.doi(pages).collect()} == {1: "10.1000/a", 2: "10.1000/first"}
    long = "word " * 30 + "end"
    text = spark.createDataFrame([(1, 1, f"Abstract: {long} Keywords x Abstract short Introduction")], "doc_id long, page int, text string")
    assert bibliography.labelled_abstract(text).first()["abstract"] == long


class Echo:
    """A model that marks texts, fails on some, and cuts others short."""

    def chat(self, system, user):
        if "fails" in user:
            raise RuntimeError
        return user.split("\n", 1)[1].replace("cell", "电池") if user.count("<<<") else "ok"


def test_translation(spark):
    rows = spark.createDataFrame([(1, f"text {i} of the cell" if i != 3 else "this fails with PCE of perovskite solar cells", "p", i) for i in range(5)], "doc_id long, text string, label string, order long")
    assert {r["translation"] for r in translation.translate(rows, None).where("text like 'text%'").collect()} == {f"text {i} of the cell" for i in (0, 1, 2, 4)}
    got = {r["text"]: r["translation"] for r in translation.translate(rows, Echo(), max_items=1).collect()}
    assert got["text 1 of the cell"] == "text 1 of the 电池" and got["this fails with PCE of perovskite solar cells"] == "this fails with PCE of 钙钛矿太阳能电池"


def test_retries():
    waits, calls = [], []

    class Bad:
        def chat(self, system, user):
            calls.append(1)
            raise OSError

    assert translation.call_with_retries(Bad(), "", "", 4, waits.append) == "" and waits == [2, 4, 6] and len(calls) == 4
    assert not translation.healthy(None) and translation.healthy(Echo())


def test_model_facts(spark):
    class Model:
        def chat(self, system, user):
            return '```json\n{"methods": [{"name": "XPS", "page": 3}, {"name": "SEM"}], "other": "x"}\n```' if "good" in user else "no json"

    prompts = spark.createDataFrame([(1, "good"), (2, "poor"), (3, " ")], "doc_id long, prompt string")
    got = translation.model_facts(prompts, Model(), "", {"methods": "name string, page int"})["methods"].collect()
    assert [(r["doc_id"], r["name"], r["page"]) for r in got] == [(1, "XPS", 3), (1, "SEM", None)]


def test_figure_places(spark):
    cols = "doc_id long, seq long, part int, kind string, text string, text_zh string"
    paras = spark.createDataFrame([(1, 1, 0, "paragraph", "See Fig. 2.", ""), (1, 2, 0, "caption", "Fig. 1 | The cell", ""), (1, 3, 0, "caption", "Fig. 2 | The cell", ""), (1, 4, 0, "paragraph", "Fig. 2 again", "")], cols)
    figs = spark.createDataFrame([(1, 1, "Fig. 1"), (1, 2, "Fig. 2"), (1, 3, "Table 9")], "doc_id long, fig_seq int, figure_id string")
    assert {r["fig_seq"]: r["seq"] for r in report.figure_places(paras, figs).collect()} == {1: 2, 2: 1, 3: None}


@pytest.mark.parametrize("seed", range(3))
def test_batches_keep_their_limits(spark, seed):
    r = random.Random(seed)
    xs = [r.randint(1, 3000) for _ in range(40)]
    ids = spark.range(1).select(translation.batches(F.array(*map(F.lit, xs)), 6, 6000).alias("x")).first()["x"]
    assert ids == sorted(ids) and len(ids) == len(xs)
    for b in set(ids):
        size = [x for x, i in zip(xs, ids) if i == b]
        assert len(size) <= 6 and (sum(size) <= 6000 or len(size) == 1)
