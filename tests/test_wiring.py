"""What the engine does with models, renderers, file metadata, progress and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork import cli
from leafwork.config import Settings, env_file, logger
from leafwork.operators import bibliography, facts, figures, report, translation
from leafwork.plans import engine
from leafwork.sources import documents, sinks, tables
from leafwork.streaming import jobs

from .test_operators import layout

LONG = "Perovskite solar cells are good candidates for cheap energy and have been studied by many groups over the years"
ROWS = [
    (1, 60, ["Interface engineering of solar cells for durable modules"], {"size": 18.0}), (1, 200, ["Introduction"]), (1, 230, [LONG + " and more of it."]),
    (1, 300, ["Results and discussion"]), (1, 330, ["The certified PCE of 24.9% was measured for the best devices of this work."]),
    (1, 400, ["The target device retained 95% of its initial PCE after 1,000 h of MPP tracking at 65 °C."]), (2, 700, ["Fig. 1 | Device performance of the cells"]), (3, 100, ["A plain sentence stands on the last page."]),
]


class Model:
    """Replies by what it is asked, in pieces."""

    def chat(self, system, user):
        if system == "":
            return "pong"
        if system == "translate":
            return iter(["<<<0>>>\n", "one"]) if "<<<" in user else "again"
        if system == "summarise":
            return "# A summary"
        if "device_performance" in system:
            return "```json\n" + json.dumps({"device_performance": [{"device_label": "told", "pce_percent": 20.5, "source_page": 2}], "stability_tests": "none"}) + "\n```"
        if "limitations" in system:
            return json.dumps({"limitations": [{"limitation": "small cells"}]})
        return "no JSON here"


class Broken:
    def __init__(self, path):
        self.path = str(path)

    def chat(self, system, user):
        with open(self.path, "a") as f:
            f.write("x")
        raise OSError("no network")


def test_a_model_answers_for_facts_and_summary(spark):
    told = []
    settings = Settings(json=True, xlsx=False)
    corpus = engine.run(layout(spark, ROWS), provider=Model(), settings=settings, progress=lambda stage, p: told.append((stage, p)))
    assert [r["device_label"] for r in corpus.facts["device_performance"].collect()] == ["told"]
    assert [r["retained_pce_percent"] for r in corpus.facts["stability_tests"].collect()] == [95.0]  # the patterns' where the model has none
    assert [r["limitation"] for r in corpus.facts["limitations"].collect()] == ["small cells"]
    out = engine.reports(corpus, settings, Model(), lambda stage, p: told.append((stage, p)))
    assert out["summary"].first()["summary"] == "# A summary"
    assert json.loads(out["json"].first()["json"])["limitations"][0]["limitation"] == "small cells"
    assert all(0.45 <= p <= 0.62 for s, p in told if s == "translate" and p != jobs.MILESTONES[s]) and len(told) > 7
    assert [(s, p) for s, p in told if p == jobs.MILESTONES[s]] == [(s, jobs.MILESTONES[s]) for s in ("parse", "figures", "probe", "translate", "extract", "summary", "write")]


def test_a_model_that_fails_its_check_is_not_called_again(spark, tmp_path):
    corpus = engine.run(layout(spark, ROWS), provider=Broken(tmp_path / "calls"), settings=Settings(extract=True))
    assert (tmp_path / "calls").read_text() == "x"
    assert any("health check" in r["warning"] for r in corpus.warnings.collect())
    texts = spark.createDataFrame([(1, "fill factor", "l", 0)], "doc_id long, text string, label string, order long")
    assert translation.translate(texts, Broken(tmp_path / "more")).first()["translation"] == "填充因子"
    assert (tmp_path / "more").read_text() == "x"


def test_single_texts():
    assert translation.translate_one("", Model()) == "" and translation.translate_one("the fill factor", None) == "the 填充因子"
    assert translation.translate_one("a", Model()) == "again"


def test_merge_of_model_and_patterns(spark):
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, method string")
    got = facts.with_model({"experimental_methods": of([(1, "p")]), "new_knowledge": of([(1, "p"), (2, "p")])}, {"experimental_methods": of([(1, "m"), (2, "m")]), "new_knowledge": of([(1, "m")])})
    assert {n: sorted((r["doc_id"], r["method"]) for r in t.collect()) for n, t in got.items()} == {"experimental_methods": [(1, "p"), (2, "m")], "new_knowledge": [(1, "m"), (2, "p")]}


def test_prompt_views(spark):
    info = spark.createDataFrame([(1, "T", "An abstract")], "doc_id long, title string, abstract string")
    p = spark.createDataFrame([(1, 1, 0, 1, 1, "Results", "paragraph", "body"), (1, 2, 0, 2, 2, "Methods", "paragraph", "made"), (1, 3, 0, 2, 2, "Methods", "non_content", "no"), (1, 4, 0, 3, 3, "Other", "caption", "cap")], "doc_id long, seq long, part int, page int, section_id long, section_title string, kind string, text string")
    f = spark.createDataFrame([(1, 1, "Fig. 1", 3, "a caption")], "doc_id long, fig_seq int, figure_id string, page int, caption string")
    got = {n: v.first()["prompt"] for n, v in report.prompts(info, p, f, 1000).items()}
    assert got["performance"] == "摘要：An abstract\n[p.1] body\n[p.3, Fig. 1] a caption"
    assert got["methods"] == "[p.2] made" and got["insights"] == "摘要：An abstract\n[p.1] body"
    assert got["evidence"].startswith("标题：T\n摘要：An abstract\n\n## Results\n[p.1] body") and "[p.3] cap" in got["evidence"]
    assert got["summary"].startswith("T\nAn abstract") and "[page 3] cap" not in got["summary"] and len(report.prompts(info, p, f, 10)["performance"].first()["prompt"]) == 10


def test_rows_come_in_order(spark):
    rows = spark.createDataFrame([(1, 2, 9.0, "a"), (1, 1, 5.0, "b"), (1, 1, 7.0, "c")], "doc_id long, source_page int, pce_percent double, source_text string")
    assert [r["source_text"] for r in facts.in_order("device_performance", rows).collect()] == ["c", "b", "a"]
    info = spark.createDataFrame([(1, "T")], "doc_id long, title string")
    assert [r["source_text"] for r in json.loads(report.nested_json(info, {"device_performance": rows}).first()["json"])["device_performance"]] == ["c", "b", "a"]


def test_authors_of_the_file_and_abstract_order(spark):
    pages = spark.createDataFrame([(1, 1, "Abstract Accelerated Article Preview " + "x " * 100 + " Introduction")], "doc_id long, page int, text string")
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    rows = [(1, 2, 20, "paragraph", True, "Photovoltaics turn light into power. " + "Many words follow here. " * 40, (50.0, 300.0, 300.0, 400.0)), (1, 1, 3, "paragraph", True, "The layout holds this long text. " * 10, (50.0, 300.0, 300.0, 400.0))]
    paragraphs = spark.createDataFrame(rows, f"doc_id long, page int, seq long, kind string, preview boolean, text string, box {box}")
    meta = spark.createDataFrame([(1, "", "", "Ann Lee and Bob Fox")], "doc_id long, title string, subject string, author string")
    got = bibliography.paper_info(pages, paragraphs, meta).first()
    assert got["authors"] == ["Ann Lee", "Bob Fox"] and got["abstract"].startswith("Photovoltaics turn")
    late = bibliography.paper_info(pages, paragraphs.withColumn("preview", F.lit(False)), meta).first()
    assert late["abstract"].startswith("Accelerated Article Preview")


class Drawn:
    """White pages but for page 3, which is red."""

    def pixels(self, content, page, box, zoom):
        if content == b"broken":
            raise ValueError("cannot be read")
        return np.full((60, 60, 3), (200, 0, 0) if page == 3 else (255, 255, 255), np.uint8)

    def encode(self, pixels, mime, compress):
        return bytes(pixels[0, 0])


def test_region_score():
    assert figures.region_score(np.full((4, 4, 3), 255)) == 0 and figures.region_score(np.zeros((0, 0, 3))) == 0
    assert figures.region_score(np.array([[[255, 255, 255], [10, 10, 10]]])) == pytest.approx(0.5 + 0.25 * 0.5)
    assert figures.region_score(np.full((400, 400, 3), (200, 0, 0))) == pytest.approx(2.8)


def test_figures_move_to_the_next_page_and_are_cut(spark, tmp_path):
    rows = layout(spark, ROWS)
    doc = rows.first()["doc_id"]
    files = spark.createDataFrame([(doc, b"good", "/a.pdf")], "doc_id long, content binary, path string")
    corpus = engine.run(rows, files=files, renderer=Drawn())
    fig = corpus.figures.first()
    assert fig["page"] == 3 and bytes(fig["image"]) == b"\xc8\x00\x00" and fig["image_mime"] == "image/png" and fig["warning"] == ""
    sinks.write_crops(corpus.figures, str(tmp_path / "crops"))
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "crops")).collect()] == ["Fig_1.png"]
    sinks.copy_sources(files, str(tmp_path / "copies"))
    assert spark.read.parquet(str(tmp_path / "copies")).count() == 1
    broken = engine.run(rows, files=files.withColumn("content", F.lit(b"broken")), renderer=Drawn()).figures.first()
    assert broken["page"] == 2 and broken["image"] is None and broken["warning"] == "cannot be read"


def test_legends_are_not_cut(spark):
    rows = layout(spark, [*ROWS[:6], (2, 400, ["Figure Legends"]), *ROWS[6:]])
    files = spark.createDataFrame([(rows.first()["doc_id"], b"good")], "doc_id long, content binary")
    fig = engine.run(rows, files=files, renderer=Drawn()).figures.first()
    assert fig["image"] is None and fig["warning"].startswith("legend")


def test_command_line(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 5")
    docs.write.parquet(str(tmp_path / "docs"))
    got = cli.run(["--text", "--output", str(tmp_path / "out"), "--json", "--no-summary"], ask=lambda _: f"'{tmp_path}/docs'", spark=spark)
    assert set(got["paths"]) == {"markdown", "json"} and json.loads(sinks.serialized(got))["output_dir"] == str(tmp_path / "out")
    assert documents.read_documents(spark, got["paths"]["json"]).count() == docs.count()
    status = jobs.latest_status(tables.job_status(spark, str(tmp_path / "out/status"))).collect()
    assert [(r["status"], r["progress"]) for r in status] == [("completed", 1.0)]
    assert cli.settings_of(cli.parser().parse_args(["x", "--html"]), {"LEAFWORK_XLSX": "1"}).xlsx


def test_long_texts_take_linear_time(spark):
    import time

    text = "The device had a PCE of 20.1% here. " * 28_000
    rows = spark.createDataFrame([(1, 1, 1, "s", "", text)], "doc_id long, item long, page int, section string, figure_id string, text string")
    began = time.time()
    found = facts.matches(rows).collect()
    assert len(found) >= 28_000 and time.time() - began < 60 and {r["sentence"].count("PCE") for r in found} == {1, 2}


def test_settings_file_and_log(tmp_path):
    (tmp_path / ".env").write_text("# options\nexport LEAFWORK_BATCH_ITEMS=4 # few\nLEAFWORK_MODEL='a b'\nbad line\n")
    assert env_file(tmp_path / ".env") == {"LEAFWORK_BATCH_ITEMS": "4", "LEAFWORK_MODEL": "a b"} and env_file(tmp_path / "none") == {}
    got = Settings.from_env(path=tmp_path / ".env")
    assert got.batch_items == 4 and got.model == "a b"
    for _ in range(2):
        logger(tmp_path / "run.log", "test").info("once")
    assert (tmp_path / "run.log").read_text().count("once") == 2
    logger(None, "test")


def test_submitted_jobs_arrive(spark, tmp_path):
    (tmp_path / "a b.pdf").write_bytes(b"abc")
    (tmp_path / "in").mkdir()
    job = jobs.submit(spark, str(tmp_path / "a b.pdf"), str(tmp_path / "in"), str(tmp_path / "status"))
    seen = []
    jobs.run_jobs(jobs.arriving_files(spark, str(tmp_path / "in")), lambda df: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert len(seen) == 1 and job in seen[0]
    state = jobs.latest_status(tables.job_status(spark, str(tmp_path / "status"))).first()
    assert (state["job_id"], state["status"], state["uploaded_name"]) == (job, "queued", str(tmp_path / "a b.pdf"))
