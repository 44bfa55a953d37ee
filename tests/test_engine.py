"""The catalogue against SQL, the engine from blocks to reports, sources, streams and settings."""

import importlib
import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafwork import schemas
from leafwork.config import Settings, default_output_dir, env_bool, input_path
from leafwork.plans import catalogue, engine
from leafwork.sources import sinks, tables
from leafwork.streaming import jobs

from .test_operators import layout

REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, sf, con, name):
    mine = catalogue.QUERIES[name](spark, sf)
    rows = mine.collect()
    if name in catalogue.SQL:
        want = con.sql(catalogue.SQL[name])
        cols = sorted(mine.columns)
        assert cols == sorted(want.columns)
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=key) == sorted(want.select(*cols).fetchall(), key=key)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_package():
    for p in (REPO / "leafwork").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm import" not in p.read_text() and "import llm" not in p.read_text(), p
    code = "import sys; sys.modules['leafwork.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


@pytest.fixture(scope="module")
def corpus(spark):
    long = "Perovskite solar cells are good candidates for cheap energy and have been studied by many groups over the years"
    rows = [
        (1, 60, ["Interface engineering of solar cells for durable modules"], {"size": 18.0}), (1, 110, ["Anna Smith, Bob Jones, Carla Diaz and Dan Wu"]),
        (1, 200, ["Abstract We report a device that works well over many hours under light. " + long + ". Introduction"], {"h": 60}),
        (1, 300, ["Introduction"]), (1, 330, [long + " and the", "fill factor of the target device is shown in Fig. 1."]), (2, 100, ["Results and discussion"]),
        (2, 130, ["We demonstrate that a champion PCE of 25.3% was achieved with VOC of 1.18 V in this work."]), (3, 100, ["The certified PCE of 24.9% was measured by XPS in our laboratory for the best devices."]),
        (2, 200, ["The target device retained 95% of its initial PCE after 1,000 h of MPP tracking at 65 °C."]), (3, 300, ["A plain sentence stands here above the figure."]), (3, 400, ["Fig. 1 | Device performance of the cells"]), (3, 600, ["References"]), (3, 630, ["1. A. Author, Some journal 12, 345 (2020)."]),
        (1, 20, ["Running head"]), (2, 20, ["Running head"]), (3, 20, ["Running head"]),
    ]
    return engine.run(layout(spark, rows))


def test_engine_tables(corpus):
    info = corpus.info.first()
    assert info["title"].startswith("Interface engineering") and info["authors"] == ["Anna Smith", "Bob Jones", "Carla Diaz", "Dan Wu"] and info["abstract"].startswith("We report")
    kinds = {r["text"][:12]: r["kind"] for r in corpus.paragraphs.collect()}
    assert kinds["Introduction"] == "heading" and kinds["1. A. Author"] == "non_content" and "Running head" not in kinds
    assert [r["pce_percent"] for r in corpus.facts["device_performance"].collect()] == [24.9]
    stable = corpus.facts["stability_tests"].collect()
    assert [(r["test_type"], r["duration_h"], r["retained_pce_percent"], r["temperature_c"]) for r in stable] == [("MPP", 1000.0, 95.0, 65.0)]
    assert [r["figure_id"] for r in corpus.figures.collect()] == ["Fig. 1"] and corpus.warnings.count() >= 1


def test_engine_reports(corpus, spark, tmp_path):
    out = engine.reports(corpus, Settings(html=True, json=True, xlsx=True))
    text = {k: v.first()[1] for k, v in out.items()}
    md = text["markdown"]
    assert md.startswith("# Interface engineering") and md.index("## Introduction") < md.index("*Fig. 1 |") < md.index("## Results and discussion") and "PCE=24.9%" in md and "最大功率点跟踪" in md
    assert "<h1>" in text["html"] and "# 论文结构化总结" in text["summary"] and text["xlsx"][:2] == b"PK"
    data = json.loads(text["json"])
    assert data["stability_tests"][0]["retained_pce_percent"] == 95.0 and data["figures"][0]["figure_id"] == "Fig. 1" and "volume" in data["paper_info"]
    sinks.write_documents(out["markdown"], "markdown", str(tmp_path / "md"))
    sinks.write_tables({"info": corpus.info}, str(tmp_path / "t"))
    sinks.write_json(out["json"], str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t/info")).count() == 1
    doc = corpus.info.first()["doc_id"]
    assert sinks.read_document(spark, str(tmp_path / "md"), doc).first()["value"] == md
    assert {s["section_title"] for s in data["sections"]} >= {"Introduction"} and data["warnings"]
    sinks.write_files(out["markdown"], "markdown", str(tmp_path / "files"))
    assert list((tmp_path / "files").glob(f"doc={doc}/*.txt"))
    with pytest.raises(ValueError):
        sinks.write_files(out["markdown"], "markdown", str(tmp_path / "none"), most=0)
    corpus.views()
    assert spark.sql("SELECT count(*) FROM paragraphs JOIN info USING (doc_id)").first()[0] > 5


def test_settings(tmp_path):
    assert env_bool("X", False, {"X": " Yes "}) and not env_bool("X", True, {"X": "no"}) and env_bool("X", True, {})
    got = Settings.from_env({"LEAFWORK_BATCH_ITEMS": "9", "LEAFWORK_XLSX": "on"})
    assert got.batch_items == 9 and got.xlsx and got.extracts and not Settings().extracts
    assert default_output_dir({"OUTPUT_DIR": "/x"}) == Path("/x") and default_output_dir({}, tmp_path) == Path("outputs")
    (tmp_path / "Desktop").mkdir()
    assert default_output_dir({}, tmp_path) == tmp_path / "Desktop"
    assert input_path("file:///a%20b.pdf") == "/a b.pdf" and input_path("file://host/x.pdf") == "//host/x.pdf" and input_path("'/a b.pdf' ") == "/a b.pdf" and input_path("/a\\ b.pdf") == "/a b.pdf"


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"one\ntwo")
    (tmp_path / "x.pdf").write_bytes(b"bad")
    files = tables.binary_files(spark, str(tmp_path))
    assert files.count() == 2 and files.select("doc_id").distinct().count() == 2

    def decoder(content):
        if content == b"bad":
            raise ValueError
        for n, t in enumerate(content.decode().split("\n")):
            yield dict(page=1, block_no=n, box=dict(x0=0.0, y0=0.0, x1=1.0, y1=1.0), page_w=1.0, page_h=1.0, block_type=0, lines=[{"spans": [dict(text=t, size=1.0, font="", flags=0)]}])

    assert [r["block_no"] for r in tables.decode(files, decoder).collect()] == [0, 1]
    pages = spark.createDataFrame([(1, "<title>T</title><body><p>a <b>b</b></p><script>x</script><li>c"), (2, None), (3, "plain")], "page_id long, html string")
    assert [(r["page_id"], r["tag"], r["text"]) for r in tables.html_blocks(pages).orderBy("page_id", "block_no").collect()] == [(1, "title", "T"), (1, "p", "a b"), (1, "li", "c"), (3, "", "plain")]


def test_job_status(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [dict(job_id="a", status="running", progress=0.4, updated_at=2.0), dict(job_id="a", status="completed", progress=1.7, updated_at=3.0), dict(job_id="b", status="running", progress=-1.0, updated_at=1.0)]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, events[1:])) + "\n{broken")
    (tmp_path / "in/2.json").write_text(json.dumps(events[0]))
    got = {r["job_id"]: (r["status"], r["progress"]) for r in jobs.latest_status(tables.job_status(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a": ("completed", 1.0), "b": ("running", 0.0)}
    for k in range(2):  # a later file changes one job; nothing is counted twice
        jobs.stream_status(tables.job_status(spark, str(tmp_path / "in"), True), str(tmp_path / "latest"), str(tmp_path / "cp"), once=True).awaitTermination(120)
        want = {"a": "completed", "b": "running" if k == 0 else "failed"}
        assert {r["job_id"]: r["status"] for r in jobs.read_status(spark, str(tmp_path / "latest")).collect()} == want
        (tmp_path / "in/3.json").write_text(json.dumps(dict(job_id="b", status="failed", progress=0.5, updated_at=5.0)))


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.pdf").write_bytes(b"abc")
    seen = []
    for _ in range(2):  # the second run finds nothing new
        jobs.run_jobs(jobs.arriving_files(spark, str(tmp_path / "in")), lambda df: seen.extend(r["length"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [3]


def test_progress(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(jobs.translation_progress(F.lit(5), F.lit(10))) == pytest.approx(0.535) and get(jobs.translation_progress(F.lit(5), F.lit(0))) == 0.46 and get(jobs.clamp(F.lit(1.7))) == 1.0


@pytest.mark.parametrize("parts", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, sf, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, catalogue.flagship(spark, sf).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(map(tuple, catalogue.flagship(spark, sf).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_schemas_parse(spark):
    for s in (schemas.LAYOUT_BLOCKS, schemas.BLOCKS, schemas.PARAGRAPHS, schemas.FIGURES, schemas.DEVICE, schemas.STABILITY, schemas.JOB_STATUS):
        assert spark.createDataFrame([], s).columns
    assert len(schemas.DEVICE.split(", ")) == 21 and len(schemas.STABILITY.split(", ")) == 28
    assert importlib.import_module("leafwork.streaming.jobs")
