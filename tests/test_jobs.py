"""Jobs that fail, fall silent or are killed; tables and files that readers see whole; replies that are asked for once."""

import io
import json
import os
import re
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from leafwork import cli
from leafwork.config import Settings
from leafwork.operators import replies, translation
from leafwork.operators.replies import Calls
from leafwork.plans import engine, process
from leafwork.sources import documents, tables
from leafwork.sources.versions import POINTER, Folder, LatestRows
from leafwork.streaming import jobs, lifecycle

from .test_operators import layout
from .test_wiring import ROWS, Model

# ------------------------------------------------------------------ life cycle


def rec(job, status, at, progress=0.0, **more):
    return dict(job_id=job, status=status, progress=progress, updated_at=at, message=None, error=None, result=None) | more


def test_rules_of_a_job():
    life = lifecycle.follow
    a = life(None, rec("a", "queued", 1.0))
    b = life(a, rec("a", "running", 2.0, 3.5))
    assert b["progress"] == 1.0 and b["created_at"] == 1.0
    assert life(b, rec("a", "running", 1.5)) is None  # an older record
    done = life(b, rec("a", "completed", 3.0))
    assert done["status"] == "completed" and life(done, rec("a", "running", 4.0)) is None
    assert life(done, rec("a", "queued", 5.0))["created_at"] == 5.0
    lost = lifecycle.given_up(b, 602.0, 600)
    assert (lost["status"], lost["progress"], lost["error"]) == ("failed", 1.0, "no record for 600 seconds")
    assert life(lost, rec("a", "running", 700.0, 0.5))["status"] == "running" and life(lost, rec("a", "completed", 700.0))["created_at"] == 1.0
    assert life(life(b, rec("a", "failed", 3.0, error="x")), rec("a", "completed", 4.0)) is None


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    (folder / f".{name}").rename(folder / f"{name}.json")


def test_a_silent_job_fails_in_the_stream(spark, tmp_path):
    """One job completes, one is told to have failed, one falls silent, one revives; the stream is stopped and started between."""
    source, out = tmp_path / "in", str(tmp_path / "table")

    def go():
        stream = spark.readStream.schema(lifecycle.RECORD).option("maxFilesPerTrigger", 1).json(str(source))
        jobs.stream_status(stream, out, str(tmp_path / "cp"), buckets=4, once=True, silence=100.0, by_clock=False).awaitTermination(180)
        return {r["job_id"]: (r["status"], r["error"]) for r in jobs.read_status(spark, out).collect()}

    put(source, 1, rec("a", "running", 1000.0), rec("b", "running", 1001.0), rec("c", "queued", 1002.0), rec("d", "running", 1003.0))
    assert go() == {"a": ("running", ""), "b": ("running", ""), "c": ("queued", ""), "d": ("running", "")}
    put(source, 2, rec("a", "completed", 1050.0, 1.0), rec("b", "failed", 1051.0, error="page 3 is torn"), rec("d", "running", 1060.0))
    put(source, 3, rec("e", "running", 1120.0))
    silent = ("failed", "no record for 100 seconds")
    assert go() == {"a": ("completed", ""), "b": ("failed", "page 3 is torn"), "c": silent, "d": ("running", ""), "e": ("running", "")}
    put(source, 4, rec("e", "completed", 1165.0))
    assert go()["d"] == silent
    put(source, 5, rec("d", "completed", 1170.0), rec("b", "running", 1171.0))
    assert go() == {"a": ("completed", ""), "b": ("failed", "page 3 is torn"), "c": silent, "d": ("completed", ""), "e": ("completed", "")}
    batch = {r["job_id"]: r["status"] for r in lifecycle.states(spark.read.schema(lifecycle.RECORD).json(str(source)), 100.0).collect()}
    assert batch == {"a": "completed", "b": "failed", "c": "failed", "d": "completed", "e": "completed"}


def test_jobs_end_by_the_clock_when_nothing_writes_any_more(spark, tmp_path):
    """As after a crash: no record comes, and the job does not stay running."""
    put(tmp_path / "in", 1, rec("a", "running", time.time()))
    stream = spark.readStream.schema(lifecycle.RECORD).json(str(tmp_path / "in"))
    query = jobs.stream_status(stream, str(tmp_path / "table"), str(tmp_path / "cp"), buckets=2, silence=3.0)
    try:
        until = time.time() + 120
        state = None
        while time.time() < until and (state is None or state["status"] != "failed"):
            time.sleep(1)
            if Folder(spark, str(tmp_path / "table")).exists(POINTER):
                state = jobs.read_status(spark, str(tmp_path / "table"), "a").first()
    finally:
        query.stop()
    assert state["status"] == "failed" and state["error"] == "no record for 3 seconds" and state["silent"]


def test_one_bad_document_fails_alone(spark, tmp_path):
    docs = spark.range(40).select(F.concat(F.lit("j"), "id").alias("job_id"), "id")
    runs = []

    def work(rows):
        bad = F.udf(lambda i: 1 // (0 if i in (7, 23) else 1), "int")
        rows.select(bad("id")).write.format("noop").mode("overwrite").save()
        runs.append(rows.count())

    ended = {}
    jobs.isolated(docs, work, lambda keys, error: ended.update({r["job_id"]: error for r in keys.collect()}))
    assert len(ended) == 40 and {k for k, e in ended.items() if e} == {"j7", "j23"}
    assert "division" in ended["j7"] and ended["j7"].startswith("ZeroDivisionError") and len(runs) < 15


def test_arriving_files_are_jobs(spark, tmp_path):
    inbox, status = tmp_path / "in", str(tmp_path / "status")
    inbox.mkdir()
    ids = []
    for name, text in (("good.pdf", "fine"), ("torn.pdf", "torn"), ("other.pdf", "fine too")):
        (tmp_path / name).write_text(text)
        ids.append(jobs.submit(spark, str(tmp_path / name), str(inbox), status))

    def work(rows):
        check = F.udf(lambda c: 1 // (b"torn" not in bytes(c)), "int")
        rows.select(check("content")).write.format("noop").mode("overwrite").save()

    for _ in range(2):  # the second run finds nothing to do
        jobs.run_jobs(jobs.arriving_files(spark, str(inbox)), work, str(tmp_path / "cp"), status=status).awaitTermination(120)
    states = {r["job_id"]: r for r in lifecycle.states(spark.read.schema(lifecycle.RECORD).json(status), now=time.time()).collect()}
    assert [states[i]["status"] for i in ids] == ["completed", "failed", "completed"] and "ZeroDivisionError" in states[ids[1]]["error"]


# ------------------------------------------------------------------ status table


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    table = LatestRows(spark, str(tmp_path / "t"), "job_id", ["updated_at"], buckets=4, keep=2)
    row = lambda n, at: spark.createDataFrame([(f"j{i}", "s" + str(at), float(at)) for i in range(n)], "job_id string, status string, updated_at double")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.merge(row(20, 1), 0, "q")
    before = table.pointer()
    held = table.read(before)
    assert held.count() == 20 and len(before["buckets"]) == 4
    seen, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append({(r["n"], r["s"]) for r in table.read().groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("n", F.col("status").alias("s")).collect()})

    thread = threading.Thread(target=reader)
    thread.start()
    try:
        for k in (2, 3):
            table.merge(row(20, k), k, "q")
    finally:
        stop.set()
        thread.join()
    assert seen and all(x in ({(20, "s1")}, {(20, "s2")}, {(20, "s3")}) for x in seen)
    assert not table.merge(row(20, 9), 3, "q") and table.read().first()["status"] == "s3"  # a batch that runs again
    table.merge(row(3, 2), 4, "q")  # late records change nothing
    assert {r["status"] for r in table.read().collect()} == {"s3"}

    def torn(*_):
        raise OSError("killed")

    monkeypatch.setattr(Folder, "swap", torn)
    with pytest.raises(OSError):
        table.merge(row(20, 7), 5, "q")
    monkeypatch.undo()
    assert {r["status"] for r in table.read().collect()} == {"s3"} and table.merge(row(20, 7), 5, "q") and {r["status"] for r in table.read().collect()} == {"s7"}
    table.merge(spark.createDataFrame([("new", "x", 1.0), (None, "x", 1.0)], "job_id string, status string, updated_at double"))
    assert table.read().count() == 21 and table.merge(row(0, 1), 6, "q")


# ------------------------------------------------------------------ documents as files


def test_a_file_a_document(spark, tmp_path):
    rows = [(1, "one", "A/B: c.pdf"), (2, "two", "A/B: c.pdf"), (3, "", "x" * 300), (4, None, "gone"), (None, "no id", "t"), (5, "five\nlines", None), (5, "five", None)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, title string")
    path = str(tmp_path / "out")
    documents.write_documents(docs, "body", path, "title", "_x.md", buckets=3)
    got = {r["name"]: bytes(r["content"]).decode() for r in documents.read_documents(spark, path).collect()}
    assert sorted(got.values()) == ["five\nlines", "one", "two"]
    assert all(re.fullmatch(r".{1,80}_[0-9a-f]{8}_x\.md", n) for n in got) and sum(n.startswith("B_ c_") for n in got) == 2
    files = [p for p in (tmp_path / "out").rglob("*.md")]
    assert len(files) == 4 and len({p.parent for p in files}) <= 3  # no folder a document
    documents.write_documents(docs.where("doc_id = 1").withColumn("body", F.lit("new")), "body", path, "title", "_x.md", append=True)
    assert sorted(bytes(r["content"]).decode() for r in documents.read_documents(spark, path).collect()) == ["five\nlines", "new", "two"]
    documents.write_documents(docs.limit(0), "body", path, "title", "_x.md")
    assert documents.read_documents(spark, path).count() == 0


@pytest.mark.parametrize("how", ["raises", "dies"])
def test_nothing_of_a_killed_run_is_seen(spark, tmp_path, how):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("first").alias("body"), F.lit("t").alias("title"))
    path = str(tmp_path / "out")
    documents.write_documents(docs, "body", path, "title")

    def bad(i):
        if i == 41:
            os._exit(3) if how == "dies" else 1 // 0
        return "second"

    with pytest.raises(Exception):  # noqa: B017  of Spark's, by the way it dies
        documents.write_documents(docs.withColumn("body", F.udf(bad, "string")("doc_id")), "body", path, "title")
    assert {bytes(r["content"]) for r in documents.read_documents(spark, path).collect()} == {b"first"} and documents.read_documents(spark, path).count() == 60
    documents.write_documents(docs.withColumn("body", F.lit("third")), "body", path, "title")
    assert {bytes(r["content"]) for r in documents.read_documents(spark, path).collect()} == {b"third"}


def test_a_task_that_dies_while_writing_leaves_staging_only(tmp_path):
    """The writer by itself: one attempt is killed in the middle, another takes its rows."""
    import pyarrow as pa

    writer = documents._Files(str(tmp_path), "r1")
    batch = pa.RecordBatch.from_pydict({"bucket": ["00", "01"], "name": ["a", "b"], "content": [b"1", b"2"]})

    def half():
        yield batch
        raise OSError("killed")

    with pytest.raises(OSError):
        writer.write(half())
    assert not list(tmp_path.glob("run-*"))
    message, more = writer.write(iter([batch])), writer.write(iter([pa.RecordBatch.from_pydict({"bucket": ["00"], "name": ["c"], "content": [b"3"]})]))
    writer.commit([message, None, more])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["run-r1/00/a", "run-r1/00/c", "run-r1/01/b"]
    other = documents._Files(str(tmp_path), "r2")
    other.write(iter([batch]))
    other.abort([])
    assert not [p for p in tmp_path.iterdir() if p.name != "run-r1"]


# ------------------------------------------------------------------ replies


class Counting:
    """Writes a line for each call; dies once at the n-th, if asked to; notes how many calls were open at a time."""

    def __init__(self, folder, dies_at=0, slow=0.0):
        self.folder, self.dies_at, self.slow = str(folder), dies_at, slow
        os.makedirs(self.folder, exist_ok=True)

    def chat(self, system, user, options=None):
        mine = f"{self.folder}/open-{threading.get_ident()}-{os.getpid()}"
        open(mine, "w").close()
        time.sleep(self.slow)
        n_open = sum(f.startswith("open-") for f in os.listdir(self.folder))
        with open(f"{self.folder}/calls", "a") as f:
            f.write(json.dumps([system, user, n_open, options]) + "\n")
        os.unlink(mine)
        if self.dies_at and len(self.calls()) == self.dies_at and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(9)
        return f"reply to {user}"

    def calls(self):
        path = f"{self.folder}/calls"
        return [json.loads(line) for line in open(path)] if os.path.exists(path) else []


def test_a_killed_task_asks_nothing_twice(spark, tmp_path):
    prompts = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), "id").alias("prompt"))
    model, calls = Counting(tmp_path / "model", dies_at=18), Calls(store=str(tmp_path / "store"))
    with pytest.raises(Exception):  # noqa: B017  the worker is gone; on a cluster Spark would run its task again
        replies.ask(prompts, model, "s", 1, calls)
    assert len(model.calls()) == 18
    got = replies.ask(prompts, model, "s", 1, calls)
    assert {r["doc_id"]: r["reply"] for r in got.collect()} == {i: f"reply to p{i}" for i in range(30)}
    asked = [c[1] for c in model.calls()]
    assert len(set(asked)) == 30 and len(asked) <= 31  # but for the call that it died in, before the reply was there
    more = prompts.unionByName(spark.createDataFrame([(99, "new"), (98, "p3"), (97, " "), (96, None)], "doc_id long, prompt string"))
    again = replies.ask(more, model, "s", 2, calls)
    assert again.count() == 32 and [c[1] for c in model.calls()[len(asked) :]] == ["new"]  # the rest come from the table
    assert replies.gather(spark, calls.store) == 1 and replies.gather(spark, calls.store) == 0
    replies.ask(prompts, model, "other system", 1, calls)
    assert len(model.calls()) == len(asked) + 31


def test_calls_in_flight_and_options(spark, tmp_path):
    prompts = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), F.col("id") % 6).alias("prompt"))
    model = Counting(tmp_path / "model", slow=0.3)
    replies.ask(prompts, model, "s", 1, Calls(in_flight=4, model="m", max_output_tokens=77, stream=False, timeout=9))
    calls = model.calls()
    assert len(calls) == 6 and max(c[2] for c in calls) == 4  # equal prompts once, four at a time
    assert calls[0][3] == {"model": "m", "timeout": 9, "stream": False, "max_output_tokens": 77}


def test_a_call_that_hangs_is_given_up():
    class Slow:
        def chat(self, system, user):
            time.sleep(5)
            return "late"

    began = time.time()
    assert replies.call(Slow(), "", "", Calls(timeout=0.2, attempts=2), lambda s: None) == "" and time.time() - began < 3


def test_translation_reports_while_it_runs(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"text number {i}", "l", 0) for i in range(12)], "doc_id long, text string, label string, order long")
    told = []
    calls = Calls(store=str(tmp_path / "store"))
    translation.translate(texts, Counting(tmp_path / "m", slow=0.4), callers=1, checked=True, calls=calls, told=lambda d, n: told.append((d, n))).count()
    assert told[0] == (0, 12) and told[-1] == (12, 12) and any(0 < d < 12 for d, _ in told) and told == sorted(told)


# ------------------------------------------------------------------ runs


def test_a_run_that_fails_says_so(spark, tmp_path):
    status = str(tmp_path / "status")
    bad = F.udf(lambda x: 1 // 0, "string")
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    got = process.job(docs.withColumn("text", bad("text")), str(tmp_path / "out"), status, "j1", kind=process.TEXT)
    assert not got["ok"] and got["error"].startswith("ZeroDivisionError") and got["paths"] == {} and got["llm_enabled"] is False
    good = process.job(docs, str(tmp_path / "out2"), status, "j2", kind=process.TEXT, settings=Settings(json=True))
    assert good["ok"] and good["outputs"]["json"] and not good["outputs"]["html"]
    states = {r["job_id"]: (r["status"], r["progress"]) for r in lifecycle.states(tables.job_status(spark, status)).collect()}
    assert states == {"j1": ("failed", 1.0), "j2": ("completed", 1.0)}
    process.follow_jobs(spark, status, str(tmp_path / "table"), str(tmp_path / "cp"), Settings(silence=1), once=True).awaitTermination(120)
    assert {r["job_id"]: r["status"] for r in jobs.read_status(spark, str(tmp_path / "table")).collect()} == {"j1": "failed", "j2": "completed"}


def test_progress_of_translation_is_in_the_status_table(spark, tmp_path):
    status = str(tmp_path / "status")
    got = process.job(layout(spark, ROWS), str(tmp_path / "out"), status, "j", provider=Model())
    seen = [r["progress"] for r in tables.job_status(spark, status).orderBy("updated_at").collect()]
    assert got["ok"] and got["llm_enabled"] and any(0.45 <= p < 0.62 for p in seen) and seen == sorted(seen) and seen[-1] == 1.0


def cells(xlsx: bytes) -> dict[str, str]:
    z = zipfile.ZipFile(io.BytesIO(xlsx))
    names = re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
    return {n: z.read(f"xl/worksheets/sheet{i}.xml").decode() for i, n in enumerate(names, 1)}


class Pixels:
    def pixels(self, content, page, box, zoom):
        import numpy as np

        return np.full((4, 4), 128, np.uint8)

    def encode(self, pixels, mime, compress):
        return (f"{mime} {compress} ".encode()) * 4000


def test_sheets_are_six_and_hold_no_pixels(spark, tmp_path):
    files = spark.createDataFrame([(1, "/x/a b.pdf", bytearray(b"pdf"))], "doc_id long, path string, content binary")
    settings = Settings(xlsx=True, image_format="jpg", compress_images=False, crops=True, sources=True)
    got = process.process(layout(spark, ROWS), str(tmp_path / "out"), settings=settings, files=files, renderer=Pixels(), names=files.select("doc_id", F.col("path").alias("name")))
    assert got["ok"], got
    sheet = cells(bytes(documents.read_documents(spark, got["paths"]["xlsx"]).first()["content"]))
    assert list(sheet) == ["paper_info", "device_performance", "stability_tests", "characterization_methods", "key_innovations", "figures"]
    assert "&lt;base64 length=" in sheet["figures"] and max(map(len, re.findall(r">([^<]*)<", sheet["figures"]))) < 32_767
    crop = documents.read_documents(spark, got["paths"]["crops"]).first()
    assert crop["name"].endswith(".jpg") and bytes(crop["content"]).startswith(b"image/jpeg False")
    copy = documents.read_documents(spark, got["paths"]["sources"]).first()
    assert copy["name"].startswith("a b_") and copy["name"].endswith(".pdf") and bytes(copy["content"]) == b"pdf"
    assert documents.read_documents(spark, got["paths"]["markdown"]).first()["name"].startswith("a b_")


def test_exit_codes(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    out = str(tmp_path / "out")
    assert cli.main([str(tmp_path / "none"), "-o", out], spark=spark) == 2 and "does not exist" in capsys.readouterr().err
    assert cli.main([str(tmp_path / "docs"), "-o", out], spark=spark) == 2 and "no column" in capsys.readouterr().err
    (tmp_path / "plain.txt").write_text("not a table")
    assert cli.main([str(tmp_path / "plain.txt"), "-o", out, "--text"], spark=spark) == 2
    docs.select("doc_id", F.expr("named_struct('x', 1)").alias("text")).write.parquet(str(tmp_path / "odd"))
    assert cli.main([str(tmp_path / "odd"), "-o", out, "--text"], spark=spark) == 1
    assert cli.main([str(tmp_path / "docs"), "-o", out, "--text", "--output-name", "my run.pdf"], spark=spark) == 0
    assert "done" in (tmp_path / "out/processing.log").read_text()
    assert {r["name"][:7] for r in documents.read_documents(spark, f"{out}/markdown").collect()} == {"my run_"}
    states = [r["status"] for r in lifecycle.states(tables.job_status(spark, f"{out}/status")).collect()]
    assert sorted(states) == ["completed", "failed"]


def test_every_setting_is_read():
    source = "".join(open(m.__file__).read() for m in (engine, process, cli, jobs)) + open(engine.__file__.replace("plans/engine.py", "config.py")).read().split("class Settings")[1].split("def from_env")[1]
    assert [f for f in Settings.__dataclass_fields__ if f"settings.{f}" not in source and f"self.{f}" not in source and f'"{f}"' not in source] == []
