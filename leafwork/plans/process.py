"""From source rows to the files of a run, with what a caller needs to know about it."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from logging import Logger

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, logger
from ..functions import text as T
from ..operators import blocks as B, figures, translation
from ..sources import documents, tables
from ..streaming import jobs
from . import engine

TEXT, LAYOUT = "text", "layout"


def read_source(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, body font) of texts (doc_id, text) or of layout blocks."""
    if kind == TEXT:
        docs = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return tables.blocks_from_text(docs), docs.select("doc_id", F.lit(None).cast("double").alias("body_font")).distinct()
    return B.blocks_from_layout(rows), B.body_font(rows)


def process(rows: DataFrame, out: str, kind: str = LAYOUT, settings: Settings | None = None, provider: translation.Provider | None = None, renderer: figures.Renderer | None = None, files: DataFrame | None = None, names: DataFrame | None = None, prefix: str = "", progress: Callable[..., None] | None = None, log: Logger | None = None, append: bool = False, **more: DataFrame) -> dict:
    """Run a corpus and write one named file a document for each report that the settings ask for (O1).

    ``names``: (doc_id, name) of the files that documents came from; ``prefix`` stands for all of them; else titles name the files.  ``files``:
    (doc_id, path, content) for pixels and copies.  The result is a dict: ok, output_dir, paths (report -> folder), warnings, llm_enabled,
    outputs (report -> whether it was asked for) and, if the run failed, error; nothing is raised, and no report is
    seen of a run that failed before it was written.  Each report's files appear together; ``append`` leaves those of earlier runs.
    """
    settings, log = settings or Settings(), log or logger()
    tell = progress or (lambda *_, **__: None)
    outputs = {n: getattr(settings, n) for n in ("markdown", "html", "summary", "json", "xlsx")} | {"facts": settings.extracts, "sources": settings.sources, "crops": settings.crops}
    result = {"ok": True, "output_dir": out, "paths": {}, "warnings": [], "llm_enabled": provider is not None, "outputs": outputs}

    def at(stage: str, done: float) -> None:
        log.info("%s %.2f", stage, done)
        tell(stage, done)

    try:
        blocks, body = read_source(rows, kind)
        corpus = engine.run_blocks(blocks, body, settings=settings, provider=provider, renderer=renderer, files=files, progress=at, **more)
        said = [r["warning"] for r in corpus.warnings.select("warning").distinct().orderBy("warning").limit(20).collect()]
        result["llm_enabled"] = provider is not None and engine.UNHEALTHY not in said
        title: Column = F.lit(prefix) if prefix else F.col("title")
        named = corpus.info.select("doc_id", "title") if names is None else names.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("name").alias("title"))
        for name, table in engine.reports(corpus, settings, provider if result["llm_enabled"] else None, at).items():
            path = f"{out}/{name}"
            documents.write_documents(table.join(named, "doc_id", "left"), table.columns[1], path, title, documents.ENDINGS[name], append=append)
            result["paths"][name] = path
        if settings.crops:
            result["paths"]["crops"] = write_crops(corpus.figures, f"{out}/crops", append)
        if settings.sources and files is not None:
            result["paths"]["sources"] = write_sources(files, f"{out}/sources", append)
        result["warnings"] = said
        log.info("done: %s", ", ".join(result["paths"]))
        tell("done", 1.0)
    except Exception as e:  # whatever went wrong ends this run, not its caller
        log.exception("the run failed")
        result |= {"ok": False, "error": jobs.reason(e), "warnings": [*result["warnings"], jobs.reason(e)], "llm_enabled": False}
        with contextlib.suppress(Exception):
            tell("failed", 1.0, jobs.reason(e))
    return result


def write_crops(figs: DataFrame, path: str, append: bool = False) -> str:
    """The pixels of figures, a file each: the figure's id and a hash of document and place (K9)."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("fig_seq").cast("string"))
    rows = figs.where("image is not null").select(key.alias("doc_id"), F.concat(F.translate("figure_id", " .", "_"), F.lit(".x")).alias("title"), "image", "image_mime")
    for k, (mime, ending) in enumerate((("image/png", ".png"), ("image/jpeg", ".jpg"))):
        documents.write_documents(rows.where(F.col("image_mime") == mime), "image", path, "title", ending, append=append or k > 0)
    return path


def write_sources(files: DataFrame, path: str, append: bool = False) -> str:
    """Copies of the source files (doc_id, path, content), but for those that lie there already."""
    rows = files.where(~F.col("path").contains(path))
    ending = F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)
    rows = rows.select("doc_id", F.concat(T.safe_slug(F.col("path")), F.lit(".x")).alias("title"), "content", ending.alias("ending"))
    kinds = [r["ending"] for r in rows.select("ending").distinct().limit(50).collect()]
    for k, kind in enumerate(kinds or [""]):
        documents.write_documents(rows.where(F.col("ending") == kind), "content", path, "title", kind, append=append or k > 0)
    return path


def job(rows: DataFrame, out: str, status: str, job_id: str | None = None, **options) -> dict:
    """``process`` as one job, whose records go to the folder ``status``."""
    tell = jobs.reporter(rows.sparkSession, status, job_id or uuid.uuid4().hex)
    return process(rows, out, progress=tell, **options)


def follow_jobs(spark: SparkSession, status: str, table: str, checkpoint: str, settings: Settings | None = None, once: bool = False):
    """Keep the table of all jobs' states from the records in a folder; a job without a record for ``settings.silence`` seconds turns failed."""
    settings = settings or Settings()
    return jobs.stream_status(records_of(spark, status), table, checkpoint, once=once, silence=settings.silence)


def records_of(spark: SparkSession, status: str) -> DataFrame:
    return spark.readStream.schema(jobs.RECORD).json(status)
