"""The whole plan: from layout blocks to the tables and reports of a corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import bibliography, blocks as B, facts, figures, report, sections, translation
from ..sources.tables import raw_pages
from ..operators.replies import Calls
from ..streaming.jobs import MILESTONES, translation_progress
from ..tables import cut


@dataclass
class Corpus:
    """Tables of a run, all keyed by doc_id.  Those that others build on are written once; the rest are lazy."""

    blocks: DataFrame
    info: DataFrame
    paragraphs: DataFrame
    figures: DataFrame
    evidence: DataFrame
    facts: dict[str, DataFrame]
    warnings: DataFrame

    def views(self) -> None:
        """Register every table for SQL."""
        for name in ("blocks", "info", "paragraphs", "figures", "evidence", "warnings"):
            getattr(self, name).createOrReplaceTempView(name)
        for name, df in self.facts.items():
            df.createOrReplaceTempView(name)


Progress = Callable[[str, float], None]


def calls_of(settings: Settings) -> Calls:
    return Calls(settings.model, settings.timeout, settings.attempts, settings.stream, settings.max_output_tokens, settings.in_flight, settings.replies or None)


def _silent(stage: str, progress: float) -> None:
    pass


def parse(blocks: DataFrame, body: DataFrame, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified blocks, paper info, paragraphs with sections)."""
    blocks = cut(blocks)
    classified = cut(B.classify(blocks, body, B.preview_documents(blocks)))
    marked = cut(B.mask_tiny(B.mask_repeats(classified, B.repeated(classified))))
    info = cut(bibliography.paper_info(cut(raw_pages(classified)), marked, metadata))
    return classified, info, cut(sections.build_sections(cut(sections.split_headings(B.mask_title(marked, info)))))


def run(layout: DataFrame, metadata: DataFrame | None = None, images: DataFrame | None = None, drawings: DataFrame | None = None, provider: translation.Provider | None = None, settings: Settings | None = None, files: DataFrame | None = None, renderer: figures.Renderer | None = None, progress: Progress = _silent) -> Corpus:
    """All tables of a corpus of layout blocks.

    A provider that answers its health check translates and, if the settings ask for facts, is asked for these too; without one,
    translations are the glossary's and facts come from patterns.  ``files`` (doc_id, content) and a renderer give figures their
    pixels.  ``progress`` is told each stage as it begins (G3).
    """
    return run_blocks(B.blocks_from_layout(layout), B.body_font(layout), metadata, images, drawings, provider, settings, files, renderer, progress)


def run_blocks(blocks: DataFrame, body: DataFrame, metadata=None, images=None, drawings=None, provider=None, settings: Settings | None = None, files=None, renderer=None, progress: Progress = _silent) -> Corpus:
    settings = settings or Settings()
    at = lambda stage: progress(stage, MILESTONES[stage])
    at("parse")
    classified, info, paragraphs = parse(blocks, body, metadata)
    at("figures")
    figs = cut(figures.extract(classified, images, drawings, files, renderer, mime=settings.mime, zoom=settings.render_zoom, compress=settings.compress_images))
    paragraphs = cut(sections.merge_fragments(figures.mask_figure_text(paragraphs, figs)))
    at("probe")
    calls = calls_of(settings)
    failed = provider is not None and not translation.healthy(provider, calls)
    provider = None if failed else provider
    at("translate")
    texts = cut(translation.items(info, paragraphs, figs))
    done = translation.translate(translation.distinct_texts(texts), provider, settings.callers, settings.batch_items, settings.batch_chars, checked=True, calls=calls, told=lambda done, total: progress("translate", translation_progress(done, total)))
    back = cut(translation.write_back(texts, done)).select("doc_id", "target", "target_id", "text_zh")
    pick = lambda target, key: back.where(F.col("target") == target).select("doc_id", F.col("target_id").alias(key), F.col("text_zh"))
    for name in ("title", "abstract"):
        info = info.join(pick(name, "_k").select("doc_id", F.col("text_zh").alias(f"{name}_zh")), "doc_id", "left")
    paragraphs = paragraphs.withColumn("_k", F.concat_ws(":", "seq", "part")).join(pick("paragraph", "_k"), ["doc_id", "_k"], "left").drop("_k")
    paragraphs = paragraphs.withColumn("text_zh", F.coalesce("text_zh", F.when(F.col("kind") == "heading", translation.T.glossary_replace(F.col("text"))).otherwise(F.col("text"))))
    figs = figs.join(pick("figure", "_k").select("doc_id", F.col("_k").cast("int").alias("fig_seq"), F.col("text_zh").alias("caption_zh")), ["doc_id", "fig_seq"], "left")
    info, paragraphs, figs = cut(info), cut(paragraphs), cut(figs)
    at("extract")
    evidence = cut(facts.evidence(info, paragraphs, figs))
    found = facts.extract(evidence, cut)
    asks = provider is not None and settings.extracts
    if asks:
        views, told = report.prompts(info, paragraphs, figs, settings.max_chars), {}
        for view, keys in facts.ASKED.items():
            wanted = {k: facts.schema_of(found[k]) if k in found else facts.LIMITATIONS for k in keys}
            told |= translation.model_facts(views[view], provider, f"{QUESTION}: {wanted}", wanted, settings.callers, calls)
        found = {name: facts.in_order(name, rows) for name, rows in facts.with_model(found, told).items()}
    said = [] if asks else ["facts come from patterns, not from a model"]
    said += [UNHEALTHY] * failed
    warnings = figs.where("warning <> ''").select("doc_id", F.concat_ws(": ", "figure_id", "warning").alias("warning"))
    for text in said:
        warnings = warnings.unionByName(info.select("doc_id", F.lit(text).alias("warning")))
    return Corpus(classified, info, paragraphs, figs, evidence, found, warnings.distinct())


UNHEALTHY = "the model did not answer its health check and was not used"
#: What a model is told before a text; the keys and fields of the reply follow.
QUESTION = "Read the text of a paper and reply with one JSON object. Each key holds a list of objects with these fields; leave out what the text does not say"


#: Fact tables that a spreadsheet holds, between the paper's data and its figures.
SHEETS = ["device_performance", "stability_tests", "characterization_methods", "key_innovations"]


def reports(corpus: Corpus, settings: Settings | None = None, provider: translation.Provider | None = None, progress: Progress = _silent) -> dict[str, DataFrame]:
    """The reports that the settings ask for, each a table of one row per document.  A provider writes the summaries that it answers."""
    settings = settings or Settings()
    out = {}
    tables = corpus.facts | {"figures": corpus.figures.drop("fig_seq", "payload")}
    nested = report.nested_json(corpus.info, tables, corpus.paragraphs, corpus.warnings)
    progress("summary", MILESTONES["summary"])
    if settings.summary:
        out["summary"] = report.fallback_summary(corpus.info, corpus.facts)
        if provider is not None and translation.healthy(provider, calls_of(settings)):
            brief = corpus.facts | {"figures": corpus.figures.select("doc_id", "figure_id", "page", "caption", "caption_zh")}
            views = report.prompts(corpus.info, corpus.paragraphs, corpus.figures)["summary"]
            told = translation.ask(report.summary_prompts(corpus.info, report.nested_json(corpus.info, brief, warnings=corpus.warnings), views), provider, "summarise", settings.callers, calls_of(settings))
            out["summary"] = out["summary"].join(told, "doc_id", "left").select("doc_id", F.coalesce(translation.T.nullif(F.trim("reply")), F.col("summary")).alias("summary"))
    progress("write", MILESTONES["write"])
    if settings.markdown or settings.html:
        markdown = report.translated_markdown(corpus.info, corpus.paragraphs, corpus.figures, corpus.facts)
        if settings.markdown:
            out["markdown"] = markdown
        if settings.html:
            named = markdown.join(corpus.info.select("doc_id", "title"), "doc_id")
            out["html"] = named.select("doc_id", report.as_html(F.col("markdown"), F.col("title")).alias("html"))
    if settings.json:
        out["json"] = nested.select("doc_id", report.pretty_json(F.col("json")).alias("json"))
    if settings.xlsx:
        sheets = {n: corpus.facts[n] for n in SHEETS if n in corpus.facts}
        out["xlsx"] = report.workbooks(report.nested_json(corpus.info, sheets | {"figures": tables["figures"].withColumn("image", report.redacted(F.col("image")))}))
    return out
