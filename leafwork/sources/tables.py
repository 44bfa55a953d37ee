"""Sources: layout blocks from files, plain text, web pages, and job status."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as G, text as T


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, doc_id, content) of the files under a folder; doc_id is a hash of the path, so files of one name stay apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.xxhash64("path").alias("doc_id"), "length", "content")


def decode(files: DataFrame, decoder: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """Layout blocks of files by a pluggable decoder: content -> dicts of page, block_no, box, page_w, page_h, block_type, lines.

    A file that the decoder refuses gives no blocks.
    """
    def run(frames):
        for pdf in frames:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows = [r | {"doc_id": doc_id} for r in decoder(bytes(content))]
                except Exception:  # a decoder may fail in any way on a broken file
                    continue
                if rows:
                    yield pd.DataFrame(rows)[["doc_id", "page", "block_no", "box", "page_w", "page_h", "block_type", "lines"]]

    return files.select("doc_id", "content").mapInPandas(run, schemas.LAYOUT_BLOCKS)


def blocks_from_text(docs: DataFrame, lines_per_page: int = 50, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Each line of a plain text as a block of a one-column page."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text"))
    page, line = (F.floor(F.col("n") / lines_per_page) + 1).cast("int"), F.pmod("n", F.lit(lines_per_page))
    top = F.lit(72.0) + line * ((height - 144) / lines_per_page)
    return rows.select(
        "doc_id", page.alias("page"), line.alias("block_no"), G.box(72.0, top, width - 72, top + 11).alias("box"), F.lit(width).alias("page_w"), F.lit(height).alias("page_h"),
        "text", F.lit(0).alias("block_type"), F.lit(None).cast("double").alias("font_size"), F.lit(False).alias("is_bold"),
    )


class _Blocks(HTMLParser):
    """Text of block elements; scripts, styles and heads are left out."""

    BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "blockquote", "pre", "section", "article", "header", "footer", "nav", "title", "br", "tr", "ul", "ol", "table", "body"}
    SKIP = {"script", "style", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.now, self.tag, self.skipped = "", "", 0

    def flush(self, tag: str) -> None:
        text = " ".join(self.now.split())
        if text:
            self.out.append((self.tag, text))
        self.now, self.tag = "", tag

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIP
        if tag in self.BLOCK:
            self.flush(tag)

    def handle_endtag(self, tag):
        self.skipped -= tag in self.SKIP and self.skipped > 0
        if tag in self.BLOCK:
            self.flush("")

    def handle_data(self, data):
        if not self.skipped:
            self.now += data


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, tag, text) of web pages: their block elements in order, white space as single spaces."""
    kind = "array<struct<tag: string, text: string>>"

    @F.pandas_udf(kind)
    def parse(pages: pd.Series) -> pd.Series:
        def one(page):
            parser = _Blocks()
            parser.feed(page or "")
            parser.close()
            parser.flush("")
            return [{"tag": t, "text": x} for t, x in parser.out]

        return pages.map(one)

    return pages.select("page_id", F.posexplode(parse("html")).alias("block_no", "b")).select("page_id", "block_no", "b.tag", "b.text")


def raw_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): cleaned block texts of each page in order (S3)."""
    rows = blocks.where("text <> ''").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x"))
    return rows.select("doc_id", "page", F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("text"))


def job_status(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Job status records; broken files give rows of nulls."""
    reader = (spark.readStream if streaming else spark.read).schema(schemas.JOB_STATUS).option("mode", "PERMISSIVE")
    return reader.json(path)


def slugs(paths: DataFrame) -> DataFrame:
    return paths.withColumn("slug", T.safe_slug(F.col("path")))
