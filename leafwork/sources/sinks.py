"""Sinks: one file per document, written by the tasks that hold the rows through the cluster's file systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Each table of a run as a folder of files."""
    for name, df in tables.items():
        df.write.mode(mode).format(fmt).save(f"{path}/{name}")


def write_documents(rows: DataFrame, column: str, path: str, mode: str = "overwrite", buckets: int = 64) -> None:
    """Reports by document as a table (doc, value) in a fixed number of folders: a document's report is found in the bucket
    of its hash, and the number of files does not grow with that of documents (K1, K4, K5, K6)."""
    out = rows.select(F.col("doc_id").cast("string").alias("doc"), F.col(column).alias("value"))
    out.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets))).repartition(buckets, "bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def read_document(spark: SparkSession, path: str, doc_id: int | str, buckets: int = 64) -> DataFrame:
    """The report of one document; only its bucket is read."""
    doc = F.lit(str(doc_id))
    return spark.read.parquet(path).where((F.col("bucket") == F.pmod(F.xxhash64(doc), F.lit(buckets))) & (F.col("doc") == doc)).select("doc", "value")


def write_files(rows: DataFrame, column: str, path: str, mode: str = "overwrite", most: int = 10_000) -> None:
    """One text file a document, in a folder of its own; for hand-outs of at most ``most`` documents."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} documents; use write_documents")
    rows.select(F.col("doc_id").cast("string").alias("doc"), F.col(column).alias("value")).write.mode(mode).partitionBy("doc").text(path, lineSep="\x00")


def write_crops(figures: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The pixels of figures with a file name each (K9)."""
    kind = F.when(F.col("image_mime") == "image/jpeg", ".jpg").otherwise(".png")
    name = F.concat(F.translate("figure_id", " .", "_"), kind)
    figures.where("image is not null").select("doc_id", "figure_id", name.alias("name"), "image_mime", "image").write.mode(mode).parquet(path)


def copy_sources(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Copies of the source files (path, doc_id, content) beside the results, but for those that lie there already."""
    files.where(~F.col("path").startswith(path)).select("doc_id", "path", "content").write.mode(mode).parquet(path)


def serialized(result: dict) -> str:
    """A run's result as JSON, with paths as texts."""
    return json.dumps(result, default=str, ensure_ascii=False)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)
