"""Pieces shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a new temporary one if all runs in one process, else an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a point that every executor can read, so that an executor lost later costs
    no recomputation of what stands before it.  The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leafwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafwork_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut has written, once all that was made from them is written too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._leafwork_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the id written as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def with_rank(df: DataFrame, keys: list[str], ident: Column, out: str, then: list[Column] | None = None, place: Column | None = None) -> DataFrame:
    """Add ``out``: the gapless rank (from 0) of each row among the rows of its keys, in order of md5(ident).

    No task holds all rows of a key: rows are dealt by key and four hex digits of the hash, ranked
    there, and shifted by counts summed over at most 256 buckets at each of two levels.  ``then``
    breaks ties of equal identities.  Keys may not be null.  ``place``: hex digits to order by in place of the hash.
    """
    df = df.withColumns({"_h": F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) if place is None else place})
    df = df.withColumns({"_b1": F.substring("_h", 1, 2), "_b2": F.substring("_h", 3, 2)})
    leaf = df.groupBy(*keys, "_b1", "_b2").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    leaf = leaf.withColumn("_low", F.coalesce(F.sum("_n").over(before(Window.partitionBy(*keys, "_b1").orderBy("_b2"))), F.lit(0)))
    top = leaf.groupBy(*keys, "_b1").agg(F.sum("_n").alias("_m"))
    top = top.withColumn("_high", F.coalesce(F.sum("_m").over(before(Window.partitionBy(*keys).orderBy("_b1"))), F.lit(0)))
    base = leaf.join(top, [*keys, "_b1"]).select(*keys, "_b1", "_b2", (F.col("_low") + F.col("_high")).alias("_base"))
    own = Window.partitionBy(*keys, "_b1", "_b2").orderBy("_h", *(then or []))
    df = df.withColumn("_i", F.row_number().over(own)).join(base, [*keys, "_b1", "_b2"])
    return df.withColumn(out, F.col("_base") + F.col("_i") - 1).drop("_h", "_b1", "_b2", "_i", "_base")


def _places(x: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each 64-bit value in a filter of 2 ** log_bits bits."""
    u = np.uint64
    shift = u(64 - log_bits)
    return x * u(0x9FB21C651E98DF25) >> shift, (x ^ (x >> u(31))) * u(0xA0761D6478BD642F) >> shift


def passes(x: np.ndarray, words: np.ndarray, log_bits: int) -> np.ndarray:
    """Whether each 64-bit value may be one of those that a filter was made of; true for all that are."""
    u, ok = np.uint64, np.ones(len(x), bool)
    for p in _places(x, log_bits):
        ok &= (words[p >> u(6)] >> (p & u(63))) & u(1) > 0
    return ok


def bit_filter(values: DataFrame, log_bits: int) -> np.ndarray:
    """The words of a filter of 2 ** log_bits bits that all values (one column of longs) pass.

    At most 2 ** (log_bits - 6) rows reach the driver, whatever the number of values.
    """
    u = np.uint64

    def run(batches):
        for b in batches:
            p = np.concatenate(_places(b.column(0).to_numpy().view(u), log_bits))
            word, at = np.unique(p >> u(6), return_inverse=True)
            bits = np.zeros(len(word), u)
            np.bitwise_or.at(bits, at, u(1) << (p & u(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = values.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log_bits - 6), u)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(u)
    return out
