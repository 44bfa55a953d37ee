"""From raw documents to training shards, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  The first three drop rows (poor, near-duplicate
and contaminated documents), mixing keeps every row and lays them out in mixed order, and sharding returns each
document's shard and its slot, in mixed order within the shard.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import decontam, mixing, nearcopy, quality, sharding
from leafwork.llm.common import cut
from leafwork.llm.queries import MIX_BLOCK, MIX_OTHER, MIX_WEIGHTS


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; rows keep their columns, repeated rows stay or go together, empty texts score the prior."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows without an id stay."""
    return nearcopy.keep_one(docs, width=5, num=4, den=5)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in mixed order, all kept; a null source counts as one that has no weight of its own.

    A table keeps no order of rows, so the schedule goes with it as metadata of doc_id.
    """
    plan = {"weights": json.dumps(MIX_WEIGHTS), "other": MIX_OTHER, "block_rows": MIX_BLOCK}
    out = mixing.mixed_order(docs, MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK)
    return out.select(*[F.col(c).alias(c, metadata={"mixed": plan}) if c == "doc_id" else c for c in out.columns])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row in 40 shards; where the stage before has mixed the rows, slots follow their mixed position.

    Only ids, sizes and digests are moved.  Null texts count as empty; equal texts share a shard.
    """
    plan = docs.schema["doc_id"].metadata.get("mixed")
    if plan is None:
        return sharding.shard(docs, shards=40)
    rows = cut(sharding.measure(docs, keep=("source",)))
    return sharding.place(mixing.mix(rows, json.loads(plan["weights"]), plan["other"], plan["block_rows"]), shards=40, order_col="position")


STAGES = [("quality classifier", good_quality), ("SimHash near-dedup", no_near_copies), ("benchmark decontamination", no_test_items), ("mixing sources", mixed), ("sharding", sharded)]

#: Nearest-neighbour scores and edit distances have no SQL form; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
