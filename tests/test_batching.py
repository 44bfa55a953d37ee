"""Greedy batches in blocks against the plain loop, with one key that holds nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from leafwork.operators import batching
from leafwork.plans import catalogue


def plain(rows, max_items, max_chars):
    out, last = {}, object()
    for key, at, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        size = size or 0
        if key != last:
            last, batch, n, chars = key, 0, 0, 0
        elif n >= max_items or chars + size > max_chars:
            batch, n, chars = batch + 1, 0, 0
        n, chars = n + 1, chars + size
        out[key, at] = batch
    return out


@pytest.mark.parametrize("seed, blocks, max_items, max_chars", [(1, 16, 6, 6000), (2, 40, 4, 10**9), (3, 7, 1, 50), (4, 300, 25, 20_000), (5, 1, 6, 6000)])
def test_equal_to_the_plain_loop(spark, seed, blocks, max_items, max_chars):
    r = random.Random(seed)
    rows = [(r.choices([5, r.randrange(12), None], [8, 1, 0.1])[0], at, r.choice([None, 0, 1, 900, 2500, 7000, r.randrange(3000)])) for at in range(2500)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k int, at long, size long")
    got = batching.with_batches(df, ["k"], "at", F.col("size"), max_items, max_chars, blocks)
    assert got.columns == ["k", "at", "batch"]
    assert {(x["k"], x["at"]): x["batch"] for x in got.collect()} == plain(rows, max_items, max_chars)


def test_one_key_is_split_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("at"), (F.col("id") * 37 % 2500).alias("size"))
    got = batching.with_batches(df, ["k"], "at", F.col("size"), blocks=16)
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 10_000 and got.count() == 20_000
    assert batching.with_batches(df.where("false"), ["k"], "at", F.col("size")).count() == 0


def test_query_runs_in_no_single_task(spark, sf):
    assert catalogue.QUERIES["greedy_batches"](spark, sf).agg(F.max("batch")).first()[0] > 0
