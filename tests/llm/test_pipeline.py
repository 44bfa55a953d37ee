"""The pipeline against plain Python, stage by stage, and its registration."""

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from leafwork.llm import decontam, queries, simhash
from leafwork.llm.quality import Model, counts

from .test_nearcopy import slow_kept
from .test_operators import slow_best_fit


def test_pipeline_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [(r["item_id"], decontam.normal(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    known = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1)
    model = Model.fitted([counts(docs[i].encode()) for i in known], np.array([labels[i] for i in known]), 16, 9)
    kept = [i for i, s in zip(docs, model.score([t.encode() for t in docs.values()])) if s >= 0.5]
    kept, _ = slow_kept({i: docs[i] for i in kept})
    kept = [i for i in kept if not any(decontam.myers(t, decontam.normal(docs[i]))[0] <= int(len(t) * 0.06) for _, t in items)]

    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(kept)
    size = {i: len(docs[i].encode()) + 16 for i in kept}
    assert all(r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in got)
    load = collections.Counter()
    for s, b in zip(sorted(size.values(), reverse=True), slow_best_fit(sorted(size.values(), reverse=True), 40)):
        load[b] += s
    mine = collections.Counter()
    for r in got:
        mine[r["shard"]] += r["size"]
    assert sorted(mine.values()) == sorted(load.values())
    for b in mine:
        assert sorted(r["slot"] for r in got if r["shard"] == b) == list(range(sum(r["shard"] == b for r in got)))


def test_stages_keep_columns_and_take_odd_rows(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", None, "x", 0), (9002, None, "en", "src1", 0), (9003, "one", "en", None, 3), (9003, "one", "en", None, 3)], table.schema)
    for docs in (table.limit(30).unionByName(odd), table.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == table.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    assert corpus_pipeline.STAGES[3][1](spark, table, sf).count() == table.count()


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert names["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
    assert set(entry.oracle_sql()) <= set(names) and {"op1_mix", "op3_topk"} <= set(queries.oracle_sql())


def test_sql_agrees(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.sql(sql)
        mine = queries.queries()[name](spark, sf)
        cols = sorted(mine.columns)
        assert cols == sorted(want.columns)
        assert sorted(tuple(r[c] for c in cols) for r in mine.collect()) == sorted(want.select(*cols).fetchall())


def test_sharding_of_a_large_group(spark):
    rows = [(i, "the same text in a third of all rows") for i in range(300)] + [(300 + i, f"text number {i} " + "x" * (i % 50)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = queries.sharding.shard(docs, shards=10).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    rest = [r["s"] for r in got if r["n"] != 300]
    assert len(rest) == 9 and max(rest) - min(rest) < 100


def test_simhash_of_large_groups(spark):
    rows = [(i, "one common text of many copies") for i in range(2000)] + [(2000 + i, f"word{i} other{i} third{i}") for i in range(50)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id = 0").count() == 2000 and got.count() == 2050
