"""Columns of any name and type, bytes that are not UTF-8, hostile texts, null and repeated ids."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafwork.llm import decontam, lmscore, mixing, nearcopy, quality, secrets, simhash, substring

#: Every column name that the operators use inside.
NAMES = [
    "weight", "at", "before", "w", "_w", "h", "_h", "nth", "r", "_r", "cycle", "_cycle", "row", "id", "leaf", "base", "place", "counts", "_b1", "_b2", "_i", "_base", "_quality", "_quality_", "_matches", "_key", "_found",
    "key", "fp", "node", "component", "component_id", "u", "v", "n", "m", "x", "size", "same", "total", "shard", "rank", "score", "held_out", "start", "mask", "anchor", "digest", "piece", "hits", "word", "c", "token", "sketch", "root", "count",
]
ADDED = ["mix_source", "block", "slot", "position"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the same words stand here twice and end", "src0"), (2, "the same words stand here twice and end", None), (3, "a text of its own", "src1"), (None, None, None), (None, "", "src0"), (3, "a text of its own", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES}).withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))


def same_columns(got, docs, but=()):
    assert [c for c in got.columns if c not in but] == list(docs.columns)
    for r in got.select("doc_id", *NAMES, "tags").collect():
        own = "-" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[c] == c + own for c in NAMES) and r["tags"] == {"k": 1}
    return got.count()


def test_user_columns_survive(spark, docs):
    benchmark = spark.createDataFrame([(7, "A TEXT of")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    assert same_columns(mixing.mix(docs, {"src0": 2}, 1, 2), docs, ADDED) == 6
    assert same_columns(mixing.mixed_order(docs, {"src0": 2}, 1, 2), docs) == 6
    assert same_columns(quality.keep_good(docs, labels, threshold=0.0), docs) == 6
    assert same_columns(decontam.decontaminate(docs, benchmark), docs) == 4
    for chunk in (1_000_000, 3):
        assert same_columns(decontam.with_matches(docs, benchmark.unionByName(benchmark.selectExpr("8L item_id", "'own' text")), chunk_chars=chunk), docs, ["matches"]) == 6
    assert same_columns(simhash.keep_one(docs), docs) == same_columns(nearcopy.keep_one(docs), docs)
    assert same_columns(corpus_pipeline.no_near_copies(spark, docs, ""), docs) == same_columns(nearcopy.keep_one(docs), docs)
    assert same_columns(corpus_pipeline.mixed(spark, docs, ""), docs) == 6


def test_added_columns_replace_those_of_their_name(docs):
    got = mixing.mix(docs.withColumn("Slot", F.lit("mine")), {"src0": 2}, 1, 2)
    assert [c for c in got.columns if c.lower() == "slot"] == ["slot"] and dict(got.dtypes)["slot"] == "bigint"
    replaced = decontam.with_matches(docs.withColumn("matches", F.lit("mine")), docs.limit(0).select(F.lit(1).alias("item_id"), "text"))
    assert replaced.columns.count("matches") == 1 and {len(r["matches"]) for r in replaced.collect()} == {0}


def test_bytes_that_are_not_utf8(spark):
    bad = b"ab\xff cd\xfe token=abcdef\xc3"
    df = spark.createDataFrame([(1, bytearray(bad)), (2, bytearray(bad))], "doc_id long, text binary")
    df = df.withColumn("text", F.col("text").cast("string"))
    text = bad.decode("utf-8", "replace")
    found = secrets.find(text)
    assert [k for k, _, _ in found] == ["assign"] and secrets.scan(df).first()["spans"] == secrets.written(found)
    assert {r["doc_id"] for r in decontam.with_matches(df, spark.createDataFrame([(5, "CD\ufffd token=abcdef\ufffd")], "item_id long, text string")).where("size(matches) = 1").collect()} == {1, 2}
    scored = lmscore.score(df).collect()
    assert len(scored) == 2 and scored[0]["score"] == scored[1]["score"] and scored[0]["n_tokens"] == 4
    assert [r["kept_sha256"] for r in substring.dedup(df).collect()] == [hashlib.sha256(b" ".join(bad.split())).hexdigest()] * 2
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {1}
    assert quality.classify(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 2


def test_deeply_nested_token_is_no_token():
    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    assert secrets.find(f"{deep}.{deep}.x") == []


@pytest.mark.parametrize("wrap", [lambda k: k, lambda k: base64.b64encode(k.encode()).decode()])
def test_armoured_keys(wrap):
    tlv = lambda tag, body: bytes([tag, len(body)]) + body
    dsa = tlv(0x30, b"".join(tlv(2, bytes([i])) for i in range(6)))
    armour = lambda kind, head, body: f"-----BEGIN {kind} PRIVATE KEY-----\n{head}{base64.b64encode(body).decode()}\n-----END {kind} PRIVATE KEY-----"
    assert [k for k, _, _ in secrets.find(wrap(armour("DSA", "", dsa)))][-1:] == [{True: "pem", False: "key"}[wrap("x") == "x"]]
    locked = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    assert secrets.find(wrap(armour("RSA", locked, b"12345678" * 8)))
    assert not secrets.find(wrap(armour("RSA", locked, b"1234567" * 3))) and not secrets.find(wrap(armour("RSA", "", b"no key at all")))
