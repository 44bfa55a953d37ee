"""Matches and sentences by built-in expressions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from leafwork.operators import facts
from leafwork.plans import catalogue

from .plain_facts import sentence_around, text_matches

PARTS = [
    "PCE of 21.3%", "a certified efficiency of 24 %", "champion PCE 19.5 %", "≈ 20.5% PCE", "retained 95% of its initial PCE after 1,000 h", "after 500 hours it maintained > 90 % of the initial value",
    "for 200 cycles with a loss of 3.5%", "degradation by 12 %", "remaining 80.5% for 30 h", "3.5", "Fig. 2", "e.g. this", "in 2020", "!", "?", "。", ".", ". ", ".5", "\n\n", "\n", ";", " and the film ", " word " * 8, "日本語 テスト", "𝔸𝔹 ", "x", " ",
]


def texts(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    out = ["".join(draw.choice(PARTS) + draw.choice(["", " ", ". "]) for _ in range(draw.randrange(1, 30))) for _ in range(n)]
    return [t for t in out if "\n\n\n" not in t]


def rows_of(spark, values):
    return spark.createDataFrame([(i, 1, 2, "results", "", t) for i, t in enumerate(values)], "doc_id long, item long, page int, section string, figure_id string, text string")


def test_matches_equal_plain_python(spark):
    values = texts(1500, 1) + ["word " * 5000 + "PCE of 21% " + "more " * 5000, ("A long line of words without an end " * 200 + "PCE of 5.5%. ") * 3, "%", "PCE 5%", "x. " * 6000 + "efficiency of 7%"]
    got = {}
    for r in facts.matches(rows_of(spark, values)).collect():
        got.setdefault(r["doc_id"], []).append((r["pattern"], r["start"], r["qualifier"], r["number"], r["count"], r["unit"], r["sentence"]))
    total = 0
    for i, t in enumerate(values):
        want = sorted(text_matches(t), key=str)
        total += len(want)
        assert sorted(got.get(i, []), key=str) == want, t
    assert total > 1500


def test_first_sentences_equal_plain_python(spark):
    values = texts(800, 2) + ["", "no end at all " * 60, "Short. Next one here! Third", "a\n\nb", "12.5 is a number. And so on."]
    got = {r["doc_id"]: r["sentence"] for r in facts.first_sentences(rows_of(spark, values)).collect()}
    assert all(got[i] == sentence_around(t, 0, ends=[]) for i, t in enumerate(values))
    assert facts.first_sentences(rows_of(spark, [None])).first()["sentence"] == ""


@pytest.mark.parametrize("name", ["perf_extract_synth", "device_rows_synth", "stability_extract_synth", "sentence_around", "characterization_synth"])
def test_no_python_in_the_plan(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Pandas" not in plan and "Python" not in plan


def test_places_in_a_text(spark):
    text = "one 𝔸 two.three 3.5 four!\n\nfive"
    row = spark.range(1).select(facts.spans(F.lit(text), "(?U)[a-z]+").alias("s")).first()["s"]
    assert [(x["start"], x["found"]) for x in row] == [(0, "one"), (6, "two"), (10, "three"), (20, "four"), (27, "five")]


@pytest.mark.parametrize("name", ["perf_extract_synth", "sentence_around", "device_metrics_synth", "device_rows_synth", "stability_kinds_synth", "stability_extract_synth", "loss_extract_synth"])
def test_a_text_is_searched_once(spark, sf, name):
    """Patterns stand above the distinct texts in the plan, none is pushed below, and rows only meet what was found."""
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    searched = [i for i, line in enumerate(plan) if "regexp_extract_all" in line]
    distinct = max(i for i, line in enumerate(plan) if "Aggregate [text" in line)
    assert len(searched) == 1 and searched[0] < distinct


def test_equal_texts_keep_their_rows(spark):
    text = "The PCE of 21.5% was high. A champion efficiency of 20% too."
    rows = spark.createDataFrame([(i % 3, i, 1 + i % 4, "results", "", text) for i in range(20)] + [(9, 1, 1, "results", "", None), (9, 2, 1, "results", "", "none at 5 %")], "doc_id long, item long, page int, section string, figure_id string, text string")
    one = {r[3:] for r in map(tuple, facts.matches(rows.limit(1)).drop("section", "figure_id").collect())}
    got = [tuple(r) for r in facts.matches(rows).drop("section", "figure_id").collect()]
    assert len(one) >= 2 and sorted(got, key=str) == sorted(((i % 3, i, 1 + i % 4, *m) for i in range(20) for m in one), key=str)
    told = facts.matches(rows, facts.DEVICE_PATTERNS, facts.device_values)
    assert sorted(map(str, facts.device_performance(told).collect())) == sorted(map(str, facts.device_performance(facts.matches(rows)).collect()))
