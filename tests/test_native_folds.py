"""Both merge folds against plain Python on random documents, without Python in their plans."""

import random

import duckdb
import pytest

from leafwork import fixed
from leafwork.functions import rules
from leafwork.operators import sections
from leafwork.plans import catalogue
from tests import plain_folds

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
SCHEMA = f"doc_id long, seq long, part int, page int, section_id long, section_title string, heading_level int, text string, box {BOX}, kind string, font_size double, is_bold boolean"
TEXTS = [
    "It works with the", "cell that we made", "A whole sentence.", "a fragment, and", "(as shown) here", "NREL data", "Spin Coating Of Films", "ends with a comma,", "  padded on both sides ",
    "Meanwhile Films Grow Well", "of", "Ω at the start", "long " * 15, "这是。", "3 mm", "And", "x", "the device stability test",
]


def random_rows(seed: int, docs: int, most: int) -> list[dict]:
    r = random.Random(seed)
    rows = []
    for doc in range(docs):
        page, section, y = 1, 0, 60.0
        for seq in range(1, r.randint(1, most) + 1):
            if r.random() < 0.2:
                page, y = page + r.choice([1, 1, 2]), r.choice([60.0, 170.0, 190.0])
            kind = r.choices(["paragraph", "heading", "caption", "non_content", "abstract"], [20, 1, 1, 2, 1])[0]
            section += kind == "heading"
            x0 = r.choice([50.0, 300.0])
            box = None if r.random() < 0.05 else {"x0": x0, "y0": y, "x1": x0 + r.choice([100, 230]), "y1": y + r.choice([10.0, 40.0, 200.0])}
            y = r.choice([y + 12, y + 50, y + 95, y - 5, y - 20, 100.0, 520.0])
            rows.append(dict(doc_id=doc, seq=seq, part=r.choice([0, 1]), page=page, section_id=section, section_title=f"S{section}", heading_level=int(kind == "heading"), text=r.choice(TEXTS), box=box, kind=kind, font_size=10.0, is_bold=False))
    return rows


@pytest.mark.parametrize("mine, plain, nouns, starters", [
    (sections.merge_paragraphs, plain_folds.merged, fixed.PARSER_NOUNS, []), (sections.merge_fragments, plain_folds.merged_fragments, [], ["Meanwhile"]),
])
def test_equal_to_the_plain_fold(spark, mine, plain, nouns, starters):
    rows = random_rows(7, 150, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    told = df.withColumn("subheading", rules.starts_subheading(df["text"], nouns, starters)).collect()
    docs: dict[int, list[dict]] = {}
    for r in sorted((r.asDict(True) for r in told), key=lambda r: (r["doc_id"], r["seq"], r["part"])):
        docs.setdefault(r["doc_id"], []).append(r)
    want = [{k: v for k, v in r.items() if k != "subheading"} for d in docs.values() for r in plain(d)]
    out = mine(df)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    got = sorted((r.asDict(True) for r in out.collect()), key=lambda r: (r["doc_id"], r["seq"], r["part"]))
    assert got == want and len({r["text"] for r in got}) > len(TEXTS)


def test_empty_blank_and_null_rows(spark):
    row = lambda seq, text, kind="paragraph": (1, seq, 0, 1, 0, "S", 0, text, None, kind, None, None)
    df = spark.createDataFrame([row(1, "with the"), row(2, "  "), row(3, None), row(4, "end of"), row(5, "it", None)], SCHEMA)
    for merge in (sections.merge_paragraphs, sections.merge_fragments):
        got = merge(df).orderBy("seq").collect()
        assert [r["text"] for r in got] == ["with the", "  ", None, "end of", "it"]
        assert merge(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["merge_paragraphs", "merge_fragments"])
def test_no_python_and_equal_to_sql_on_a_larger_table(spark, name):
    folder = "/root/testdata/sf0.01"
    got = catalogue.QUERIES[name](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(catalogue.SQL[name])
    columns = want.columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
