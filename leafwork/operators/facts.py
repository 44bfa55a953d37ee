"""Measured facts with their evidence sentences.

All of it is built-in expressions: where a match starts is a sum of lengths, and its sentence is cut from the text around that place.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..fixed import COUNT, SIGNED, any_of
from ..functions import rules, text as T
from ..functions.numbers import round_even
from ..tables import spread

_period = f"({COUNT})\\s*({'|'.join(fixed.PERIODS)})"
_efficiency, _retained, _lost = any_of(fixed.EFFICIENCY), any_of(fixed.RETAINED), any_of(fixed.LOST)
#: Name -> (pattern, groups that hold qualifier, number, count, unit; 0 where there is none)
PATTERNS = {
    "pce": (rf"(?:({'|'.join(fixed.QUALIFIERS)})\s+)?{_efficiency}[^\n.;]{{0,120}}?({SIGNED})\s*%", (1, 2, 0, 0)),
    "pce_reverse": (rf"({SIGNED})\s*%[^\n.;]{{0,80}}?{_efficiency}", (0, 1, 0, 0)),
    "stability": (rf"{_retained}[^.]{{0,160}}?({SIGNED})\s*%[^.]{{0,160}}?(?:after|for)\s+{_period}", (0, 1, 2, 3)),
    "stability_reverse": (rf"(?:after|for)\s+{_period}[^.]{{0,180}}?{_retained}[^.]{{0,120}}?({SIGNED})\s*%", (0, 3, 1, 2)),
    "loss": (rf"(?:after|for)\s+{_period}[^.]{{0,180}}?{_lost}[^.]{{0,80}}?({SIGNED})\s*%", (0, 3, 1, 2)),
}
#: name -> lists of words; a match holds a word of each list, in this order.
GATES = {
    "pce": [fixed.EFFICIENCY, ["%"]], "pce_reverse": [["%"], fixed.EFFICIENCY], "stability": [fixed.RETAINED, ["%"], fixed.SPANS],
    "stability_reverse": [fixed.SPANS, fixed.RETAINED, ["%"]], "loss": [fixed.SPANS, fixed.LOST, ["%"]],
}


def _gate(name: str) -> str:
    """A pattern for lower-cased texts in which the words of a gate stand in order; possessive, so that it never goes back."""
    word = lambda ws: any_of([w.lower() for w in ws])
    return "(?s)^" + "".join(f"(?>.*?{word(ws)})" for ws in GATES[name])


#: An end of a sentence, tested for only at characters that may be one; up to the next, the next that is no blank line, the last.
_end, _end_in_line = rf"(?=[.!?\n。！？])(?:{fixed.SENTENCE_END})", rf"(?=[.!?。！？])(?:{fixed.SENTENCE_END})"
_to_next, _to_next_in_line, _to_last = rf"(?s)^.*?{_end}", rf"(?s)^.*?{_end_in_line}", rf"(?s)^.*{_end}"


def sentence_around(text: Column, pos: Column, reach: int = 320, short: int = 40, more: int = 160, cut_before: Column | None = None, cut_after: Column | None = None) -> Column:
    """The sentence that holds a position (from 0): between sentence ends or blank lines, not longer than ``reach`` without an end.

    A sentence under ``short`` characters takes the next one with it if that ends within ``more``.  A period
    between digits is a decimal point (X9).  Where the text is part of a longer one (``cut_before``, ``cut_after``) and the
    sentence may begin or end outside of it, the result is null.
    """
    def ends(s):
        text, pos = s["text"], s["pos"]
        start = F.length(F.regexp_extract(F.substr(text, F.lit(1), pos + 1), _to_last, 0))
        unknown = s["cut_before"] & (start <= 1)
        return F.when(~unknown, T.bound(F.struct(text.alias("text"), pos.alias("pos"), F.least(start, pos).alias("start"), F.regexp_extract(F.substr(text, pos + 1), _to_next, 0).alias("ahead"), s["cut_after"].alias("cut_after")), cut))

    def cut(s):
        text, pos, ahead = s["text"], s["pos"], s["ahead"]
        stop = pos + F.length(ahead)
        end = F.when(ahead == "", F.least(F.length(text), pos + reach)).when(F.endswith(ahead, F.lit("\n\n")), stop - 2).otherwise(stop)
        unknown = s["cut_after"] & ((ahead == "") | (end + more + 2 > F.length(text)))
        return F.when(~unknown, T.bound(F.struct(text.alias("text"), s["start"].alias("start"), end.alias("end"), F.btrim(F.substr(text, s["start"] + 1, end - s["start"]), F.lit(" .;")).alias("out")), longer))

    def longer(s):
        text, start, end, out = s["text"], s["start"], s["end"], s["out"]
        extra = lambda: F.length(F.regexp_extract(F.substr(text, end + 1, F.lit(more + 2)), _to_next_in_line, 0))
        takes = (F.length(out) < short) & (end < F.length(text))
        more_of = lambda n: F.when((n > 0) & (n <= more), F.btrim(F.substr(text, start + 1, end - start + n), F.lit(" .;"))).otherwise(out)
        return F.when(takes, T.bound(extra(), more_of)).otherwise(out)

    no = F.lit(False)
    told = {"text": text, "pos": F.greatest(pos.cast("int"), F.lit(0)), "cut_before": no if cut_before is None else cut_before, "cut_after": no if cut_after is None else cut_after}
    return T.bound(F.struct(*[c.alias(n) for n, c in told.items()]), ends)


def with_sentences(text: Column, found: Column, block: int = 4096) -> Column:
    """Add ``sentence`` to each of an array of matches with a start.

    Texts of more than three blocks are cut into blocks once, and a match is looked at within its own block and those beside
    it, so that the work grows with the text and not with its square; only a sentence that passes these is cut from the whole text.
    """
    def of(s):
        text, blocks = s["text"], s["blocks"]

        def near(m):
            at = F.floor(m["start"] / block).cast("int")
            first = F.greatest(at - 1, F.lit(0))
            part = F.array_join(F.slice(blocks, first + 1, at - first + 2), "")
            return F.coalesce(sentence_around(part, m["start"] - first * block, cut_before=first > 0, cut_after=at + 2 < F.size(blocks)), sentence_around(text, m["start"]))

        sentence = lambda m: F.when(F.size(blocks) == 0, sentence_around(text, m["start"])).otherwise(near(m))
        return F.transform(s["found"], lambda m: m.withField("sentence", sentence(m)))

    n = F.ceil(F.length(text) / block).cast("int")
    blocks = F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * block + 1, F.lit(block)))).otherwise(F.array().cast("array<string>"))
    return T.bound(F.struct(text.alias("text"), blocks.alias("blocks"), found.alias("found")), of)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, found>> of all matches of a pattern that matches no empty text.

    A single match starts where its text first stands, as the pattern would match there too.  Of several, they and the pieces
    between them cut the text up, so where one starts is the sum of the lengths before it; matches are replaced by a mark and
    the text is split there, as splitting by the pattern would compile it for every row.
    """
    kind = "array<struct<start:int,found:string>>"

    def of(found):
        one = F.array(F.struct((F.position(found[0], text) - 1).alias("start"), found[0].alias("found")))
        pieces = F.split(F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit("\x02")), pattern, "\x01"), "\x01", -1)
        many = T.bound(F.struct(found.alias("found"), pieces.alias("pieces")), starts)
        return F.when(F.size(found) == 0, F.array().cast(kind)).when(F.size(found) == 1, one).otherwise(many)

    def starts(s):
        lengths = F.zip_with(F.slice(s["pieces"], F.lit(1), F.size(s["found"])), s["found"], lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
        zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
        add = lambda a, x: F.struct(F.array_append(a["starts"], a["at"] + x["p"]).alias("starts"), (a["at"] + x["p"] + x["m"]).alias("at"))
        return F.arrays_zip(F.aggregate(lengths, zero, add, lambda a: a["starts"]).alias("start"), s["found"].alias("found"))

    return T.bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


#: The patterns that each table of facts is made from.
DEVICE_PATTERNS, STABILITY_PATTERNS = ("pce", "pce_reverse"), ("stability", "stability_reverse", "loss")


def matches(evidence: DataFrame, names: tuple[str, ...] = (*DEVICE_PATTERNS, *STABILITY_PATTERNS), told=None) -> DataFrame:
    """Evidence rows (doc_id, item, page, section, figure_id, text) as rows of matches: pattern, start, qualifier, number, count, unit, sentence.

    A text is searched once, however many rows have it, and rows meet what was found in their text by a join.  ``told``
    (device_values or stability_values) adds a column of that name, also made once a text.
    """
    carried = ["doc_id", "item", "page", "section", "figure_id"]
    text = F.col("text")
    rows = evidence.where(F.contains(text, F.lit("%"))).select(*carried, "text")
    empty = F.array().cast("array<struct<pattern:string,start:int,qualifier:string,number:string,count:string,unit:string>>")

    def of(name: str) -> Column:
        pattern, groups = T.rx(PATTERNS[name][0]), PATTERNS[name][1]
        group = lambda m, g: F.nullif(F.regexp_extract(m, pattern, g), F.lit("")) if g else F.lit(None).cast("string")
        row = lambda m: F.struct(F.lit(name).alias("pattern"), m["start"].alias("start"), *[group(m["found"], g).alias(c) for g, c in zip(groups, ("qualifier", "number", "count", "unit"))])
        return F.when(F.regexp_like(F.col("_low"), F.lit(_gate(name))), F.transform(spans(text, pattern), row)).otherwise(empty)

    each = [of(name) for name in PATTERNS if name in names]
    found = with_sentences(text, F.concat(*each))
    found = found if told is None else F.transform(found, lambda m: m.withField("told", told(m)))
    found = F.when(T.mentions(text, [*fixed.EFFICIENCY, *fixed.RETAINED, *fixed.LOST]), found)
    texts = spread(rows.select("text").distinct()).withColumn("_low", F.lower("text")).select("text", found.alias("_found"))
    # No filter looks at _found, not even the one that explode implies: it would be pushed below distinct, and search every row.
    return rows.join(texts, "text").select(*carried, F.explode_outer("_found").alias("m")).where("m is not null").select(*carried, "m.*")


def first_sentences(evidence: DataFrame) -> DataFrame:
    """Evidence with ``sentence``, the first sentence of each text."""
    return evidence.withColumn("sentence", sentence_around(F.coalesce("text", F.lit("")), F.lit(0)))


def evidence(info: DataFrame, paragraphs: DataFrame, figures: DataFrame, captions_twice: bool = False) -> DataFrame:
    """Abstract, then body paragraphs, then figure captions, as rows of evidence in order.

    Captions come only from figures, so that a fact keeps its figure; ``captions_twice`` also takes caption paragraphs.
    """
    kinds = ["paragraph", "caption"] if captions_twice else ["paragraph"]
    of = lambda df, rank, seq, page, section, figure, text: df.select("doc_id", F.struct(F.lit(rank).alias("r"), seq.cast("long").alias("s")).alias("_o"), page.cast("int").alias("page"), section.alias("section"), figure.alias("figure_id"), text.alias("text"))
    none = F.lit("")
    rows = of(info, 0, F.lit(0), F.lit(1), F.lit("abstract"), none, F.col("abstract"))
    rows = rows.unionByName(of(paragraphs.where(F.col("kind").isin(kinds)), 1, F.col("seq") * 4 + F.col("part"), F.col("page"), F.lower("section_title"), none, F.col("text")))
    rows = rows.unionByName(of(figures, 2, F.col("fig_seq"), F.col("page"), F.lit("figure_caption"), F.col("figure_id"), F.col("caption")))
    item = F.row_number().over(Window.partitionBy("doc_id").orderBy("_o", "text")).cast("long")
    return rows.where("coalesce(text, '') <> ''").withColumn("item", item).drop("_o")


def unique_first(rows: DataFrame, keys: list[str], value: Column, order: list[Column]) -> DataFrame:
    """The first row of each key and first 220 characters of a value (A5)."""
    w = Window.partitionBy(*keys, F.left(value, F.lit(220))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe_devices(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row per document, efficiency to one decimal, page and role: the one with most metrics, then the longest evidence, then the first."""
    metrics = sum((F.col(c).isNotNull().cast("int") for c in ("voc_v", "jsc_ma_cm2", "ff_percent", "active_area_cm2")), F.lit(0))
    key = F.coalesce(round_even(F.col("pce_percent"), 1), F.lit(0.0))
    w = Window.partitionBy("doc_id", key, F.coalesce("source_page", F.lit(0)), "sample_role").orderBy(metrics.desc(), F.length("source_text").desc(), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe_stability(rows: DataFrame, order: list[Column], with_cycles: bool = True) -> DataFrame:
    """One row per document, retention to one decimal, duration, page and cycles: the one with the longest evidence, then the first."""
    keys = ["doc_id", round_even(F.col("retained_pce_percent"), 1), "duration_h", "source_page", *(["cycles"] if with_cycles else [])]
    w = Window.partitionBy(*keys).orderBy(F.length("source_text").desc(), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _filled(template: str, values: dict[str, Column], strings_empty: bool = True) -> list[Column]:
    """All columns of a row template, those given from values, the others empty."""
    out = []
    for field in template.split(", "):
        name, kind = field.split(" ", 1)
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit("") if kind == "string" and strings_empty else F.lit(None).cast(kind)
        out.append((values[name].cast(kind) if name in values else empty).alias(name))
    return out


def _order() -> list[Column]:
    return [F.col("_item"), F.col("_pattern"), F.col("_start"), F.col("source_text")]


def _with_told(found: DataFrame, names: tuple[str, ...], told) -> DataFrame:
    rows = found.where(F.col("pattern").isin(*names))
    return rows if "told" in found.columns else rows.withColumn("told", told({c: F.col(c) for c in found.columns}))


def device_values(m) -> Column:
    """What a match of an efficiency tells, whatever its document and page: other metrics, label and role, and whether it counts."""
    s = m["sentence"]
    n, metric = T.operator_number(m["number"]), lambda p: T.find(s, p).try_cast("double")
    said = F.when(m["qualifier"].isNotNull(), m["qualifier"]).when(T.has(s, r"\bchampion\b"), "champion").when(T.has(s, r"\bcertified\b"), "certified").when(T.has(s, r"\bsteady[- ]state\b"), "steady-state").otherwise("")
    values = {
        "other_kind": rules.is_stability_sentence(s) | rules.is_retention(s) | rules.is_environment(s), "of_others": rules.is_other_work(s, F.lit(1)),
        "label": said, "role": T.role(s), "pce": n["value"],
        "voc": metric(rf"\bV(?:OC)?\b[^\d]{{0,20}}({fixed.NUMBER})\s*V"), "jsc": metric(rf"\bJSC\b[^\d]{{0,20}}({fixed.NUMBER})\s*mA\s*cm[-−]?\s*2"),
        "ff": metric(rf"(?:\bFF\b|fill\s+factor)[^\d]{{0,20}}({fixed.NUMBER})\s*%"), "area": metric(rf"(?:active\s+area|area)[^\d]{{0,20}}({fixed.NUMBER})\s*cm\s*2"),
        "source": T.bound(n["op"], lambda op: F.when(op != "", F.concat(s, F.lit(" [operator for PCE: "), op, F.lit("]"))).otherwise(s)),
    }
    return F.struct(*[c.alias(k) for k, c in values.items()])


def device_performance(found: DataFrame) -> DataFrame:
    """Efficiencies with the voltage, current, fill factor and area of their sentence."""
    rows = _with_told(found, DEVICE_PATTERNS, device_values)
    t = lambda name: F.col(f"told.{name}")
    rows = rows.where(~t("other_kind") & ~((F.col("page") <= 2) & t("of_others")))
    values = {
        "device_label": t("label"), "sample_role": t("role"), "pce_percent": t("pce"),
        "certified_pce_percent": F.when(F.lower(t("label")) == "certified", t("pce")), "steady_state_pce_percent": F.when(F.lower(t("label")).contains("steady"), t("pce")),
        "voc_v": t("voc"), "jsc_ma_cm2": t("jsc"), "ff_percent": t("ff"), "active_area_cm2": t("area"),
        "source_text": t("source"), "source_page": F.col("page"), "source_figure": F.col("figure_id"),
    }
    rows = rows.select("doc_id", F.col("item").alias("_item"), F.col("pattern").alias("_pattern"), F.col("start").alias("_start"), *_filled(schemas.DEVICE, values))
    rows = unique_first(rows.repartition("doc_id"), ["doc_id", "pce_percent"], F.col("source_text"), _order())
    return dedupe_devices(rows, _order()).drop("_item", "_pattern", "_start")


def stability_values(m) -> Column:
    """What a match of a retention or loss tells, whatever its document and page."""
    s, n = m["sentence"], T.operator_number(m["number"])
    values = {"op": n["op"], "value": n["value"], "role": T.role(s), "test": T.test_type(s), "celsius": T.temperature(s), "humidity": T.humidity(s), "steady": T.has(s, "no significant degradation")}
    return F.struct(*[c.alias(k) for k, c in values.items()])


def stability_tests(found: DataFrame, compat: bool = False) -> DataFrame:
    """Retention after hours or cycles, told forwards, backwards or as a loss (E1c, E1d, E1e).

    ``compat`` leaves losses without a number and ignores cycles when rows are deduplicated.
    """
    s, unit = F.col("sentence"), F.lower("unit")
    rows = _with_told(found, STABILITY_PATTERNS, stability_values)
    t = lambda name: F.col(f"told.{name}")
    lost = F.col("pattern") == "loss"
    loss = F.when(lost, F.lit(None).cast("double") if compat else t("value"))
    kept = F.when(lost, round_even(100 - loss, 3)).otherwise(t("value"))
    quality = F.when(loss.isNotNull(), F.concat(F.lit("reported efficiency loss "), t("op"), loss.cast("string"), F.lit("%"))).when((F.col("pattern") == "stability") & t("steady"), "no significant degradation")
    values = {
        "sample_role": t("role"), "test_type": t("test"), "duration_h": F.when(unit.startswith("h"), T.number(F.col("count"))),
        "cycles": F.when(unit.contains("cycle"), F.coalesce(T.number(F.col("count")), F.lit(0.0)).cast("int")),
        "retained_pce_operator": F.when(loss.isNotNull(), "~").otherwise(t("op")), "retained_pce_percent": kept,
        "temperature_c": t("celsius"), "relative_humidity_percent": t("humidity"), "qualitative_result": F.coalesce(quality, F.lit("")),
        "source_text": s, "source_page": F.col("page"), "source_figure": F.col("figure_id"),
    }
    rows = rows.select("doc_id", F.col("item").alias("_item"), F.col("pattern").alias("_pattern"), F.col("start").alias("_start"), *_filled(schemas.STABILITY, values))
    rows = unique_first(rows.repartition("doc_id"), ["doc_id", "retained_pce_percent", "duration_h", "cycles"], F.col("source_text"), _order())
    return dedupe_stability(rows, _order(), not compat).drop("_item", "_pattern", "_start")


def characterization_methods(items: DataFrame) -> DataFrame:
    """Instruments that a text names (E1f).  ``items``: evidence with first sentences."""
    hits = F.filter(F.array(*[F.when(T.has(F.col("text"), rf"\b{re.escape(m)}\b"), m) for m in fixed.INSTRUMENTS]), lambda m: m.isNotNull())
    rows = items.select("doc_id", "item", "page", "sentence", F.posexplode(hits).alias("pos", "method"))
    rows = rows.select("doc_id", "item", "pos", "method", F.lit("").alias("purpose"), F.lit("").alias("key_finding"), F.left("sentence", F.lit(260)).alias("source_text"), F.col("page").alias("source_page"))
    return unique_first(rows, ["doc_id", "method"], F.col("source_text"), [F.col("item"), F.col("pos")]).drop("item", "pos")


def experimental_methods(items: DataFrame) -> DataFrame:
    low = F.lower("text")
    made = F.exists(F.array(*map(F.lit, fixed.FABRICATION)), lambda w: F.contains(low, w))
    rows = items.where(rules.is_method_section(F.col("section")) & made)
    rows = rows.select("doc_id", "item", T.method_name(F.col("text")).alias("method_name"), F.left("sentence", F.lit(260)).alias("description"), F.col("page").alias("source_page"))
    return unique_first(rows, ["doc_id"], F.col("description"), [F.col("item")]).drop("item")


def first_per_document(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each document: a report's cap."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def _claims(items: DataFrame, test: Column, name: str, other: str, limit: int) -> DataFrame:
    cut = F.left("sentence", F.lit(220))
    rows = items.where(rules.is_result_section(F.col("section")) & test)
    rows = rows.select("doc_id", "item", cut.alias(name), F.lit("").alias(other), cut.alias("source_text"), F.col("page").alias("source_page"))
    return first_per_document(unique_first(rows, ["doc_id"], F.col("source_text"), [F.col("item")]), [F.col("item")], limit).drop("item")


def key_innovations(items: DataFrame, limit: int = 8) -> DataFrame:
    return _claims(items, rules.is_innovation(F.col("sentence")), "innovation", "explanation", limit)


def new_knowledge(items: DataFrame, limit: int = 10) -> DataFrame:
    return _claims(items, rules.is_finding(F.col("sentence")), "finding", "evidence", limit)


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first table, and of the second for documents that the first has nothing of."""
    return first.unionByName(second.join(first.select("doc_id").distinct(), "doc_id", "left_anti"), allowMissingColumns=True)


#: The tables of the model's replies, by the view of the text that is asked about.
ASKED = {"performance": ["device_performance", "stability_tests"], "methods": ["experimental_methods", "characterization_methods"], "insights": ["key_innovations", "new_knowledge", "limitations"]}
PATTERNS_FIRST = {"experimental_methods", "characterization_methods"}
LIMITATIONS = "limitation string, source_text string, source_page int"


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "doc_id")


def with_model(found: dict[str, DataFrame], told: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The patterns' tables and the model's together: for each document the model's rows if it has some, else the patterns';
    the other way round for methods (J9)."""
    out = dict(found)
    for name, rows in told.items():
        if name not in found:
            out[name] = rows
        elif name in PATTERNS_FIRST:
            out[name] = prefer(found[name], rows.select(*found[name].columns))
        else:
            out[name] = prefer(rows.select(*found[name].columns), found[name])
    return out


#: Order of a document's rows in tables and reports.
ORDERS = {
    "device_performance": lambda: [F.col("source_page"), F.col("pce_percent").desc(), F.col("source_text")],
    "stability_tests": lambda: [F.col("source_page"), F.col("source_text"), F.col("duration_h"), F.col("retained_pce_percent")],
}


def in_order(name: str, rows: DataFrame) -> DataFrame:
    """Rows of one document together and in order: devices by page and falling efficiency, tests by page."""
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", *ORDERS[name]()) if name in ORDERS else rows


def extract(evidence_rows: DataFrame, keep=lambda df: df) -> dict[str, DataFrame]:
    """All fact tables of a corpus (E1).  ``keep`` may write the two tables that they are all made from."""
    found, items = keep(matches(evidence_rows)), keep(first_sentences(evidence_rows))
    return {
        "device_performance": in_order("device_performance", device_performance(found)), "stability_tests": in_order("stability_tests", stability_tests(found)), "characterization_methods": characterization_methods(items),
        "experimental_methods": experimental_methods(items), "key_innovations": key_innovations(items), "new_knowledge": new_knowledge(items),
    }
