"""Preparing, sending and taking back texts for a pluggable model, with a glossary where there is no model.

Texts are deduplicated before the call and joined back after it.  The call itself stands in exactly one Arrow
stage; the number of partitions is the number of concurrent callers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import rules, text as T
from ..tables import cut
from .batching import with_batches
from .replies import Calls, Provider, ask, call


def call_with_retries(provider: Provider | None, system: str, user: str, attempts: int = 3, wait: Callable[[float], None] | None = None) -> str:
    """The reply, or "" without a provider or after the last attempt (L1, L2)."""
    return call(provider, system, user, Calls(attempts=attempts), wait)


def healthy(provider: Provider | None, calls: Calls = Calls()) -> bool:
    """Asked once, on the driver; a provider that fails is not used at all (L3)."""
    return call(provider, "", "ping", replace(calls, attempts=1)).strip() != ""


def translate_one(text: str, provider: Provider | None, glossary: dict[str, str] | None = None, caption: bool = False, calls: Calls = Calls()) -> str:
    """One text by itself, without a table; captions go without the glossary's terms (L8).  The glossary's version if nothing comes back."""
    glossary = fixed.GLOSSARY if glossary is None else glossary
    if not text:
        return ""
    terms = "; ".join(f"{t}={by}" for t, by in glossary.items() if t.lower() in text.lower())
    reply = call(provider, "translate a caption" if caption else "translate", text if caption else f"{terms}\n{text}", calls).strip()
    if reply:
        return reply
    for term in sorted(glossary, key=len, reverse=True):
        text = re.sub(re.escape(term), lambda _, by=glossary[term]: by, text, flags=re.I)
    return text


def items(info: DataFrame, paragraphs: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, target, target_id, label, text, order) of all texts to translate: title, abstract, paragraphs, captions.

    References, text that is not content and boilerplate pass through untranslated and are not listed.
    """
    def of(df, target, target_id, label, text, order):
        return df.select("doc_id", F.lit(target).alias("target"), target_id.cast("string").alias("target_id"), label.alias("label"), text.alias("text"), order.cast("long").alias("order"))

    refs = T.has(F.col("section_title"), "references|bibliography")
    body = paragraphs.where(~refs & ~F.col("kind").isin("non_content", "heading") & ~rules.skips_translation(F.col("text")))
    word = F.when(F.col("kind") == "caption", "caption_page_").otherwise("paragraph_page_")
    rows = of(info, "title", F.lit(""), F.lit("title"), F.col("title"), F.lit(0))
    rows = rows.unionByName(of(info, "abstract", F.lit(""), F.lit("abstract"), F.col("abstract"), F.lit(1)))
    rows = rows.unionByName(of(body, "paragraph", F.concat_ws(":", "seq", "part"), F.concat(word, F.col("page")), F.col("text"), F.col("seq") * 4 + F.col("part") + 10))
    rows = rows.unionByName(of(figures, "figure", F.col("fig_seq"), F.concat(F.lit("figure_"), F.col("figure_id")), F.col("caption"), F.col("fig_seq") + (1 << 40)))
    return rows.where("coalesce(text, '') <> ''")


def distinct_texts(rows: DataFrame, keys: list[str] = ("doc_id",)) -> DataFrame:
    """(keys, text, label, order, uses): texts equal but for white space once, with the first label."""
    rows = rows.withColumn("key", T.squeeze(F.col("text"))).where("key <> ''")
    first = F.struct("order", "label")
    return rows.groupBy(*keys, "key").agg(F.min_by("label", first).alias("label"), F.min("order").alias("order"), F.count(F.lit(1)).alias("uses")).withColumnRenamed("key", "text")


def write_back(rows: DataFrame, translated: DataFrame, keys: list[str] = ("doc_id",), out: str = "text_zh") -> DataFrame:
    """Give every item the translation of its text."""
    done = translated.select(*keys, F.col("text").alias("key"), F.col("translation").alias(out))
    return rows.withColumn("key", T.squeeze(F.col("text"))).join(done, [*keys, "key"], "left").drop("key")


def batches(lengths: Column, max_items: int, max_chars: int) -> Column:
    """The batch number, from 0, of each of an ordered array of lengths.

    A batch closes when it is full or the next text would exceed its characters; a longer text stands alone.
    """
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"))

    def step(s, length):
        closes = (s["n"] > 0) & ((s["n"] >= max_items) | (s["chars"] + length > max_chars))
        batch = F.when(closes, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.concat(s["ids"], F.array(batch)).alias("ids"), batch.alias("batch"), F.when(closes, 1).otherwise(s["n"] + 1).alias("n"), F.when(closes, length).otherwise(s["chars"] + length).alias("chars"))

    return F.aggregate(lengths, start, step, lambda s: s["ids"])


def chunk_lines(text: Column, max_chars: int, separator: str = r"\n\s*\n", joiner: str = "\n\n") -> Column:
    """Texts cut at blank lines into chunks of at most ``max_chars`` characters, separators not counted."""
    parts = F.split(text, separator)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), F.lit(0).alias("k"))

    def step(s, p):
        closes = (s["k"] > 0) & (s["n"] + F.length(p) > max_chars)
        fresh = closes | (s["k"] == 0)
        return F.struct(
            F.when(closes, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(fresh, p).otherwise(F.concat(s["now"], F.lit(joiner), p)).alias("now"),
            F.when(fresh, F.length(p)).otherwise(s["n"] + F.length(p)).alias("n"),
            F.when(closes, 1).otherwise(s["k"] + 1).alias("k"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s["k"] > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def translate(texts: DataFrame, provider: Provider | None, callers: int = 2, max_items: int = 6, max_chars: int = 6000, checked: bool = False, calls: Calls = Calls(), told: Callable[[int, int], None] | None = None) -> DataFrame:
    """(doc_id, text, translation) of distinct texts, batch by batch.

    A batch goes out as marked texts.  A text that does not come back, or comes back short, is asked for once more by itself; then
    the glossary's version stands.  A provider that fails its health check is not called at all, unless the caller has
    ``checked`` it already; ``callers`` bounds the tasks that call in either round.  ``told`` hears (done, total) of the batches.
    """
    if provider is not None and not checked and not healthy(provider, calls):
        provider = None
    rows = texts.join(with_batches(texts, ["doc_id"], "order", F.length("text"), max_items, max_chars), ["doc_id", "order"])
    rows = rows.withColumn("glossary", T.glossary_relevant(F.col("text")))
    sent = rows.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("order", "text", "glossary"))).alias("xs"))
    if provider is not None:
        sent = cut(sent)
        terms = F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("xs", lambda x: F.split(x["glossary"], "; "))), lambda t: t != ""))), "; ")
        marked = F.array_join(F.transform("xs", lambda x, i: F.concat(F.lit("<<<"), i.cast("string"), F.lit(">>>\n"), x["text"])), "\n")
        prompts = sent.select("doc_id", "batch", F.concat(terms, F.lit("\n"), marked).alias("prompt"))
        sent = sent.join(ask(prompts, provider, "translate", callers, calls, {"doc_id": "long", "batch": "int"}, told=told), ["doc_id", "batch"])
    else:
        sent = sent.withColumn("reply", F.lit(""))
    parts = T.marked_parts(F.col("reply"), max_items)
    out = sent.select("doc_id", F.posexplode("xs").alias("i", "x"), parts.alias("parts")).select("doc_id", "x.text", F.get("parts", F.col("i")).alias("got"))
    poor = F.col("got").isNull() | T.looks_truncated(F.col("text"), F.col("got"))
    fallback = T.glossary_replace(F.col("text"))
    if provider is not None:
        retried = out.where(poor).select("doc_id", "text", F.col("text").alias("prompt")).distinct()
        out = out.join(ask(retried, provider, "translate", callers, calls, {"doc_id": "long", "text": "string"}, "retry"), ["doc_id", "text"], "left")
        fallback = F.when((F.coalesce("retry", F.lit("")) != "") & ~T.looks_truncated(F.col("text"), F.col("retry")), F.col("retry")).otherwise(fallback)
    return out.select("doc_id", "text", F.when(poor, fallback).otherwise(F.col("got")).alias("translation"))


def model_facts(prompts: DataFrame, provider: Provider | None, system: str, keys: dict[str, str], callers: int = 2, calls: Calls = Calls()) -> dict[str, DataFrame]:
    """Rows that a model finds: one table per key of its JSON reply, parsed with the key's schema; no rows for replies that do not parse.

    ``prompts``: (doc_id, prompt), each asked once for all keys.  ``keys``: key -> element schema, such as "method_name string, source_page int".
    """
    if provider is None:
        told = prompts.select("doc_id", F.lit("").alias("reply"))
    else:
        told = ask(prompts, provider, system, callers, calls)
    told = told.withColumn("json", T.json_object(F.col("reply")).cast("string"))
    listed = lambda schema: "array<struct<" + ", ".join(p.strip().replace(" ", ": ", 1) for p in schema.split(", ")) + ">>"
    return {key: told.select("doc_id", F.inline(F.from_json(F.get_json_object("json", f"$.{key}"), listed(schema)))) for key, schema in keys.items()}


def latest(status: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return status.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
