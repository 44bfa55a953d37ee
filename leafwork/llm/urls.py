"""URL filters: gradient-boosted trees on lexical features, trained from labelled URLs, under host and path rules."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

Rule = tuple[str, str]  # (host/path, "allow" or "block")

FEATURES = ["n_chars", "n_host", "n_path", "depth", "digits", "entropy", "n_params", "n_dots", "n_hyphens", "fragment", "suffix_rate", "suffix_seen"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty where the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule whose host holds this host or a parent of it and whose path starts this path."""
    out = None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, suffix (the last two labels of the host) and the features of the url's text."""
    host, path = parts(F.col(url))
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c)))
    share = lambda c: (n - F.length(F.replace(text, c))) / n
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    df = df.withColumns({"host": host, "path": path})
    return df.withColumns({
        "suffix": F.regexp_extract("host", r"([^.]+\.)?[^.]*$", 0),
        "n_chars": n, "n_host": F.length("host"), "n_path": F.length("path"), "depth": count(F.col("path"), "/"),
        "digits": F.when(n > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "n_params": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "n_dots": count(F.col("host"), "."), "n_hyphens": count(F.col("host"), "-"), "fragment": F.instr(text, "#").cast("boolean").cast("int"),
    })


def _labelled(rows: DataFrame, rules: list[Rule], labelled: DataFrame | None) -> DataFrame:
    """(url, block) of all labelled urls: those given, or else the pages that a rule decides."""
    if labelled is not None:
        return labelled.where("url is not null and block is not null").select("url", F.col("block").cast("int").alias("block"))
    verdict = matching_rule(F.col("host"), F.col("path"), rules)["verdict"]
    return rows.withColumn("verdict", verdict).where("verdict is not null").select("url", (F.col("verdict") == "block").cast("int").alias("block"))


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, sample_rows: int = 20_000, trees: int = 20, depth: int = 4, threshold: float = 0.5, folds: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows of pages (page_id, url) with host, path, rule, verdict and score, the model's probability of "block".

    Labelled urls (url, block as 0 or 1) come from ``labelled``, or else are the pages that a rule decides.  Block rates of
    host suffixes are counted over all of them; the trees are fitted on at most ``sample_rows``, those with the smallest
    hash, each with the rate that the other ``folds`` - 1 parts of the labelled urls give its suffix, so that no url sees its
    own label.  A rule's verdict stands above the model's.  Without labelled urls the model allows everything; null and
    odd urls have empty parts and are judged by their text.  Repeated rows are judged alike.  An empty table gives no rows;
    columns other than the two read are ignored.
    """
    rows = lexical(pages.select("page_id", "url"))
    known = cut(lexical(_labelled(rows, rules, labelled)).select("url", "block", "suffix", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(folds)).alias("fold")))
    n, blocked = known.agg(F.count(F.lit(1)), F.sum("block")).first()
    score = F.lit(0.0)
    if n:
        prior = (blocked or 0) / n
        rate = lambda b, m: ((b + 10 * prior) / (m + 10)).alias("suffix_rate")
        parts = cut(known.groupBy("suffix", "fold").agg(F.sum("block").alias("b"), F.count(F.lit(1)).alias("m")))
        whole = cut(parts.groupBy("suffix").agg(F.sum("b").alias("b_all"), F.sum("m").alias("m_all")))
        gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
        sample = known.orderBy(F.xxhash64("url"), "url", "block").limit(sample_rows)
        others = parts.join(whole, "suffix").select("suffix", "fold", rate(F.col("b_all") - F.col("b"), F.col("m_all") - F.col("m")), (F.col("m_all") - F.col("m")).cast("int").alias("suffix_seen"))
        sample = F.broadcast(sample).join(others, ["suffix", "fold"]).drop("suffix")
        train = cut(gather.transform(lexical(sample)).select("features", F.col("block").cast("double").alias("label")).coalesce(1))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(train)
        rates = whole.select("suffix", rate(F.col("b_all"), F.col("m_all")), F.col("m_all").cast("int").alias("suffix_seen"))
        rates = F.broadcast(rates) if whole.count() <= broadcast_rows else rates
        rows = rows.join(rates, "suffix", "left").withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(prior)), "suffix_seen": F.coalesce("suffix_seen", F.lit(0))})
        rows = model.transform(gather.transform(rows))
        score = vector_to_array("probability")[1]
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", hit.alias("_hit"), score.alias("score"))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "url", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", own).alias("verdict"), "score")
