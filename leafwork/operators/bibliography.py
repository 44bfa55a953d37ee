"""Bibliographic data of a document: identifier, title, abstract, authors and publication.

Publication data come from an ordered table of rules.  Each rule is a pattern over the first pages with the fields
that its groups fill; it either fills only empty fields or overwrites.  The table is folded into one expression per
field, so the whole cascade is a projection over one row per document.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import any_of
from ..functions import rules, text as T
from ..functions.text import find, has, nullif, rx, squeeze, strip

FIELDS = ["journal", "volume", "issue", "pages", "year"]
EMPTY = ""


@dataclass(frozen=True)
class Rule:
    """A pattern with the number of the group for each field; ``constants`` set a field whatever the text says."""

    name: str
    pattern: str
    groups: dict[str, int]
    overwrite: bool = False
    ignore_case: bool = True
    source: str = "text"
    constants: dict[str, str] = field(default_factory=dict)
    check_journal: bool = False
    unless_set: tuple[str, ...] = ()  # skipped when all of these are set
    clear_others: bool = False
    words: tuple[tuple[str, ...], ...] = ()  # every match holds a word of each of these, in lower case


# Citation styles, in order (RULES, PIPES and LATER).
_year, _vol, _page, _name = fixed.YEAR, fixed.VOLUME, fixed.PAGES, fixed.NAME
_both = ("journal", "year")
RULES = [
    Rule("subject", rf"^([A-Z][A-Za-z &]+)\s+{_year}\.{_vol}:(\d+(?:[-–]\d+)?)", {"journal": 1, "year": 2, "volume": 3, "pages": 4}, ignore_case=False, source="subject"),
    Rule("cite_as", rf"Cite this article as:.{{0,260}}?\b(Nature)\s+https?://doi\.org/\S+.*?\b{_year}\b", {"journal": 1, "year": 2}, overwrite=True, words=(("cite this article as:",), ("doi.org",))),
    Rule("head_vol_no", rf"\b(IEEE\s+[A-Z][A-Z0-9 &/\-]+?)\s*,?\s+VOL\.?\s*{_vol}(?:\s*,?\s+NO\.?\s*{_vol})?.{{0,80}}?\b{_year}\b", {"journal": 1, "volume": 2, "issue": 3, "year": 4}, overwrite=True, clear_others=True, words=(("ieee",), ("vol",))),
    Rule("name_vol_year_pages", rf"{_name}\s+(\d{{1,4}}[A-Za-z]?)\s*\({_year}\)\s*{_page}", {"journal": 1, "volume": 2, "year": 3, "pages": 4}, check_journal=True, unless_set=_both, words=(("(",),)),
    Rule("name_comma_year", rf"{_name},\s*{_year},\s*(\d{{1,4}}[A-Za-z]?)\s*,\s*([A-Za-z]?\d+(?:[-−–]\d+)?|[A-Za-z]\d{{4,}})", {"journal": 1, "year": 2, "volume": 3, "pages": 4}, check_journal=True, unless_set=_both, words=((",",),)),
    Rule("name_year_vol", rf"{_name}\s+{_year},\s*(\d{{1,4}}[A-Za-z]?)\s*,\s*([A-Za-z]?\d+(?:[-−–]\d+)?|[A-Za-z]\d{{4,}})", {"journal": 1, "year": 2, "volume": 3, "pages": 4}, check_journal=True, unless_set=_both, words=((",",),)),
    Rule("short_name_year", rf"(Adv(?:anced)?\.?\s+[A-Za-z &]+|Angew(?:andte)?\.?\s+[A-Za-z &]+|Small|Solar RRL)\s*,?\s*{_year}\s*,\s*(\d{{1,4}}[A-Za-z]?)\s*,\s*{_page}", {"journal": 1, "year": 2, "volume": 3, "pages": 4}, check_journal=True, unless_set=_both, words=(("adv", "angew", "small", "solar rrl"), (",",))),
    Rule("vol_no_pp", rf"(IEEE\s+[A-Z][A-Za-z. &/]+?),\s*vol\.?\s*{_vol}(?:,\s*no\.?\s*{_vol})?(?:,\s*(?:pp?\.?\s*)?([A-Za-z]?\d+(?:[-–]\d+)?))?,?\s*(?:[A-Z][a-z]{{2,8}}\.?)?\s*{_year}", {"journal": 1, "volume": 2, "issue": 3, "pages": 4, "year": 5}, check_journal=True, unless_set=_both, words=(("ieee",), ("vol",))),
    Rule("review", rf"(Phys(?:ical)?\.?\s*Rev(?:iew)?\.?\s*[A-Za-z &]+?)\s+{_vol}\s*,\s*([A-Za-z]?\d+)\s*\({_year}\)", {"journal": 1, "volume": 2, "pages": 3, "year": 4}, check_journal=True, unless_set=_both, words=(("phys",), ("rev",), ("(",))),
]
_piped = r"([A-Z][A-Za-z0-9 &+\-]+?)\s*\|\s*\(?((?:19|20)\d{2})\)?\s*"
_end = r"\s*[:;,]\s*([A-Za-z]?\d+(?:[-–]\d+)?)"
PIPES = [
    (rf"{_piped}\|\s*{_vol}\s*(?:\(([^)]+)\))?{_end}", {"journal": 1, "year": 2, "volume": 3, "issue": 4, "pages": 5}),
    (rf"{_piped}{_vol}{_end}", {"journal": 1, "year": 2, "volume": 3, "pages": 4}),
    (rf"([A-Z][A-Za-z0-9 &+\-]{{3,80}}?)\s+\(?{_year}\)?\s+{_vol}\s*(?:\(([^)]+)\))?{_end}", {"journal": 1, "year": 2, "volume": 3, "issue": 4, "pages": 5}),
]
LATER = [
    Rule("letters", rf"\bACS Energy Lett\.\s*{_year},\s*(\d+),\s*{_page}", {"year": 1, "volume": 2, "pages": 3}, overwrite=True, constants={"journal": "ACS Energy Letters"}, words=(("acs energy lett",),)),
    Rule("commun", rf"\bNat(?:ure)?\s+Commun(?:ications)?\s*\({_year}\)", {"year": 1}, overwrite=True, constants={"journal": "Nature Communications"}, words=(("nat",), ("commun",), ("(",))),
    Rule("review_again", rf"\b(Phys(?:ical)?\.?\s*Rev(?:iew)?\.?\s*[A-Za-z]+|[A-Z][a-z]+\.?\s*Rev\.?\s*[A-Za-z]+)\s+{_vol}\s*,\s*([A-Za-z]?\d+)\s*\({_year}\)", {"journal": 1, "volume": 2, "pages": 3, "year": 4}, unless_set=("journal", "volume"), words=(("rev",), ("(",))),
]


def _tidy(x: Column) -> Column:
    return F.translate(strip(x, " .,:;|"), "−–", "--")


def _holding(words: tuple[tuple[str, ...], ...], found: Column) -> Column:
    """What a search finds, but for texts without the words that each of its matches holds: those are not searched."""
    if not words:
        return found
    return F.when(reduce(Column.__and__, [reduce(Column.__or__, [F.contains("_low", F.lit(w)) for w in ws]) for ws in words]), found).otherwise(EMPTY)


def _apply(df: DataFrame, rule: Rule) -> DataFrame:
    """Search for the rule's pattern once; hits and groups are then read from the short text that it matched."""
    df = df.withColumn("_m", _holding(rule.words, find(F.col(rule.source), rule.pattern, 0, rule.ignore_case)))
    group = lambda g: find(F.col("_m"), rule.pattern, g, rule.ignore_case)
    hit = F.col("_m") != EMPTY
    got = {f: _tidy(group(g)) for f, g in rule.groups.items()}
    if rule.check_journal:
        hit = hit & rules.is_journal(group(rule.groups["journal"]))
    if rule.unless_set:
        hit = hit & (F.greatest(*[(F.col(f) == EMPTY).cast("int") for f in rule.unless_set]) == 1)
    got |= {f: F.lit(v) for f, v in rule.constants.items()}
    if rule.clear_others:
        got = {f: got.get(f, F.lit(EMPTY)) for f in FIELDS}
    out = {f: F.when(hit if rule.overwrite else hit & (F.col(f) == EMPTY), v).otherwise(F.col(f)) for f, v in got.items()}
    if "journal" in out and "journal" not in rule.constants:
        out["journal"] = F.when(hit, T.clean_journal(out["journal"])).otherwise(F.col("journal"))
    return df.withColumns(out).drop("_m")


def publication(pages: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, journal, volume, issue, pages, year) from the text of the first four pages.

    ``pages``: (doc_id, page, text).  ``metadata``: (doc_id, subject).  Fields that nothing fills are empty.
    """
    texts = pages.where("page <= 4").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    df = texts.select("doc_id", squeeze(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("text"))
    df = df.withColumn("_low", T.folded(F.col("text")))
    if metadata is not None:
        df = df.join(metadata.select("doc_id", "subject"), "doc_id", "left")
        df = df.withColumn("subject", F.coalesce("subject", F.lit("")))
    else:
        df = df.withColumn("subject", F.lit(""))
    df = df.withColumns({f: F.lit(EMPTY) for f in FIELDS})
    for rule in RULES:
        df = _apply(df, rule)
    df = df.withColumns({f"_p{n}": _holding((("|",),) if n < 2 else ((":", ";", ","),), find(F.col("text"), p, 0, False)) for n, (p, _) in enumerate(PIPES)})
    pick = lambda f: F.coalesce(*[F.when(F.col(f"_p{n}") != EMPTY, strip(find(F.col(f"_p{n}"), p, g[f], False), " .,:;|") if f in g else F.lit(EMPTY)) for n, (p, g) in enumerate(PIPES)], F.col(f))
    df = df.withColumns({f: T.clean_journal(pick(f)) if f == "journal" else pick(f) for f in FIELDS}).drop(*[f"_p{n}" for n in range(len(PIPES))])
    known = find(F.col("text"), rf"\b({'|'.join(fixed.JOURNALS)})\b")
    df = df.withColumn("journal", F.when(F.col("journal") == EMPTY, T.clean_journal(known)).otherwise(F.col("journal")))
    for rule in LATER:
        df = _apply(df, rule)
    t = F.col("text")
    vol_issue = fixed.VOLUME_AND_ISSUE
    df = df.withColumn("_m", F.when(F.col("volume") == EMPTY, _holding((("(",),), find(t, vol_issue, 0))).otherwise(EMPTY))
    m, hit = F.col("_m"), F.col("_m") != EMPTY
    issue = strip(find(m, vol_issue, 2))
    df = df.withColumns({
        "volume": F.when(hit, find(m, vol_issue, 1)).otherwise(F.col("volume")),
        "issue": F.when(hit, F.when(has(issue, fixed.NOT_ISSUES_IN_BRACKETS), EMPTY).otherwise(issue)).otherwise(F.col("issue")),
        "pages": F.when(hit, _tidy(find(m, vol_issue, 3))).otherwise(F.col("pages")),
    }).drop("_m")
    fill = lambda f, value: F.when(F.col(f) == EMPTY, value).otherwise(F.col(f))
    df = df.withColumn("volume", fill("volume", _holding((("vol",),), find(t, fixed.VOLUME_WORD))))
    number = _holding((("issue", "no"),), find(t, fixed.ISSUE_WORD))
    df = df.withColumn("issue", fill("issue", F.when(has(number, fixed.NOT_ISSUES), EMPTY).otherwise(number)))
    df = df.withColumn("pages", fill("pages", _tidy(find(t, fixed.PAGES_WORD))))
    piped = fixed.PIPED_PAGES
    df = df.withColumn("_m", F.when(F.col("pages") == EMPTY, _holding((("|",),), find(t, piped, 0))).otherwise(EMPTY))
    df = df.withColumns({f: F.when(hit & (F.col(f) == EMPTY), _tidy(find(m, piped, g))).otherwise(F.col(f)) for f, g in (("year", 1), ("volume", 2), ("pages", 3))}).drop("_m")
    said = _holding((("published", "copyright", "cite this"),), find(t, fixed.PUBLISHED_YEAR))
    year = F.coalesce(nullif(said), nullif(_holding((("accepted:",),), find(t, fixed.ACCEPTED_YEAR))), find(t, rf"\b{_year}\b"))
    return df.withColumn("year", fill("year", year)).select("doc_id", *FIELDS)


def doi(pages: DataFrame) -> DataFrame:
    """(doc_id, doi): the first on page one, else the last in the document, repositories only if there is no other."""
    found = pages.select("doc_id", "page", F.posexplode(F.regexp_extract_all("text", F.lit(rx(fixed.DOI)), F.lit(0))).alias("pos", "doi"))
    at, repository = F.struct("page", "pos"), has(F.col("doi"), any_of(fixed.REPOSITORIES))
    out = found.groupBy("doc_id").agg(F.min_by("doi", F.when(F.col("page") == 1, at)).alias("a"), F.max_by("doi", F.when(~repository, at)).alias("b"), F.max_by("doi", at).alias("c"))
    return out.select("doc_id", F.coalesce("a", "b", "c").alias("doi"))


def labelled_abstract(pages: DataFrame) -> DataFrame:
    """(doc_id, abstract): the longest text of 120 characters or more between "Abstract" and the next heading, first eight pages."""
    texts = pages.where("page <= 8").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    flat = squeeze(F.array_join(F.transform("p", lambda x: x["text"]), "\n"))
    found = F.regexp_extract_all(flat, F.lit(rx(fixed.LABELLED_ABSTRACT)), F.lit(1))
    found = F.filter(F.transform(found, lambda x: strip(squeeze(x), " .:-—")), lambda x: (F.length(x) >= 120) & ~has(x, fixed.NOT_ABSTRACTS))
    longest = F.aggregate(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return texts.select("doc_id", longest.alias("abstract"))


def layout_abstract(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, abstract): the topmost long column paragraph on page one that is neither title nor authors."""
    rows = paragraphs.join(titles.select("doc_id", "title"), "doc_id", "left")
    t, b = F.col("text"), F.col("box")
    fits = (F.length(t) >= 180) & b["y0"].between(180, 460) & (b["x1"] - b["x0"] <= 380) & (b["x0"] >= 5) & (b["x1"] <= 590)
    other = has(F.left(t, F.lit(1)), r"^\p{Ll}", False) | rules.is_author_line(t) | rules.is_preview_noise(t) | rules.split_embedded_heading(t).isNotNull()
    rows = rows.where((F.col("page") == 1) & (F.col("kind") != "non_content") & (t != F.coalesce("title", F.lit(""))) & fits & ~other)
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct("box.y0", "box.x0", "seq")).alias("abstract"))


def title(paragraphs: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, title): in the first twelve paragraphs, the text after a DOI or the first that reads as a title; else the file's own."""
    rows = paragraphs.where("seq <= 12")
    t = F.col("text")
    after = T.clean_title(F.substr(t, F.instr(t, find(t, fixed.DOI, 0)) + F.length(find(t, fixed.DOI, 0))))
    by_doi = has(t, fixed.DOI) & (F.length(t) > F.instr(t, find(t, fixed.DOI, 0)) - 1 + F.length(find(t, fixed.DOI, 0)) + 20) & (after != "")
    # Columns of their own: else each of the many tests that look at them would clean the title anew.
    rows = rows.withColumn("_own", T.clean_title(t))
    own = F.col("_own")
    rows = rows.withColumn("_caption", (F.length(own) > 20) & (F.length(own) < 260) & rules.is_caption(own))
    caption = F.col("_caption")
    reads = (F.length(own) > 20) & (F.length(own) < 260) & ~rules.is_title_noise(own) & ~has(own, fixed.DOI) & (rules.section_word(own) == "") & ~rules.is_non_content(own, caption, rules.is_heading(own, caption))
    rows = rows.withColumn("c", F.when(by_doi, after).when(reads, own))
    out = rows.groupBy("doc_id").agg(F.min_by("c", F.when(F.col("c").isNotNull(), F.col("seq"))).alias("title"))
    if metadata is not None:
        out = out.join(metadata.select("doc_id", T.clean_title(F.coalesce("title", F.lit(""))).alias("m")), "doc_id", "left")
        usable = (F.length("m") > 20) & (F.length("m") < 260) & ~rules.is_title_noise(F.col("m")) & ~has(F.col("m"), fixed.DOI)
        poor = F.col("title").isNull() | rules.is_title_noise(F.col("title"))
        out = out.withColumn("title", F.when(poor & usable, F.col("m")).otherwise(F.col("title"))).drop("m")
    return out.withColumn("title", F.coalesce("title", F.lit("")))


def authors(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, authors): names of the first author line after the title, high on page one."""
    rows = paragraphs.where("seq <= 20 and page = 1").where(F.coalesce(F.col("box.y0") <= 430, F.lit(True))).join(titles.select("doc_id", "title"), "doc_id").where("title <> ''")
    t = F.col("text")
    is_title = (t == F.col("title")) | (T.clean_title(t) == F.col("title")) | (F.contains(t, F.col("title")) & has(t, fixed.DOI))
    seen = F.max(is_title | F.coalesce(F.col("box.y0") > 120, F.lit(False))).over(Window.partitionBy("doc_id").orderBy("seq"))
    rows = rows.withColumn("ok", seen & ~is_title & rules.is_author_line(t)).where("ok")
    line = rows.groupBy("doc_id").agg(F.min_by("text", "seq").alias("line"))
    return line.select("doc_id", T.author_names(T.author_marks_removed(F.col("line"))).alias("authors"))


def preview_abstract(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, abstract) of early versions: topical paragraphs of pages 2 to 4, gathered until they end."""
    topic, other = fixed.PREVIEW_TOPIC, fixed.PREVIEW_OTHER
    rows = paragraphs.where("page between 2 and 4 and kind <> 'non_content' and text <> ''").join(titles.select("doc_id", "title"), "doc_id", "left")
    t = F.col("text")
    rows = rows.where((t != F.coalesce("title", F.lit(""))) & ~rules.is_preview_noise(t) & ~rules.is_author_line(t) & ~has(t, r"^\d+\s") & ~has(t, fixed.PREVIEW_CONTACTS))
    item = F.struct("seq", "text", (has(t, topic) & ~has(t, other)).alias("starts"), has(t, other).alias("other"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("ps"))
    state = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(s, p):
        begun = s["text"] != ""
        stop = s["done"] | (begun & p["other"] & (F.length(s["text"]) > 300))
        both = F.concat_ws(" ", F.when(begun, s["text"]), p["text"])
        full = ((F.length(both) > 300) & has(both, fixed.PREVIEW_LAST_WORDS)) | ((F.length(both) > 900) & has(both, r"\.\s*$"))
        takes = ~stop & (begun | p["starts"])
        return F.struct(F.when(takes, both).otherwise(s["text"]).alias("text"), (stop | (takes & full)).alias("done"))

    text = squeeze(F.aggregate("ps", state, step, lambda s: s["text"]))
    return docs.select("doc_id", F.when(F.length(text) > 250, text).otherwise("").alias("abstract"))


def paper_info(pages: DataFrame, paragraphs: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row per document: title, authors, doi, publication fields and abstract.

    ``metadata``: (doc_id, title, subject, author) of the files; its author stands in where no author line is found (S4).  The
    abstract is the labelled one, else, in early versions, that of the manuscript, else the layout's; a label over
    the noise of an early version does not count (W10).
    """
    docs = pages.select("doc_id").distinct()
    titles = title(paragraphs, metadata)
    out = docs.join(titles, "doc_id", "left").join(authors(paragraphs, titles), "doc_id", "left").join(doi(pages), "doc_id", "left").join(publication(pages, metadata), "doc_id", "left")
    out = out.join(labelled_abstract(pages).withColumnRenamed("abstract", "a1"), "doc_id", "left").join(layout_abstract(paragraphs, titles).withColumnRenamed("abstract", "a3"), "doc_id", "left")
    labelled, early = nullif(F.col("a1")), F.lit(None).cast("string")
    if "preview" in paragraphs.columns:
        out = out.join(preview_abstract(paragraphs.where("preview"), titles).select("doc_id", F.col("abstract").alias("a2")), "doc_id", "left")
        out = out.join(paragraphs.where("preview").select("doc_id", F.lit(True).alias("is_early")).distinct(), "doc_id", "left")
        labelled = F.when(~(F.coalesce("is_early", F.lit(False)) & rules.is_preview_noise(F.col("a1"))), labelled)
        early = nullif(F.col("a2"))
    names = F.coalesce("authors", F.array().cast("array<string>"))
    if metadata is not None and "author" in metadata.columns:
        out = out.join(metadata.select("doc_id", F.col("author").alias("own")), "doc_id", "left")
        names = F.when(F.size(names) > 0, names).otherwise(T.author_names(F.col("own")))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("doc_id", text("title"), names.alias("authors"), text("doi"), *map(text, FIELDS), F.coalesce(labelled, early, F.col("a3"), F.lit("")).alias("abstract"))
