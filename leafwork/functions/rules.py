"""Predicates on texts and blocks as boolean Columns.

Callers that need several of them should first materialise ``is_caption`` and ``is_heading`` as columns and hand
them in: both stand inside other predicates.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import any_of
from .text import bound, find, has, lstrip, mentions, squeeze, strip

_label = "^(?:" + "|".join(fixed.CAPTION_LABELS) + ")"
_label_words = any_of(sorted({re.match(r"[^\W\d_]+", x)[0] for x in fixed.CAPTION_LABELS}))
_section = rf"^{any_of(fixed.SECTION_WORDS)}\b"
_lower = r"^\p{Ll}"


def is_caption(text: Column) -> Column:
    """A label of a figure, table, scheme, chart or box with a number up to 80, followed as a title is, not as a reference in a sentence."""
    opens = has(F.left(lstrip(text), F.lit(8)), f"^{_label_words}")  # few texts do; the others are not looked at further
    labelled = lambda t: bound(find(t, f"({_label})"), lambda label: (label != "") & bound(F.regexp_replace(F.substr(t, F.length(label) + 1), r"(?U)^\s+", ""), lambda rest: _titled(t, label, rest)))
    return opens & bound(squeeze(F.coalesce(text, F.lit(""))), labelled)


def _titled(text: Column, label: Column, rest: Column) -> Column:
    """Whether what follows the label of a text reads as a title."""
    roman = has(label, r"^Table\s+[IVXLCDM]+$")
    n = F.when(roman, 1).otherwise(F.coalesce(F.regexp_extract(label, r"(\d+)", 1).try_cast("int"), F.when(F.regexp_extract(label, r"(\d+)", 1) == "", 0).otherwise(1 << 30)))
    refused = has(rest, "^[),;]") | has(rest, r"^[a-z](?:[,)]|\b)", False) | has(rest, rf"^[.:]\s*{any_of(fixed.INLINE_REFERENCE_WORDS)}\b")
    accepted = has(rest, r"^[|:：]\s*\S") | has(rest, rf"^\.\s+{any_of(fixed.CAPTION_OPENERS)}\b") | has(rest, r"^[-–]\s*\S") | has(rest, "^[A-Z][A-Za-z0-9,()/ -]{8,}", False)
    return ~has(text, r"\b(?:Supplementary|Supporting)\s+(?:Fig|Figure|Table)\b") & (n <= fixed.CAPTION_MAX_NUMBER) & ~refused & accepted


def caption_kind(figure_id: Column) -> Column:
    return F.when(has(figure_id, r"^Table\b"), "table").when(has(figure_id, r"^(?:Scheme|Chart|Box)\b"), "graphic").otherwise("figure")


def section_word(text: Column) -> Column:
    """The known section name at the start of a text, in lower case; empty if none."""
    return F.lower(find(F.coalesce(text, F.lit("")), rf"^({'|'.join(fixed.SECTION_WORDS)})\b"))


def is_heading(text: Column, caption: Column) -> Column:
    """A section name that stands as a heading, a numbered one, or another known heading."""
    rest = lambda word: strip(F.substr(text, F.length(word) + 1))
    stands = lambda word: (rest(word) == "") | has(rest(word), r"^[:.\-–]") | word.isin(fixed.INLINE_HEADINGS)
    by_word = lambda word: ~word.isin(fixed.NEVER_HEADINGS) & stands(word)
    other = has(text, rf"^(?:\d+\.?|[IVXLCDM]+\.?)\s+{any_of(fixed.NUMBERED_HEADINGS)}\b") | has(text, rf"^{any_of(fixed.KNOWN_HEADINGS)}\.?\b")
    barred = caption | (F.coalesce(text, F.lit("")) == "") | has(text, _lower, False) | has(text, r"^(?:Supplementary|Supporting)\s+(?:Fig\.?|Figure|Table|Note|Information)\b")
    return ~barred & bound(section_word(text), lambda word: F.when(word != "", by_word(word)).otherwise(other))


def heading_level(text: Column, font: Column, bold: Column, body_font: Column, caption: Column, non_content: Column) -> Column:
    """0 for captions, the depth of a section number up to 3, 1 for roman numbers and section names, else by font."""
    number = F.regexp_extract(text, r"(?U)^(\d+(?:\.\d+)*)\s+", 1)
    ratio = F.when(body_font > 0, font / body_font)
    return (
        F.when(caption, 0)
        .when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(3)))
        .when(has(text, r"^[IVXLCDM]+\.\s+", False) | (section_word(text) != ""), 1)
        .when(ratio > 1.3, 1)
        .when(ratio > 1.1, 2)
        .when(F.coalesce(bold, F.lit(False)) & ~non_content, 1)
        .otherwise(0)
    )


def is_preview_noise(text: Column) -> Column:
    compact = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))
    opens = F.lower(F.left(lstrip(F.coalesce(text, F.lit(""))), F.lit(1))) == "a"
    return (opens & (compact == "ACCELERATEDARTICLEPREVIEW")) | has(text, "^" + any_of(fixed.PREVIEW_OPENERS))


def is_preview_banner(text: Column) -> Column:
    return has(text, fixed.PREVIEW_BANNER)


def is_non_content(text: Column, caption: Column, heading: Column) -> Column:
    """Boilerplate, running heads, numbers and other text that is not content (F7).  Words count wherever they stand."""
    bare = strip(F.coalesce(text, F.lit("")))
    noise = (
        is_preview_noise(text)
        | has(text, fixed.UPDATES)
        | mentions(text, fixed.BOILERPLATE)
        | reduce(Column.__or__, [has(bare, p, case) for p, case in fixed.RUNNING_HEADS])
        | ((F.length(bare) < 45) & has(bare, fixed.CAPITALS, False))
        | has(text, fixed.ISSN, False)
        | ((F.length(text) < 220) & has(text, fixed.DOI))
        | has(bare, r"^\d+$", False)
        | ((F.length(bare) < 40) & ~has(text, r"[A-Za-z一-鿿]", False))
        | ((F.length(text) < 18) & has(text, fixed.METADATA))
    )
    return ~caption & ~heading & noise


def is_author_line(text: Column) -> Column:
    """A line of names."""
    n, commas = F.length(text), F.length(text) - F.length(F.replace(text, F.lit(",")))
    listed = (commas >= 2) | has(text, r"\s&\s")
    too_long = (n > 650) | ((n > 350) & text.contains("."))
    other = has(text, fixed.DOI) | (section_word(text) != "") | has(text, rf"\b{any_of(fixed.NOT_AUTHORS)}\b")
    sentence = text.contains(".") & (n < 220) & ~listed
    return (text.contains(",") | text.contains("&")) & ~too_long & ~sentence & ~other & has(text, "[A-Z][a-z]+", False)


def is_preview_front(text: Column) -> Column:
    """Front matter of an early version: dates, citations, authors, affiliations."""
    return is_preview_noise(text) | has(text, rf"\b{any_of(fixed.PREVIEW_FRONT)}\b") | is_author_line(text) | has(text, rf"\b{any_of(fixed.AFFILIATIONS)}\b", False)


def is_margin(text: Column, box: Column, width: Column, height: Column) -> Column:
    """A short or narrow block in the top 7.5 % or below 93 % of the page."""
    return ((box["y1"] < height * 0.075) | (box["y0"] > height * 0.93)) & ((F.length(strip(text)) < 120) | (box["x1"] - box["x0"] < width * 0.35))


def is_watermark(text: Column, box: Column, width: Column, height: Column, font: Column, max_chars: int | None = None) -> Column:
    """A watermark word, or a large wide centred line (F10).  ``max_chars`` limits the words to short texts."""
    word = mentions(text, fixed.WATERMARKS)
    if max_chars:
        word = word & (F.length(text) <= max_chars)
    centred = (F.abs((box["x0"] + box["x1"]) / 2 - width / 2) < width * 0.15) & (F.abs((box["y0"] + box["y1"]) / 2 - height / 2) < height * 0.35)
    large = (box["x1"] - box["x0"] > width * 0.5) & centred & (F.coalesce(font, F.lit(0.0)) > 20) & (F.length(strip(text)) < 60)
    return word | large


def is_axis_label(text: Column) -> Column:
    """Under 55 characters without a sentence end or a common word."""
    return (F.length(text) < 55) & ~has(text, "[.!?]", False) & ~has(text, rf"\b{any_of(fixed.AXIS_STOP_WORDS)}\b")


def is_title_noise(text: Column) -> Column:
    return has(text, rf"^{any_of(fixed.TITLE_NOISE)}\b")


def is_journal(text: Column) -> Column:
    return (F.length(text) > 0) & (F.length(text) <= 100) & ~has(text, rf"\b{any_of(fixed.NOT_JOURNALS)}\b")


def skips_translation(text: Column) -> Column:
    """Blank, digits, short metadata or boilerplate."""
    text = squeeze(F.coalesce(text, F.lit("")))
    short = (F.length(text) < 25) & has(text, r"\b(?:article|doi|volume|issue|page)\b")
    return (text == "") | has(text, r"^\d+$", False) | short | mentions(text, fixed.UNTRANSLATED)


def is_stability_sentence(text: Column) -> Column:
    words, initial = fixed.STABILITY_SENTENCE
    return has(text, words) & has(text, initial)


def is_other_work(text: Column, page: Column) -> Column:
    """On the first two pages, efficiencies that others have reported."""
    before, after = fixed.OTHERS_EFFICIENCY
    return (page <= 2) & (has(text, before) | has(text, after))


def is_retention(text: Column) -> Column:
    """A share of the initial efficiency that was kept, not an efficiency."""
    return has(text, fixed.RETENTION)


def is_environment(text: Column) -> Column:
    return has(text, fixed.ENVIRONMENT) & ~has(text, r"\bPCE\b")


def is_finding(text: Column) -> Column:
    """60 to 500 characters that claim something, with a word of result or a number with a unit."""
    claim = has(text, "|".join(fixed.FINDINGS))
    result = has(text, rf"\b{any_of(fixed.RESULT_WORDS)}\b") | has(text, rf"{fixed.NUMBER}\s*{any_of(fixed.FINDING_UNITS)}", False)
    return F.length(text).between(60, 500) & claim & result


def is_innovation(text: Column) -> Column:
    """50 to 500 characters in which the authors say what they did."""
    return F.length(text).between(50, 500) & has(text, "|".join(fixed.INNOVATIONS))


def in_sections(title: Column, names: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(title), n))


def is_method_section(title: Column) -> Column:
    return in_sections(title, fixed.METHOD_SECTIONS)


def is_result_section(title: Column) -> Column:
    return in_sections(title, fixed.RESULT_SECTIONS)


def is_references(title: Column) -> Column:
    return has(title, rf"^{any_of(fixed.REFERENCE_HEADINGS)}\b")


def starts_subheading(text: Column, more_nouns: list[str] = (), more_starters: list[str] = (), ascii_words: bool = False) -> Column:
    """2 to 14 words that look like a subheading: no sentence, and numbered, with a technical noun, or in title case."""
    words = F.split(strip(text), r"(?U)\s+")
    n = F.size(words)
    barred = (strip(text) == "") | has(text, _lower, False) | has(text, r"[.!?。！？]$", False) | has(text, rf"^{any_of([*fixed.SENTENCE_STARTERS, *more_starters])}\b", False, ascii_words)
    titled = (n <= 6) & has(F.get(words, F.lit(0)), "^[A-Z]", False) & has(F.get(words, n - 1), "^[A-Z]", False)
    titled = titled & (F.size(F.filter(words, lambda w: (F.length(w) > 2) & w.rlike("^[A-Za-z]"))) >= 2)
    named = has(text, rf"^\d+(?:\.\d+)*\s+[A-Z]", False) | has(text, rf"{any_of([*fixed.TECHNICAL_NOUNS, *more_nouns])}\b", True, ascii_words)
    return ~barred & n.between(2, 14) & (named | titled)


ABSTRACT_CHARS = 120


def is_duplicate_abstract(text: Column, abstract: Column) -> Column:
    """A text over 120 characters that stands in the abstract or begins as it does."""
    return stands_in_abstract(squeeze(text), squeeze(abstract))


def stands_in_abstract(t: Column, a: Column) -> Column:
    """The same of texts whose white space is single spaces; short texts are not looked for."""
    n = ABSTRACT_CHARS
    return F.coalesce((F.length(t) > n) & (a != "") & (F.startswith(a, F.left(t, F.lit(n))) | F.startswith(t, F.left(a, F.lit(n))) | F.contains(a, t)), F.lit(False))


def split_inline_heading(text: Column) -> Column:
    """Struct (title, rest): a known heading or a leading technical noun phrase, and what follows; else (text, "")."""
    pick = lambda p, case=True: F.struct(find(text, p, 1, case).alias("title"), strip(find(text, p, 2, case)).alias("rest"))
    whole = F.struct(text.alias("title"), F.lit("").alias("rest"))
    stop = fixed.SECTION_WORDS.index("Appendix") + 1
    section = rf"^(Results and discussion|{'|'.join(fixed.SECTION_WORDS[:stop])})\b[:.\s-]*(.*)$"
    more = rf"^({'|'.join(fixed.SPLIT_HEADINGS)})\b[.:]?\s*(.*)$"
    nouns = [*[n for n in fixed.TECHNICAL_NOUNS if n not in ("filling", "effect")], *fixed.HEADING_ABBREVIATIONS]
    noun = rf"^([A-Z][A-Za-z0-9\-–\s]{{15,100}}?{any_of(nouns)})\s*({any_of(fixed.BODY_STARTERS)}.*)$"
    named = pick("(?s)" + noun, False)
    fits = has(text, "(?s)" + noun, False) & (F.size(F.split(strip(named["title"]), r"(?U)\s+")) <= 12) & (F.length(named["rest"]) > 30)
    return (
        F.when(has(text, section), F.when(F.lower(find(text, section)) == "supplementary", whole).otherwise(pick(section)))
        .when(has(text, more), pick(more))
        .when(fits, F.struct(strip(named["title"]).alias("title"), named["rest"].alias("rest")))
        .otherwise(whole)
    )


def split_embedded_heading(text: Column) -> Column:
    """Struct (before, title, after) around ". Known Heading. " within a text; null if there is none or both sides are short (X11)."""
    p = rf"(?s)^(.*?\.)\s+({'|'.join(fixed.EMBEDDED_HEADINGS)})\.\s+(.*)$"
    out = F.struct(strip(find(text, p, 1)).alias("before"), find(text, p, 2).alias("title"), strip(find(text, p, 3)).alias("after"))
    return F.when(text.contains(".") & has(text, p) & ((F.length(out["before"]) >= 40) | (F.length(out["after"]) >= 40)), out)
