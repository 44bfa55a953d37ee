"""Scalar text functions as Columns; all of them stay in whole-stage code generation or higher-order functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import any_of


_ASCII_WORD = "[0-9A-Za-z_]"


def rx(pattern: str, ignore_case: bool = True, ascii_words: bool = False) -> str:
    """A pattern with Unicode classes, as the document model reads them; ``ascii_words``: classes and ends of words are ASCII's, as in SQL,
    so that a word also ends before or after a letter with an accent.  There, \\b opens the pattern or closes a word in it."""
    if ascii_words:
        opened = re.sub(r"^\\b", f"(?<!{_ASCII_WORD})", pattern)
        return ("(?iu)" if ignore_case else "") + opened.replace(r"\b", f"(?!{_ASCII_WORD})")
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def has(text: Column, pattern: str, ignore_case: bool = True, ascii_words: bool = False) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rx(pattern, ignore_case, ascii_words))


def folded(text: Column) -> Column:
    """A text in lower case, with the two letters that a pattern without case takes for s and i."""
    return F.lower(F.replace(F.replace(text, F.lit("ſ"), F.lit("s")), F.lit("İ"), F.lit("i")))


def find(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    return F.regexp_extract(text, rx(pattern, ignore_case), group)


def sub(text: Column, pattern: str, by: str = "", ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, rx(pattern, ignore_case), by)


#: White space, for trimming.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What is not yet single spaces: runs, or one white space other than a space.  Plain prose has few of either.
LOOSE = r"(?U)\s{2,}|[^\S ]"
LOOSE_IN_LINE = r"(?U)[^\S\n]{2,}|[^\S\n ]"


def strip(text: Column, chars: str = SPACES) -> Column:
    return F.btrim(text, F.lit(chars))


def lstrip(text: Column, chars: str = SPACES) -> Column:
    return F.ltrim(text, F.lit(chars))


def rstrip(text: Column, chars: str = SPACES) -> Column:
    return F.rtrim(text, F.lit(chars))


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, LOOSE, " "))


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def core(pattern: str) -> str:
    """The longest text that every match of a plain pattern holds; empty where its syntax is more than escapes, ends of words and optional letters."""
    bare = re.sub(r"\\b|[^\\]\?", "\0", pattern)
    if re.search(r"(?<!\\)\.", bare):
        return ""
    bare = bare.replace("\\.", ".")
    return "" if set(bare) & set("\\?[](){}|*+^$") else max(bare.split("\0"), key=len)


def mentions(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands anywhere, whatever its case.  Plain words are found as substrings; only entries with
    pattern syntax cost a regular expression."""
    plain = [w.lower() for w in words if not set(w) & set("\\?[](){}|*+^$.")]
    patterns = [w for w in words if set(w) & set("\\?[](){}|*+^$.")]
    tests = [lambda t, w=w: F.contains(t, F.lit(w)) for w in plain]
    if patterns:
        # Searched only where the text holds what a match must hold, or a letter that a pattern without case takes for another.
        cores = [core(p.lower()) for p in patterns]
        gate = ["ſ", "ı", *cores] if all(cores) else [""]
        tests.append(lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in gate]) & t.rlike(rx(any_of(patterns))))
    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda t: reduce(Column.__or__, [f(t) for f in tests]))


def line_keys(text: Column) -> Column:
    """The keys of a text's lines as an array: lower case, white space as single spaces."""
    flat = F.regexp_replace(F.lower(text), LOOSE_IN_LINE, " ")
    return F.transform(F.split(flat, "\n"), lambda line: F.trim(line))


def nullif(text: Column) -> Column:
    return F.when(text != "", text)


def clean_text(text: Column, line_numbers: Column | bool = False) -> Column:
    """Text of a layout block: ligatures, units, broken words and lines put right."""
    for old, new in fixed.LIGATURES.items():
        if len(new) > 1 or new in " -":
            text = F.replace(text, F.lit(old), F.lit(new))
    text = F.translate(F.replace(text, F.lit("\xad"), F.lit("")), "ðÞ", "()")
    text = sub(text, r"ffiffi(?:ffi)*\s*([A-Za-z0-9]+)\s*p", "sqrt($1)", False)
    text = sub(text, r"(?<=\d)(" + "|".join(fixed.UNITS_AFTER_DIGIT) + ")", " $1", False)
    text = F.regexp_replace(text, r"-\n(?=[a-z])", "")
    numbered = F.regexp_replace(text, r"(?Um)\s+\d{1,4}\s*$", "")
    if line_numbers is True:
        text = numbered
    elif line_numbers is not False:
        text = F.when(line_numbers, numbered).otherwise(text)
    return squeeze(text)


def repeat_key(text: Column) -> Column:
    return squeeze(F.lower(text))


def fuzzy_key(text: Column) -> Column:
    """A running head without the numbers at its ends."""
    text = sub(strip(text), r"\s*\d+\s*$")
    return F.lower(squeeze(sub(text, r"^\d+\s*")))


def clean_title(text: Column) -> Column:
    text = strip(squeeze(text), " .;:-")
    text = strip(sub(text, rf"^{any_of(fixed.TITLE_PREFIXES)}\b[:.\s-]*"))
    text = strip(sub(text, r"^Nature Communications Article in Press\b[:.\s-]*"))
    return strip(sub(text, rf"^{any_of(fixed.TITLE_BANNERS)}\s*(?=[A-Z])", "", False))


def clean_journal(text: Column) -> Column:
    text = strip(squeeze(F.coalesce(text, F.lit(""))), " .,:;|")
    text = strip(sub(text, r"^(?:Cite This:|Original Article|Research Article|Article)\s*"))
    alias = F.create_map(*[F.lit(x) for pair in fixed.JOURNAL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(alias, F.lower(text)), text)


def author_names(text: Column) -> Column:
    """At most 40 names of 2 to 79 characters."""
    text = strip(squeeze(F.coalesce(text, F.lit(""))), " ,;")
    text = F.replace(sub(text, r"\s+(?:and|&)\s+", ", ", False), F.lit(";"), F.lit(","))
    names = F.transform(F.split(text, ","), lambda n: strip(n, " ,;"))
    return F.slice(F.filter(names, lambda n: (F.length(n) > 1) & (F.length(n) < 80)), 1, 40)


def author_marks_removed(text: Column) -> Column:
    """An author line without affiliation numbers and signs."""
    text = sub(text, r"(?<=[A-Za-z])\d+(?:,\d+)*", "", False)
    text = sub(text, r"\b\d+(?:,\d+)*\b", "", False)
    return strip(squeeze(F.regexp_replace(text, "[*†‡§]", "")), " ,;")


def figure_id(text: Column) -> Column:
    """The label of a caption, with Figure written as Fig."""
    label = find(squeeze(text), "^(" + "|".join(fixed.CAPTION_LABELS) + ")")
    return squeeze(sub(label, r"\bFigure\b", "Fig."))


def ref_key(figure: Column, compat: bool = False) -> Column:
    """``fig.N``, ``extendeddatafig.N`` or ``table.N``; without a number, the id in lower case without spaces.

    ``compat`` gives tables the key of the figure with their number.
    """
    number = F.regexp_extract(figure, r"(\d+)", 1)
    kind = F.when(has(figure, r"Extended\s+Data"), "extendeddatafig.")
    if not compat:
        kind = kind.when(has(figure, r"^\s*Table\b"), "table.")
    return F.when(number == "", F.replace(F.lower(figure), F.lit(" "), F.lit(""))).otherwise(F.concat(kind.otherwise("fig."), number))


def figure_key(figure: Column, page: Column) -> Column:
    return F.concat(F.lower(figure), F.lit("@"), page.cast("string"))


def figure_refs(text: Column) -> Column:
    """Keys of the figures that a text refers to: extended data first, then by the order of each spelling, without repeats."""
    low = F.lower(text)
    none = F.array().cast("array<string>")
    gated = lambda kind, word, pattern: F.when(F.contains(low, F.lit(word)), F.transform(F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(1)), lambda n: F.concat(F.lit(kind), n))).otherwise(none)
    found = F.concat(*[gated(k, w, p) for k, w, p in fixed.FIGURE_REFERENCES])
    return F.when(F.contains(low, F.lit("fig")) | F.contains(text, F.lit("图")), F.array_distinct(found)).otherwise(F.when(text.isNotNull(), none))


def operator_number(text: Column) -> Column:
    """Struct (op, value) of the first number and the sign before it; ≈ is written ~."""
    pattern = r"([>~<≈≥≤])?\s*(\d+(?:\.\d+)?)"
    op = F.regexp_extract(text, pattern, 1)
    return F.struct(F.replace(op, F.lit("≈"), F.lit("~")).alias("op"), F.regexp_extract(text, pattern, 2).try_cast("double").alias("value"))


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def temperature(text: Column) -> Column:
    return find(text, rf"({fixed.NUMBER})\s*°?\s*C", 1, False).try_cast("double")


def humidity(text: Column) -> Column:
    return find(text, rf"({fixed.NUMBER})\s*%\s*RH").try_cast("double")


def role(text: Column) -> Column:
    return F.when(has(text, r"\b(?:control|reference)\b"), "control").when(has(text, r"\b(?:target|modified|treated)\b"), "target").otherwise("unknown")


def test_type(text: Column, whole_words: bool = False) -> Column:
    """Kind of a stability test.  ``whole_words`` keeps "slight" from counting as light."""
    low = F.lower(text)
    any_in = lambda *words: reduce(Column.__or__, [has(low, rf"\b{w}") if whole_words else low.contains(w) for w in words])
    reverse = low.contains("reverse") & any_in("bias", "breakdown")
    return F.when(low.contains("mpp"), "MPP").when(any_in("thermal", "heat", "damp"), "thermal").when(reverse, "reverse_bias").when(any_in("light", "illumination", "uv"), "illumination").otherwise("other")


def method_name(text: Column) -> Column:
    low, out = F.lower(text), None
    for word, label in fixed.METHOD_LABELS:
        out = F.when(low.contains(word), label) if out is None else out.when(low.contains(word), label)
    return out.otherwise(fixed.METHOD_DEFAULT)


def glossary_replace(text: Column, glossary: dict[str, str] | None = None) -> Column:
    """Every term by its translation, longest terms first, whatever their case."""
    for term, by in sorted((fixed.GLOSSARY if glossary is None else glossary).items(), key=lambda t: -len(t[0])):
        text = F.regexp_replace(text, "(?iu)" + re.escape(term), by.replace("\\", r"\\").replace("$", r"\$"))
    return text


def glossary_relevant(text: Column, glossary: dict[str, str] | None = None) -> Column:
    """``term=translation`` of the terms in a text, in the glossary's order, joined by "; " (J7)."""
    low, found = F.lower(text), []
    for term, by in (fixed.GLOSSARY if glossary is None else glossary).items():
        hit = low.contains(term.lower())
        if term.isupper():
            hit = hit | has(text, rf"\b{re.escape(term)}\b", False)
        found.append(F.when(hit, f"{term}={by}"))
    return F.concat_ws("; ", *found)


def json_object(text: Column) -> Column:
    """The JSON object in a reply, as a VARIANT: code fence removed, else from the first { to the last }."""
    text = strip(text)
    text = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(text)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1))))


def marked_parts(text: Column, expected: int) -> Column:
    """The texts after the marks <<<0>>> .. <<<expected-1>>> as an array; null without marks; the last of equal marks counts."""
    text = strip(F.coalesce(text, F.lit("")))
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"<<<\s*(\d+)\s*>>>"), F.lit(1)), lambda m: m.try_cast("int"))
    parts = F.slice(F.transform(F.split(text, r"<<<\s*\d+\s*>>>"), lambda p: strip(p)), 2, 1 << 30)
    pick = lambda i: F.coalesce(F.get(parts, F.size(marks) - F.array_position(F.reverse(marks), i).cast("int")), F.lit(""))
    picked = F.transform(F.sequence(F.lit(0), F.lit(expected - 1)), lambda i: F.when(F.array_contains(marks, i), pick(i)).otherwise(""))
    return F.when(F.size(marks) > 0, picked)


def base64(content: Column) -> Column:
    """Base64 in one line, whatever the session's line breaks are."""
    return F.translate(F.base64(content), "\r\n", "")


def safe_slug(path: Column) -> Column:
    """The stem of a file name, with characters that file systems refuse as _."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")
    slug = strip(F.regexp_replace(F.when(stem == "", "paper").otherwise(stem), r'[\\/:*?"<>|]+', "_"))
    return F.when(slug == "", "paper").otherwise(slug)


def looks_truncated(source: Column, result: Column, ascii_words: bool = False) -> Column:
    """Whether a translation stops short: empty, newly ending in an ellipsis, or far shorter than its source's words (F32)."""
    src, dst = squeeze(source), squeeze(result)
    ends = fixed.ELLIPSIS
    kept = F.aggregate(F.regexp_extract_all(src, F.lit(rx(fixed.UNTRANSLATED_PARTS, False, ascii_words)), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    n_src, n_dst = F.length(src) - kept, F.length(dst) - kept
    ratio = F.when(n_src > 0, n_dst / n_src)
    short = ((n_src >= 300) & (ratio < 0.30)) | ((n_src >= 180) & (ratio < 0.20))
    return F.when(src == "", False).when(dst == "", True).when(has(dst, ends) & ~has(src, ends), True).otherwise(F.coalesce(short, F.lit(False)))
