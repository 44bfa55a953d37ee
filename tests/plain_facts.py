"""Matches and sentences of one text in plain Python, to hold the plan against."""

import re
from bisect import bisect_right

from leafwork import fixed
from leafwork.operators.facts import PATTERNS

_compiled = [(name, re.compile(p, re.I), groups) for name, (p, groups) in PATTERNS.items()]
_stop = re.compile(fixed.SENTENCE_END)


def sentence_ends(text: str) -> list[int]:
    return [m.end() for m in _stop.finditer(text)]


def sentence_around(text: str, pos: int, reach: int = 320, short: int = 40, more: int = 160, ends: list[int] | None = None) -> str:
    """The sentence that holds a position: between sentence ends or blank lines, not longer than ``reach`` without an end.

    A sentence under ``short`` characters takes the next one with it if that ends within ``more``.  A period
    between digits is a decimal point (X9).  ``ends``: those of the text, where many positions of it are asked for.
    """
    pos = max(pos, 0)
    ends = sentence_ends(text[: pos + 2]) if ends is None else ends
    before = bisect_right(ends, pos)
    start = ends[before - 1] if before else 0
    last = _stop.search(text, pos)
    end = min(len(text), pos + reach) if last is None else last.start() if last[0] == "\n\n" else last.end()
    out = text[start:end].strip(" .;")
    if len(out) < short and end < len(text):
        after = next((m for m in _stop.finditer(text, end, end + more + 2) if m[0] != "\n\n"), None)
        if after and after.start() < end + more:
            out = text[start : after.end()].strip(" .;")
    return out


def text_matches(text: str):
    """Tuples (pattern, start, qualifier, number, count, unit, sentence) of one text; sentence ends are looked for once."""
    ends = sentence_ends(text)
    for name, pattern, groups in _compiled:
        for m in pattern.finditer(text):
            yield (name, m.start(), *[m[g] if g else None for g in groups], sentence_around(text, m.start(), ends=ends))
