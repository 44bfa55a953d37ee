"""Both merge folds in plain Python, row by row over one document, to compare with."""

import re

from leafwork import fixed
from leafwork.fixed import any_of

_open_end = re.compile(r"[.!?。！？:]$")
_joining = re.compile(rf"\b{any_of(fixed.JOINING_WORDS)}$", re.I)
_goes_on = re.compile(r"[A-Z]{2,}\b|[a-z0-9(),;/%±~<>≥≤]")
_goes_on_small = re.compile(r"[a-z0-9),;/%±~<>≥≤]")


def near(prev: dict, cur: dict) -> bool:
    """Whether two boxes can belong to one paragraph: on one page close together, or the head of the next page."""
    a, b = prev["box"], cur["box"]
    if a is None or b is None:
        return True
    if prev["page"] == cur["page"]:
        wraps = a["x1"] < b["x0"] and a["y1"] > 500 and b["y0"] < 140
        far = b["y0"] < a["y0"] - 8 or b["y0"] - a["y1"] > 80 or max(a["y1"], b["y1"]) - min(a["y0"], b["y0"]) > 320
        return wraps or not far
    if cur["page"] != prev["page"] + 1 or b["y0"] > 180:
        return False
    return len(cur["text"].strip()) >= 50 or bool(_goes_on_small.match(cur["text"].lstrip()))


def continues(prev: dict, cur: dict) -> bool:
    """Whether a paragraph goes on in the next one; ``cur["subheading"]`` says if that looks like a subheading."""
    if not prev["text"] or not cur["text"] or not near(prev, cur) or cur["subheading"]:
        return False
    before, after = prev["text"].rstrip(), cur["text"].lstrip()
    if _open_end.search(before):
        return False
    return bool(_joining.search(before) or _goes_on.match(after) or before.endswith((",", ";")))


def merged(rows: list[dict]) -> list[dict]:
    out: list[dict] = []
    for cur in rows:
        prev = out[-1] if out else None
        if prev and prev["section_id"] == cur["section_id"] and prev["kind"] == cur["kind"] == "paragraph" and continues(prev, cur):
            prev["text"] = f"{prev['text'].rstrip()} {cur['text'].lstrip()}"
            a, b = prev["box"], cur["box"]
            if prev["page"] == cur["page"] and a and b and b["y0"] >= a["y0"]:
                prev["box"] = {k: (min if k in ("x0", "y0") else max)(a[k], b[k]) for k in a}
            continue
        out.append(dict(cur))
    return out


def merged_fragments(rows: list[dict]) -> list[dict]:
    """A fragment that begins in the middle of a sentence goes to the body paragraph before it."""
    last = None
    for cur in rows:
        if cur["kind"] in ("non_content", "caption", "heading"):
            last = None if cur["kind"] == "heading" else last
            continue
        if last and last["section_id"] == cur["section_id"] and last["kind"] == cur["kind"] == "paragraph" and 0 <= cur["page"] - last["page"] <= 1 and not cur["subheading"]:
            before, after = last["text"].rstrip(), cur["text"].lstrip()
            if before and after and _goes_on_small.match(after) and not re.search("[.!?。！？]$", before):
                last["text"] = f"{before} {after}"
                cur["kind"] = "non_content"
                continue
        last = cur
    return rows
