"""The text that a page's glyphs show against an intended text: copies of a run, glyphs that stand for nothing, spans whose
own text disagrees with their glyphs, and what is left between the characters that agree.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Sequence

#: How far copies of a run may drift, and how far one may lie from the first, in parts of the font's size.
DRIFT, NEAR = 0.005, 0.25
#: Variation selectors.
SELECTORS = re.compile("[︀-️\U000e0100-\U000e01ef]")
REPLACEMENT = "�"
#: How far a wide character's width may be from one em, and from half an em.
FULL, HALF = 0.02, 0.1


def clusters(text: str) -> list[str]:
    """Characters with the variation selectors after them, without white space."""
    out: list[str] = []
    for c in text:
        if SELECTORS.match(c) and out:
            out[-1] += c
        elif not c.isspace():
            out.append(c)
    return out


def _copies(runs: Sequence[Sequence[dict]]) -> bool:
    """Whether the runs show the first one's codes, each moved by one short step."""
    first = runs[0]
    length = sum(abs(g["width"]) / 1000 * g["size"] for g in first)
    for run in runs[1:]:
        dx, dy = run[0]["x"] - first[0]["x"], run[0]["y"] - first[0]["y"]
        if math.hypot(dx, dy) >= min(length / 2, NEAR * first[0]["size"]):
            return False
        for a, b in zip(first, run, strict=True):
            if (a["font"], a["code"]) != (b["font"], b["code"]) or math.hypot(b["x"] - a["x"] - dx, b["y"] - a["y"] - dy) > DRIFT * a["size"]:
                return False
    return True


def collapse(glyphs: list[dict]) -> tuple[list[dict], int]:
    """The last of the most runs of one length that are copies of the first, and how many there are."""
    n = len(glyphs)
    codes = [(g["font"], g["code"]) for g in glyphs]
    for count in range(n, 1, -1):
        if n % count == 0:
            size = n // count
            if codes[:-size] == codes[size:] and _copies([glyphs[k * size : (k + 1) * size] for k in range(count)]):
                return glyphs[-size:], count
    return glyphs, 1


def failure(g: dict) -> str | None:
    """missing-glyph or unmapped for a glyph that stands for no text; nothing for an empty glyph without text."""
    text, empty = g["text"], g["hidden"] == "empty"
    if g["reason"] == "notdef" or (empty and text and text.strip()):
        return "missing-glyph"
    if not text:
        return "nothing" if empty else "unmapped"
    return None


def proportional(glyphs: Sequence[dict]) -> set[str]:
    """Fonts that show a wide character at neither one em nor half of it."""
    return {g["font"] for g in glyphs if _wide(g["text"]) and abs(g["width"] / 1000 - 1) > FULL and abs(g["width"] / 1000 - 0.5) > HALF}


def _wide(text: str | None) -> bool:
    return bool(text) and len(text) == 1 and unicodedata.east_asian_width(text) in "FW"


def shown(glyphs: list[dict], equivalents: dict[str, str]) -> tuple[list[tuple[str, str | None]], list[tuple[str, str, str]]]:
    """Clusters of text with the failure of each, and notes (kind, text, what the glyphs show)."""
    out: list[tuple[str, str | None]] = []
    notes: list[tuple[str, str, str]] = []
    same = lambda t: "".join(equivalents.get(c, c) for c in t)
    odd = proportional(glyphs)
    k = 0
    while k < len(glyphs):
        g = glyphs[k]
        end = k + 1
        if g["span"] is not None:
            while end < len(glyphs) and glyphs[end]["span"] == g["span"]:
                end += 1
        run = glyphs[k:end]
        k = end
        bad = [f for f in map(failure, run) if f in ("missing-glyph", "unmapped")]
        if bad:
            kind = "missing-glyph" if "missing-glyph" in bad else "unmapped"
            text = (g["actual"] if g["span"] is not None else g["text"]) or REPLACEMENT
            out.append((text if kind == "missing-glyph" else REPLACEMENT, kind))
            continue
        folded = "".join(x["folded"] or "" for x in run)
        for x in run:
            if _wide(x["text"]) and x["font"] not in odd and abs(x["width"] / 1000 - 0.5) <= HALF:
                notes.append(("half-width", x["text"], ""))
        text = same(folded)
        if g["span"] is not None:
            actual = g["actual"] or ""
            own = {*SELECTORS.findall(folded)}
            plain = SELECTORS.sub(lambda m: m[0] if m[0] in own else "", actual)  # noqa: B023
            if clusters(plain) == clusters(folded):
                text = plain if same(folded) == folded else text
            else:
                notes.append(("actual-text-disagrees", actual, folded))
        out += [(c, None) for c in clusters(text)]
    return out, notes


def match(glyphs: list[dict], intended: str, align: Callable, work: int, equivalents: dict[str, str] | None = None) -> dict:
    """status, kept, copies, differences (kind, intended, found, place) and notes for one page.

    Between clusters that agree, the rest is paired in order: pairs are substituted, what has no pair is missing or extra;
    glyphs that stand for nothing are differences of their own. A page with only unmapped glyphs besides, with half-width
    forms or with spans that disagree is unverified; any other difference is a mismatch.
    """
    glyphs, count = collapse(glyphs)
    found, notes = shown(glyphs, equivalents or {})
    want = clusters(intended)
    tokens = [c if f is None else f"\0{k}" for k, (c, f) in enumerate(found)]
    steps = align(want, tokens, work)
    if steps is None:
        return {"status": "mismatch", "kept": None, "copies": count, "differences": [("work-limit", None, None, None)], "notes": notes}
    differences: list[tuple[str, str | None, str | None, int | None]] = []
    missing: list[int] = []
    extra: list[int] = []
    kept = 0

    def flush() -> None:
        for p in range(max(len(missing), len(extra))):
            i = missing[p] if p < len(missing) else None
            if p < len(extra):
                text, bad = found[extra[p]]
                kind = bad or ("substituted" if i is not None else "extra")
                differences.append((kind, None if i is None else want[i], text, i))
            else:
                differences.append(("missing", want[i], None, i))
        missing.clear()
        extra.clear()

    for step, i, j in steps:
        if step == "keep":
            flush()
            kept += 1
        elif step == "missing":
            missing.append(i)
        else:
            extra.append(j)
    flush()
    hard = [d for d in differences if d[0] != "unmapped"]
    status = "mismatch" if hard else "unverified" if differences or notes or (want and not found) else "match"
    return {"status": status, "kept": kept, "copies": count, "differences": differences, "notes": notes}
