"""Fonts of a page: codes to widths and text."""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_right
from dataclasses import dataclass, field

from .encodings import ENCODINGS, STANDARD, STANDARD_14, built_in, name_text, standard_width
from .objects import EOF, Keyword, Name, PdfError, Reader, Stream, Str, serialize
from .truetype import character_map, evidence, glyph_box, tables

def subset_tag(name: bytes) -> tuple[str | None, str, bool]:
    """(tag, name without it, malformed)."""
    text = name.decode("latin-1")
    if re.match(r"[A-Z]{6}\+", text):
        return text[:6], text[7:], False
    return None, text, bool(re.match(r"[^+]{6}\+", text))


@dataclass
class CMap:
    """Code spaces, and codes to text or to numbers."""

    spaces: list = field(default_factory=list)
    single: dict = field(default_factory=dict)
    ranges: list = field(default_factory=list)
    vertical: bool = False
    parent: CMap | None = None
    notdef: list = field(default_factory=list)
    starts: list | None = None
    reach: list = field(default_factory=list)

    def undefined(self, code: int) -> int:
        """The number of what stands for a code without one: of a range, else 0."""
        return next((to for lo, hi, to in self.notdef if lo <= code <= hi), 0)

    def split(self, data: bytes):
        """(code, bytes) one after another: the first length of 1 to 4 that a code space holds."""
        k = 0
        while k < len(data):
            for n in range(1, 5):
                part = data[k : k + n]
                if len(part) == n and any(len(lo) == n and all(a <= c <= b for a, c, b in zip(lo, part, hi, strict=True)) for lo, hi in self.spaces):
                    break
            else:
                n = min([len(lo) for lo, _ in self.spaces], default=1)
                part = data[k : k + n]
            yield int.from_bytes(part, "big"), len(part)
            k += max(1, len(part))

    def get(self, code: int):
        """What a code stands for: of overlapping ranges the one with the highest start counts, and of these the last."""
        if code in self.single:
            return self.single[code]
        if self.starts is None:
            order = sorted(range(len(self.ranges)), key=lambda k: (self.ranges[k][0], k))
            self.starts = [self.ranges[k] for k in order]
            reach, self.reach = -1, []
            for _, hi, _ in self.starts:
                self.reach.append(reach := max(reach, hi))
        k = bisect_right(self.starts, code, key=lambda r: r[0]) - 1
        while k >= 0 and self.reach[k] >= code:
            lo, hi, to = self.starts[k]
            if hi >= code:
                if isinstance(to, int):
                    return to + code - lo
                if isinstance(to, list):
                    return to[code - lo] if code - lo < len(to) else None
                return to[:-1] + chr(min(ord(to[-1]) + code - lo, 0x10FFFF)) if to else ""
            k -= 1
        return self.parent.get(code) if self.parent else None


IDENTITY = CMap([(b"\0\0", b"\xff\xff")], {}, [(0, 0xFFFF, 0)])


def parse_cmap(data: bytes, provider=None, depth: int = 0) -> CMap:
    """provider: a function from the name of a character map to its bytes, for those that this one builds on."""
    out, r = CMap(), Reader(data, 0, refs=False)
    held: list = []
    text = lambda v: v.data.decode("utf-16-be", "replace") if isinstance(v, Str) else v
    code = lambda v: int.from_bytes(v.data, "big")
    while True:
        v = r.object()
        if v is EOF or v == b"":
            return out
        if not isinstance(v, Keyword):
            held.append(v)
            continue
        try:
            if v == b"endcodespacerange":
                out.spaces += [(a.data, b.data) for a, b in zip(held[::2], held[1::2], strict=False)]
            elif v in (b"endbfchar", b"endcidchar"):
                out.single |= {code(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
            elif v in (b"endbfrange", b"endcidrange"):
                out.ranges += [(code(a), code(b), [text(x) for x in c] if isinstance(c, list) else text(c)) for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False)]
            elif v == b"endnotdefrange":
                out.notdef += [(code(a), code(b), c) for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False)]
            elif v == b"usecmap" and held:
                out.parent = named_cmap(held[-1], provider, depth + 1)
                if out.parent:
                    out.spaces += out.parent.spaces
            elif v == b"def" and len(held) > 1 and held[-2] == b"WMode":
                out.vertical = held[-1] == 1
        except (AttributeError, TypeError):
            pass
        held = []


def named_cmap(name: bytes, provider=None, depth: int = 0) -> CMap | None:
    """A predefined character map: Identity, or what the provider has under the name; null beyond a depth of 8."""
    if name in (b"Identity-H", b"Identity-V"):
        return CMap([(b"\0\0", b"\xff\xff")], {}, [(0, 0xFFFF, 0)], name.endswith(b"V"))
    data = provider(name.decode("latin-1")) if provider and depth < 8 else None
    if data is None:
        return None
    out = parse_cmap(data, provider, depth)
    out.vertical = out.vertical or name.endswith(b"-V")
    return out


class Metrics:
    """Widths, or vertical metrics, by number: single ones, and ranges that share a value; later entries count before earlier ones."""

    def __init__(self, doc, entries, size: int, default: tuple):
        self.default, self.single, self.ranges, self.bad = default, {}, [], False
        get, k = doc.get, 0
        entries = entries if isinstance(entries, list) else []
        try:
            while k + 1 < len(entries):
                first, second = get(entries[k]), get(entries[k + 1])
                if isinstance(second, list):
                    values = [float(get(x)) for x in second]
                    self.single |= {first + i: tuple(values[i * size : (i + 1) * size]) for i in range(len(values) // size)}
                    k += 2
                else:
                    self.ranges.append((int(first), int(second), tuple(float(get(x)) for x in entries[k + 2 : k + 2 + size])))
                    k += 2 + size
        except (TypeError, ValueError):
            self.bad = True

    def get(self, number: int) -> tuple:
        if number in self.single:
            return self.single[number]
        return next((v for lo, hi, v in reversed(self.ranges) if lo <= number <= hi and v), self.default)


@dataclass
class Font:
    """A font as its dictionary describes it."""

    key: object
    subtype: str
    name: str
    tag: str | None
    malformed_tag: bool
    embedded: str | None
    widths: dict
    default: float
    texts: dict
    cmap: CMap | None
    unicode: CMap | None
    vertical: bool = False
    problems: tuple = ()
    procedures: dict = field(default_factory=dict)
    resources: dict = field(default_factory=dict)
    matrix: tuple = (0.001, 0.0, 0.0, 0.001, 0.0, 0.0)
    program: tuple | None = None
    to_glyph: bytes | None = None
    metrics: Metrics | None = None
    standing: Metrics | None = None
    collection: str | None = None
    program_digest: str | None = None
    sfnt: dict | None = None
    encoding: str | None = None
    ascent: float = 880.0
    descent: float = -120.0

    def vertical_metrics(self, cid: int) -> tuple[float, float, float]:
        """How far a glyph moves the pen down, and where its origin for vertical writing lies: in the middle of its width, at the default height, unless given."""
        height, y = self.standing.default[1], self.standing.default[0]
        found = self.standing.get(cid)
        if len(found) == 3:
            return found
        return height, self.metrics.get(cid)[0] / 2, y

    def evidence(self, code: int, text: str | None) -> str | None:
        """Whether the embedded program's own map leads from the text to the glyph; null where that can't be asked."""
        if self.program is None or not text or self.cmap is None:
            return None
        cid = self.cmap.get(code) or 0
        glyph = int.from_bytes(self.to_glyph[2 * cid : 2 * cid + 2], "big") if self.to_glyph is not None else cid
        return evidence(text, glyph, *self.program)

    def outline(self, code: int) -> tuple[float, float, float, float] | None:
        """The box around a glyph's outline in ems; null without an embedded TrueType program, or for an empty outline."""
        if self.sfnt is None or self.cmap is None:
            return None
        cid = self.cmap.get(code) or 0
        glyph = int.from_bytes(self.to_glyph[2 * cid : 2 * cid + 2], "big") if self.to_glyph is not None else cid
        try:
            b, em = glyph_box(self.sfnt, glyph), int.from_bytes(self.sfnt["head"][18:20], "big")
        except (KeyError, IndexError, struct.error):
            return None
        return tuple(v / em for v in b) if b and em else None

    def glyphs(self, data: bytes):
        """(code, bytes, width, text, reason) of each code; the reason tells why there is no text."""
        for code, size in self.cmap.split(data) if self.cmap else ((c, 1) for c in data):
            cid = self.cmap.get(code) if self.cmap else code
            if self.cmap and cid is None:
                cid = self.cmap.undefined(code)
            width = self.metrics.get(cid)[0] if self.metrics else self.widths.get(cid, self.default)
            text = self.unicode.get(code) if self.unicode else None
            if text is None:
                text = self.texts.get(code)
            reason = "notdef" if self.cmap and not cid else None if text else "no-mapping"
            yield code, size, width, text if isinstance(text, str) else None, reason


def load_font(doc, d: dict, key, provider=None) -> Font:
    """provider: a function from the name of a predefined character map to its bytes."""
    get = doc.get
    subtype = get(d.get(b"Subtype")) or b""
    tag, name, malformed = subset_tag(get(d.get(b"BaseFont")) or b"")
    u = get(d.get(b"ToUnicode"))
    unicode = parse_cmap(doc.decoded(u)[0]) if isinstance(u, Stream) else None
    problems, widths, texts, cmap, default, vertical = [], {}, {}, None, 0.0, False
    metrics = standing = collection = None
    procedures, resources, matrix = {}, {}, (0.001, 0.0, 0.0, 0.001, 0.0, 0.0)
    inner = d
    if subtype == b"Type0":
        kids = get(d.get(b"DescendantFonts"))
        inner = get(kids[0]) if isinstance(kids, list) and kids else {}
        e = get(d.get(b"Encoding"))
        cmap = parse_cmap(doc.decoded(e)[0], provider) if isinstance(e, Stream) else named_cmap(e, provider) if isinstance(e, Name) else None
        if isinstance(e, Stream) and cmap.parent is None and (used := get(e.dict.get(b"UseCMap"))) is not None:
            cmap.parent = parse_cmap(doc.decoded(used)[0], provider) if isinstance(used, Stream) else named_cmap(used, provider)
            cmap.spaces += cmap.parent.spaces if cmap.parent else []
        if cmap is None:
            problems.append("predefined-cmap-unavailable")
            cmap, unicode = CMap([(b"\0\0", b"\xff\xff")]), None
        vertical = cmap.vertical
        metrics = Metrics(doc, get(inner.get(b"W")), 1, (float(get(inner.get(b"DW", 1000))),))
        stand = get(inner.get(b"DW2"))
        stand = tuple(float(get(x)) for x in stand[:2]) if isinstance(stand, list) and len(stand) > 1 else (880.0, -1000.0)
        standing = Metrics(doc, get(inner.get(b"W2")), 3, stand)
        if metrics.bad or standing.bad:
            problems.append("bad-widths")
        info = get(inner.get(b"CIDSystemInfo"))
        if isinstance(info, dict):
            collection = "-".join(x.data.decode("latin-1") for n in (b"Registry", b"Ordering") if isinstance(x := get(info.get(n)), Str)) or None
    else:
        first = get(d.get(b"FirstChar", 0))
        widths = {first + k: float(get(x)) for k, x in enumerate(get(d.get(b"Widths")) or [])} if isinstance(first, int) else {}
        e = get(d.get(b"Encoding"))
        described = get(d.get(b"FontDescriptor"))
        flags = get(described.get(b"Flags")) if isinstance(described, dict) else 0
        nonsymbolic = bool(isinstance(flags, int) and flags & 32)
        own = built_in(subtype, name, nonsymbolic, isinstance(described, dict))
        base = get(e.get(b"BaseEncoding")) if isinstance(e, dict) else e
        if isinstance(base, Name) and base not in ENCODINGS:
            problems.append("unknown-encoding")
        texts = dict(ENCODINGS.get(base, own) if isinstance(base, Name) else own)
        drawn = get(d.get(b"CharProcs")) if subtype == b"Type3" else None
        if isinstance(e, dict):
            code = 0
            for x in get(e.get(b"Differences")) or []:
                x = get(x)
                if isinstance(x, Name):
                    texts[code] = name_text(x.decode("latin-1"))
                    if isinstance(drawn, dict) and isinstance(p := get(drawn.get(x)), Stream):
                        procedures[code] = p
                    code += 1
                elif isinstance(x, int):
                    code = x
        if subtype == b"TrueType" and nonsymbolic:
            texts = STANDARD | texts
        if not widths and name in STANDARD_14 and tag is None:
            widths = {c: w for c in range(256) if (w := standard_width(name, c, texts.get(c))) is not None}
        if subtype == b"Type3":
            m = get(d.get(b"FontMatrix")) or [0.001, 0, 0, 0.001, 0, 0]
            widths = {c: w * float(get(m[0])) * 1000 for c, w in widths.items()}
            matrix = tuple(float(get(x)) for x in m)
            resources = get(d.get(b"Resources")) or {}
    descriptor = get(inner.get(b"FontDescriptor"))
    embedded, ascent, descent = None, 880.0, -120.0
    if isinstance(descriptor, dict):
        embedded = next((k.decode() for k in (b"FontFile", b"FontFile2", b"FontFile3") if isinstance(get(descriptor.get(k)), Stream)), None)
        if subtype not in (b"Type0", b"Type3"):
            default = float(get(descriptor.get(b"MissingWidth", 0)))
        heights = [get(descriptor.get(n)) for n in (b"Ascent", b"Descent")]
        if all(isinstance(x, (int, float)) for x in heights) and heights[0] != heights[1]:
            ascent, descent = float(heights[0]), -abs(float(heights[1]))
    elif subtype != b"Type3" and name not in STANDARD_14:
        problems.append("missing-descriptor")
    digest = None
    if embedded:
        try:
            digest = hashlib.md5(doc.decoded(get(descriptor[embedded.encode()]))[0]).hexdigest()
        except PdfError:
            problems.append("unreadable-program")
    e = get(d.get(b"Encoding"))
    encoding = e.decode("latin-1") if isinstance(e, Name) else None
    if isinstance(e, (dict, Stream)):  # one of its own: a digest of what it says
        encoding = hashlib.md5(doc.decoded(e)[0] if isinstance(e, Stream) else serialize({k: get(v) for k, v in sorted(e.items())})).hexdigest()
    program = to_glyph = sfnt = None
    if subtype == b"Type0" and embedded == "FontFile2":
        try:
            sfnt = tables(doc.decoded(get(descriptor[b"FontFile2"]))[0])
            program = character_map(sfnt["cmap"])
        except (PdfError, KeyError, IndexError, struct.error):
            problems.append("unreadable-program")
        m = get(inner.get(b"CIDToGIDMap"))
        to_glyph = doc.decoded(m)[0] if isinstance(m, Stream) else None
    return Font(key, subtype.decode("latin-1"), name, tag, malformed, "Type3" if subtype == b"Type3" else embedded, widths, default, texts, cmap, unicode, vertical, tuple(problems), procedures, resources, matrix, program, to_glyph, metrics, standing, collection, digest, sfnt, encoding, ascent, descent)
