"""Page content: operations, and the interpreter that turns them into text, paint and cover events."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from .clip import LIMIT_VERTICES, Clip
from .fonts import Font, load_font
from .objects import EOF, Keyword, Name, PdfError, Reader, Ref, Stream, Str

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
DEVICE = {b"g": (b"DeviceGray", 1), b"rg": (b"DeviceRGB", 3), b"k": (b"DeviceCMYK", 4)}
#: Painting operators: (fill rule or None, strokes, closes).
PAINT = {b"S": (None, True, False), b"s": (None, True, True), b"f": ("nonzero", False, False), b"F": ("nonzero", False, False), b"f*": ("evenodd", False, False), b"B": ("nonzero", True, False), b"B*": ("evenodd", True, False), b"b": ("nonzero", True, True), b"b*": ("evenodd", True, True)}
#: Operators without a tracked effect, with the kinds of their operands: n number, a array, N name, x any.
PLAIN = {b"w": "n", b"J": "n", b"j": "n", b"M": "n", b"d": "an", b"ri": "N", b"i": "n", b"MP": "N", b"DP": "Nx", b"d0": "nn", b"d1": "nnnnnn"}
LIMIT_DEPTH, LIMIT_OPERATIONS, LIMIT_PROCEDURES = 64, 10_000_000, 16


def mul(m, n):
    """First m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def at(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def operations(data: bytes) -> Iterator[tuple[bytes, list, int]]:
    """(operator, operands, offset). An inline image is one operation BI with its dictionary and data."""
    r = Reader(data, 0, refs=False)
    operands: list = []
    while True:
        r.space()
        start = r.at
        v = r.object()
        if not isinstance(v, Keyword):
            operands.append(v)
            if len(operands) > 16_384:
                raise PdfError("size-limit", "operands")
            continue
        if v is EOF or v == b"":
            return
        if v == b"BI":
            entries: dict = {}
            while (k := r.object()) != b"ID" and k != b"":
                if isinstance(k, Name):
                    entries[k] = r.object()
            begin = r.at + 1
            end = begin
            while True:
                end = data.find(b"EI", end)
                if end < 0:
                    end = len(data)
                    break
                if data[end - 1 : end] in (b" ", b"\n", b"\r", b"\t", b"") and (data[end + 2 : end + 3] in (b" ", b"\n", b"\r", b"\t", b"")):
                    break
                end += 2
            r.at = end + 2
            yield b"BI", [entries, data[begin : max(begin, end - 1)]], start
            operands = []
            continue
        yield bytes(v), operands, start
        operands = []


@dataclass(frozen=True)
class State:
    """What q saves."""

    ctm: tuple = IDENTITY
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    lead: float = 0.0
    mode: int = 0
    rise: float = 0.0
    fill: tuple = (b"DeviceGray", (0.0,))
    stroke: tuple = (b"DeviceGray", (0.0,))
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    blend: bytes = b"Normal"
    masked: bool = False
    clip: Clip | None = None
    tile: Stream | None = None


class Interpreter:
    """Runs a page's content in order. events: (seq, kind, values) for glyph, paint, select and cover."""

    def __init__(self, doc, annotations: str = "none", provider=None):
        """annotations: whose appearances are drawn after the page: none, printable or all. provider: predefined character maps by name."""
        self.doc, self.events, self.warnings, self.annotations, self.provider = doc, [], [], annotations, provider
        self.fonts: dict = {}
        self.empty: dict = {}
        self.count = self.nested = 0
        self.masks: list = []

    def page(self, page) -> list[tuple[int, str, dict]]:
        resources = self.doc.inherited(page, b"Resources")[0]
        try:
            data = b"\n".join(self.doc.contents(page))
        except PdfError as e:
            self.warnings.append(e.code)
            data = b""
        resources = resources if isinstance(resources, dict) else {}
        self.run(data, resources, State(), 0, frozenset())
        if self.annotations != "none":
            for a in self.doc.get(page.dict.get(b"Annots")) or []:
                self.annotation(self.doc.get(a), resources)
        return self.events

    def annotation(self, a, resources: dict) -> None:
        """The normal appearance, its box under its matrix moved and scaled onto the annotation's rectangle."""
        if not isinstance(a, dict):
            return
        flags = self.doc.get(a.get(b"F", 0))
        hidden, printed = flags & 2, flags & 4
        if hidden or (self.annotations == "printable" and not printed):
            return
        look = self.doc.get((self.doc.get(a.get(b"AP")) or {}).get(b"N"))
        if isinstance(look, dict):
            look = self.doc.get(look.get(self.doc.get(a.get(b"AS"))))
        rect = self.doc.get(a.get(b"Rect"))
        if not isinstance(look, Stream) or not isinstance(rect, list):
            return
        number = lambda v: [float(self.doc.get(x)) for x in v]
        r, b = number(rect), number(self.doc.get(look.dict.get(b"BBox")) or [0, 0, 1, 1])
        m = tuple(number(self.doc.get(look.dict.get(b"Matrix")) or IDENTITY))
        x0, y0, x1, y1 = _bounds([[at(m, p, q) for p, q in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))]])
        if x1 == x0 or y1 == y0:
            return
        left, low = min(r[0], r[2]), min(r[1], r[3])
        sx, sy = abs(r[2] - r[0]) / (x1 - x0), abs(r[3] - r[1]) / (y1 - y0)
        own = self.doc.get(look.dict.get(b"Resources"))
        move = (sx, 0.0, 0.0, sy, left - x0 * sx, low - y0 * sy)
        self.run(self.doc.decoded(look)[0], own if isinstance(own, dict) else resources, State(ctm=mul(m, move), clip=Clip.of_box((left, low, left + abs(r[2] - r[0]), low + abs(r[3] - r[1])))), 1, frozenset())

    def emit(self, kind: str, **values) -> None:
        self.events.append((len(self.events), kind, values))

    def _find(self, resources: dict, kind: bytes, name):
        group = self.doc.get(resources.get(kind))
        raw = group.get(name) if isinstance(group, dict) else None
        return raw, self.doc.get(raw)

    def font(self, raw, value) -> Font | None:
        key = (raw.num, raw.gen) if isinstance(raw, Ref) else id(value)
        if key not in self.fonts:
            self.fonts[key] = load_font(self.doc, value, key, self.provider) if isinstance(value, dict) else None
        return self.fonts[key]

    def run(self, data: bytes, resources: dict, s: State, depth: int, forms: frozenset) -> None:
        if depth > LIMIT_DEPTH:
            raise PdfError("nesting-limit", "forms")
        stack: list[State] = []
        tm = line = IDENTITY
        path: list[list[tuple[float, float]]] = []
        rects: list[tuple] = []
        here = (0.0, 0.0)
        pending, lenient, cutting = "", 0, False
        marks: list[tuple] = []
        for op, v, _ in operations(data):
            self.count += 1
            if self.count > LIMIT_OPERATIONS:
                raise PdfError("size-limit", "operations")
            try:
                n = [float(x) for x in v if isinstance(x, (int, float)) and not isinstance(x, bool)]
                if op == b"q":
                    if len(stack) < LIMIT_DEPTH:
                        stack.append(s)
                    else:
                        self.warnings.append("state-stack-limit")
                elif op == b"Q":
                    if stack:
                        s = stack.pop()
                    else:
                        self.warnings.append("unbalanced-restore")
                elif op == b"cm":
                    s = replace(s, ctm=mul(n[:6], s.ctm))
                elif op in (b"BT", b"ET"):
                    tm = line = IDENTITY
                    if op == b"ET" and cutting:  # the shapes of glyphs are not known
                        s, cutting = replace(s, clip=Clip(vertices=LIMIT_VERTICES + 1)), False
                elif op == b"Tf":
                    raw, value = self._find(resources, b"Font", v[0])
                    s = replace(s, font=self.font(raw, value), size=n[-1])
                elif op in (b"Tc", b"Tw", b"TL", b"Ts"):
                    s = replace(s, **{{b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise"}[op]: n[0]})
                elif op == b"Tz":
                    s = replace(s, scale=n[0] / 100)
                elif op == b"Tr":
                    s = replace(s, mode=int(n[0]))
                elif op in (b"Td", b"TD"):
                    if op == b"TD":
                        s = replace(s, lead=-n[1])
                    tm = line = mul((1, 0, 0, 1, n[0], n[1]), line)
                elif op == b"Tm":
                    tm = line = tuple(n[:6])
                elif op == b"T*":
                    tm = line = mul((1, 0, 0, 1, 0, -s.lead), line)
                elif op in (b"Tj", b"'", b'"', b"TJ"):
                    if op == b'"':
                        s = replace(s, word=n[0], char=n[1])
                    if op in (b"'", b'"'):
                        tm = line = mul((1, 0, 0, 1, 0, -s.lead), line)
                    parts = v[-1] if op == b"TJ" else [v[-1]]
                    tm = self.show(parts, s, tm, marks)
                    cutting = cutting or s.mode > 3
                elif op in (b"g", b"rg", b"k", b"G", b"RG", b"K"):
                    space, size = DEVICE[op.lower()]
                    s = replace(s, **{"stroke" if op.isupper() else "fill": (space, tuple(n[:size]))})
                    self.emit("select", space=space.decode(), components=list(n[:size]), stroke=op.isupper())
                elif op in (b"cs", b"CS"):
                    raw, value = self._find(resources, b"ColorSpace", v[0])
                    name = self.space(value) if value is not None else v[0].decode("latin-1")
                    s = replace(s, **{"stroke" if op == b"CS" else "fill": (name.encode("latin-1"), ())})
                    self.emit("select", space=name, components=[], stroke=op == b"CS")
                elif op in (b"sc", b"scn", b"SC", b"SCN"):
                    side = "stroke" if op.isupper() else "fill"
                    s = replace(s, **{side: (getattr(s, side)[0], tuple(n))})
                    if v and isinstance(v[-1], Name) and side == "fill":
                        cell = self._find(resources, b"Pattern", v[-1])[1]
                        s = replace(s, tile=cell if isinstance(cell, Stream) and self.doc.get(cell.dict.get(b"PatternType")) == 1 else None)
                elif op == b"gs":
                    _, g = self._find(resources, b"ExtGState", v[0])
                    s = self.state(s, g if isinstance(g, dict) else {})
                    if isinstance(g, dict) and isinstance(mask := self.doc.get(g.get(b"SMask")), dict):
                        self.mask(mask, s, resources, depth, forms)
                elif op == b"m":
                    here = (n[0], n[1])
                    path.append([at(s.ctm, *here)])
                elif op == b"l":
                    here = (n[0], n[1])
                    path[-1].append(at(s.ctm, *here))
                elif op in (b"c", b"v", b"y"):
                    a, b, c = (n[0:2], n[2:4], n[4:6]) if op == b"c" else (here, n[0:2], n[2:4]) if op == b"v" else (n[0:2], n[2:4], n[2:4])
                    for k in range(1, 17):
                        t = k / 16
                        w = (1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3
                        path[-1].append(at(s.ctm, *(w[0] * here[i] + w[1] * a[i] + w[2] * b[i] + w[3] * c[i] for i in (0, 1))))
                    here = tuple(c)
                elif op == b"re":
                    x, y, w, h = n[:4]
                    corners = [at(s.ctm, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                    path.append([*corners, corners[0]])
                    rects.append((corners, s.ctm[1] == s.ctm[2] == 0 or s.ctm[0] == s.ctm[3] == 0))
                elif op == b"h":
                    if path:
                        path[-1].append(path[-1][0])
                elif op in (b"W", b"W*"):
                    pending = "nonzero" if op == b"W" else "evenodd"
                elif op == b"n" or op in PAINT:
                    if op in PAINT:
                        rule, stroke, _ = PAINT[op]
                        self.paint(path, rects, rule, stroke, s)
                        if rule and path and s.tile is not None and s.fill[0].startswith(b"Pattern"):
                            self.cell(s, path, resources, depth, forms)
                    if pending and path:
                        s = replace(s, clip=(s.clip or Clip()).cut(path, pending))
                    path, rects, pending = [], [], ""
                elif op == b"sh":
                    shading = self._find(resources, b"Shading", v[0])[1]
                    shading = shading.dict if isinstance(shading, Stream) else shading
                    if not isinstance(shading, dict):
                        self.warnings.append("missing-shading")
                        continue
                    raw = self.doc.get(shading.get(b"ColorSpace"))
                    named = self._find(resources, b"ColorSpace", raw)[1] if isinstance(raw, Name) else None
                    box = s.clip.box if s.clip else None
                    self.emit("paint", what="shading", space=self.space(named if named is not None else raw), components=[], stroke=False, box=list(box) if box else None, alpha=s.fill_alpha)
                elif op in PLAIN:
                    if len(v) != len(PLAIN[op]) or not all(_is(x, k) for x, k in zip(v, PLAIN[op], strict=True)):
                        self.warnings.append("bad-operands")
                elif op in (b"BX", b"EX"):
                    lenient = max(0, lenient + (1 if op == b"BX" else -1))
                elif op == b"BI":
                    self.image(s, v[0].get(b"IM", v[0].get(b"ImageMask")) is True)
                elif op == b"Do":
                    self.do(v[0], resources, s, depth, forms)
                elif op in (b"BMC", b"BDC"):
                    props = v[1] if len(v) > 1 else None
                    if isinstance(props, Name):
                        props = self._find(resources, b"Properties", props)[1]
                    actual = self.doc.get(props.get(b"ActualText")) if isinstance(props, dict) else None
                    marks.append((v[0].decode("latin-1"), actual.data if isinstance(actual, Str) else None, len(self.events)))
                elif op == b"EMC":
                    if marks:
                        marks.pop()
                    else:
                        self.warnings.append("unbalanced-marked-content")
                elif not lenient:
                    self.warnings.append("unknown-operator")
            except (IndexError, TypeError, ValueError, AttributeError):
                self.warnings.append("bad-operands")
            except PdfError as e:
                if e.code in ("nesting-limit", "size-limit"):
                    raise
                self.warnings.append(e.code)

    def state(self, s: State, g: dict) -> State:
        get = lambda k: self.doc.get(g.get(k))
        if isinstance(get(b"ca"), (int, float)):
            s = replace(s, fill_alpha=float(get(b"ca")))
        if isinstance(get(b"CA"), (int, float)):
            s = replace(s, stroke_alpha=float(get(b"CA")))
        if (bm := get(b"BM")) is not None:
            s = replace(s, blend=bytes(bm[0] if isinstance(bm, list) else bm))
        if (mask := get(b"SMask")) is not None:
            s = replace(s, masked=isinstance(mask, dict))
        if isinstance(f := get(b"Font"), list) and len(f) == 2:
            s = replace(s, font=self.font(f[0], self.doc.get(f[0])), size=float(f[1]))
        return s

    def space(self, value) -> str:
        """A colour space's family, with the names of its colorants."""
        if isinstance(value, Name):
            return value.decode("latin-1")
        if isinstance(value, list) and value:
            kind = self.doc.get(value[0])
            if kind == b"Separation":
                return f"Separation/{_escaped(self.doc.get(value[1]))}"
            if kind == b"DeviceN":
                return "DeviceN/" + "/".join(_escaped(x) for x in self.doc.get(value[1]))
            if kind in (b"Indexed", b"Pattern") and len(value) > 1:
                return f"{kind.decode()}:{self.space(self.doc.get(value[1]))}"
            return kind.decode("latin-1") if isinstance(kind, bytes) else "unknown"
        return "unknown"

    def paint(self, path, rects, rule, stroke: bool, s: State) -> None:
        if not path:
            return
        box = _meet(s.clip.box, _bounds(path)) if s.clip else _bounds(path)
        for side in (["fill"] if rule else []) + (["stroke"] if stroke else []):
            space, parts = getattr(s, side)
            self.emit("paint", what=side, space=space.decode("latin-1"), components=list(parts), stroke=side == "stroke", box=list(box) if box else None, alpha=s.fill_alpha if side == "fill" else s.stroke_alpha)
        opaque = rule and s.fill_alpha == 1 and s.blend in (b"Normal", b"Compatible") and not s.masked and not s.fill[0].startswith(b"Pattern")
        if opaque and len(rects) == len(path) <= 64:
            for corners, upright in rects:
                b = _bounds([corners])
                if upright and s.clip:
                    b = _meet(s.clip.box, b) if s.clip.upright or s.clip.side(corners) == "inside" else None
                if upright and b and not self.masks:
                    self.emit("cover", box=list(b))

    def image(self, s: State, mask: bool) -> None:
        box = _bounds([[at(s.ctm, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]])
        self.emit("paint", what="image-mask" if mask else "image", space=s.fill[0].decode("latin-1") if mask else "Image", components=list(s.fill[1]) if mask else [], stroke=False, box=list((_meet(s.clip.box, box) if s.clip else box) or box), alpha=s.fill_alpha)

    def do(self, name, resources: dict, s: State, depth: int, forms: frozenset) -> None:
        raw, x = self._find(resources, b"XObject", name)
        if not isinstance(x, Stream):
            self.warnings.append("missing-xobject")
        elif x.dict.get(b"Subtype") == b"Image":
            self.image(s, x.dict.get(b"ImageMask") is True)
        elif x.dict.get(b"Subtype") == b"Form":
            key = raw.num if isinstance(raw, Ref) else id(x)
            if key in forms:
                self.warnings.append("form-cycle")
                return
            m = self.doc.get(x.dict.get(b"Matrix"))
            inner = replace(s, ctm=mul([float(self.doc.get(k)) for k in m], s.ctm) if isinstance(m, list) else s.ctm)
            if isinstance(b := self.doc.get(x.dict.get(b"BBox")), list):
                b = [float(self.doc.get(k)) for k in b]
                inner = replace(inner, clip=(inner.clip or Clip()).cut([[at(inner.ctm, p, q) for p, q in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))]], "nonzero"))
            own = self.doc.get(x.dict.get(b"Resources"))
            self.run(self.doc.decoded(x)[0], own if isinstance(own, dict) else resources, inner, depth + 1, forms | {key})

    def mask(self, mask: dict, s: State, resources: dict, depth: int, forms: frozenset) -> None:
        """A soft mask's group, run once where it is chosen; what it shows is marked as part of a mask."""
        group = self.doc.get(mask.get(b"G"))
        key = ("mask", id(group))
        if not isinstance(group, Stream) or key in forms:
            self.warnings.append("missing-mask" if not isinstance(group, Stream) else "mask-cycle")
            return
        m = self.doc.get(group.dict.get(b"Matrix"))
        own = self.doc.get(group.dict.get(b"Resources"))
        inner = State(ctm=mul([float(self.doc.get(k)) for k in m], s.ctm) if isinstance(m, list) else s.ctm)
        self.masks.append(key)
        try:
            self.run(self.doc.decoded(group)[0], own if isinstance(own, dict) else resources, inner, depth + 1, forms | {key})
        finally:
            self.masks.pop()

    def cell(self, s: State, path: list, resources: dict, depth: int, forms: frozenset) -> None:
        """A tiling pattern's cell, once, within what it paints; an uncoloured one paints in the current colour."""
        d, key = s.tile.dict, id(s.tile)
        if key in forms:
            self.warnings.append("pattern-cycle")
            return
        own = self.doc.get(d.get(b"Resources"))
        colour = s.fill if self.doc.get(d.get(b"PaintType")) == 2 else State().fill
        if colour[0].startswith(b"Pattern:"):
            colour = (colour[0][8:], colour[1])
        matrix = self.doc.get(d.get(b"Matrix"))
        m = tuple(float(self.doc.get(x)) for x in matrix) if isinstance(matrix, list) else IDENTITY
        self.run(self.doc.decoded(s.tile)[0], own if isinstance(own, dict) else resources, State(ctm=m, fill=colour, clip=(s.clip or Clip()).cut(path, "nonzero")), depth + 1, forms | {key})

    def procedure(self, f: Font, code: int, m, s: State) -> None:
        """What a Type 3 glyph's procedure paints."""
        proc = f.procedures.get(code)
        if proc is None:
            return
        if self.nested >= LIMIT_PROCEDURES:
            self.warnings.append("type3-nesting-limit")
            return
        self.nested += 1
        try:
            self.run(self.doc.decoded(proc)[0], f.resources, replace(s, ctm=mul(f.matrix, m)), 1, frozenset())
        finally:
            self.nested -= 1

    @staticmethod
    def ink(f: Font, code: int, m, left: float, low: float) -> list[float] | None:
        """The box of a glyph's outline on the page, where the embedded program tells it."""
        b = f.outline(code)
        if b is None:
            return None
        return list(_bounds([[at(m, left + x, low + y) for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))]]))

    def draws_nothing(self, f: Font, code: int) -> bool:
        """Whether a Type 3 glyph has no procedure, or one without an operator that paints."""
        key = (f.key, code)
        if key not in self.empty:
            proc = f.procedures.get(code)
            paints = {*PAINT, b"Tj", b"TJ", b"'", b'"', b"Do", b"sh", b"BI"}
            self.empty[key] = proc is None or not any(op in paints for op, _, _ in operations(self.doc.decoded(proc)[0]))
        return self.empty[key]

    def show(self, parts, s: State, tm, marks):
        f = s.font
        if f is None:
            self.warnings.append("missing-font")
            return tm
        span = next(((m[1], m[2]) for m in marks if m[1] is not None), None)  # the outermost counts
        for part in parts:
            if isinstance(part, (int, float)):
                move = -part / 1000 * s.size * (1 if f.vertical else s.scale)
                tm = mul((1, 0, 0, 1, 0, move) if f.vertical else (1, 0, 0, 1, move, 0), tm)
                continue
            for code, size, width, text, reason in f.glyphs(part.data):
                m = mul((s.size * s.scale, 0, 0, s.size, 0, s.rise), mul(tm, s.ctm))
                left = low = 0.0
                if f.vertical:
                    down, vx, vy = f.vertical_metrics(f.cmap.get(code) or 0)
                    left, low = -vx / 1000, -vy / 1000
                    shift = (0, down / 1000 * s.size + s.char + (s.word if size == 1 and code == 32 else 0))
                else:
                    shift = ((width / 1000 * s.size + s.char + (s.word if size == 1 and code == 32 else 0)) * s.scale, 0)
                bottom, top = f.descent / 1000 + low, f.ascent / 1000 + low
                corners = [at(m, x, y) for x, y in ((left, bottom), (left + width / 1000, bottom), (left + width / 1000, top), (left, top))]
                alpha = s.stroke_alpha if s.mode % 4 == 1 else s.fill_alpha
                flat = abs(m[0] * m[3] - m[1] * m[2]) < 1e-9
                hidden = "soft-mask" if self.masks else "render-mode" if s.mode % 4 == 3 else "transparent" if alpha == 0 else "degenerate" if flat else "empty" if f.subtype == "Type3" and self.draws_nothing(f, code) else None
                x, y = at(m, left, low)
                self.emit("glyph", code=code, bytes=size, text=text, reason=reason, font=f.name, x=x, y=y, box=list(_bounds([corners])), size=s.size, width=width, hidden=hidden, clipped=s.clip is not None and s.clip.side(corners) in ("outside", "unknown"), actual=span[0] if span else None, span=span[1] if span else None, space=s.fill[0].decode("latin-1"), evidence=f.evidence(code, text), ink=self.ink(f, code, m, left, low))
                if f.procedures and hidden is None:
                    self.procedure(f, code, m, s)
                tm = mul((1, 0, 0, 1, *shift), tm)
        return tm


def _escaped(name: bytes) -> str:
    """A colorant's name without slashes of its own."""
    return name.decode("latin-1").replace("~", "~0").replace("/", "~1")


def _is(value, kind: str) -> bool:
    """Whether an operand is of the kind: n number, a array, N name, x any."""
    if kind == "n":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind == "x" or isinstance(value, list if kind == "a" else Name)


def _bounds(path) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for sub in path for p in sub], [p[1] for sub in path for p in sub]
    return min(xs), min(ys), max(xs), max(ys)


def _meet(a, b):
    """The part that two boxes share; None stands for nothing."""
    if a is None or b is None:
        return None
    out = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return out if out[0] <= out[2] and out[1] <= out[3] else None
