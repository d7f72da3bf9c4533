"""New documents, and content drawn by calls: paths, colours, states, images and groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from . import xmp
from .filters import deflate
from .metadata import MAPPING, iso_date
from .objects import Name, PdfError, Ref, Str, Stream, number_text
from .write import build, identifier

#: Joins, caps, and operators by rule.
JOINS, CAPS = {"miter": 0, "round": 1, "bevel": 2}, {"butt": 0, "round": 1, "square": 2}
FILLS, CLIPS, BOTH = {"nonzero": "f", "evenodd": "f*"}, {"nonzero": "W", "evenodd": "W*"}, {"nonzero": "B", "evenodd": "B*"}
SPACES = {1: ("g", "G"), 3: ("rg", "RG"), 4: ("k", "K")}
BLENDS = "Normal Multiply Screen Overlay Darken Lighten ColorDodge ColorBurn HardLight SoftLight Difference Exclusion Hue Saturation Color Luminosity".split()


def _number(v: float) -> bytes:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
        raise PdfError("invalid-number", repr(v))
    return number_text(float(v))


class Content:
    """Operators in the order of the calls, and the resources that they name."""

    def __init__(self):
        self.out: list[bytes] = []
        self.resources: dict[bytes, dict] = {}
        self.depth, self.open = 0, False
        self.overprint = {"fill": False, "stroke": False}
        self.colour: dict[str, tuple] = {"fill": (0.0,), "stroke": (0.0,)}
        self.held: list[tuple] = []

    def op(self, name: str, *values) -> Content:
        self.out.append(b" ".join([*(v if isinstance(v, bytes) else _number(v) for v in values), name.encode()]))
        return self

    def name(self, kind: str, value) -> bytes:
        """The resource's name; the same value has one."""
        group = self.resources.setdefault(kind.encode(), {})
        for k, v in group.items():
            if v == value:
                return b"/" + k
        key = Name(f"{kind[0]}{len(group)}".encode())
        group[key] = value
        return b"/" + key

    # ------------------------------------------------------------ state

    def save(self) -> Content:
        self.depth += 1
        self.held.append((dict(self.overprint), dict(self.colour)))
        return self.op("q")

    def restore(self) -> Content:
        if not self.depth:
            raise PdfError("unbalanced-restore")
        self.depth -= 1
        self.overprint, self.colour = self.held.pop()
        return self.op("Q")

    def transform(self, *matrix: float) -> Content:
        if len(matrix) != 6 or matrix[0] * matrix[3] == matrix[1] * matrix[2]:
            raise PdfError("invalid-matrix")
        return self.op("cm", *matrix)

    def line_width(self, width: float) -> Content:
        if width < 0:
            raise PdfError("invalid-number", "line width")
        return self.op("w", width)

    def line_join(self, join: str) -> Content:
        return self.op("j", JOINS[join])

    def line_cap(self, cap: str) -> Content:
        return self.op("J", CAPS[cap])

    def miter_limit(self, limit: float) -> Content:
        if limit < 1:
            raise PdfError("invalid-number", "miter limit")
        return self.op("M", limit)

    def dash(self, lengths: Sequence[float], phase: float = 0) -> Content:
        if any(x < 0 for x in lengths) or (lengths and not any(lengths)) or phase < 0:
            raise PdfError("invalid-number", "dash")
        return self.op("d", b"[" + b" ".join(map(_number, lengths)) + b"]", phase)

    def graphics_state(self, fill_alpha: float | None = None, stroke_alpha: float | None = None, blend: str | None = None, fill_overprint: bool | None = None, stroke_overprint: bool | None = None, overprint_mode: int | None = None) -> Content:
        d: dict = {b"Type": Name(b"ExtGState")}
        for k, v in ((b"ca", fill_alpha), (b"CA", stroke_alpha)):
            if v is not None:
                if not 0 <= v <= 1:
                    raise PdfError("invalid-number", "alpha")
                d[k] = v
        if blend is not None:
            if blend not in BLENDS:
                raise PdfError("invalid-blend", blend)
            d[b"BM"] = Name(blend.encode())
        for side, k, v in (("fill", b"op", fill_overprint), ("stroke", b"OP", stroke_overprint)):
            if v is not None:
                d[k] = v
                self.overprint[side] = v
        if overprint_mode is not None:
            d[b"OPM"] = overprint_mode
        return self.op("gs", self.name("ExtGState", d))

    # ------------------------------------------------------------ colour

    def _set(self, side: int, colour, tint: float) -> Content:
        which = ("fill", "stroke")[side]
        if isinstance(colour, list):  # a separation's space
            if not 0 <= tint <= 1:
                raise PdfError("invalid-number", "tint")
            self.colour[which] = (colour[1], tint)
            self.op(("cs", "CS")[side], self.name("ColorSpace", colour))
            return self.op(("scn", "SCN")[side], tint)
        if len(colour) not in SPACES or not all(0 <= x <= 1 for x in colour):
            raise PdfError("invalid-colour")
        self.colour[which] = tuple(colour)
        return self.op(SPACES[len(colour)][side], *colour)

    def fill_colour(self, colour, tint: float = 1.0) -> Content:
        """colour: grey, red green and blue, or inks, each from 0 to 1; or a separation with a tint."""
        return self._set(0, colour, tint)

    def stroke_colour(self, colour, tint: float = 1.0) -> Content:
        return self._set(1, colour, tint)

    # ------------------------------------------------------------ paths

    def move(self, x: float, y: float) -> Content:
        self.open = True
        return self.op("m", x, y)

    def _on(self, name: str, *v: float) -> Content:
        if not self.open:
            raise PdfError("no-current-point", name)
        return self.op(name, *v)

    def line(self, x: float, y: float) -> Content:
        return self._on("l", x, y)

    def curve(self, *v: float) -> Content:
        return self._on("c", *v)

    def rectangle(self, x: float, y: float, w: float, h: float) -> Content:
        self.open = True
        return self.op("re", x, y, w, h)

    def close(self) -> Content:
        return self._on("h")

    def _paint(self, name: str, *sides: str) -> Content:
        if not self.open:
            raise PdfError("no-path", name)
        for s in sides:  # what overprints and adds no ink would be lost without a trace
            c = self.colour[s]
            if self.overprint[s] and ((len(c) == 4 and not any(c)) or (len(c) == 2 and c[1] == 0)):
                raise PdfError("invisible-overprint", s)
        self.open = False
        return self.op(name)

    def fill(self, rule: str = "nonzero") -> Content:
        return self._paint(FILLS[rule], "fill")

    def stroke(self) -> Content:
        return self._paint("S", "stroke")

    def fill_and_stroke(self, rule: str = "nonzero") -> Content:
        return self._paint(BOTH[rule], "fill", "stroke")

    def clip(self, rule: str = "nonzero") -> Content:
        if not self.open:
            raise PdfError("no-path", "clip")
        self.open = False
        self.op(CLIPS[rule])
        return self.op("n")

    # ------------------------------------------------------------ objects

    def draw(self, x: Ref, *matrix: float) -> Content:
        """An image or a group under a matrix."""
        self.save()
        self.transform(*(matrix or (1, 0, 0, 1, 0, 0)))
        self.op("Do", self.name("XObject", x))
        return self.restore()

    def data(self) -> bytes:
        if self.depth:
            raise PdfError("unbalanced-save")
        return b"\n".join(self.out)


class NewDocument:
    """Pages, spot colours, images and groups of a file to be written."""

    def __init__(self, info: dict[str, str] | None = None, created: str | None = None):
        """info: entries of the information dictionary, which the packet tells too. created: a date of the form D:20240102030405Z."""
        self.objects: dict[int, object] = {}
        self.pages: list[Ref] = []
        self.info = (info or {}) | ({"CreationDate": created, "ModDate": created} if created else {})

    def add(self, value) -> Ref:
        num = len(self.objects) + 10
        self.objects[num] = value
        return Ref(num, 0)

    def separation(self, name: str, inks: Sequence[float]) -> list:
        """A spot colour that stands for inks at full tint."""
        if not name or name in ("All", "None") or len(inks) != 4 or not all(0 <= x <= 1 for x in inks):
            raise PdfError("invalid-separation", name)
        return [Name(b"Separation"), Name(name.encode()), Name(b"DeviceCMYK"), {b"FunctionType": 2, b"Domain": [0, 1], b"C0": [0, 0, 0, 0], b"C1": list(inks), b"N": 1}]

    def image(self, width: int, height: int, samples: bytes, channels: int, depth: int = 8) -> Ref:
        if len(samples) != -(-width * channels * depth // 8) * height:
            raise PdfError("short-image")
        space = {1: b"DeviceGray", 3: b"DeviceRGB", 4: b"DeviceCMYK"}[channels]
        return self.add(Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": width, b"Height": height, b"BitsPerComponent": depth, b"ColorSpace": Name(space), b"Filter": Name(b"FlateDecode")}, deflate(samples)))

    def group(self, box: Sequence[float], draw: Callable[[Content], object], isolated: bool = False, knockout: bool = False) -> Ref:
        """A transparency group in ink."""
        c = Content()
        draw(c)
        d = {b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"BBox": list(box), b"Resources": c.resources, b"Group": {b"S": Name(b"Transparency"), b"CS": Name(b"DeviceCMYK"), b"I": isolated, b"K": knockout}}
        return self.add(Stream(d, c.data()))

    def page(self, width: float, height: float, draw: Callable[[Content], object], boxes: dict[str, list[float]] | None = None) -> Ref:
        if not (0 < width <= 14_400 and 0 < height <= 14_400):
            raise PdfError("invalid-box", "page")
        c = Content()
        draw(c)
        content = self.add(Stream({b"Filter": Name(b"FlateDecode")}, deflate(c.data())))
        d = {b"Type": Name(b"Page"), b"Parent": Ref(2, 0), b"MediaBox": [0, 0, width, height], b"Resources": c.resources, b"Contents": content}
        self.pages.append(self.add(d | {k.encode(): v for k, v in (boxes or {}).items()}))
        return self.pages[-1]

    def write(self) -> bytes:
        if not self.pages:
            raise PdfError("no-pages")
        objects = {1: {b"Type": Name(b"Catalog"), b"Pages": Ref(2, 0)}, 2: {b"Type": Name(b"Pages"), b"Kids": list(self.pages), b"Count": len(self.pages)}}
        trailer: dict = {b"Root": Ref(1, 0)}
        if self.info:
            objects[3] = {k.encode(): Str(v.encode("latin-1")) if v.isascii() else Str(b"\xfe\xff" + v.encode("utf-16-be")) for k, v in self.info.items()}
            if "Trapped" in self.info:
                objects[3][b"Trapped"] = Name(self.info["Trapped"].encode())
            trailer[b"Info"] = Ref(3, 0)
            kinds = {"Title": "alt", "Subject": "alt", "Author": "seq"}
            rows = [(name, iso_date(v) if k.endswith("Date") else v, kinds.get(k, "text")) for k, name in MAPPING if (v := self.info.get(k)) is not None]
            base = identifier(repr((sorted(self.info.items()), len(self.objects))).encode()).data.hex()
            mm = "{http://ns.adobe.com/xap/1.0/mm/}"
            rows += [(mm + n, f"uuid:{base[:8]}-{base[8:12]}-{base[12:16]}-{base[16:20]}-{base[20:]}", "text") for n in ("DocumentID", "InstanceID")]
            objects[4] = Stream({b"Type": Name(b"Metadata"), b"Subtype": Name(b"XML")}, xmp.packet(rows))
            objects[1][b"Metadata"] = Ref(4, 0)
        body = build(objects | self.objects, trailer)
        return build(objects | self.objects, trailer | {b"ID": [identifier(body)] * 2})


def append_content(doc, page, draw: Callable[[Content], object]) -> dict[int, object]:
    """Edits that draw on top of a page; its own content is put between a save and a restore, and names don't meet its own."""
    c = Content()
    draw(c)
    fresh = max(doc.index, default=0) + 1
    raw = page.dict.get(b"Contents")
    own = doc.get(raw)
    old = own if isinstance(own, list) else [raw] if raw is not None else []
    resources = doc.get(doc.inherited(page, b"Resources")[0])
    resources = dict(resources) if isinstance(resources, dict) else {}
    data = c.data()
    for kind, group in c.resources.items():
        have = doc.get(resources.get(kind))
        have = dict(have) if isinstance(have, dict) else {}
        for key, value in group.items():
            new = key
            while new in have:
                new = Name(new + b"x")
            if new != key:
                data = data.replace(b"/" + key + b" ", b"/" + new + b" ")
            have[new] = value
        resources[kind] = have
    edits = {fresh: Stream({}, b"q\n"), fresh + 1: Stream({}, b"\nQ\n" + data)}
    edits[page.ref.num] = page.dict | {b"Resources": resources, b"Contents": [Ref(fresh, 0), *old, Ref(fresh + 1, 0)]}
    return edits
