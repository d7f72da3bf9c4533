"""Process colours for a whole document: content of pages and of everything that they draw, images, palettes, spot
alternates, shadings and groups, as an edit of the objects that change. Each object that others share is converted once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np

from . import icc
from .content import operations
from .document import Document
from .filters import deflate
from .functions import Function
from .images import icc_header
from .objects import Name, PdfError, Ref, Str, Stream, number_text, serialize

Convert = Callable[[np.ndarray], np.ndarray]
CMYK = Name(b"DeviceCMYK")
#: Steps of a sampled colour function by its number of inputs; with more inputs it is refused.
STEPS = {1: 256, 2: 33, 3: 17}
#: Names that stand for others in inline images.
SHORT = {b"W": b"Width", b"H": b"Height", b"BPC": b"BitsPerComponent", b"CS": b"ColorSpace", b"F": b"Filter", b"DP": b"DecodeParms", b"IM": b"ImageMask", b"D": b"Decode", b"I": b"Interpolate"}


class Inks:
    """The conversion of one document. edits: changed objects by number."""

    def __init__(self, doc: Document, convert: Convert, pure_black: bool = True):
        self.doc, self.transform, self.pure_black = doc, convert, pure_black
        self.edits: dict[int, object] = {}
        self.fresh = max(doc.index, default=0) + 1

    # ------------------------------------------------------------ colours

    def colours(self, x: np.ndarray, channels: int) -> np.ndarray:
        """Ink for rows of grey or red, green and blue; grey, and black if asked for, is black ink alone."""
        x = np.clip(np.asarray(x, float).reshape(-1, channels), 0, 1)
        if channels == 1:
            return np.concatenate([np.zeros((len(x), 3)), 1 - x], 1)
        out = np.clip(self.transform(x), 0, 1)
        if self.pure_black:
            out[~x.any(1)] = [0, 0, 0, 1]
        return out

    def source(self, space, resources: dict | None = None, depth: int = 0, inline: bool = False) -> int | None:
        """How many components a space has that is to be converted; null for spaces that stay as they are. inline: of an image within content, which has short names."""
        space = self.doc.get(space)
        if depth > 8:
            raise PdfError("nesting-limit", "colour space")
        if isinstance(space, Name):
            if space == b"DeviceRGB" or (inline and space == b"RGB"):
                return 3
            if space == b"DeviceGray" or (inline and space == b"G"):
                return 1
            named = self.doc.get((resources or {}).get(b"ColorSpace"))
            return self.source(named[space], resources, depth + 1) if isinstance(named, dict) and space in named else None
        if isinstance(space, list) and space:
            kind = self.doc.get(space[0])
            if kind in (b"DeviceRGB", b"CalRGB", b"DeviceGray", b"CalGray"):
                return 3 if kind.endswith(b"RGB") else 1
            if kind == b"ICCBased" and isinstance(s := self.doc.get(space[1]), Stream):
                n = self.doc.get(s.dict.get(b"N"))
                return n if n in (1, 3) else None
        return None

    def sampled(self, inputs: int, domain: list[float], f: Callable[[list[float]], np.ndarray]) -> Ref:
        """A function of inputs to ink, as a table of samples in a new object."""
        if inputs not in STEPS:
            raise PdfError("unsupported-feature", f"{inputs} inputs of a colour function")
        n = STEPS[inputs]
        axes = [np.linspace(domain[2 * k], domain[2 * k + 1], n) for k in range(inputs)]
        points = [list(reversed(p)) for p in product(*reversed(axes))]  # the first input varies fastest
        table = np.floor(np.clip(np.vstack([f(p) for p in points]), 0, 1) * 65535 + 0.5).astype(">u2").tobytes()
        d = {b"FunctionType": 0, b"Domain": domain, b"Range": [0, 1] * 4, b"Size": [n] * inputs, b"BitsPerSample": 16, b"Filter": Name(b"FlateDecode")}
        return self.add(Stream(d, deflate(table)))

    def add(self, value) -> Ref:
        self.edits[self.fresh] = value
        self.fresh += 1
        return Ref(self.fresh - 1, 0)

    def space(self, space):
        """The space in ink: an indexed space's palette and a spot colour's alternate are converted; null if nothing changes."""
        own = self.doc.get(space)
        if self.source(own):
            return CMYK
        if not isinstance(own, list) or not own:
            return None
        kind = self.doc.get(own[0])
        if kind == b"Indexed" and (n := self.source(own[1])):
            raw = self.doc.get(own[3])
            raw = self.doc.decoded(raw)[0] if isinstance(raw, Stream) else raw.data
            top = int(self.doc.get(own[2]))
            raw = raw[: (top + 1) * n].ljust((top + 1) * n, b"\0")
            inks = self.colours(np.frombuffer(raw, np.uint8).reshape(-1, n) / 255, n)
            return [own[0], CMYK, top, Str(np.floor(inks * 255 + 0.5).astype(np.uint8).tobytes(), True)]
        if kind in (b"Separation", b"DeviceN") and (n := self.source(own[2])):
            names = self.doc.get(own[1])
            inputs = len(names) if isinstance(names, list) else 1
            tint = Function(self.doc, own[3])
            return [own[0], own[1], CMYK, self.sampled(inputs, [0, 1] * inputs, lambda p: self.colours(tint(p), n)), *own[4:]]
        if kind == b"Pattern" and len(own) > 1 and (inner := self.space(own[1])) is not None:
            return [own[0], inner]
        return None

    # ------------------------------------------------------------ content

    def content(self, data: bytes, resources: dict) -> bytes | None:
        """Content whose colours are set in ink; null if none changes. What a space that stays has set, stays."""
        out, changed = bytearray(), False
        state: dict[str, int | None] = {"fill": 1, "stroke": 1}  # the components of the current space, if it is to be converted
        stack: list[dict] = []
        for op, v, _ in operations(data):
            side = "stroke" if op.isupper() else "fill"
            if op == b"q":
                stack.append(dict(state))
            elif op == b"Q" and stack:
                state = stack.pop()
            elif op in (b"rg", b"RG", b"g", b"G") and len(v) == (3 if op.lower() == b"rg" else 1):
                op, v, changed = (b"k" if side == "fill" else b"K"), self.colours(np.array([[float(x) for x in v]]), len(v))[0].tolist(), True
                state[side] = None
            elif op in (b"k", b"K"):
                state[side] = None
            elif op in (b"cs", b"CS") and v:
                state[side] = self.source(v[0], resources)
                if state[side]:
                    v, changed = [CMYK], True
            elif op in (b"sc", b"scn", b"SC", b"SCN") and state[side] and len(v) == state[side] and not isinstance(v[-1], Name):
                v, changed = self.colours(np.array([[float(x) for x in v]]), state[side])[0].tolist(), True
            elif op == b"BI":
                entries, body = self.inline(v[0], v[1], resources)
                changed = changed or body is not v[1]
                out += b"BI " + b" ".join(serialize(Name(k)) + b" " + serialize(x) for k, x in entries.items()) + b" ID " + body + b" EI\n"
                continue
            out += b" ".join(number_text(x) if isinstance(x, float) else serialize(x) for x in v) + (b" " if v else b"") + op + b"\n"
        return bytes(out) if changed else None

    def inline(self, entries: dict, body: bytes, resources: dict) -> tuple[dict, bytes]:
        full = {SHORT.get(k, k): x for k, x in entries.items()}
        n = self.source(full.get(b"ColorSpace"), resources, inline=True) if full.get(b"ImageMask") is not True else None
        if not n:
            return entries, body
        full[b"ColorSpace"] = Name(b"DeviceRGB" if n == 3 else b"DeviceGray")
        image = self.image(Stream({Name(k): x for k, x in full.items()}, body), resources)
        return ({k: x for k, x in image.dict.items() if k != b"Length"}, image.data) if image else (entries, body)

    # ------------------------------------------------------------ images and shadings

    def image(self, s: Stream, resources: dict | None = None) -> Stream | None:
        """An image of 8 or 16 bits in ink, a row at a time; null for masks and spaces that stay. Images that can't be decoded are refused."""
        d = s.dict
        if self.doc.get(d.get(b"ImageMask")) is True:
            return None
        space = self.doc.get(d.get(b"ColorSpace"))
        n = self.source(space, resources)
        if not n:
            inner = None if isinstance(d.get(b"ColorSpace"), Ref) else self.space(space)
            return Stream(d | {b"ColorSpace": inner}, s.data) if inner is not None else None
        w, h, depth = (int(self.doc.get(d.get(k, 8))) for k in (b"Width", b"Height", b"BitsPerComponent"))
        if depth not in (8, 16):
            raise PdfError("unsupported-feature", f"images of {depth} bits")
        kind = np.dtype(np.uint8) if depth == 8 else np.dtype(">u2")
        raw = self.doc.decoded(s)[0]
        size = w * n * kind.itemsize
        if len(raw) < size * h:
            raise PdfError("short-image")
        decode = [float(self.doc.get(x)) for x in self.doc.get(d.get(b"Decode")) or [0, 1] * n]
        low, high = np.array(decode[::2]), np.array(decode[1::2])
        known: dict[bytes, np.ndarray] = {}
        rows = []
        top = 255 if depth == 8 else 65535
        for k in range(h):
            row = np.frombuffer(raw, kind, w * n, k * size).reshape(w, n)
            colours, place = np.unique(row, axis=0, return_inverse=True)
            keys = [c.tobytes() for c in colours]
            new = [i for i, c in enumerate(keys) if c not in known]
            if new:
                if len(known) > 200_000:
                    known = {c: known[c] for c in keys if c in known}
                inks = np.floor(self.colours(low + colours[new] / top * (high - low), n) * top + 0.5).astype(kind)
                known |= {keys[i]: x for i, x in zip(new, inks, strict=True)}
            rows.append(np.stack([known[c] for c in keys])[place.ravel()].tobytes())
        keep = {k: x for k, x in d.items() if k not in (b"Filter", b"DecodeParms", b"Length", b"Decode", b"ColorSpace")}
        return Stream(keep | {b"ColorSpace": CMYK, b"Filter": Name(b"FlateDecode")}, deflate(b"".join(rows)))

    def shading(self, d: dict) -> dict | None:
        """A shading by a function in ink. Meshes that give colours by themselves are refused."""
        n = self.source(d.get(b"ColorSpace"))
        if not n:
            inner = None if isinstance(d.get(b"ColorSpace"), Ref) else self.space(d.get(b"ColorSpace"))
            return d | {b"ColorSpace": inner} if inner is not None else None
        kind, f = self.doc.get(d.get(b"ShadingType")), d.get(b"Function")
        if f is None:
            raise PdfError("unsupported-feature", f"shading of type {kind}")
        inputs = 2 if kind == 1 else 1
        default = [0, 1] * inputs
        domain = [float(self.doc.get(x)) for x in self.doc.get(d.get(b"Domain")) or default]
        if kind > 3:
            found = self.doc.get(f)
            first = self.doc.get(found[0]) if isinstance(found, list) else found
            own = first.dict if isinstance(first, Stream) else first
            domain = [float(self.doc.get(x)) for x in self.doc.get(own[b"Domain"])]
        g = Function(self.doc, f)
        extra = {}
        if isinstance(back := self.doc.get(d.get(b"Background")), list):
            extra[b"Background"] = self.colours(np.array([[float(self.doc.get(x)) for x in back]]), n)[0].tolist()
        return d | {b"ColorSpace": CMYK, b"Function": self.sampled(inputs, domain, lambda p: self.colours(np.array([g(p)]), n))} | extra

    # ------------------------------------------------------------ objects

    def resources(self, r: dict) -> dict:
        """Resources whose spaces and direct shadings are in ink, and whose graphics states have no transfer functions."""
        out = dict(r)
        spaces = self.doc.get(r.get(b"ColorSpace"))
        if isinstance(spaces, dict):
            if {b"DefaultGray", b"DefaultCMYK"} & set(spaces):
                raise PdfError("default-colour-space")
            fresh = {k: v if isinstance(v, Ref) or self.source(v) else self.space(v) or v for k, v in spaces.items()}  # what is referred to is an object of its own
            if fresh != spaces:
                out[b"ColorSpace"] = fresh
        shadings = self.doc.get(r.get(b"Shading"))
        if isinstance(shadings, dict):
            fresh = {k: (self.shading(v) or v) if isinstance(v, dict) else v for k, v in shadings.items()}
            if fresh != shadings:
                out[b"Shading"] = fresh
        return out

    def group(self, d: dict) -> dict:
        g = self.doc.get(d.get(b"Group"))
        if isinstance(g, dict) and self.source(g.get(b"CS")):
            return d | {b"Group": g | {b"CS": CMYK}}
        return d

    def run(self) -> dict[int, object]:
        doc = self.doc
        masks = set()  # groups of luminosity masks: their colours are weights and stay
        for num in doc.numbers():
            v = doc.load(num)
            d = v.dict if isinstance(v, Stream) else v
            states = doc.get(d.get(b"ExtGState")) if isinstance(d, dict) else None
            for g in [d, *(doc.get(x) for x in states.values())] if isinstance(states, dict) else [d]:
                m = doc.get(g.get(b"SMask")) if isinstance(g, dict) else None
                if isinstance(m, dict) and doc.get(m.get(b"S")) == b"Luminosity" and isinstance(m.get(b"G"), Ref):
                    masks.add(m[b"G"].num)
        inherited = {p.ref.num: doc.inherited(p, b"Resources")[0] for p in doc.pages}
        for page in doc.pages:
            if b"PieceInfo" in page.dict:
                raise PdfError("page-piece")
            r = doc.get(inherited[page.ref.num])
            r = r if isinstance(r, dict) else {}
            new = self.group(dict(page.dict))
            found = self.resources(r)
            if found != r:
                new[b"Resources"] = found
            content = self.content(b"\n".join(doc.contents(page)), r)
            if content is not None:
                new[b"Contents"] = self.add(Stream({b"Filter": Name(b"FlateDecode")}, deflate(content)))
            if new != page.dict:
                self.edits[page.ref.num] = new
        fallback = next((r for x in inherited.values() if isinstance(r := doc.get(x), dict)), {})  # of forms without resources
        drawn = self.drawn()
        for num in doc.numbers():
            v = doc.load(num)
            if num in self.edits or num in masks:
                continue
            new = self.object(num, v, drawn, fallback)
            if new is not None:
                self.edits[num] = new
        return self.edits

    def drawn(self) -> set[int]:
        """Procedures and appearances, whose own dictionaries needn't tell that they are content."""
        out: set[int] = set()
        for num in self.doc.numbers():
            v = self.doc.load(num)
            d = v.dict if isinstance(v, Stream) else v
            if isinstance(d, dict):
                each = [d.get(b"CharProcs")] if d.get(b"Subtype") == b"Type3" else []
                looks = self.doc.get(d.get(b"AP"))
                each += [looks.get(k) for k in (b"N", b"R", b"D")] if isinstance(looks, dict) else []
                for x in each:
                    if isinstance(x, Ref) and isinstance(self.doc.get(x), Stream):
                        out.add(x.num)
                    elif isinstance(x := self.doc.get(x), dict):
                        out |= {y.num for y in x.values() if isinstance(y, Ref)}
        return out

    def object(self, num: int, v, drawn: set[int], fallback: dict):
        d = v.dict if isinstance(v, Stream) else v
        if isinstance(d, list):
            return self.space(d) if d and self.doc.get(d[0]) in (b"Indexed", b"Separation", b"DeviceN", b"Pattern") else None
        if not isinstance(d, dict):
            return None
        if isinstance(v, Stream) and d.get(b"Subtype") == b"Image":
            return self.image(v)
        if b"ShadingType" in d:
            new = self.shading(d)
            return None if new is None else Stream(new, v.data) if isinstance(v, Stream) else new
        coloured = isinstance(v, Stream) and (d.get(b"Subtype") == b"Form" or num in drawn or (self.doc.get(d.get(b"PatternType")) == 1 and self.doc.get(d.get(b"PaintType")) != 2))
        if coloured:
            r = self.doc.get(d.get(b"Resources"))
            new = self.group(dict(d))
            if isinstance(r, dict) and not isinstance(d.get(b"Resources"), Ref) and (found := self.resources(r)) != r:
                new[b"Resources"] = found
            content = self.content(self.doc.decoded(v)[0], r if isinstance(r, dict) else fallback)
            if content is None:
                return Stream(new, v.data) if new != d else None
            keep = {k: x for k, x in new.items() if k not in (b"Filter", b"DecodeParms", b"Length")}
            return Stream(keep | {b"Filter": Name(b"FlateDecode")}, deflate(content))
        if d.get(b"Type") == b"ExtGState" or {b"TR", b"TR2", b"BG", b"BG2", b"UCR", b"UCR2"} & set(d):
            new = {k: x for k, x in d.items() if k not in (b"TR", b"TR2", b"BG", b"BG2", b"UCR", b"UCR2")}
            return new if new != d else None
        if isinstance(v, dict) and {b"ColorSpace", b"Shading"} & set(d) and not {b"Type", b"Subtype"} & set(d):
            new = self.resources(d)
            return new if new != d else None
        return None


def convert_document(data: bytes, target: bytes, source: bytes | None = None, convert: Convert | None = None, intent: str = "relative", pure_black: bool = True) -> bytes:
    """A file in the inks of a target profile. source: the profile of its red, green and blue, unless convert does that.

    Refused are target profiles that aren't for CMYK output, files with output intents or private data on their pages,
    default spaces for grey or ink, images and shadings that can't be decoded, and encrypted files.
    """
    from .edit import save

    doc = Document(data)
    head = icc_header(target)
    if head["class"] != "prtr" or head["space"] != "CMYK":
        raise PdfError("invalid-profile", "no CMYK output profile")
    if doc.get(doc.catalog.get(b"OutputIntents")):
        raise PdfError("has-output-intent")
    if b"PieceInfo" in doc.catalog:
        raise PdfError("page-piece")
    if convert is None:
        if source is None:
            raise PdfError("invalid-profile", "no source")
        convert = icc.transform(icc.Profile(source), icc.Profile(target), intent)
    return save(doc, Inks(doc, convert, pure_black).run())
