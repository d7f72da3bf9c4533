"""One PDF file: its cross-reference sections, objects, pages and what pages inherit."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import filters
from .objects import Invalid, Keyword, Name, PdfError, Reader, Ref, Stream, Str, serialize

OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,10})[\0\t\n\f\r ]+obj(?![A-Za-z])")
BOXES = (b"MediaBox", b"CropBox", b"BleedBox", b"TrimBox", b"ArtBox")
INHERITED = (b"Resources", b"MediaBox", b"CropBox", b"Rotate")


ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])(?: \r| \n|\r\n)")


@dataclass
class Page:
    ref: Ref
    dict: dict
    parents: list


class Document:
    """Reads a file as its cross-reference says, or, where that fails, by a scan for objects."""

    def __init__(self, data: bytes, recovery: str = "strict"):
        self.data, self.recovery = data, recovery
        self.warnings: list[tuple[str, str]] = []
        self.sections: list[dict] = []
        self.index: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.status = "intact"
        self._cache: dict[int, object] = {}
        self._members: dict[int, dict] = {}
        head = data.find(b"%PDF-", 0, 4096)
        self.header = data[head + 5 : head + 8].decode("latin-1") if head >= 0 else None
        self.base = max(head, 0)
        if head < 0:
            self.warn("missing-header")
        elif head:
            self.warn("junk-before-header", str(head))
        try:
            try:
                self._read(self.base)
            except PdfError:
                if not self.base:
                    raise
                self.base = 0
                self._read(0)
            self.pages = self._pages()
            if any(w not in ("junk-before-header", "missing-header") for w, _ in self.warnings):
                self.status = "tolerated"
        except PdfError as e:
            if e.code in ("encrypted-document", "nesting-limit", "size-limit"):
                raise
            self.warn("rebuilt", e.code)
            self._rebuild()
            self.status = "reconstructed"
            self.pages = self._pages()

    def warn(self, code: str, detail: str = "") -> None:
        self.warnings.append((code, detail))

    # ------------------------------------------------------------ structure

    def _read(self, base: int) -> None:
        self.sections, self.index, self._cache, self._members = [], {}, {}, {}
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("missing-startxref")
        start = Reader(self.data, at + 9).token()
        if type(start) is not int:
            raise PdfError("bad-startxref")
        seen: set[int] = set()
        todo = [start]
        while todo:
            offset = todo.pop(0)
            if offset in seen:
                self.warn("xref-cycle", str(offset))
                continue
            seen.add(offset)
            section = self._section(offset + base)
            self.sections.append(section | {"offset": offset})
            t = section["trailer"]
            more = [x for x in (t.get(b"XRefStm"), t.get(b"Prev")) if type(x) is int]
            todo = more + todo
        for s in self.sections:  # the first section that names an object wins
            for num, entry in s["entries"].items():
                self.index.setdefault(num, entry)
        self.trailer = self.sections[0]["trailer"]
        if b"Encrypt" in self.trailer:
            raise PdfError("encrypted-document")
        root = self.get(self.trailer.get(b"Root"))
        if not isinstance(root, dict):
            raise PdfError("missing-catalog")
        self.catalog = root

    def _section(self, at: int) -> dict:
        if not 0 <= at < len(self.data):
            raise PdfError("bad-xref-offset", str(at))
        r = Reader(self.data, at)
        first = r.token()
        if first == b"xref":
            entries: dict[int, tuple] = {}
            while True:
                t = r.token()
                if t == b"trailer":
                    break
                count = r.token()
                if type(t) is not int or type(count) is not int:
                    raise PdfError("bad-xref-section", str(r.at))
                r.space()
                rows = ENTRY.findall(data := self.data[r.at : r.at + 20 * count])
                if count > 0 and len(rows) == count and len(data) == 20 * count:  # as the standard lays them out
                    for k, (offset, gen, kind) in enumerate(rows, t):
                        entries.setdefault(k, ("file" if kind == b"n" else "free", int(offset), int(gen)))
                    r.at += 20 * count
                    continue
                for k in range(count):
                    offset, gen, kind = r.token(), r.token(), r.token()
                    if type(offset) is not int or type(gen) is not int or kind not in (b"n", b"f"):
                        raise PdfError("bad-xref-entry", str(r.at))
                    entries.setdefault(t + k, ("file", offset, gen) if kind == b"n" else ("free", offset, gen))
            trailer = r.object()
            if not isinstance(trailer, dict):
                raise PdfError("bad-trailer")
            return {"kind": "classic", "entries": entries, "trailer": trailer}
        if type(first) is int:
            _, _, s = self._indirect(at)
            if isinstance(s, Stream) and s.dict.get(b"Type") == b"XRef":
                return {"kind": "stream", "entries": self._xref_stream(s), "trailer": s.dict}
        raise PdfError("bad-xref-section", str(at))

    def _xref_stream(self, s: Stream) -> dict[int, tuple]:
        raw, widths = self.decoded(s)[0], s.dict.get(b"W")
        if not isinstance(widths, list) or len(widths) < 3:
            raise PdfError("bad-xref-stream")
        index = s.dict.get(b"Index", [0, s.dict.get(b"Size", 0)])
        out: dict[int, tuple] = {}
        at, step = 0, sum(widths)
        for first, count in zip(index[::2], index[1::2], strict=True):
            for num in range(first, first + count):
                row = raw[at : at + step]
                if len(row) < step:
                    self.warn("short-xref-stream")
                    return out
                at += step
                f, k = [], 0
                for w in widths[:3]:
                    f.append(int.from_bytes(row[k : k + w], "big") if w else None)
                    k += w
                kind = 1 if f[0] is None else f[0]
                out.setdefault(num, {0: ("free", f[1], f[2]), 1: ("file", f[1], f[2] or 0), 2: ("compressed", f[1], f[2] or 0)}.get(kind, ("free", 0, 0)))
        return out

    def _rebuild(self) -> None:
        """Every object found by a scan; a later copy outranks an earlier one."""
        self.sections, self.index, self._cache, self._members, self.base = [], {}, {}, {}, 0
        found: dict[int, list[tuple]] = {}
        trailers = []
        for m in OBJ.finditer(self.data):
            found.setdefault(int(m[1]), []).append(("file", m.start(), int(m[2])))
        for m in re.finditer(rb"trailer", self.data):
            t = Reader(self.data, m.end()).object()
            if isinstance(t, dict):
                trailers.append(t)
        ambiguous = []
        for num, copies in found.items():
            if len(copies) > 1:
                texts = set()
                for c in copies:
                    try:
                        texts.add(serialize(self._indirect(c[1])[2]))
                    except (PdfError, TypeError):
                        texts.add(b"?%d" % c[1])
                if len(texts) > 1:
                    ambiguous.append(num)
            self.index[num] = copies[-1]
        if ambiguous and self.recovery != "latest":
            raise PdfError("ambiguous-copies", ",".join(map(str, ambiguous[:20])))
        for num in list(found):
            s = self.get(Ref(num, self.index[num][2]))
            if isinstance(s, Stream) and s.dict.get(b"Type") == b"ObjStm":
                for k, (member, _) in enumerate(self._object_stream(num)["order"]):
                    if member not in found:
                        self.index[member] = ("compressed", num, k)
            elif isinstance(s, Stream) and s.dict.get(b"Type") == b"XRef":
                trailers.append(s.dict)
        for t in reversed(trailers):
            if isinstance(self.get(t.get(b"Root")), dict):
                self.trailer = t
                break
        else:
            roots = [n for n in self.index if isinstance(o := self.get(Ref(n, self._gen(n))), dict) and o.get(b"Type") == b"Catalog" and b"Pages" in o]
            if not roots:
                raise PdfError("missing-catalog")
            self.trailer = {b"Root": Ref(roots[-1], self._gen(roots[-1]))}
        if b"Encrypt" in self.trailer:
            raise PdfError("encrypted-document")
        self.catalog = self.get(self.trailer[b"Root"])

    def _gen(self, num: int) -> int:
        e = self.index.get(num)
        return e[2] if e and e[0] == "file" else 0

    # ------------------------------------------------------------ objects

    def _indirect(self, at: int):
        r = Reader(self.data, at)
        num, gen, word = r.token(), r.token(), r.token()
        if type(num) is not int or type(gen) is not int or word != b"obj":
            raise PdfError("bad-object-header", str(at))
        value = r.object()
        if isinstance(value, Keyword):
            value = None if value == b"endobj" else Invalid(bytes(value), "keyword")
        after = r.at
        word = r.token()
        if word == b"stream" and isinstance(value, dict):
            begin = r.at
            if self.data[begin : begin + 2] == b"\r\n":
                begin += 2
            elif self.data[begin : begin + 1] in (b"\n", b"\r"):
                begin += 1
            n = value.get(b"Length")
            if isinstance(n, Ref):
                e = self.index.get(n.num)
                n = self._indirect(e[1] + self.base)[2] if e and e[0] == "file" else self.get(n)
            if type(n) is not int or n < 0 or Reader(self.data, begin + n).token() != b"endstream":
                end = self.data.find(b"endstream", begin)
                if end < 0:
                    raise PdfError("unterminated-stream", str(at))
                n = end - begin
                n -= 2 if self.data[end - 2 : end] == b"\r\n" else 1 if self.data[end - 1 : end] in (b"\n", b"\r") else 0
                self.warn("stream-length", str(num))
            value = Stream(value, self.data[begin : begin + max(n, 0)])
        elif word != b"endobj":
            self.warn("missing-endobj", str(num))
            r.at = after
        for code, _ in r.warnings:
            self.warn(code, str(num))
        return num, gen, value

    def _object_stream(self, num: int) -> dict:
        if num not in self._members:
            s = self.get(Ref(num, self._gen(num)))
            if not isinstance(s, Stream):
                raise PdfError("bad-object-stream", str(num))
            raw, first, count = self.decoded(s)[0], s.dict.get(b"First", 0), s.dict.get(b"N", 0)
            head = Reader(raw)
            order = [(head.token(), head.token()) for _ in range(count)]
            self._members[num] = {"raw": raw, "first": first, "order": order}
        return self._members[num]

    def load(self, num: int):
        """The object of that number, read once; a missing or free one is null."""
        if num not in self._cache:
            self._cache[num] = None  # a reference to itself reads as null
            e = self.index.get(num)
            if e and e[0] == "file":
                found, _, value = self._indirect(e[1] + self.base)
                if found != num:
                    raise PdfError("object-number-mismatch", f"{num}: {found}")
                self._cache[num] = value
            elif e and e[0] == "compressed":
                m = self._object_stream(e[1])
                place = {n: o for n, o in m["order"]}.get(num)
                if type(place) is int:
                    value = Reader(m["raw"], m["first"] + place).object()
                    self._cache[num] = None if isinstance(value, Keyword) else value
        return self._cache[num]

    def get(self, v):
        """What a value refers to."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.load(v.num) if self._gen(v.num) == v.gen else None
        return None

    def decoded(self, s: Stream) -> tuple[bytes, list[str]]:
        f, p = self.get(s.dict.get(b"Filter", s.dict.get(b"F"))), self.get(s.dict.get(b"DecodeParms", s.dict.get(b"DP")))
        fs = [] if f is None else [self.get(x) for x in f] if isinstance(f, list) else [f]
        ps = [] if p is None else [self.get(x) for x in p] if isinstance(p, list) else [p]
        ps = [{k: self.get(v) for k, v in x.items()} if isinstance(x, dict) else x for x in ps]
        return filters.decode(s.data, fs, ps)

    def numbers(self) -> list[int]:
        return sorted(n for n, e in self.index.items() if e[0] != "free")

    # ------------------------------------------------------------ pages

    def _pages(self) -> list[Page]:
        out: list[Page] = []
        seen: set[int] = set()

        def walk(ref, parents: list) -> None:
            node = self.get(ref)
            if not isinstance(ref, Ref) or not isinstance(node, dict):
                raise PdfError("bad-page-tree")
            if ref.num in seen:
                raise PdfError("page-tree-cycle", str(ref.num))
            seen.add(ref.num)
            kids = self.get(node.get(b"Kids"))
            kind = node.get(b"Type") or (b"Pages" if b"Kids" in node else b"Page")
            if kind == b"Pages":
                if not isinstance(kids, list):
                    raise PdfError("bad-page-tree", "Kids")
                before = len(out)
                for k in kids:
                    walk(k, [(ref, node), *parents])
                if self.get(node.get(b"Count")) != len(out) - before:
                    self.warn("page-count-mismatch", str(ref.num))
            else:
                out.append(Page(ref, node, parents))

        walk(self.catalog.get(b"Pages"), [])
        return out

    def inherited(self, page: Page, key: bytes):
        """(value, depth) of the page's own (0) or nearest ancestor's entry; (None, None) without one."""
        for depth, node in enumerate([page.dict, *[n for _, n in page.parents]]):
            if (v := self.get(node.get(key))) is not None:
                return v, depth
        return None, None

    def boxes(self, page: Page) -> dict[str, tuple[list[float] | None, bool]]:
        """Each box's effective rectangle, and whether the page or an ancestor names it. Crop falls back to Media, the others to Crop."""
        out: dict[str, tuple[list[float] | None, bool]] = {}
        for key in BOXES:
            v = self.inherited(page, key)[0] if key in INHERITED else self.get(page.dict.get(key))
            rect = None
            if isinstance(v, list) and len(v) == 4:
                n = [self.get(x) for x in v]
                if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in n):
                    rect = [float(min(n[0], n[2])), float(min(n[1], n[3])), float(max(n[0], n[2])), float(max(n[1], n[3]))]
            name = key.decode()
            back = None if key == b"MediaBox" else out["MediaBox"][0] if key == b"CropBox" else out["CropBox"][0] if out["CropBox"] else None
            out[name] = (rect if rect is not None else back, rect is not None)
        return out

    def contents(self, page: Page) -> list[bytes]:
        v = self.get(page.dict.get(b"Contents"))
        parts = [self.get(x) for x in v] if isinstance(v, list) else [v]
        return [self.decoded(s)[0] for s in parts if isinstance(s, Stream)]


def text_string(v) -> str | None:
    """A text string: UTF-16BE or UTF-8 after their marks, else one byte a character."""
    if not isinstance(v, Str):
        return None
    if v.data[:2] == b"\xfe\xff":
        return v.data[2:].decode("utf-16-be", "replace")
    if v.data[:3] == b"\xef\xbb\xbf":
        return v.data[3:].decode("utf-8", "replace")
    return "".join(PDF_DOC.get(c, chr(c)) for c in v.data)


#: Bytes that stand for other characters than in Latin-1, in text strings.
PDF_DOC = dict(zip([*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0], "˘ˇˆ˙˝˛˚˜•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž€", strict=True))


def nodes(v, path: str = "", depth: int = 0, ordinal: int = 0):
    """(path, depth, ordinal, kind, number, bytes, reference) of a value and all in it."""
    key = lambda k: k.decode("latin-1").replace("~", "~0").replace("/", "~1")
    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "real" if isinstance(v, float) else {Name: "name", Str: "string", Ref: "reference", Invalid: "invalid", list: "array", dict: "dictionary", Stream: "stream"}[type(v)]
    number = float(v) if kind in ("integer", "real", "boolean") else None
    raw = bytes(v) if kind == "name" else v.data if kind in ("string", "invalid") else None
    yield path, depth, ordinal, kind, number, raw, v if kind == "reference" else None
    if kind == "array":
        for k, x in enumerate(v):
            yield from nodes(x, f"{path}/{k}", depth + 1, k)
    elif kind in ("dictionary", "stream"):
        for k, (n, x) in enumerate((v.dict if kind == "stream" else v).items()):
            yield from nodes(x, f"{path}/{key(n)}", depth + 1, k)
