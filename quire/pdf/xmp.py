"""Metadata packets: tokens of their XML under limits, the properties of their RDF, and replacing some of these in place.

Written from the XML 1.0 and XMP specifications. A DOCTYPE, an entity beyond the five predefined ones and text that is
not well-formed are refused, in whatever encoding and wherever they stand.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from .objects import PdfError

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"
#: The limits of a packet, and the five predefined entities.
TOKENS, DEPTH, ATTRIBUTES = 160_000, 64, 256
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "apos": "'", "quot": '"'}
NAME = r"[A-Za-z_:\u0080-\U0010ffff][\w.:\u0080-\U0010ffff-]*"
TAG = re.compile(rf"<(/?)({NAME})")
ATTRIBUTE = re.compile(rf"""[ \t\r\n]+({NAME})[ \t\r\n]*=[ \t\r\n]*("[^"<]*"|'[^'<]*')""")
INVALID = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")


def decode(data: bytes) -> tuple[str, str]:
    """The text of a packet and its encoding, told by a byte order mark or by where the first characters have zeros."""
    for mark, name in ((codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF8, "utf-8")):
        if data.startswith(mark):
            break
    else:
        zero = tuple(b == 0 for b in data[:4])
        name = {(True, True, True, False): "utf-32-be", (False, True, True, True): "utf-32-le", (True, False, True, False): "utf-16-be", (False, True, False, True): "utf-16-le"}.get(zero, "utf-8")
    try:
        return data.decode(name).rstrip("\0"), name
    except UnicodeDecodeError as e:
        raise PdfError("xmp-malformed", "encoding") from e


def _plain(raw: str) -> str:
    """Text with its references resolved."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body is None:
            raise PdfError("xmp-malformed", "ampersand")
        if number := re.fullmatch(r"#(?:([0-9]+)|x([0-9A-Fa-f]+))", body):
            code = int(number[1]) if number[1] else int(number[2], 16)
            if code > 0x10FFFF or INVALID.match(chr(code)):
                raise PdfError("xmp-malformed", "character")
            return chr(code)
        if body not in ENTITIES:
            raise PdfError("xmp-entity", body)
        return ENTITIES[body]

    return re.sub(r"&(?:([^;&<]*);)?", one, raw)


@dataclass
class Element:
    """An element with where it stands in the text; inner: where its content ends."""

    name: tuple[str, str]
    attributes: list[tuple[tuple[str, str], str, int, int]]
    start: int
    end: int = 0
    inner: int = 0
    closed: bool = False
    children: list[Element] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def get(self, space: str, local: str) -> str | None:
        return next((v for n, v, _, _ in self.attributes if n == (space, local)), None)

    def walk(self) -> Iterator[Element]:
        yield self
        for c in self.children:
            yield from c.walk()


def parse(text: str) -> list[Element]:
    """The top elements of a text: one, or none if it holds no element."""
    if bad := INVALID.search(text.removeprefix("﻿")):
        raise PdfError("xmp-malformed", f"character {bad[0]!r}")
    tops: list[Element] = []
    open_: list[tuple[Element, str, dict[str, str]]] = []
    at, count = 0, 0
    spaces = {"xml": XML, "": ""}

    def resolve(name: str, known: dict[str, str], default: bool) -> tuple[str, str]:
        prefix, _, local = name.rpartition(":")
        if not prefix and not default:
            return "", local
        if prefix not in known:
            raise PdfError("xmp-malformed", f"prefix {prefix}")
        return known[prefix], local

    while at < len(text):
        count += 1
        if count > TOKENS:
            raise PdfError("xmp-too-many-tokens")
        if text[at] != "<":
            end = text.find("<", at)
            end = len(text) if end < 0 else end
            part = text[at:end]
            if open_:
                open_[-1][0].parts.append(_plain(re.sub("\r\n?", "\n", part)))
            elif part.strip("﻿ \t\r\n\0"):
                raise PdfError("xmp-malformed", "text outside")
            at = end
            continue
        skipped = next(((a, z) for a, z in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")) if text.startswith(a, at)), None)
        if skipped:
            end = text.find(skipped[1], at + len(skipped[0]))
            if end < 0 or (skipped[0] == "<![CDATA[" and not open_):
                raise PdfError("xmp-malformed", skipped[0])
            if skipped[0] == "<![CDATA[":
                open_[-1][0].parts.append(text[at + 9 : end])
            at = end + len(skipped[1])
            continue
        if text.startswith("<!", at):
            raise PdfError("xmp-doctype" if text.startswith("<!DOCTYPE", at) else "xmp-malformed", "declaration")
        m = TAG.match(text, at)
        if not m:
            raise PdfError("xmp-malformed", "tag")
        if m[1]:
            end = re.compile(r"[ \t\r\n]*>").match(text, m.end())
            if not open_ or not end or open_[-1][1] != m[2]:
                raise PdfError("xmp-malformed", f"end of {m[2]}")
            element, _, _ = open_.pop()
            element.inner, element.end, at = at, end.end(), end.end()
            continue
        if tops and not open_:
            raise PdfError("xmp-malformed", "second root")
        raw: list[tuple[str, str, int, int]] = []
        place = m.end()
        while a := ATTRIBUTE.match(text, place):
            raw.append((a[1], _plain(re.sub("[\t\r\n]", " ", a[2][1:-1])), a.start(), a.end()))
            place = a.end()
            if len(raw) > ATTRIBUTES:
                raise PdfError("xmp-too-many-attributes")
        close = re.compile(r"[ \t\r\n]*(/?)>").match(text, place)
        if not close or len({n for n, *_ in raw}) < len(raw):
            raise PdfError("xmp-malformed", f"start of {m[2]}")
        known = dict(open_[-1][2] if open_ else spaces)
        known |= {n[6:]: v for n, v, *_ in raw if n.startswith("xmlns:")} | {"": v for n, v, *_ in raw if n == "xmlns"}
        own = [(resolve(n, known, False), v, s, e) for n, v, s, e in raw if n != "xmlns" and not n.startswith("xmlns:")]
        element = Element(resolve(m[2], known, True), own, at)
        (open_[-1][0].children if open_ else tops).append(element)
        at = close.end()
        if close[1]:
            element.inner, element.end, element.closed = close.start(), at, True
        else:
            if len(open_) >= DEPTH:
                raise PdfError("xmp-too-deep")
            open_.append((element, m[2], known))
    if open_:
        raise PdfError("xmp-malformed", "open element")
    return tops


def _name(n: tuple[str, str]) -> str:
    return f"{{{n[0]}}}{n[1]}" if n[0] else n[1]


def _values(p: Element, name: str, out: dict[str, list[str]]) -> None:
    """A property's values; those of a structure's fields under the property's name and theirs."""
    inner = [c for c in p.children if c.name[0] == RDF and c.name[1] in ("Alt", "Seq", "Bag")]
    if inner:
        items = [c for c in inner[0].children if c.name == (RDF, "li")]
        plain = [(i.get(RDF, "resource") or i.text.strip() if not i.children else "", i.get(XML, "lang")) for i in items]
        if inner[0].name[1] == "Alt":
            plain = ([x for x in plain if x[1] == "x-default"] or plain)[:1]
        out[name] = [x for x, _ in plain]
        for k, i in enumerate(items):
            if i.children or any(n[0] not in ("", XML, RDF) for n, *_ in i.attributes):
                _fields(i, f"{name}[{k + 1}]", out)
        return
    nested = next((c for c in p.children if c.name == (RDF, "Description")), None)
    if p.get(RDF, "parseType") == "Resource" or nested is not None or (not p.children and any(n[0] not in ("", XML, RDF) for n, *_ in p.attributes)):
        value = next((c for c in (nested or p).children if c.name == (RDF, "value")), None)
        if value is not None:  # a value with qualifiers
            out[name] = [value.text]
        _fields(nested or p, name, out)
        return
    out[name] = [p.get(RDF, "resource") or p.text]


def _fields(p: Element, name: str, out: dict[str, list[str]]) -> None:
    p = next((c for c in p.children if c.name == (RDF, "Description")), p)
    for n, v, _, _ in p.attributes:
        if n[0] not in ("", XML, RDF):
            out[f"{name}/{_name(n)}"] = [v]
    for c in p.children:
        if c.name != (RDF, "value"):
            _values(c, f"{name}/{_name(c.name)}", out)


def descriptions(text: str) -> tuple[Element, list[Element]]:
    """The RDF element and its descriptions."""
    rdf = next((e for top in parse(text) for e in top.walk() if e.name == (RDF, "RDF")), None)
    if rdf is None:
        raise PdfError("xmp-malformed", "no RDF")
    return rdf, [c for c in rdf.children if c.name == (RDF, "Description")]


def read(data: bytes) -> dict[str, list[str]]:
    """Property name, as {namespace}name, to its values: one of a text, all of a list, the default language's of alternatives."""
    out: dict[str, list[str]] = {}
    for d in descriptions(decode(data)[0])[1]:
        out |= {_name(n): [v] for n, v, _, _ in d.attributes if n[0] not in ("", RDF, XML)}
        for p in d.children:
            _values(p, _name(p.name), out)
    return out


def written_value(name: str, value: str, kind: str) -> str:
    """A property as an element with its own namespace: kind is text, alt or seq."""
    space, local = name[1:].split("}")
    body = escape(value)
    inner = {"text": body, "alt": f'<rdf:Alt><rdf:li xml:lang="x-default">{body}</rdf:li></rdf:Alt>', "seq": f"<rdf:Seq><rdf:li>{body}</rdf:li></rdf:Seq>"}[kind]
    return f"<v:{local} xmlns:v={quoteattr(space)}>{inner}</v:{local}>"


def described(values: list[tuple[str, str, str]], about: str = "") -> str:
    return f'<rdf:Description xmlns:rdf="{RDF}" rdf:about={quoteattr(about)}>' + "".join(written_value(*v) for v in values) + "</rdf:Description>"


def packet(values: list[tuple[str, str, str]], padding: int = 2048) -> bytes:
    """A new packet that holds (name, value, kind)."""
    lines = (" " * 99 + "\n") * (padding // 100)
    return f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}">{described(values)}</rdf:RDF></x:xmpmeta>\n{lines}<?xpacket end="w"?>'.encode()


def splice(data: bytes, values: list[tuple[str, str, str]], managed: set[str], same: Callable[[str, list[str]], bool] | None = None) -> bytes:
    """A packet in UTF-8 in which the managed properties are gone and the given ones stand in a new description.

    Everything else is copied as it is. The result is read again; if it doesn't hold the values, it is refused.
    """
    text, kind = decode(data)
    rdf, each = descriptions(text)
    gone: list[tuple[int, int]] = []
    about = ""
    for d in each:
        about = about or d.get(RDF, "about") or ""
        gone += [(s, e) for n, _, s, e in d.attributes if _name(n) in managed]
        gone += [(c.start, c.end) for c in d.children if _name(c.name) in managed]
    fresh = described(values, about)
    out, at = [], 0
    for s, e in sorted(gone):
        if s >= at:
            out.append(text[at:s].rstrip(" \t\r\n") if text[s] == "<" else text[at:s])
            at = e
    if rdf.closed:
        tag = TAG.match(text, rdf.start)[2]
        out += [text[at : rdf.inner], ">", fresh, f"</{tag}>", text[rdf.end :]]
    else:
        out += [text[at : rdf.inner], fresh, text[rdf.inner :]]
    result = "".join(out)
    if kind != "utf-8":
        result = re.sub(r"(<\?xml[^>]*encoding=)([\"'])[^\"']*\2", r"\1\2UTF-8\2", result.removeprefix("﻿"), count=1)
    found = read(result.encode())
    want = {n: v for n, v, _ in values}
    if any(found.get(n, []) != ([want[n]] if n in want else []) for n in managed):
        raise PdfError("xmp-unreadable", "the edited packet does not hold its values")
    return result.encode()
