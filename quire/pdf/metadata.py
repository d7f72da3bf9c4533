"""Metadata of a file: the information dictionary, the packet, and how the two agree."""

from __future__ import annotations

import re
from bisect import bisect_right

from . import xmp
from .document import text_string
from .objects import PdfError, Ref, Stream, Name

#: Information keys and the properties of the packet that they map to.
MAPPING = [
    ("Title", "{http://purl.org/dc/elements/1.1/}title"), ("Author", "{http://purl.org/dc/elements/1.1/}creator"), ("Subject", "{http://purl.org/dc/elements/1.1/}description"),
    ("Keywords", "{http://ns.adobe.com/pdf/1.3/}Keywords"), ("Creator", "{http://ns.adobe.com/xap/1.0/}CreatorTool"), ("Producer", "{http://ns.adobe.com/pdf/1.3/}Producer"),
    ("CreationDate", "{http://ns.adobe.com/xap/1.0/}CreateDate"), ("ModDate", "{http://ns.adobe.com/xap/1.0/}ModifyDate"), ("Trapped", "{http://ns.adobe.com/pdf/1.3/}Trapped"),
]


def iso_date(pdf_date: str) -> str:
    """A document date in the packet's notation, to the same precision; other text as it is."""
    m = re.match(r"D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(Z|[+-]\d\d'?\d\d)?", pdf_date)
    if not m:
        return pdf_date
    y, mo, d, h, mi, s, z = m.groups()
    out = "-".join(x for x in (y, mo, d) if x)
    if h:
        out += f"T{h}:{mi or '00'}:{s or '00'}" + ((z if z == "Z" else f"{z[:3]}:{z[-2:]}") if z else "")
    return out


def read_packet(data: bytes) -> dict[str, list[str]]:
    """Property name to its values; what is not a packet, or has a DOCTYPE, is refused."""
    return xmp.read(data)


def all_properties(doc) -> dict[str, list[str]]:
    """Every property of the document's packet; none if it can't be read."""
    stream = doc.get(doc.catalog.get(b"Metadata"))
    try:
        return read_packet(doc.decoded(stream)[0]) if isinstance(stream, Stream) else {}
    except PdfError:
        return {}


def properties(doc) -> tuple[list[dict], list[str]]:
    """A row for each mapped key, and findings."""
    findings: list[str] = []
    info = doc.get(doc.trailer.get(b"Info"))
    info = info if isinstance(info, dict) else {}
    stream = doc.get(doc.catalog.get(b"Metadata"))
    packet: dict[str, list[str]] = {}
    if isinstance(stream, Stream):
        try:
            packet = read_packet(doc.decoded(stream)[0])
        except PdfError as e:
            findings.append(e.code)
    rows = []
    for key, name in MAPPING:
        raw = doc.get(info.get(key.encode()))
        own = raw.decode("latin-1") if isinstance(raw, Name) else text_string(raw)
        rows.append({"key": key, "info": own or None, "xmp": [x for x in packet.get(name, []) if x] or None})
    held = doc.catalog.get(b"Metadata")
    for num in doc.numbers():
        try:
            s = doc.load(num)
        except PdfError:
            continue
        if isinstance(s, Stream) and s.dict.get(b"Type") == b"Metadata" and not (isinstance(held, Ref) and held.num == num):
            findings.append(f"other-packet:{num}")
    return rows, findings


def signed(doc) -> bool:
    """Whether a signature field holds a value. Each field is asked once, however often others name it."""
    form = doc.get(doc.catalog.get(b"AcroForm"))
    todo = list(doc.get(form.get(b"Fields")) or []) if isinstance(form, dict) else []
    seen: set[int] = set()
    while todo:
        raw = todo.pop()
        if isinstance(raw, Ref):
            if raw.num in seen:
                continue
            seen.add(raw.num)
        f = doc.get(raw)
        if isinstance(f, dict):
            if f.get(b"FT") == b"Sig" and doc.get(f.get(b"V")) is not None:
                return True
            todo += list(doc.get(f.get(b"Kids")) or [])
    return False


HEADER = b"<?xpacket begin="


def scan_packets(doc) -> dict[str, int]:
    """Headers of packets that a scan of the file's bytes finds, by place: in the document's stream, in other metadata
    streams, in further streams, or in no object that counts. Filtered metadata streams count by their decoded data."""
    place = doc.catalog.get(b"Metadata")
    out = {"document": 0, "others": 0, "streams": 0, "superseded": 0}
    roles: dict[int, str] = {}
    decoded: set[int] = set()
    for num in doc.numbers():
        try:
            v = doc.load(num)
        except PdfError:
            continue
        if isinstance(v, Stream) and v.dict.get(b"Type") == b"Metadata":
            roles[num] = "document" if isinstance(place, Ref) and place.num == num else "others"
            if b"Filter" in v.dict:
                decoded.add(num)
                try:
                    out[roles[num]] += doc.decoded(v)[0].count(HEADER)
                except PdfError:
                    pass
    spans = sorted((doc.base + e[1], num) for num, e in doc.index.items() if e[0] == "file")
    at = doc.data.find(HEADER)
    while at >= 0:
        k = bisect_right(spans, (at, 1 << 62)) - 1
        end = doc.data.find(b"endobj", at) if k >= 0 else -1
        last = spans[k + 1][0] if 0 <= k < len(spans) - 1 else len(doc.data)
        begun = doc.data.find(b"endobj", spans[k][0], at) if k >= 0 else 0
        if k < 0 or end < 0 or end > last or begun >= 0:
            out["superseded"] += 1
        elif spans[k][1] not in decoded:
            out[roles.get(spans[k][1], "streams")] += 1
        at = doc.data.find(HEADER, at + 1)
    return out
