"""Edits of single files: a file's bytes in, another's out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from . import metadata, xmp
from .builder import append_content
from .content import operations
from .document import Document
from .filters import deflate
from .images import icc_header
from .objects import Name, PdfError, Ref, Str, Stream, number_text, serialize
from .write import rewrite, update


def save(doc: Document, edits: dict[int, object], mode: str = "auto") -> bytes:
    """The source with an update where it was read as it is, else a rewrite. Boxes that break what a page may have stop the save."""
    for num, v in edits.items():
        if isinstance(v, dict) and v.get(b"Type") == b"Page":
            check_boxes(doc, num, v)
    return update(doc, edits) if mode == "incremental" or (mode == "auto" and doc.status == "intact") else rewrite(doc, edits)


def check_boxes(doc: Document, num: int, page: dict) -> None:
    for key in (b"MediaBox", b"CropBox", b"BleedBox", b"TrimBox", b"ArtBox"):
        box = doc.get(page.get(key))
        box = [doc.get(x) for x in box] if isinstance(box, list) else box
        if box is not None and (not isinstance(box, list) or len(box) != 4 or not all(isinstance(x, (int, float)) for x in box) or box[0] >= box[2] or box[1] >= box[3]):
            raise PdfError("invalid-box", f"{num} {key.decode()}")


def set_boxes(data: bytes, boxes: dict[str, list[float]], pages: list[int] | None = None) -> bytes:
    """Gives pages the named boxes; None takes one away."""
    doc, edits = Document(data), {}
    for k, page in enumerate(doc.pages):
        if pages is None or k in pages:
            entries = {b: v for b, v in page.dict.items() if b.decode("latin-1") not in boxes}
            edits[page.ref.num] = entries | {b.encode(): v for b, v in boxes.items() if v is not None}
    return save(doc, edits)


def prepare_pages(data: bytes, group: bool = True) -> bytes:
    """Gives a TrimBox, the size of the crop box, to pages that have neither that nor an ArtBox; and, unless told
    otherwise, a transparency group in ink to pages that have none."""
    doc, edits = Document(data), {}
    for page in doc.pages:
        boxes, new = doc.boxes(page), dict(page.dict)
        if not boxes["TrimBox"][1] and not boxes["ArtBox"][1] and boxes["CropBox"][0]:
            new[b"TrimBox"] = boxes["CropBox"][0]
        if group and b"Group" not in new:
            new[b"Group"] = {b"Type": Name(b"Group"), b"S": Name(b"Transparency"), b"CS": Name(b"DeviceCMYK")}
        if new != page.dict:
            edits[page.ref.num] = new
    return save(doc, edits)


def draw_on(data: bytes, draw: Callable, pages: list[int] | None = None) -> bytes:
    """A file with more drawn on its pages, by calls of a builder's content."""
    doc = Document(data)
    return save(doc, _drawn(doc, draw, pages))


def _drawn(doc: Document, draw: Callable, pages: list[int] | None) -> dict[int, object]:
    """The edits of several pages, each with numbers of its own."""
    edits: dict[int, object] = {}
    step = 0
    first = max(doc.index, default=0) + 1
    for k, page in enumerate(doc.pages):
        if pages is None or k in pages:
            for num, v in append_content(doc, page, draw).items():
                if isinstance(v, dict):
                    v = v | {b"Contents": [Ref(x.num + step, 0) if isinstance(x, Ref) and x.num >= first else x for x in v[b"Contents"]]}
                edits[num if num == page.ref.num else num + step] = v
            step += 2
    return edits


def write_pdfx_metadata(data: bytes, title: str, trapped: bool = False, identifiers: tuple[str, str] | None = None) -> bytes:
    """Sets what PDF/X-4 asks of metadata on both sides: a title, trapping, the version, and identifiers of the document and this copy of it."""
    out = set_metadata(data, {"Title": title, "Trapped": "True" if trapped else "False"})
    doc = Document(out)
    held = doc.catalog[b"Metadata"]
    stream = doc.get(held)
    one, two = identifiers or tuple(f"uuid:{hashlib.md5(data + bytes([k])).hexdigest()}" for k in range(2))
    mm, px = "{http://ns.adobe.com/xap/1.0/mm/}", "{http://www.npes.org/pdfx/ns/id/}"
    rows = [(px + "GTS_PDFXVersion", "PDF/X-4", "text"), (mm + "DocumentID", one, "text"), (mm + "InstanceID", two, "text"), (mm + "VersionID", "1", "text"), (mm + "RenditionClass", "default", "text")]
    packet = xmp.splice(doc.decoded(stream)[0], rows, {n for n, _, _ in rows})
    entries = {k: v for k, v in stream.dict.items() if k not in (b"Filter", b"DecodeParms", b"Length")}
    return save(doc, {held.num: Stream(entries, packet)})


def add_output_intent(data: bytes, profile: bytes, condition: str, info: str = "", registry: str = "http://www.color.org") -> bytes:
    """Names the printing condition that the file is made for, with its profile. A file that has an intent is refused."""
    doc = Document(data)
    if doc.get(doc.catalog.get(b"OutputIntents")):
        raise PdfError("has-output-intent")
    head = icc_header(profile)
    channels = {"GRAY": 1, "RGB": 3, "CMYK": 4}.get(head["space"])
    if head["class"] != "prtr" or channels is None:
        raise PdfError("invalid-profile", "no output profile")
    num = max(doc.index, default=0) + 1
    intent = {b"Type": Name(b"OutputIntent"), b"S": Name(b"GTS_PDFX"), b"OutputConditionIdentifier": Str(condition.encode("latin-1")), b"Info": Str(info.encode("latin-1")), b"RegistryName": Str(registry.encode("latin-1")), b"DestOutputProfile": Ref(num, 0)}
    edits = {num: Stream({b"N": channels, b"Filter": Name(b"FlateDecode")}, deflate(profile)), num + 1: intent, doc.trailer[b"Root"].num: doc.catalog | {b"OutputIntents": [Ref(num + 1, 0)]}}
    return save(doc, edits)


def set_metadata(data: bytes, values: dict[str, str | None]) -> bytes:
    """Sets keys of the information dictionary and the packet alike; None takes a key away. A signed file is refused."""
    doc = Document(data)
    if metadata.signed(doc):
        raise PdfError("signed-document")
    rows, _ = metadata.properties(doc)
    now = {r["key"]: values[r["key"]] if r["key"] in values else (r["info"] or (r["xmp"] or [None])[0]) for r in rows}
    fresh = max(doc.index, default=0) + 1
    held = doc.trailer.get(b"Info")
    info_num = held.num if isinstance(held, Ref) else fresh
    old = doc.get(held) if isinstance(doc.get(held), dict) else {}
    info = {k: v for k, v in old.items() if k.decode("latin-1") not in now}
    for k, v in now.items():
        if v is not None:
            info[k.encode()] = Name(v.encode("latin-1")) if k == "Trapped" else Str(v.encode("latin-1")) if v.isascii() else Str(b"\xfe\xff" + v.encode("utf-16-be"))
    kinds = {"Title": "alt", "Subject": "alt", "Author": "seq"}
    rows = [(name, metadata.iso_date(v) if key.endswith("Date") else v, kinds.get(key, "text")) for key, name in metadata.MAPPING if (v := now[key]) is not None]
    old_packet = doc.get(doc.catalog.get(b"Metadata"))
    if isinstance(old_packet, Stream):  # all other properties stay as they are
        packet = xmp.splice(doc.decoded(old_packet)[0], rows, {name for _, name in metadata.MAPPING})
        entries = {k: v for k, v in old_packet.dict.items() if k not in (b"Filter", b"DecodeParms", b"Length")}
    else:
        packet, entries = xmp.packet(rows), {b"Type": Name(b"Metadata"), b"Subtype": Name(b"XML")}
    root = doc.trailer[b"Root"]
    place = doc.catalog.get(b"Metadata")
    packet_num = place.num if isinstance(place, Ref) else max(fresh, info_num + 1)
    edits: dict[int, object] = {info_num: info, packet_num: Stream(entries, packet)}
    if not isinstance(place, Ref):
        edits[root.num] = doc.catalog | {b"Metadata": Ref(packet_num, 0)}
    if not isinstance(held, Ref):
        doc.trailer = doc.trailer | {b"Info": Ref(info_num, 0)}
    return save(doc, edits)


def convert_content(data: bytes, convert: Callable[[np.ndarray], np.ndarray], pure_black: bool = True) -> bytes:
    """A file whose pages set process colours where they set RGB; grey becomes black ink. Forms and images stay as they are."""
    doc, edits = Document(data), {}
    fresh = max(doc.index, default=0) + 1
    for page in doc.pages:
        out, changed = bytearray(), False
        for op, v, _ in operations(b"\n".join(doc.contents(page))):
            if op in (b"rg", b"RG") and len(v) == 3:
                rgb = np.array([[min(1.0, max(0.0, float(x))) for x in v]])
                cmyk = np.array([0, 0, 0, 1.0]) if pure_black and not rgb.any() else convert(rgb)[0]
                op, v, changed = b"k" if op == b"rg" else b"K", [float(x) for x in cmyk], True
            elif op in (b"g", b"G") and len(v) == 1:
                op, v, changed = b"k" if op == b"g" else b"K", [0, 0, 0, 1 - float(v[0])], True
            if op == b"BI":
                out += b"BI " + b" ".join(serialize(Name(k)) + b" " + serialize(x) for k, x in v[0].items()) + b" ID " + v[1] + b" EI\n"
            else:
                out += b" ".join(number_text(x) if isinstance(x, float) else serialize(x) for x in v) + (b" " if v else b"") + op + b"\n"
        if changed:  # a stream of its own: others may share the old one
            edits[fresh] = Stream({}, bytes(out))
            edits[page.ref.num] = page.dict | {b"Contents": Ref(fresh, 0)}
            fresh += 1
    return save(doc, edits)
