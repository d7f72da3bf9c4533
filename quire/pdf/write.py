"""Writing files: new ones, rewrites and updates appended to what is there."""

from __future__ import annotations

import hashlib

from .objects import Ref, Stream, Str, serialize


def build(objects: dict[int, object], trailer: dict, version: str = "1.6", tail: bytes = b"") -> bytes:
    """A file of the objects with a classic cross-reference table."""
    out = bytearray(f"%PDF-{version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1"))
    places = {}
    for num in sorted(objects):
        places[num] = len(out)
        v = objects[num]
        out += b"%d 0 obj\n" % num + (v if isinstance(v, bytes) and type(v) is bytes else serialize(v)) + b"\nendobj\n"
    at = len(out)
    out += _table(places, first=True)
    out += b"trailer\n" + serialize(trailer | {b"Size": max(objects, default=0) + 1}) + b"\n" + tail + b"startxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def _table(places: dict[int, int], first: bool) -> bytes:
    nums = sorted(({0} if first else set()) | set(places))
    out, k = bytearray(b"xref\n"), 0
    while k < len(nums):
        end = k
        while end + 1 < len(nums) and nums[end + 1] == nums[end] + 1:
            end += 1
        out += b"%d %d\n" % (nums[k], end - k + 1)
        for n in nums[k : end + 1]:
            out += b"0000000000 65535 f \n" if n == 0 else b"%010d 00000 n \n" % places[n]
        k = end + 1
    return bytes(out)


def identifier(data: bytes) -> Str:
    return Str(hashlib.md5(data).digest(), True)


def rewrite(doc, edits: dict[int, object] | None = None, trailer: dict | None = None) -> bytes:
    """The whole document with edits (None deletes); object numbers stay, cross-reference and object streams go."""
    objects = {n: doc.load(n) for n in doc.numbers()}
    objects = {n: v for n, v in objects.items() if not (isinstance(v, Stream) and v.dict.get(b"Type") in (b"XRef", b"ObjStm"))} | (edits or {})
    objects = {n: v for n, v in objects.items() if v is not None}
    keep = {k: v for k, v in (doc.trailer | (trailer or {})).items() if k in (b"Root", b"Info", b"ID")}
    body = build(objects, keep, doc.header or "1.6")
    ids = keep.get(b"ID")
    first = ids[0] if isinstance(ids, list) and ids else identifier(body)
    return build(objects, keep | {b"ID": [first, identifier(body)]}, doc.header or "1.6")


def update(doc, edits: dict[int, object]) -> bytes:
    """The source with a section appended that holds the edits; without edits the source as it is."""
    if not edits:
        return doc.data
    if doc.status == "reconstructed":
        return rewrite(doc, edits)
    out, places = bytearray(doc.data), {}
    if not out.endswith(b"\n"):
        out += b"\n"
    for num, v in sorted(edits.items()):
        places[num] = len(out) - doc.base
        out += b"%d 0 obj\n" % num + serialize(v) + b"\nendobj\n"
    at = len(out) - doc.base
    keep = {k: v for k, v in doc.trailer.items() if k in (b"Root", b"Info", b"ID")}
    size = max([*edits, *doc.index]) + 1
    if doc.sections[0]["kind"] == "stream":  # the section's form follows the newest one
        num = size
        rows = b"".join(b"\1" + places[n].to_bytes(4, "big") + b"\0\0" for n in sorted(places)) + b"\1" + at.to_bytes(4, "big") + b"\0\0"
        index = [x for n in [*sorted(places), num] for x in (n, 1)]
        stream = Stream(keep | {b"Type": _name("XRef"), b"Size": num + 1, b"W": [1, 4, 2], b"Index": index, b"Prev": doc.sections[0]["offset"]}, rows)
        out += b"%d 0 obj\n" % num + serialize(stream) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
    else:
        out += _table(places, first=False) + b"trailer\n" + serialize(keep | {b"Size": size, b"Prev": doc.sections[0]["offset"]}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def _name(text: str):
    from .objects import Name

    return Name(text.encode())


def page_file(pages: list[tuple[bytes, dict]], extra: dict[int, object] | None = None, catalog: dict | None = None, trailer: dict | None = None) -> bytes:
    """A simple file: pages of (content, further page entries), 600 by 800 points; extra objects from 100 on."""
    n = _name
    objects: dict[int, object] = {1: {b"Type": n("Catalog"), b"Pages": Ref(2, 0)} | (catalog or {})}
    objects[2] = {b"Type": n("Pages"), b"Kids": [Ref(10 + 2 * k, 0) for k in range(len(pages))], b"Count": len(pages)}
    for k, (content, entries) in enumerate(pages):
        objects[10 + 2 * k] = {b"Type": n("Page"), b"Parent": Ref(2, 0), b"MediaBox": [0, 0, 600, 800], b"Contents": Ref(11 + 2 * k, 0)} | entries
        objects[11 + 2 * k] = Stream({}, content)
    return build(objects | (extra or {}), {b"Root": Ref(1, 0)} | (trailer or {}))
