"""PDF files as flat tables.

Each file is parsed once, in Python, into rows of (doc_id, table, payload); the tables are views of these. What goes wrong
in one file is a row, too, so a damaged file never fails a task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..pdf import metadata
from ..pdf.content import Interpreter, operations
from ..pdf.document import Document, nodes, text_string
from ..pdf.images import icc_header
from ..pdf.objects import Keyword, Name, PdfError, Ref, Stream, Str, serialize

BOX = "array<double>"
#: The tables and their columns, without doc_id.
TABLES = {
    "pdf_documents": "status string, header string, pages int, sections int, objects int, linearized boolean, signed boolean, error_code string, error_detail string",
    "pdf_warnings": "stage string, page int, code string, detail string",
    "pdf_xref": "ordinal int, kind string, object_number int, type string, location long, generation long",
    "pdf_objects": "object_number int, generation int, kind string, digest string, filters array<string>, decoded_digest string, decoded_size long, reachable boolean, inline_filters array<string>, readable boolean",
    "pdf_nodes": "object_number int, path string, depth int, ordinal int, kind string, number double, bytes string, ref_num int, ref_gen int",
    "pdf_values": "owner string, page int, path string, kind string, value string",
    "pdf_pages": f"page int, object_number int, rotate int, user_unit double, media {BOX}, crop {BOX}, bleed {BOX}, trim {BOX}, art {BOX}, explicit array<string>, rotate_depth int, content_digest string, tokens_digest string, complete boolean, inline_filters array<string>",
    "pdf_operations": "page int, seq int, operator string, operands string",
    "pdf_glyphs": f"page int, seq int, code int, text string, reason string, font string, x double, y double, size double, width double, box {BOX}, hidden string, clipped boolean, span int, actual string, space string, evidence string, ink {BOX}",
    "pdf_paints": f"page int, seq int, what string, space string, components {BOX}, stroke boolean, box {BOX}, alpha double",
    "pdf_selects": f"page int, seq int, space string, components {BOX}, stroke boolean",
    "pdf_covers": f"page int, seq int, box {BOX}",
    "pdf_fonts": "page int, font_key string, subtype string, name string, tag string, malformed_tag boolean, embedded string, problems array<string>, shown boolean, program string, encoding string",
    "pdf_resources": "page int, path string, kind string, name string, object_number int, space string, alternate string",
    "pdf_type3": "page int, font_key string, code int, empty boolean, box array<double>",
    "pdf_properties": "key string, info string, xmp array<string>",
    "pdf_xmp": "name string, values array<string>",
    "pdf_packets": "document int, others int, streams int, superseded int",
    "pdf_intents": "ordinal int, subtype string, condition string, info string, registry string, profile string, space string, class string, inverse boolean, relative boolean",
}


def _digest(v) -> str:
    return hashlib.md5(serialize(v)).hexdigest()


def _inline_filters(doc: Document, data: bytes) -> list[str]:
    """Filters of the inline images in content."""
    out = []
    for op, v, _ in operations(data):
        if op == b"BI":
            f = doc.get(v[0].get(b"F", v[0].get(b"Filter")))
            out += [x.decode("latin-1") for x in (f if isinstance(f, list) else [f]) if isinstance(x, bytes)]
    return out


def _drawn(doc: Document, numbers: list[int]) -> set[int]:
    """Streams of content other than pages': forms, tiling patterns, glyph procedures and appearances."""
    out: set[int] = set()

    def streams(v) -> None:
        if isinstance(v, Ref) and isinstance(doc.get(v), Stream):
            out.add(v.num)
        elif isinstance(v := doc.get(v), dict):
            out.update(x.num for x in v.values() if isinstance(x, Ref) and isinstance(doc.get(x), Stream))

    for num in numbers:
        try:
            v = doc.load(num)
        except PdfError:
            continue
        d = v.dict if isinstance(v, Stream) else v
        if isinstance(v, Stream) and (d.get(b"Subtype") == b"Form" or doc.get(d.get(b"PatternType")) == 1):
            out.add(num)
        if isinstance(d, dict):
            if d.get(b"Subtype") == b"Type3":
                streams(d.get(b"CharProcs"))
            looks = doc.get(d.get(b"AP"))
            for state in (looks.get(k) for k in (b"N", b"R", b"D")) if isinstance(looks, dict) else ():
                streams(state)
    return out


def reached(doc: Document) -> set[int]:
    """Objects that the trailer leads to; a reference counts only if its generation is the current one."""
    out: set[int] = set()
    todo = [doc.trailer]
    while todo:
        v = todo.pop()
        if isinstance(v, Ref):
            if v.num in out or v.num not in doc.index or doc._gen(v.num) != v.gen:
                continue
            out.add(v.num)
            try:
                v = doc.load(v.num)
            except PdfError:
                continue
        v = v.dict if isinstance(v, Stream) else v
        todo += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return out


#: Entries of a page and of the catalog that other areas of a comparison tell about, or that only bind the file together.
PAGE_KEYS = {b"Type", b"Parent", b"Contents", b"Resources", b"MediaBox", b"CropBox", b"BleedBox", b"TrimBox", b"ArtBox", b"Rotate", b"UserUnit"}
CATALOG_KEYS = {b"Type", b"Pages", b"Metadata"}


def _values(doc: Document, entries: dict, skip: set[bytes], pages: dict[int, int]) -> Iterator[tuple[str, str, str]]:
    """(path, kind, value) of everything in entries through references. An object is followed where it is met first; later
    it is the path of that. A page is its place; a stream's data is a digest of what it decodes to."""
    met: dict[int, str] = {}
    key = lambda k: k.decode("latin-1").replace("~", "~0").replace("/", "~1")
    todo = [(f"/{key(k)}", v) for k, v in entries.items() if k not in skip][::-1]
    while todo:
        path, v = todo.pop()
        if isinstance(v, Ref):
            if v.num in pages:
                yield path, "page", str(pages[v.num])
                continue
            if v.num in met:
                yield path, "same", met[v.num]
                continue
            met[v.num] = path
            try:
                v = doc.get(v)
            except PdfError as e:
                yield path, "unreadable", e.code
                continue
        if isinstance(v, Stream):
            try:
                yield f"{path}/(data)", "data", hashlib.md5(doc.decoded(v)[0]).hexdigest()
            except PdfError:
                yield f"{path}/(data)", "data", hashlib.md5(v.data).hexdigest()
            v = {k: x for k, x in v.dict.items() if k not in (b"Length", b"Filter", b"DecodeParms")}
        if isinstance(v, dict):
            if not v:
                yield path, "dictionary", ""
            todo += [(f"{path}/{key(k)}", x) for k, x in sorted(v.items(), reverse=True) if not (k == b"Parent" and isinstance(x, Ref))]
        elif isinstance(v, list):
            if not v:
                yield path, "array", ""
            todo += [(f"{path}/{k}", x) for k, x in reversed([*enumerate(v)])]
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "name" if isinstance(v, Name) else "string"
            yield path, kind, _token(v).decode("latin-1")


def _resources(doc: Document, it: Interpreter, page) -> Iterator[dict]:
    """Every resource that a page can reach: its own, and those of forms, patterns, masks, Type 3 fonts and appearances; each once."""
    met: set = set()
    start = doc.get(doc.inherited(page, b"Resources")[0])
    todo = [("", start if isinstance(start, dict) else {})]
    for k, raw in enumerate(doc.get(page.dict.get(b"Annots")) or []):
        looks = doc.get((doc.get(raw) or {}).get(b"AP"))
        for state in (looks or {}).values() if isinstance(looks, dict) else []:
            each = doc.get(state)
            todo += [(f"/Annots/{k}", d) for x in (each.values() if isinstance(each, dict) else [each]) if isinstance(s := doc.get(x), Stream) and isinstance(d := doc.get(s.dict.get(b"Resources")), dict)]
    while todo:
        path, r = todo.pop()
        for kind in (b"ColorSpace", b"ExtGState", b"Font", b"Pattern", b"Properties", b"Shading", b"XObject"):
            group = doc.get(r.get(kind))
            for name, raw in sorted(group.items()) if isinstance(group, dict) else []:
                key = (kind, raw.num) if isinstance(raw, Ref) else (kind, path, name)
                if key in met:
                    continue
                met.add(key)
                v = doc.get(raw)
                d = v.dict if isinstance(v, Stream) else v
                here = f"{path}/{kind.decode()}/{name.decode('latin-1')}"
                found = {"path": here, "kind": kind.decode(), "name": name.decode("latin-1"), "object_number": raw.num if isinstance(raw, Ref) else None}
                own = v if kind == b"ColorSpace" else d.get(b"ColorSpace") if isinstance(d, dict) and kind in (b"Shading", b"XObject") else doc.get(d.get(b"Shading")).get(b"ColorSpace") if kind == b"Pattern" and isinstance(d, dict) and isinstance(doc.get(d.get(b"Shading")), dict) else None
                if (own := doc.get(own)) is not None:
                    found["space"] = it.space(own)
                    if isinstance(own, list) and len(own) > 2 and doc.get(own[0]) in (b"Separation", b"DeviceN"):
                        found["alternate"] = it.space(doc.get(own[2]))
                yield found
                if not isinstance(d, dict):
                    continue
                if isinstance(inner := doc.get(d.get(b"Resources")), dict):
                    todo.append((here, inner))
                mask = doc.get(d.get(b"SMask")) if kind == b"ExtGState" else None
                if isinstance(mask, dict) and isinstance(g := doc.get(mask.get(b"G")), Stream) and isinstance(inner := doc.get(g.dict.get(b"Resources")), dict):
                    todo.append((here + "/SMask", inner))


def _intents(doc: Document) -> Iterator[dict]:
    listed = doc.get(doc.catalog.get(b"OutputIntents"))
    for k, raw in enumerate(listed if isinstance(listed, list) else []):
        d = doc.get(raw)
        if not isinstance(d, dict):
            continue
        text = lambda n: text_string(v) if isinstance(v := doc.get(d.get(n)), Str) else None  # noqa: B023, E731
        found = {"profile": "none"}
        stream = doc.get(d.get(b"DestOutputProfile"))
        if isinstance(stream, Stream):
            try:
                head = icc_header(doc.decoded(stream)[0])
                found = {"profile": "read", "space": head["space"], "class": head["class"], "inverse": any(f"B2A{i}" in head["tags"] for i in range(3)), "relative": "A2B1" in head["tags"]}
            except PdfError as e:
                found = {"profile": e.code}
        subtype = doc.get(d.get(b"S"))
        yield {"ordinal": k, "subtype": subtype.decode("latin-1") if isinstance(subtype, Name) else None, "condition": text(b"OutputConditionIdentifier"), "info": text(b"Info"), "registry": text(b"RegistryName")} | found


def parse(doc_id: str, data: bytes, want: set[str], recovery: str = "strict", annotations: str = "none", maps: dict[str, bytes] | None = None) -> Iterator[tuple[str, str, str]]:
    """Rows of one file. annotations: whose appearances are part of a page: none, printable or all. maps: predefined character maps by name."""

    def row(table: str, **values):
        return doc_id, table, json.dumps(values)

    try:
        doc = Document(data, recovery)
    except (PdfError, RecursionError) as e:
        yield row("pdf_documents", error_code=getattr(e, "code", "nesting-limit"), error_detail=getattr(e, "detail", ""))
        return
    numbers = doc.numbers()
    first = doc.load(numbers[0]) if numbers else None
    yield row("pdf_documents", status=doc.status, header=doc.header, pages=len(doc.pages), sections=len(doc.sections), objects=len(numbers), linearized=isinstance(first, dict) and b"Linearized" in first, signed=metadata.signed(doc))
    if "pdf_xref" in want:
        for k, s in enumerate(doc.sections):
            for num, e in s["entries"].items():
                yield row("pdf_xref", ordinal=k, kind=s["kind"], object_number=num, type=e[0], location=e[1], generation=e[2])
    if "pdf_intents" in want:
        for found in _intents(doc):
            yield row("pdf_intents", **found)
    places = {p.ref.num: k for k, p in enumerate(doc.pages)}
    if "pdf_values" in want:
        for path, kind, v in _values(doc, doc.catalog, CATALOG_KEYS, places):
            yield row("pdf_values", owner="document", path=path, kind=kind, value=v)
    if "pdf_packets" in want:
        yield row("pdf_packets", **metadata.scan_packets(doc))
    live = reached(doc) if "pdf_objects" in want else set()
    drawn = _drawn(doc, numbers) if "pdf_objects" in want else set()
    if want & {"pdf_objects", "pdf_nodes"}:
        for num, v in [(0, doc.trailer), *((n, None) for n in numbers)]:
            try:
                v = v if num == 0 else doc.load(num)
                extra = {}
                if isinstance(v, Stream):
                    f = doc.get(v.dict.get(b"Filter"))
                    extra["filters"] = [x.decode("latin-1") for x in (f if isinstance(f, list) else [f]) if isinstance(x, bytes)]
                    try:
                        raw, found = doc.decoded(v)
                        if num in drawn:
                            extra["inline_filters"] = _inline_filters(doc, raw)
                        extra |= {"decoded_digest": hashlib.md5(raw).hexdigest(), "decoded_size": len(raw)}
                        for w in found:
                            doc.warn(w, str(num))
                    except PdfError as e:
                        doc.warn(e.code, f"{num} {e.detail}")
                kind = "null"
                for path, depth, ordinal, kind_, number, raw, ref in nodes(v):
                    if not path:
                        kind = kind_
                    if "pdf_nodes" in want:
                        yield row("pdf_nodes", object_number=num, path=path, depth=depth, ordinal=ordinal, kind=kind_, number=number, bytes=raw.decode("latin-1") if raw is not None else None, ref_num=ref.num if ref else None, ref_gen=ref.gen if ref else None)
                yield row("pdf_objects", object_number=num, generation=doc._gen(num), kind=kind, digest=_digest(v), reachable=num == 0 or num in live, readable=True, **extra)
            except PdfError as e:
                doc.warn(e.code, str(num))
                yield row("pdf_objects", object_number=num, generation=doc._gen(num), reachable=num in live, readable=False)
    for k, page in enumerate(doc.pages):
        if "pdf_values" in want:
            for path, kind, v in _values(doc, page.dict, PAGE_KEYS, places):
                yield row("pdf_values", owner="page", page=k, path=path, kind=kind, value=v)
        boxes = doc.boxes(page)
        rotate, depth = doc.inherited(page, b"Rotate")
        it, values, events = Interpreter(doc, annotations, (maps or {}).get), {}, []
        complete = True
        try:
            data = b"\n".join(doc.contents(page))
            values["content_digest"] = hashlib.md5(data).hexdigest()
            ops = [(op, v) for op, v, _ in operations(data)]
            values["tokens_digest"] = hashlib.md5(b"\n".join(b" ".join(map(_token, v)) + b" " + op for op, v in ops)).hexdigest()
            values["inline_filters"] = _inline_filters(doc, data)
            if "pdf_operations" in want:
                for seq, (op, v) in enumerate(ops):
                    yield row("pdf_operations", page=k, seq=seq, operator=op.decode("latin-1"), operands=b" ".join(map(_token, v)).decode("latin-1"))
            if want & {"pdf_glyphs", "pdf_paints", "pdf_selects", "pdf_covers", "pdf_fonts", "pdf_type3"}:
                events = it.page(page)
        except (PdfError, RecursionError) as e:
            doc.warn(getattr(e, "code", "nesting-limit"), f"page {k}")
            complete = False
        yield row("pdf_pages", page=k, object_number=page.ref.num, rotate=rotate if isinstance(rotate, int) else 0, rotate_depth=depth, user_unit=float(doc.get(page.dict.get(b"UserUnit", 1))), **{n: boxes[b][0] for n, b in zip(("media", "crop", "bleed", "trim", "art"), boxes, strict=True)}, explicit=[b for b, (_, own) in boxes.items() if own], complete=complete and not it.warnings, **values)
        shown = set()
        for seq, kind, v in events:
            if kind == "glyph":
                shown.add(v["font"])
                v["actual"] = None if v["actual"] is None else _text(v["actual"])
                v = {n: v[n] for n in v if n != "bytes"}
            yield row(f"pdf_{kind}s", page=k, seq=seq, **v)
        if "pdf_resources" in want:
            for found in _resources(doc, it, page):
                yield row("pdf_resources", page=k, **found)
        if "pdf_type3" in want:
            for key, f in it.fonts.items():
                for code, proc in (f.procedures if f else {}).items():
                    first = next(((op, v) for op, v, _ in operations(doc.decoded(proc)[0]) if op in (b"d0", b"d1")), (b"", []))
                    box = [float(x) for x in first[1][2:6]] if first[0] == b"d1" and len(first[1]) == 6 else None
                    yield row("pdf_type3", page=k, font_key=str(key), code=code, empty=it.draws_nothing(f, code), box=box)
        for w in it.warnings:
            yield row("pdf_warnings", stage="content", page=k, code=w)
        for key, f in it.fonts.items():
            if f:
                yield row("pdf_fonts", page=k, font_key=str(key), subtype=f.subtype, name=f.name, tag=f.tag, malformed_tag=f.malformed_tag, embedded=f.embedded, problems=list(f.problems), shown=f.name in shown, program=f.program_digest, encoding=f.encoding)
    if "pdf_xmp" in want:
        for name, found in metadata.all_properties(doc).items():
            yield row("pdf_xmp", name=name, values=found)
    if "pdf_properties" in want:
        rows, findings = metadata.properties(doc)
        for r in rows:
            yield row("pdf_properties", **r)
        for w in findings:
            yield row("pdf_warnings", stage="metadata", code=w)
    for code, detail in doc.warnings:
        yield row("pdf_warnings", stage="load", code=code, detail=detail)


def _text(raw: bytes) -> str:
    return text_string(Str(raw)) or ""


def _token(v) -> bytes:
    """An operand's canonical text: numbers by value, dictionaries by sorted keys."""
    if isinstance(v, bool) or v is None or isinstance(v, (Name, Str, Ref, Keyword)):
        return serialize(v) if not isinstance(v, Str) else b"<" + v.data.hex().encode() + b">"
    if isinstance(v, (int, float)):
        return serialize(float(v))
    if isinstance(v, list):
        return b"[" + b" ".join(map(_token, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(serialize(Name(k)) + b" " + _token(v[k]) for k in sorted(v)) + b">>"
    return bytes(v) if isinstance(v, bytes) else serialize(v)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (doc_id, content); Spark pushes filters on length down to the listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "length", "content")


def parse_files(files: DataFrame, tables: list[str] | None = None, recovery: str = "strict", annotations: str = "none", maps: dict[str, bytes] | None = None) -> DataFrame:
    """(doc_id, table, payload) for files (doc_id, content); only what the named tables need is worked out.

    annotations: whose appearances are drawn after a page: none, printable or all. maps: bytes of predefined character
    maps by name, which go to every task, so they should be the few that the files name.

    A file is one row, so its parts never meet another task's; write the result once and read tables from that.
    Null contents count as empty files, which have an error row.
    """
    want = set(tables or TABLES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                out: list[tuple[str, str, str]] = []
                for r in parse(doc_id, bytes(content or b""), want, recovery, annotations, maps):
                    out.append(r)
                    if len(out) >= 5000:
                        yield pd.DataFrame(out, columns=["doc_id", "table", "payload"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "table", "payload"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, table string, payload string")


def table(records: DataFrame, name: str) -> DataFrame:
    """One of TABLES."""
    rows = records.filter(F.col("table") == name).select("doc_id", F.from_json("payload", TABLES[name]).alias("r"))
    return rows.select("doc_id", "r.*")


def write_tables(records: DataFrame, path: str, names: list[str] | None = None) -> list[DataFrame]:
    """The named tables of records, written by table as Parquet, each with its own columns, and read again."""
    spark = records.sparkSession
    records.write.option("compression", "zstd").partitionBy("table").parquet(path)
    back = spark.read.schema("doc_id string, payload string, table string").parquet(path)
    return [table(back, n) for n in names or TABLES]
