import hashlib
import struct
import zlib

import numpy as np
import pytest

from quire.operators import documents
from quire.pdf import calculator, filters, images, metadata
from quire.pdf.content import Interpreter, operations
from quire.pdf.document import Document, text_string
from quire.pdf.fonts import name_text, parse_cmap, subset_tag
from quire.pdf.objects import Invalid, Keyword, Name, PdfError, Reader, Ref, Str, Stream, serialize
from quire.pdf.write import build, page_file, rewrite, update
from quire.plans.files import FONT, packet, text_page
from quire.sources import pdf
from quire.streaming import files as stream


def read(text):
    return Reader(text).object()


@pytest.mark.parametrize(
    ("text", "value"),
    [
        (b"12", 12), (b"-.5", -0.5), (b"+3.", 3.0), (b"/A#20b", Name(b"A b")), (b"(a\\(b(c))", Str(b"a(b(c)")), (b"(\\101\\n\\\r\nx)", Str(b"A\nx")), (b"<4 1 4>", Str(b"A@", True)),
        (b"[1 0 R null true]", [Ref(1, 0), None, True]), (b"<</A 1/B<</C[2]>>>>", {b"A": 1, b"B": {b"C": [2]}}), (b"% note\n7", 7), (b"<</A 1/A 2>>", {b"A": 2}), (b"(open", Invalid(b"open", "string")),
    ],
)
def test_objects(text, value):
    got = read(text)
    assert got == value and type(got) is type(value)


def test_objects_survive_writing():
    v = {b"A b": [1, -2.5, Str(b"x(\\)\r"), Str(b"\0\xff", True), None, True, Ref(3, 0)], b"N": Name(b"a/b#")}
    assert read(serialize(v)) == v
    with pytest.raises(PdfError):
        read(b"[" * 400)


def test_filters():
    raw = bytes(range(256)) * 5 + b"aaaa" * 50
    assert filters.decode(zlib.compress(raw), [Name(b"Fl")], [])[0] == raw
    assert filters.decode(zlib.compress(raw)[:-6], [Name(b"FlateDecode")], [])[1]
    assert filters.ascii_hex(b"48 65 6C6c 6F7>") == b"Hellop"
    assert filters.ascii85(b"<~87cURD]i,\"Ebo80~>".replace(b"<~", b"")) == b"Hello World!"
    assert filters.run_length(b"\x02abc\xfed\x80zz") == b"abcddd"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1 << 20) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    with pytest.raises(PdfError, match="unsupported"):
        filters.decode(b"", [Name(b"JPXDecode")], [])
    with pytest.raises(PdfError, match="size-limit"):
        filters.decode(zlib.compress(bytes(5000)), [Name(b"FlateDecode")], [], limit=100)


def png_rows(pixels, kinds, step):
    out, before = b"", np.zeros(pixels.shape[1], np.int64)
    for row, kind in zip(pixels.astype(np.int64), kinds, strict=True):
        left = np.concatenate([np.zeros(step, np.int64), row[:-step]])
        corner = np.concatenate([np.zeros(step, np.int64), before[:-step]])
        p = left + before - corner
        d = np.abs(p - left), np.abs(p - before), np.abs(p - corner)
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, corner))
        guess = [np.zeros_like(row), left, before, (left + before) // 2, paeth][kind]
        out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    return out


def png(pixels, color, depth=8, kinds=None, extra=b""):
    h, w = pixels.shape[:2]
    flat = pixels.reshape(h, -1)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(png_rows(flat, kinds or [k % 5 for k in range(h)], pixels.shape[2]))) + chunk(b"IEND", b"")


def test_png():
    p = np.random.default_rng(1).integers(0, 256, (10, 7, 3)).astype(np.uint8)
    got = images.decode_png(png(p, 2))
    assert (got["pixels"] == p).all() and (images.to_rgba(got)[:, :, :3] == p).all()
    with pytest.raises(PdfError):
        images.decode_png(png(p, 2).replace(b"IDAT", b"IDAU"))


def test_calculator():
    run = lambda s, *x: calculator.run_program(calculator.compile_program(s), list(x))
    assert run(b"{ 2 copy add 3 1 roll sub }", 5.0, 3.0) == [8.0, 2.0]
    assert run(b"{ dup 0 lt { neg } { 2 mul } ifelse }", -4.0) == [4.0] and run(b"{ 1 index exch }", 1.0, 2.0) == [1.0, 1.0, 2.0]
    assert run(b"{ 7 3 mod 7 3 idiv -3.5 truncate 2.5 round 90 sin }") == [1.0, 2.0, -3.0, 3.0, 1.0]
    with pytest.raises(PdfError):
        run(b"{ pop }")


def test_inherited_boxes_and_updates():
    f = page_file([(b"", {b"TrimBox": [10, 10, 500, 500]})])
    d = Document(f)
    boxes = d.boxes(d.pages[0])
    assert boxes["TrimBox"] == ([10, 10, 500, 500], True) and boxes["ArtBox"] == ([0, 0, 600, 800], False) and d.status == "intact"
    again = Document(update(d, {10: d.load(10) | {b"Rotate": 90}}))
    assert again.inherited(again.pages[0], b"Rotate") == (90, 0) and len(again.sections) == 2 and update(d, {}) == f
    assert Document(rewrite(again)).load(10)[b"Rotate"] == 90


def test_broken_files_are_rebuilt():
    f = page_file([(b"0 0 5 5 re f", {})])
    d = Document(f.replace(b"startxref\n", b"startxref\n9"))
    assert d.status == "reconstructed" and len(d.pages) == 1
    two = f + b"11 0 obj\n(other)\nendobj\n"
    with pytest.raises(PdfError, match="ambiguous"):
        Document(two.replace(b"startxref\n", b"startxref\n9"))
    assert Document(two.replace(b"startxref\n", b"startxref\n9"), "latest").load(11) == Str(b"other")
    with pytest.raises(PdfError, match="encrypted"):
        Document(page_file([(b"", {})], trailer={b"Encrypt": {}}))
    assert Document(b"junk before\n" + f).warnings[0][0] == "junk-before-header"


def test_cross_reference_and_object_streams():
    members = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]>>"]
    head = b" ".join(b"%d %d" % (k + 1, sum(map(len, members[:k])) + k) for k in range(3)) + b" "
    body = zlib.compress(head + b" ".join(members))
    out = b"%PDF-1.5\n"
    places = {4: len(out)}
    out += b"4 0 obj\n" + serialize(Stream({b"Type": Name(b"ObjStm"), b"N": 3, b"First": len(head), b"Filter": Name(b"FlateDecode")}, body)) + b"\nendobj\n"
    places[5] = len(out)
    rows = b"\0\0\0\0" + b"".join(b"\2\0\4" + bytes([k]) for k in range(3)) + b"".join(b"\1" + places[n].to_bytes(2, "big") + b"\0" for n in (4, 5))
    up = b"".join(b"\2" + bytes((c - p) % 256 for c, p in zip(rows[k : k + 4], rows[k - 4 : k] if k else b"\0\0\0\0", strict=True)) for k in range(0, len(rows), 4))
    out += b"5 0 obj\n" + serialize(Stream({b"Type": Name(b"XRef"), b"Size": 6, b"W": [1, 2, 1], b"Root": Ref(1, 0), b"Filter": Name(b"FlateDecode"), b"DecodeParms": {b"Predictor": 12, b"Columns": 4}}, zlib.compress(up))) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % places[5]
    d = Document(out)
    assert d.status == "intact" and d.boxes(d.pages[0])["MediaBox"][0] == [0, 0, 9, 9] and d.index[2][0] == "compressed"


def events(content, entries=None, extra=None):
    d = Document(page_file([(content, entries or {})], extra))
    return Interpreter(d), d


def test_text_state_and_positions():
    it, d = events(b"BT /F1 10 Tf 2 0 0 2 50 60 Tm 3 Tc (AB) Tj 0 -12 Td (C) Tj ET", {b"Resources": {b"Font": {b"F1": Ref(100, 0)}}}, {100: FONT})
    g = [v for _, k, v in it.page(d.pages[0]) if k == "glyph"]
    assert [(v["text"], v["x"], v["y"]) for v in g] == [("A", 50, 60), ("B", 66, 60), ("C", 50, 36)]
    it, d = events(b"q 1 0 0 1 5 5 cm BT /F1 10 Tf 3 Tr (A) Tj ET Q BT (B) Tj ET", {b"Resources": {b"Font": {b"F1": Ref(100, 0)}}}, {100: FONT})
    g = [v for _, k, v in it.page(d.pages[0]) if k == "glyph"]
    assert [(v["x"], v["hidden"]) for v in g] == [(5, "render-mode")] and it.warnings == ["missing-font"]


def test_forms_clips_and_cycles():
    form = Stream({b"Subtype": Name(b"Form"), b"BBox": [0, 0, 10, 10], b"Matrix": [1, 0, 0, 1, 100, 0], b"Resources": {b"XObject": {b"X": Ref(100, 0)}}}, b"0 0 50 50 re f /X Do")
    it, d = events(b"/X Do", {b"Resources": {b"XObject": {b"X": Ref(100, 0)}}}, {100: form})
    found = [v["box"] for _, k, v in it.page(d.pages[0]) if k == "paint"]
    assert found == [[100, 0, 110, 10]] and it.warnings == ["form-cycle"]


def boxes_of(it, page):
    return [(v["space"], v["box"]) for _, k, v in it.page(page) if k == "paint"]


def test_tiling_patterns():
    tile = Stream({b"PatternType": 1, b"PaintType": 1, b"BBox": [0, 0, 5, 5]}, b"1 0 0 rg 0 0 5 5 re f")
    it, d = events(b"/Pattern cs /P scn 2 2 50 50 re f", {b"Resources": {b"Pattern": {b"P": Ref(100, 0)}}}, {100: tile})
    assert boxes_of(it, d.pages[0]) == [("Pattern", [2, 2, 52, 52]), ("DeviceRGB", [2, 2, 5, 5])]


def test_type_3_procedures():
    font = {b"Subtype": Name(b"Type3"), b"FontMatrix": [0.01, 0, 0, 0.01, 0, 0], b"FirstChar": 65, b"Widths": [50], b"Encoding": {b"Differences": [65, Name(b"box")]}, b"CharProcs": {b"box": Ref(101, 0)}}
    it, d = events(b"BT /F 10 Tf 5 5 Td (AA) Tj ET", {b"Resources": {b"Font": {b"F": Ref(100, 0)}}}, {100: font, 101: Stream({}, b"50 0 d0 0 0 50 50 re f")})
    assert [b for _, b in boxes_of(it, d.pages[0])] == [[5, 5, 10, 10], [10, 5, 15, 10]]


def test_annotations():
    look = Stream({b"Subtype": Name(b"Form"), b"BBox": [0, 0, 10, 10]}, b"0 0 10 10 re f")
    notes = [{b"Rect": [100, 100, 120, 140], b"F": flags, b"AP": {b"N": Ref(100, 0)}} for flags in (4, 0, 6)]
    _, d = events(b"", {b"Annots": notes}, {100: look})
    seen = lambda mode: [b for _, b in boxes_of(Interpreter(d, mode), d.pages[0])]
    assert seen("none") == [] and seen("printable") == [[100, 100, 120, 140]] and len(seen("all")) == 2


def test_inline_image_is_one_operation():
    ops = list(operations(b"q BI /W 1 /H 1 /BPC 8 /CS /G ID \xffEI\x01 EI Q"))
    assert [o for o, _, _ in ops] == [b"q", b"BI", b"Q"] and ops[1][1][0][b"W"] == 1


def test_character_maps():
    m = parse_cmap(b"1 begincodespacerange <00> <7f> endcodespacerange 1 begincodespacerange <8000> <ffff> endcodespacerange 1 beginbfrange <41> <43> <0061> endbfrange 1 beginbfchar <8001> <d83dde00> endbfchar 1 beginbfrange <50> <51> [<0078> <00790079>] endbfrange")
    assert list(m.split(b"A\x80\x01B")) == [(0x41, 1), (0x8001, 2), (0x42, 1)]
    assert [m.get(c) for c in (0x41, 0x43, 0x8001, 0x51, 0x99)] == ["a", "c", "😀", "yy", None]
    assert [name_text(n) for n in ("A", "space", "eacute", "uni20AC", "f_i", "a.alt", "nosuch")] == ["A", " ", "é", "€", "fi", "a", None]
    assert subset_tag(b"ABCDEF+X") == ("ABCDEF", "X", False) and subset_tag(b"abcdef+X") == (None, "abcdef+X", True)


def test_metadata():
    d = Document(page_file([(b"", {})], {101: packet("T"), 102: {b"Title": Str(b"T"), b"Trapped": Name(b"Unknown")}, 103: packet("lost")}, {b"Metadata": Ref(101, 0)}, {b"Info": Ref(102, 0)}))
    rows, findings = metadata.properties(d)
    assert rows[0] == {"key": "Title", "info": "T", "xmp": ["T"]} and findings == ["other-packet:103"]
    with pytest.raises(PdfError, match="doctype"):
        metadata.read_packet(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>')
    assert text_string(Str(b"\xfe\xff\0A")) == "A" and text_string(Str(b"\x84\x8b")) == "—‰"


# ------------------------------------------------------------------ tables and plans


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("files")
    (out / "a.pdf").write_bytes(page_file([text_page("first line\nsecond"), text_page("")], {100: FONT}))
    (out / "b.pdf").write_bytes(b"no pdf at all")
    (out / "c.pdf").write_bytes(b"")
    return out


def test_tables_of_a_folder(spark, folder):
    records = pdf.parse_files(pdf.binary_files(spark, str(folder))).cache()
    docs = {r.doc_id.rsplit("/", 1)[-1]: r for r in pdf.table(records, "pdf_documents").collect()}
    assert docs["a.pdf"].pages == 2 and docs["b.pdf"].error_code and "c.pdf" not in docs  # Spark lists no empty files
    found = {r.page: r.text for r in documents.page_text(pdf.table(records, "pdf_glyphs")).collect()}
    assert found == {0: "first linesecond"}
    for name in pdf.TABLES:
        assert pdf.table(records, name).columns[0] == "doc_id"
    empty = pdf.parse_files(spark.createDataFrame([], "doc_id string, content binary"))
    assert pdf.table(empty, "pdf_pages").count() == 0


def test_files_as_a_stream(spark, folder, tmp_path):
    for _ in range(2):  # a restart adds nothing
        stream.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("table = 'pdf_documents'").count() == 2
    assert stream.arrivals(stream.incoming(spark, str(folder))).isStreaming


def test_actual_text_stands_for_its_glyphs(spark):
    content = b"BT /F1 9 Tf /Span <</ActualText (say)>> BDC (xyz) Tj EMC (!) Tj ET"
    f = page_file([(content, {b"Resources": {b"Font": {b"F1": Ref(100, 0)}}})], {100: FONT})
    t = pdf.table(pdf.parse_files(spark.createDataFrame([("d", bytearray(f))], "doc_id string, content binary")), "pdf_glyphs")
    assert [r.text for r in documents.page_text(t).collect()] == ["say!"]


def test_digest_of_operations_heeds_values_only(spark):
    make = lambda c: hashlib.md5(b"\n".join(b" ".join(map(pdf._token, v)) + b" " + op for op, v, _ in operations(c))).hexdigest()
    assert make(b"1.0 0 0 1. 5 5 cm %x\n/A<</b 1/a 2>>DP") == make(b"1 0 0 1 5 5 cm /A <</a 2 /b 1>> DP") != make(b"1 0 0 1 5 6 cm")


def test_build_needs_no_objects():
    assert Reader(build({}, {})).token() is not None and isinstance(Keyword(b"x"), bytes)


def test_private_data_and_double_keys_are_compared(spark):
    a = page_file([(b"", {b"PieceInfo": {b"App": {b"V": 1}}})])
    b = page_file([(b"", {b"PieceInfo": {b"App": {b"V": 2}}})], {100: b"<</K 1/K 2>>"}, {b"X": Ref(100, 0)})
    records = pdf.parse_files(spark.createDataFrame([("a", bytearray(a)), ("b", bytearray(b))], "doc_id string, content binary")).cache()
    t = [pdf.table(records, f"pdf_{n}") for n in ("pages", "fonts", "values", "warnings")]
    got = documents.compare(spark.createDataFrame([("a", "b")], "a string, b string"), *t).collect()
    assert sorted((r.kind, r.path) for r in got) == [("attributes", "/X/K"), ("duplicate-keys", ""), ("page-piece", "/PieceInfo/App/V")]


def test_matching_with_equivalents_and_incomplete_pages(spark):
    found = spark.createDataFrame([("a", 0, "x y"), ("a", 1, "same"), ("a", 2, "same")], "doc_id string, page int, text string")
    want = spark.createDataFrame([("a", 0, "xz"), ("a", 1, "same"), ("a", 2, "same"), ("a", 3, "none there")], "doc_id string, page int, text string")
    pages = spark.createDataFrame([("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 3, True)], "doc_id string, page int, complete boolean")
    said = lambda **k: {r.page: r.status for r in documents.match_text(found, want, **k).collect()}
    assert said() == {0: "mismatch", 1: "match", 2: "match", 3: "unverified"}
    assert said(equivalents={"y": "z"}, pages=pages) == {0: "match", 1: "match", 2: "unverified", 3: "unverified"}
