"""Kernels of one file: limits, odd input, refusals."""

import random

import numpy as np
import pytest

from quire.operators import relations
from quire.pdf import clip, edit, encodings, fonts, icc, images, inks, matching, metadata, xmp
from quire.pdf.builder import Content, NewDocument
from quire.pdf.content import Interpreter
from quire.pdf.document import Document
from quire.pdf.objects import Name, PdfError, Ref, Str, Stream
from quire.pdf.write import page_file
from quire.plans.files import FONT, packet
from quire.plans.formats import para_tag, profile

F1 = {b"Resources": {b"Font": {b"F1": Ref(100, 0)}}}


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def test_sides_of_a_clip():
    triangle = clip.Clip().cut([[(0, 0), (500, 0), (0, 500)]], "nonzero")
    assert [triangle.side(square(*p)) for p in ((10, 10, 20), (450, 450, 10), (245, 245, 20), (700, 0, 5))] == ["inside", "outside", "partial", "outside"]
    ring = clip.Clip().cut([square(0, 0, 100), square(30, 30, 40)], "evenodd")
    assert [ring.side(square(*p)) for p in ((40, 40, 10), (5, 5, 10), (25, 25, 50))] == ["outside", "inside", "partial"]
    assert clip.Clip().cut([square(0, 0, 100), square(30, 30, 40)], "nonzero").side(square(40, 40, 10)) == "inside"
    both = triangle.cut([[(500, 500), (480, 500), (500, 480)]], "nonzero")
    assert both.side(square(0, 0, 500)) == "outside" and both.box == (480, 480, 500, 500)
    assert clip.Clip().cut([[(0, 0)] * (clip.LIMIT_VERTICES + 1)], "nonzero").side(square(0, 0, 1)) == "unknown"
    assert clip.Clip().side(square(0, 0, 1)) == "inside" and clip.Clip.of_box((0, 0, 5, 5)).upright and not triangle.upright


def test_text_that_clips_hides_what_follows():
    f = page_file([(b"BT /F1 9 Tf 7 Tr (a) Tj 0 Tr (b) Tj ET BT /F1 9 Tf (c) Tj ET", F1)], {100: FONT})
    doc = Document(f)
    seen = [(v["text"], v["hidden"], v["clipped"]) for _, k, v in Interpreter(doc).page(doc.pages[0]) if k == "glyph"]
    assert seen == [("a", "render-mode", False), ("b", None, False), ("c", None, True)]


def test_names_of_glyphs():
    want = {"A": "A", "space": " ", "eacute": "é", "Lambda": "Λ", "afii10023": "Ё", "alefhebrew": "א", "ahiragana": "あ", "f_f_i": "ffi", "A.alt": "A", "uni00410042": "AB", "u1F600": "😀", "uniD800": None, "u110000": None, "": None, "nosuch": None, "radical": "√"}
    assert {n: encodings.name_text(n) for n in want} == want
    assert len(encodings.WIN) == 224 and encodings.STANDARD[0x27] == "’" and encodings.SYMBOL[0x61] == "α" and encodings.MAC[0x8A] == "ä"
    assert encodings.standard_width("Helvetica", 0xE9, "é") == 556 and encodings.standard_width("Courier-Bold", 65, "A") == 600 and encodings.standard_width("Times-Roman", 0, "漢") is None


def test_character_maps_build_on_others():
    base = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 begincidrange <0000> <00ff> 10 endcidrange 1 beginnotdefrange <0100> <0200> 3 endnotdefrange"
    m = fonts.parse_cmap(b"/Base usecmap 1 begincidchar <0041> 7 endcidchar", {"Base": base}.get)
    assert [m.get(0x41), m.get(0x42), m.get(0x9999)] == [7, 10 + 0x42, None] and [*m.split(b"\0A")] == [(0x41, 2)]
    assert m.parent.undefined(0x150) == 3 and fonts.named_cmap(b"none") is None and fonts.named_cmap(b"Identity-V").vertical
    loop = fonts.parse_cmap(b"/Base usecmap", lambda name: b"/Base usecmap")
    assert loop.get(1) is None
    m = fonts.parse_cmap(b"3 begincidrange <0000> <00ff> 0 <0010> <0020> 500 <0010> <0015> 900 endcidrange")
    assert [m.get(c) for c in (5, 0x12, 0x18, 0xFF)] == [5, 902, 508, 255]


def test_widths_are_not_expanded():
    doc = Document(page_file([(b"", {})]))
    m = fonts.Metrics(doc, [0, 2**31 - 1, 500, 7, [1, 2], 3, "x"], 1, (1000.0,))
    assert [m.get(k)[0] for k in (0, 7, 8, 2**30)] == [500, 1, 2, 500] and m.bad
    assert fonts.Metrics(doc, None, 3, (880.0, -1000.0)).get(5) == (880.0, -1000.0)


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ('<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>', "xmp-doctype"), ("<a>&b;</a>", "xmp-entity"), ("<a><b></a>", "xmp-malformed"), ("<a/><a/>", "xmp-malformed"), ("<a>\x01</a>", "xmp-malformed"), ("<a>&#1;</a>", "xmp-malformed"),
        ("<a x='1' x='2'/>", "xmp-malformed"), ("<p:a/>", "xmp-malformed"), ("<a" + "".join(f" x{k}='1'" for k in range(300)) + "/>", "xmp-too-many-attributes"), ("<a>" * 70, "xmp-too-deep"), ("<a>" + "<b/>" * 160_001 + "</a>", "xmp-too-many-tokens"), ("", "xmp-malformed"),
    ],
)
@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-32", "utf-16-be"])
def test_packets_that_are_refused(text, code, encoding):
    if encoding != "utf-8" and len(text) > 10_000:
        return
    with pytest.raises(PdfError, match=code):
        xmp.read(text.encode(encoding))


def test_values_of_packets():
    ns = f'xmlns:r="{xmp.RDF}" xmlns:d="urn:d" xmlns:x="http://www.w3.org/XML/1998/namespace"'.replace(' xmlns:x="http://www.w3.org/XML/1998/namespace"', "")
    body = "<d:t>a&amp;b<!-- no --><![CDATA[<c>]]></d:t><d:l><r:Seq><r:li>1</r:li><r:li>2</r:li></r:Seq></d:l><d:a><r:Alt><r:li xml:lang='de'>zwei</r:li><r:li xml:lang='x-default'>two</r:li></r:Alt></d:a><d:q r:parseType='Resource'><r:value>v</r:value><d:how>so</d:how></d:q><d:s><r:Description d:one='1'><d:two>2</d:two></r:Description></d:s><d:u r:resource='urn:u'/>"
    got = xmp.read(f"<r:RDF {ns}><r:Description d:attr='x &lt; y'>{body}</r:Description></r:RDF>".encode("utf-16"))
    assert got == {"{urn:d}attr": ["x < y"], "{urn:d}t": ["a&b<c>"], "{urn:d}l": ["1", "2"], "{urn:d}a": ["two"], "{urn:d}q": ["v"], "{urn:d}q/{urn:d}how": ["so"], "{urn:d}s/{urn:d}one": ["1"], "{urn:d}s/{urn:d}two": ["2"], "{urn:d}u": ["urn:u"]}


def test_splicing_keeps_the_rest():
    text = packet("old").data.decode().replace("<rdf:Description", "<!-- kept --><rdf:Description xmlns:z='urn:z' z:a='1'")
    out = xmp.splice(text.encode("utf-16"), [("{http://purl.org/dc/elements/1.1/}title", "new <&>", "alt")], {"{http://purl.org/dc/elements/1.1/}title"})
    assert xmp.read(out) == {"{urn:z}a": ["1"], "{http://purl.org/dc/elements/1.1/}title": ["new <&>"]} and b"<!-- kept -->" in out
    empty = f'<r:RDF xmlns:r="{xmp.RDF}"/>'.encode()
    assert xmp.read(xmp.splice(empty, [("{urn:z}b", "2", "text")], {"{urn:z}b"})) == {"{urn:z}b": ["2"]}
    assert xmp.read(xmp.packet([("{urn:z}b", "2", "seq")])) == {"{urn:z}b": ["2"]}


def test_many_signature_fields():
    kids = {100 + k: {b"T": Str(b"x")} for k in range(300)}
    f = page_file([(b"", {})], kids | {99: {b"FT": Name(b"Sig"), b"V": {}}}, {b"AcroForm": {b"Fields": [Ref(99, 0), *[Ref(n, 0) for n in kids] * 500]}})
    assert metadata.signed(Document(f))


def test_alignment_stops_at_its_limit():
    a, b = ([f"{s}{k}" for k in range(400)] for s in "xy")
    assert relations.align(a, b, 1000) is None and len(relations.align(a, b)) == 800
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        steps = relations.align(a, b)
        assert [i for s, i, _ in steps if s != "extra"] == [*range(len(a))] and all(a[i] == b[j] for s, i, j in steps if s == "keep")


def glyph(text, x, **more):
    return {"text": text, "folded": text, "font": "F", "code": ord(text[0]) if text else 0, "x": x, "y": 0.0, "size": 10.0, "width": 500.0, "reason": None, "hidden": None, "span": None, "actual": None} | more


def test_matching_of_glyphs():
    run = lambda dx: [glyph(c, 5 * k + dx) for k, c in enumerate("abc")]
    told = lambda g, want: matching.match(g, want, relations.align, 10**6)
    assert told(run(0), "a b\nc")["status"] == "match" and told([], "")["status"] == "match" and told([], "x")["status"] == "mismatch"
    m = told(run(0) + run(0.4), "abc")
    assert (m["status"], m["copies"]) == ("match", 2) and told(run(0) + run(15), "abc")["status"] == "mismatch"
    assert told(run(0)[:2] + [glyph(None, 9)], "abc")["status"] == "unverified"
    assert [d[0] for d in told([glyph("a", 0, reason="notdef")], "a")["differences"]] == ["missing-glyph"]
    wide = [glyph("漢", 0, width=500.0), glyph("字", 5, width=1000.0)]
    assert told(wide, "漢字")["notes"] == [("half-width", "漢", "")] and told([*wide, glyph("語", 9, width=700.0)], "漢字語")["notes"] == []
    assert matching.clusters("a️b \U000e0100") == ["a️", "b\U000e0100"]


def test_curves_and_identities():
    t = np.array([0, 0.2, 0.2, 0.2, 1.0])
    assert np.allclose(icc.inverse(t, np.array([0.0, 0.1, 0.2, 0.6, 1.0])), [0, 0.125, 0.5, 0.875, 1.0])
    assert np.allclose(icc.inverse(np.linspace(1, 0, 5), np.array([0.25])), [0.75])
    for kind, p in enumerate(([2.0], [2.0, 0.5, 0.5], [2.0, 0.5, 0.5, 0.1], [2.0, 0.5, 0.5, 0.5, 0.25], [2.0, 0.5, 0.5, 0.5, 0.25, 0.1, 0.2])):
        got = icc.parametric(*images.icc_parametric(para_tag(kind, *p)), np.array([0.1, 0.8]))
        low = {0: 0.01, 1: 0.3025, 2: 0.4025, 3: 0.05, 4: 0.25}[kind]
        assert np.allclose(got, [low, {0: 0.64, 2: 0.91, 4: 0.91}.get(kind, 0.81)], atol=1e-4)  # parameters have 16 binary places
    one = profile(b"GRAY", b"XYZ ", [])
    other = one[:64] + b"\0\0\0\1" + one[68:84] + b"x" * 16 + one[100:]
    assert images.icc_identity(one) == images.icc_identity(other) != images.icc_identity(one + b"x")


def test_colour_of_jpeg_2000():
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    head = box(b"ihdr", bytes(8) + b"\0\3" + bytes(4)) + box(b"colr", b"\1\0\0" + (16).to_bytes(4, "big"))
    data = box(b"jP  ", b"\r\n\x87\n") + box(b"jp2h", head)
    assert images.jpx_colour(data) == {"components": 3, "space": "sRGB", "profile": None}
    with pytest.raises(PdfError):
        images.jpx_colour(data[:-3])


def test_refusals_of_the_builder():
    for code, call in [
        ("invalid-number", lambda c: c.line_width(float("nan"))), ("no-path", lambda c: c.fill()), ("unbalanced-restore", lambda c: c.restore()), ("invalid-matrix", lambda c: c.transform(0, 0, 0, 0, 1, 1)), ("invalid-colour", lambda c: c.fill_colour((2, 0, 0, 0))),
        ("invalid-blend", lambda c: c.graphics_state(blend="None")), ("invisible-overprint", lambda c: c.graphics_state(stroke_overprint=True).stroke_colour((0, 0, 0, 0)).rectangle(0, 0, 1, 1).stroke()), ("unbalanced-save", lambda c: c.save().data()),
    ]:
        with pytest.raises(PdfError, match=code):
            call(Content())
    with pytest.raises(PdfError, match="no-pages"):
        NewDocument().write()


def test_drawing_on_pages_keeps_names_apart():
    state = {b"ExtGState": {b"E0": {b"ca": 0}}}
    f = page_file([(b"/E0 gs 0 0 1 1 re f", {b"Resources": state}), (b"", {})])
    doc = Document(edit.draw_on(f, lambda c: c.graphics_state(fill_alpha=1).rectangle(0, 0, 2, 2).fill()))
    seen = [[v["alpha"] for _, k, v in Interpreter(doc).page(p) if k == "paint"] for p in doc.pages]
    assert seen == [[0.0, 1.0], [1.0]]


def test_refusals_of_a_conversion():
    press = profile(b"CMYK", b"Lab ", [(b"B2A0", b"mft1" + bytes(60))])
    screen = profile(b"RGB ", b"XYZ ", [])
    run = lambda f, p=press: inks.convert_document(f, p, convert=lambda x: np.zeros((len(x), 4)))
    mesh = Stream({b"ShadingType": 4, b"ColorSpace": Name(b"DeviceRGB"), b"BitsPerCoordinate": 8, b"BitsPerComponent": 8, b"BitsPerFlag": 8, b"Decode": [0, 1] * 5}, b"")
    for code, f in [
        ("has-output-intent", page_file([(b"", {})], catalog={b"OutputIntents": [{}]})), ("page-piece", page_file([(b"", {b"PieceInfo": {}})])), ("default-colour-space", page_file([(b"", {b"Resources": {b"ColorSpace": {b"DefaultGray": [Name(b"CalGray"), {}]}}})])),
        ("unsupported-feature", page_file([(b"", {b"X": Ref(100, 0)})], {100: mesh})), ("short-image", page_file([(b"", {b"X": Ref(100, 0)})], {100: Stream({b"Subtype": Name(b"Image"), b"Width": 9, b"Height": 9, b"BitsPerComponent": 8, b"ColorSpace": Name(b"DeviceRGB")}, b"")})),
    ]:
        with pytest.raises(PdfError, match=code):
            run(f)
    with pytest.raises(PdfError, match="invalid-profile"):
        run(page_file([(b"", {})]), screen)
    plain = page_file([(b"0 0 0 1 k 0 0 1 1 re f", {})])
    assert run(plain) == plain


def test_files_of_one_name_from_two_folders(spark, tmp_path):
    from quire.operators import edits

    rows = [("in/a/x.pdf", bytearray(b"1")), ("in/b/x.pdf", bytearray(b"22")), ("plain", bytearray(b"333"))]
    got = edits.write_files(spark.createDataFrame(rows, "doc_id string, content binary"), str(tmp_path / "out")).collect()
    assert sorted((tmp_path / "out" / r.file).read_bytes() for r in got) == [b"1", b"22", b"333"] and {r.file for r in got} >= {"plain.pdf"}


def test_large_covers_have_few_rows(spark):
    from pyspark.sql import functions as F

    boxes = spark.createDataFrame([(0.0, 0.0, 1e6, 1e6), (5.0, 5.0, 6.0, 6.0), (-1e9, 0.0, 1e9, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(5.5, 5.5), (-3.0, 0.5)], "x double, y double")
    p, b = relations.on_grids(points, boxes, 50.0, F.col("x"), F.col("y"), [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    assert b.count() <= 12
    hits = p.join(b, ["level", "cx", "cy"]).filter("x between x0 and x1 and y between y0 and y1")
    assert sorted((r.x, r.x1) for r in hits.collect()) == [(-3.0, 1e9), (5.5, 6.0), (5.5, 1e6)]
