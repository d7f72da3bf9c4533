import struct

import numpy as np
import pytest

from quire.pdf import jpeg, truetype
from quire.pdf.document import Document
from quire.pdf.functions import Function
from quire.pdf.objects import PdfError, Ref, Stream
from quire.pdf.write import page_file


def function(value, extra=None):
    return Function(Document(page_file([(b"", {})], extra or {})), value)


def test_functions_of_a_file():
    square = {b"FunctionType": 2, b"Domain": [0, 1], b"N": 2, b"C0": [0, 1], b"C1": [1, 0]}
    assert function(square)([0.5]) == [0.25, 0.75] and function(square)([7]) == [1.0, 0.0]
    line = {b"FunctionType": 2, b"Domain": [0, 1], b"N": 1}
    both = {b"FunctionType": 3, b"Domain": [0, 1], b"Functions": [line, line], b"Bounds": [0.5], b"Encode": [0, 1, 1, 0]}
    assert [function(both)([x])[0] for x in (0, 0.25, 0.5, 0.75, 1)] == [0, 0.5, 1, 0.5, 0]
    plane = Stream({b"FunctionType": 0, b"Domain": [0, 1, 0, 1], b"Range": [0, 1], b"Size": [2, 3], b"BitsPerSample": 8}, bytes([0, 85, 85, 170, 170, 255]))
    assert function(plane)([0.5, 0.25])[0] == pytest.approx((0.5 + 0.5) / 3)
    program = Stream({b"FunctionType": 4, b"Domain": [0, 1], b"Range": [0, 1]}, b"{ 2 mul dup 1 gt { pop 1 } if }")
    assert function(program)([0.3]) == [0.6] and function(program)([0.9]) == [1.0]
    assert function([square, program])([0.5]) == [0.25, 0.75, 1.0]
    with pytest.raises(PdfError, match="nesting"):
        function(Ref(100, 0), {100: {b"FunctionType": 3, b"Domain": [0, 1], b"Functions": [Ref(100, 0)], b"Bounds": [], b"Encode": [0, 1]}})


def font():
    four = struct.pack(">HHHHHHH", 4, 32, 0, 4, 4, 1, 0) + struct.pack(">2H", 0x42, 0xFFFF) + b"\0\0" + struct.pack(">2H", 0x41, 0xFFFF) + struct.pack(">2h", -0x40, 1) + struct.pack(">2H", 0, 0)
    variant = struct.pack(">HII", 14, 0, 1) + b"\x00\xfe\x00" + struct.pack(">II", 21, 29) + struct.pack(">I", 1) + b"\0\0\x41\0" + struct.pack(">I", 1) + b"\0\0\x42" + struct.pack(">H", 7)
    cmap = struct.pack(">HH", 0, 2) + struct.pack(">HHI", 3, 1, 20) + struct.pack(">HHI", 0, 5, 20 + len(four)) + four + variant
    glyf = struct.pack(">5h", 1, -1, -2, 300, 400) + b"\0\0"
    parts = {"cmap": cmap, "head": bytes(50) + struct.pack(">hh", 1, 0), "loca": struct.pack(">4I", 0, 0, len(glyf), len(glyf)), "glyf": glyf}
    at, head, body = 12 + 16 * len(parts), b"\0\1\0\0" + struct.pack(">HHHH", len(parts), 0, 0, 0), b""
    for k, v in parts.items():
        head += struct.pack(">4sIII", k.encode(), 0, at + len(body), len(v))
        body += v
    return head + body


def test_truetype():
    t = truetype.tables(font())
    plain, variants = truetype.character_map(t["cmap"])
    assert plain == {0x41: 1, 0x42: 2} and variants == {(0x41, 0xFE00): None, (0x42, 0xFE00): 7}
    assert truetype.glyph_box(t, 0) is None and truetype.glyph_box(t, 1) == (-1, -2, 300, 400)
    said = [truetype.evidence(s, g, plain, variants) for s, g in (("A", 1), ("A", 2), ("C", 1), ("A︀", 1), ("B︀", 2), ("AB", 1))]
    assert said == ["confirmed", "disagrees", "silent", "confirmed", "disagrees", "silent"]
    with pytest.raises(PdfError):
        truetype.tables(b"nothing")


def jpeg_of(levels):
    """A grey image of 8 x 8 blocks, each of one level, that are multiples of a step."""
    sizes = list(range(12))
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
    h, w = levels.shape
    out += b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h * 8 - 3, w * 8 - 1, 1) + bytes([1, 0x11, 0])
    out += b"\xff\xc4" + struct.pack(">HB", 19 + len(sizes), 0) + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(sizes)
    out += b"\xff\xc4" + struct.pack(">HB", 20, 0x10) + bytes([1, *[0] * 15]) + b"\0"
    out += b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0x00, 0, 63, 0])
    bits, before = "", 0
    for v in levels.ravel().tolist():
        d, before = v - 128 - before, v - 128
        n = abs(d).bit_length()
        bits += f"{n:04b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    return out + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_jpeg():
    levels = np.array([[0, 128, 255], [200, 17, 90]])
    got = jpeg.decode_jpeg(jpeg_of(levels))
    assert got["pixels"].shape == (13, 23, 1) and (got["pixels"][:, :, 0] == np.kron(levels, np.ones((8, 8), int))[:13, :23]).all()
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    for cut in range(0, 150, 7):
        with pytest.raises((PdfError, IndexError)):
            jpeg.decode_jpeg(jpeg_of(levels)[:cut])


def test_evidence_of_embedded_programs(spark):
    from quire.operators import documents
    from quire.pdf.objects import Name
    from quire.sources import pdf

    n = Name
    text = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <0043> endbfchar"
    extra = {
        100: {b"Subtype": n(b"Type0"), b"BaseFont": n(b"X"), b"Encoding": n(b"Identity-H"), b"DescendantFonts": [Ref(101, 0)], b"ToUnicode": Ref(103, 0)},
        101: {b"Subtype": n(b"CIDFontType2"), b"FontDescriptor": {b"FontFile2": Ref(102, 0)}, b"DW": 500},
        102: Stream({}, font()),
        103: Stream({}, text),
    }
    entries = {b"Resources": {b"Font": {b"F": Ref(100, 0)}}}
    pages = [(b"BT /F 9 Tf <0001> Tj ET", entries), (b"BT /F 9 Tf <00010002> Tj ET", entries)]
    files = spark.createDataFrame([("d", bytearray(page_file(pages, extra)))], "doc_id string, content binary")
    glyphs = pdf.table(pdf.parse_files(files), "pdf_glyphs")
    got = {r.page: (r.level, r.disagreeing) for r in documents.evidence_level(glyphs).collect()}
    assert got == {0: ("glyph-checked", 0), 1: ("encoding-only", 0)}
