import struct

import numpy as np
import pytest

from quire.operators import edits
from quire.pdf import edit, icc, metadata
from quire.pdf.document import Document
from quire.pdf.objects import Name, PdfError, Ref, Str
from quire.pdf.write import page_file


def profile(space, pcs, tags):
    head = bytearray(128)
    head[8], head[36:40], head[12:16], head[16:20], head[20:24] = 2, b"acsp", b"prtr", space, pcs
    at, table, body = 132 + 12 * len(tags), struct.pack(">I", len(tags)), b""
    for name, data in tags:
        table += struct.pack(">4sII", name, at + len(body), len(data))
        body += data
    return bytes(head) + table + body


def rgb_profile():
    xyz = lambda *v: b"XYZ \0\0\0\0" + struct.pack(">3i", *[round(x * 65536) for x in v])
    gamma = b"curv\0\0\0\0" + struct.pack(">IH", 1, 512)
    return profile(b"RGB ", b"XYZ ", [(b"rXYZ", xyz(0.4361, 0.2225, 0.0139)), (b"gXYZ", xyz(0.3851, 0.7169, 0.0971)), (b"bXYZ", xyz(0.1431, 0.0606, 0.7141)), *[(c + b"TRC", gamma) for c in (b"r", b"g", b"b")]])


def cmyk_profile():
    """Lab to ink through a table of 9 points: black ink by lightness alone."""
    n = 9
    grid = np.zeros((n, n, n, 4))
    grid[..., 3] = (1 - np.linspace(0, 1, n) * 65535 / 65280)[:, None, None].clip(0)
    line = np.linspace(0, 65535, 2).round().astype(">u2").tobytes()
    return profile(b"CMYK", b"Lab ", [(b"B2A0", b"mft2\0\0\0\0" + bytes([3, 4, n, 0]) + bytes(36) + struct.pack(">HH", 2, 2) + line * 3 + (grid * 65535).round().astype(">u2").tobytes() + line * 4)])


def test_profiles():
    p = icc.Profile(rgb_profile())
    white = p.to_lab(np.array([[1.0, 1, 1], [0, 0, 0]]))
    assert np.allclose(white, [[100, 0, 0], [0, 0, 0]], atol=0.1)
    t = icc.transform(p, icc.Profile(cmyk_profile()))
    out = t(np.array([[1.0, 1, 1], [0, 0, 0], [0.5, 0.5, 0.5]]))
    assert (out[0] == 0).all() and out[1, 3] == pytest.approx(1, abs=0.01) and 0.3 < out[2, 3] < 0.6
    assert icc.black_point(p, "relative") == pytest.approx(0, abs=1e-6)
    same = icc.transform(p, icc.Profile(cmyk_profile()), compensate=True)(np.array([[0.2, 0.5, 0.7]]))
    assert np.allclose(same, t(np.array([[0.2, 0.5, 0.7]])))
    x = np.random.default_rng(0).random((50, 3))
    plane = np.fromfunction(lambda i, j, k: i + 2 * j + 3 * k, (4, 4, 4))[..., None] / 3
    want = (x @ [1.0, 2, 3])[:, None]
    assert np.allclose(icc.tetrahedral(plane, x), want) and np.allclose(icc.multilinear(plane, x), want)
    assert np.allclose(icc.lab(icc.xyz(x * [100, 60, 60])), x * [100, 60, 60])
    with pytest.raises(PdfError):
        icc.Profile(b"x" * 200)


def test_metadata_is_set_on_both_sides():
    f = page_file([(b"", {})], {100: {b"Title": Str(b"old"), b"Custom": Str(b"kept")}}, trailer={b"Info": Ref(100, 0)})
    d = Document(edit.set_metadata(f, {"Title": "neu – größer", "CreationDate": "D:20240102030405+01'00'"}))
    rows = {r["key"]: r for r in metadata.properties(d)[0]}
    assert (rows["Title"]["info"], rows["Title"]["xmp"]) == ("neu – größer", ["neu – größer"])
    assert rows["CreationDate"]["xmp"] == ["2024-01-02T03:04:05+01:00"] and d.load(100)[b"Custom"] == Str(b"kept")
    form = {b"AcroForm": {b"Fields": [{b"FT": Name(b"Sig"), b"V": {}}]}}
    with pytest.raises(PdfError, match="signed"):
        edit.set_metadata(page_file([(b"", {})], catalog=form), {})


def test_boxes_and_colours():
    f = page_file([(b"1 0 0 rg 0 0 5 5 re f 0 g 0 0 1 RG q Q", {})])
    d = Document(edit.prepare_pages(f))
    assert d.boxes(d.pages[0])["TrimBox"] == ([0, 0, 600, 800], True)
    with pytest.raises(PdfError, match="invalid-box"):
        edit.set_boxes(f, {"TrimBox": [5, 5, 1, 1]})
    t = icc.transform(icc.Profile(rgb_profile()), icc.Profile(cmyk_profile()))
    c = Document(edit.convert_content(f, t))
    content = c.contents(c.pages[0])[0]
    assert b"rg" not in content and b"RG" not in content and b"0 0 0 1 k" in content and content.count(b" k\n") == 2


def test_output_intents():
    f = edit.add_output_intent(page_file([(b"", {})]), cmyk_profile(), "FOGRA39")
    d = Document(f)
    intent = d.get(d.get(d.catalog[b"OutputIntents"])[0])
    assert intent[b"OutputConditionIdentifier"] == Str(b"FOGRA39") and d.decoded(d.get(intent[b"DestOutputProfile"]))[0] == cmyk_profile()
    with pytest.raises(PdfError, match="has-output-intent"):
        edit.add_output_intent(f, cmyk_profile(), "x")


def test_rows_of_an_image():
    t = icc.transform(icc.Profile(rgb_profile()), icc.Profile(cmyk_profile()))
    p = np.array([[[255, 255, 255], [0, 0, 0]], [[255, 255, 255], [255, 255, 255]]], np.uint8)
    out = icc.convert_rows(p, t)
    assert out.shape == (2, 2, 4) and (out[p[..., 0] == 255] == 0).all() and out[0, 1, 3] > 250


def test_columns_of_geometry_and_identifiers(spark):
    import uuid

    from pyspark.sql import functions as F

    from quire.functions import colour, geometry, text

    u = uuid.uuid3(uuid.NAMESPACE_URL, "x")
    c1, c2 = geometry.quadratic_to_cubic(F.lit(0.0), F.lit(3.0), F.lit(0.0))
    x, _, z = colour.calibrated_rgb(F.lit(1.0), F.lit(0.5), F.lit(0.0), (1, 2, 1), (0.4, 0.2, 0.1, 0.3, 0.6, 0.1, 0.2, 0.1, 0.7))
    row = spark.range(1).select(c1.alias("c1"), c2.alias("c2"), x.alias("x"), z.alias("z"), geometry.miter(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("m"), text.uuid_text(F.md5(F.lit(uuid.NAMESPACE_URL.bytes + b"x"))).alias("u")).first()
    assert (row.c1, row.c2) == (2.0, 2.0) and row.x == pytest.approx(0.475) and row.z == pytest.approx(0.125)
    assert row.m == pytest.approx(2**0.5) and row.u == str(u)


def test_many_files_and_the_sink(spark, tmp_path):
    rows = [("a", bytearray(page_file([(b"", {})]))), ("b", bytearray(b"nothing")), ("c", None)]
    got = edits.edit_files(spark.createDataFrame(rows, "doc_id string, content binary"), edit.prepare_pages)
    by = {r.doc_id: r for r in got.collect()}
    assert by["a"].content and by["b"].error and by["c"].content is None and by["c"].error is None
    assert edits.write_files(got, str(tmp_path / "out")).collect()[0].file == "a.pdf"
    assert Document((tmp_path / "out" / "a.pdf").read_bytes()).pages


def test_colours_of_a_table(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0, 1.0, 1.0])], "id int, components array<double>")
    got = {r.id: r.converted for r in edits.convert_colours(df, rgb_profile(), cmyk_profile()).collect()}
    assert got[1] == got[3] == [0.0] * 4 and got[2][3] > 0.9
