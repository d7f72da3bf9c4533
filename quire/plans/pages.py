"""Queries that draw pages of one feature each from the driver's tables and ask what the files show."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import documents, edits
from ..pdf import edit, inks
from ..pdf.builder import Content, NewDocument
from ..pdf.document import Document
from ..pdf.encodings import LATIN
from ..pdf.objects import Name, PdfError, Ref, Str, Stream, serialize
from ..pdf.write import page_file, rewrite
from ..session import shared_dir, table
from ..sources import pdf
from .files import CHECKED, FONT, ORACLES, QUERIES, made, packet, parsed, query, text_page
from .formats import RGB, gamma_tag, profile, run_lengths, xyz_tag

__all__ = ["ORACLES", "QUERIES"]
F1 = {b"Resources": {b"Font": {b"F1": Ref(100, 0)}}}


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))


def key(name: str, kind: str = "int") -> F.Column:
    return F.col("doc_id").cast(kind).alias(name)


# ---------------------------------------------------------------------------- text

LISTS = "[" + ", ".join("[" + ", ".join(LATIN[n].split()) + "]" for n in LATIN) + "]"


@query(f"""WITH t AS (SELECT item_id, item_id % 6 AS f, replace(text, chr(10), ' ') AS text FROM benchmark), c AS (SELECT item_id, f, text, unnest(string_split(text, '')) AS c FROM t)
SELECT item_id, text, sum(CASE WHEN c = 'ß' THEN [611, 611, 500, 556, 500, 500][f + 1] WHEN c IN ('í', 'ì', 'î', 'ï') THEN 278 ELSE {LISTS}[f + 1][ord(strip_accents(c)) - 31] END)::BIGINT AS width FROM c GROUP BY 1, 2""")
def pdf_standard_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in six of the standard fonts, which name no widths: text and advances."""

    def make(r) -> bytes:
        font = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name([*LATIN][r.doc_id % 6].encode()), b"Encoding": Name(b"WinAnsiEncoding")}
        shown = r.text.replace("\n", " ").encode("cp1252")
        return page_file([(b"BT /F1 10 Tf 20 780 Td <" + shown.hex().encode() + b"> Tj ET", F1)], {100: font})

    files = made(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), make)
    (glyphs,) = parsed(files, "pdf_glyphs")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return glyphs.groupBy("doc_id").agg(text.alias("text"), F.sum("width").cast("long").alias("width")).select(key("item_id", "long"), "text", "width")


SYMBOLS = {0: (b"Symbol", b"abq\xa5\xb1", "αβθ∞±"), 1: (b"ZapfDingbats", b"\x21\x22\x48\xaa", "✁✂★♥"), 2: (b"Helvetica", b"\xae\xd0\xe9`", "ﬁ—Ø‘")}


@query("SELECT n_nationkey, ['αβθ∞±', '✁✂★♥', 'ﬁ—Ø‘', 'А€Ωéfi', 'Ж•ß'][n_nationkey % 5 + 1] AS text, CASE n_nationkey % 5 WHEN 0 THEN 2963 WHEN 1 THEN 0 WHEN 2 THEN 2500 WHEN 3 THEN 2500 ELSE 1500 END::BIGINT AS width FROM nation")
def pdf_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in encodings of symbol fonts and of the standard fonts, names of glyphs, and a named encoding with differences."""

    def make(r) -> bytes:
        k = r.doc_id % 5
        font = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name(SYMBOLS[k][0] if k < 3 else b"Helvetica")}
        if k >= 3:
            names = [b"afii10017", b"Euro", b"Omega", b"eacute", b"f_i"] if k == 3 else [b"afii10024"]
            font |= {b"Encoding": {b"BaseEncoding": Name(b"WinAnsiEncoding"), b"Differences": [65, *map(Name, names)]}, b"FirstChar": 0, b"Widths": [500] * 256}
        shown = SYMBOLS[k][1] if k < 3 else b"ABCDE" if k == 3 else b"A\x95\xdf"
        return page_file([(b"BT /F1 10 Tf 20 700 Td <" + shown.hex().encode() + b"> Tj ET", F1)], {100: font})

    (glyphs,) = parsed(made(nations(spark, sf_dir), make), "pdf_glyphs")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return glyphs.groupBy("doc_id").agg(text.alias("text"), F.sum("width").cast("long").alias("width")).select(key("n_nationkey"), "text", "width")


@query("SELECT n_nationkey, n_name AS text, CASE n_nationkey % 3 WHEN 0 THEN 10 * length(n_name) WHEN 1 THEN 5 * length(n_name) ELSE 0 END::DOUBLE AS right, CASE n_nationkey % 3 WHEN 2 THEN -8 * length(n_name) ELSE 0 END::DOUBLE AS down FROM nation")
def pdf_composite_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-byte codes with a map to text: default widths, widths of a range, and vertical writing with metrics of its own."""

    def make(r) -> bytes:
        k = r.doc_id % 3
        unicode = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0020> <007e> <0020> endbfrange"
        inner = {b"Type": Name(b"Font"), b"Subtype": Name(b"CIDFontType2"), b"BaseFont": Name(b"X"), b"CIDSystemInfo": {b"Registry": Str(b"Adobe"), b"Ordering": Str(b"Identity"), b"Supplement": 0}}
        inner |= {b"W": [0, 2147483647, 500]} if k == 1 else {b"W2": [32, 126, -800, 250, 880]} if k == 2 else {}
        font = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type0"), b"BaseFont": Name(b"X"), b"Encoding": Name(b"Identity-V" if k == 2 else b"Identity-H"), b"DescendantFonts": [Ref(101, 0)], b"ToUnicode": Ref(102, 0)}
        shown = r.name.encode("utf-16-be").hex().encode()
        tail = b" (\\000.) Tj"  # a stop shows where the pen is
        return page_file([(b"BT /F1 10 Tf 100 700 Td <" + shown + b"> Tj" + tail + b" ET", F1)], {100: font, 101: inner, 102: Stream({}, unicode)})

    (glyphs,) = parsed(made(nations(spark, sf_dir), make), "pdf_glyphs")
    ends = glyphs.groupBy("doc_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("t"))
    return ends.select(key("n_nationkey"), F.expr("left(t, length(t) - 1)").alias("text"), F.round(F.col("b.x") - F.col("a.x"), 6).alias("right"), F.round(F.col("b.y") - F.col("a.y"), 6).alias("down"))


MATCHED = {0: ("match", 1, "", ""), 1: ("mismatch", 1, "substituted", ""), 2: ("match", 3, "", ""), 3: ("unverified", 1, "unmapped", ""), 4: ("mismatch", 1, "substituted", "actual-text-disagrees"), 5: ("mismatch", 1, "extra,missing-glyph", "")}


@query("SELECT n_nationkey, " + ", ".join(f"{[m[i] for m in MATCHED.values()]}[n_nationkey % 6 + 1]{cast} AS {name}" for i, (name, cast) in enumerate([("status", ""), ("copies", "::INT"), ("kinds", ""), ("notes", "")])) + " FROM nation")
def pdf_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name and a ligature as they are; a letter changed; set three times as a shadow; with a glyph that has no text; under
    a text that says something else; with an empty glyph and one too many."""

    def make(r) -> bytes:
        k = r.doc_id % 6
        font = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name(b"Helvetica"), b"Encoding": {b"BaseEncoding": Name(b"WinAnsiEncoding"), b"Differences": [1, Name(b"fi"), Name(b"nosuch")]}}
        name = r.name.encode()
        shown = b"(" + (b"#" + name[1:] if k == 1 else name) + (b"\\002" if k == 3 else b"\\001") + b") Tj"
        if k == 2:  # each copy a little to the right
            shown = b" ".join(b"1 0 0 1 %.1f 600 Tm " % (50 + 0.3 * i) + shown for i in range(3))
        elif k == 4:
            shown = b"/Span <</ActualText (other)>> BDC (" + name + b"*) Tj EMC"
        elif k == 5:
            shown += b" /F2 10 Tf (a) Tj /F1 10 Tf (+) Tj"
        three = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type3"), b"FontMatrix": [0.001, 0, 0, 0.001, 0, 0], b"FontBBox": [0, 0, 500, 500], b"FirstChar": 97, b"LastChar": 97, b"Widths": [500], b"CharProcs": {b"a": Ref(102, 0)}, b"Encoding": {b"Differences": [97, Name(b"a")]}}
        start = b"BT /F1 10 Tf 1 0 0 1 50 600 Tm "
        return page_file([(start + shown + b" ET", {b"Resources": {b"Font": {b"F1": Ref(100, 0), b"F2": Ref(101, 0)}}})], {100: font, 101: three, 102: Stream({}, b"500 0 d0")})

    n = nations(spark, sf_dir)
    (glyphs,) = parsed(made(n, make), "pdf_glyphs")
    tail = F.when(F.col("doc_id") % 6 == 3, "?").when(F.col("doc_id") % 6 == 4, "!").otherwise("fi")
    want = n.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.concat("name", tail).alias("text"))
    told = documents.match_glyphs(glyphs, want)
    kinds = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda x: x["kind"]))), ",")
    return told.select(key("n_nationkey"), "status", "copies", kinds("differences").alias("kinds"), kinds("notes").alias("notes"))


def truetype(widths: list[int], characters: dict[int, int], variants: dict[tuple[int, int], int]) -> bytes:
    """A program of a thousand units an em whose glyphs are boxes as wide as given, the first one empty, with two maps of characters."""
    glyf = [b"" if not w else struct.pack(">5h", 1, 0, 0, w, 500) + bytes(10) for w in widths]
    loca = struct.pack(f">{len(widths) + 1}I", *[sum(map(len, glyf[:k])) for k in range(len(widths) + 1)])
    head = bytes(18) + struct.pack(">H", 1000) + bytes(30) + struct.pack(">hh", 1, 0)
    codes = sorted(characters)
    wide = struct.pack(">HHIII", 12, 0, 16 + 12 * len(codes), 0, len(codes)) + b"".join(struct.pack(">III", c, c, characters[c]) for c in codes)
    by: dict[int, list[tuple[int, int]]] = {}
    for (c, selector), g in sorted(variants.items()):
        by.setdefault(selector, []).append((c, g))
    own, lists = b"", b""
    for selector, each in by.items():
        own += selector.to_bytes(3, "big") + struct.pack(">II", 0, 10 + 11 * len(by) + len(lists))
        lists += struct.pack(">I", len(each)) + b"".join(c.to_bytes(3, "big") + struct.pack(">H", g) for c, g in each)
    chosen = struct.pack(">HII", 14, 10 + len(own) + len(lists), len(by)) + own + lists
    cmap = struct.pack(">HHHHIHHI", 0, 2, 0, 5, 20, 3, 10, 20 + len(chosen)) + chosen + wide
    out, at, body = b"\0\1\0\0" + struct.pack(">H", 4) + bytes(6), 12 + 16 * 4, b""
    for tag, data in ((b"cmap", cmap), (b"glyf", b"".join(glyf)), (b"head", head), (b"loca", loca)):
        out += struct.pack(">4sIII", tag, 0, at + len(body), len(data))
        body += data
    return out + body


@query("SELECT p_partkey, ['confirmed', 'disagrees', 'silent', 'confirmed'][p_partkey % 4 + 1] AS evidence, CASE WHEN p_partkey % 4 <> 2 THEN round(p_size * (p_partkey % 4 + 1) * 0.1, 6) END::DOUBLE AS ink, CASE WHEN p_partkey % 4 IN (0, 3) THEN 'glyph-checked' ELSE 'encoding-only' END AS level FROM part")
def pdf_embedded_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of embedded programs: whether the program's own map leads from the text to the glyph, one with a variation
    selector among them, and the boxes of their outlines."""

    def make(r) -> bytes:
        k = r.doc_id % 4
        program = truetype([0, 10 * r.size, 20 * r.size, 0, 40 * r.size], {65: 1, 66: 2, 0x845B: 2}, {(0x845B, 0xE0100): 4})
        glyph = (1, 2, 3, 4)[k]  # the text says A, A, Z and a character with a selector
        text = ("0041", "0041", "005a", "845bdb40dd00")[k].encode()
        unicode = Stream({}, b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <%04x> <%s> endbfchar" % (glyph, text))
        inner = {b"Subtype": Name(b"CIDFontType2"), b"BaseFont": Name(b"X"), b"CIDToGIDMap": Name(b"Identity"), b"FontDescriptor": {b"FontFile2": Ref(103, 0)}}
        font = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type0"), b"BaseFont": Name(b"X"), b"Encoding": Name(b"Identity-H"), b"DescendantFonts": [Ref(101, 0)], b"ToUnicode": Ref(102, 0)}
        return page_file([(b"BT /F1 10 Tf 100 700 Td <%04x> Tj ET" % glyph, F1)], {100: font, 101: inner, 102: unicode, 103: Stream({}, program)})

    (glyphs,) = parsed(made(parts(spark, sf_dir), make), "pdf_glyphs")
    told = documents.evidence_level(glyphs).select("doc_id", "level")
    return glyphs.join(told, "doc_id").select(key("p_partkey", "long"), "evidence", F.round(F.col("ink")[2] - F.col("ink")[0], 6).alias("ink"), "level")


# ---------------------------------------------------------------------------- content


@query("SELECT p_partkey, (p_partkey * 7) % 480 + (p_partkey * 13) % 480 - 1.2 > 500 AS triangle, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 7) % 480 > 100 AND (p_partkey * 7) % 480 < 295 ELSE false END AS hole FROM part")
def pdf_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs under a triangle; and under bands that cross, of which the even-odd rule leaves a hole and the nonzero rule none."""

    def make(r) -> bytes:
        x, y = r.doc_id * 7 % 480, r.doc_id * 13 % 480
        rule = b"W*" if r.doc_id % 2 == 0 else b"W"
        one = b"q 0 0 m 500 0 l 0 500 l h W n BT /F1 10 Tf %d %d Td (A) Tj ET Q " % (x, y)
        two = b"q 0 0 600 800 re 100 0 200 800 re %s n BT /F1 10 Tf %d 400 Td (B) Tj ET Q" % (rule, x)
        return page_file([(one + two, F1)], {100: FONT})

    (glyphs,) = parsed(made(parts(spark, sf_dir), make), "pdf_glyphs")
    return glyphs.groupBy(key("p_partkey", "long")).agg(F.max(F.when(F.col("text") == "A", F.col("clipped"))).alias("triangle"), F.max(F.when(F.col("text") == "B", F.col("clipped"))).alias("hole"))


@query("SELECT p_partkey, (2.0 * (p_size + 10) + 5)::DOUBLE AS x, (3.0 * 20 + 7 + p_size)::DOUBLE AS y FROM part")
def pdf_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glyph in a form with a matrix, drawn under another one; the form's font is the page's."""

    def make(r) -> bytes:
        form = Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"BBox": [0, 0, 500, 500], b"Matrix": [1, 0, 0, 1, 10, 20]}, b"BT /F1 5 Tf %d 0 Td (x) Tj ET" % r.size)
        entries = {b"Resources": {b"Font": {b"F1": Ref(100, 0)}, b"XObject": {b"X": Ref(101, 0)}}}
        return page_file([(b"q 2 0 0 3 5 7 cm Q q 1 0 0 1 0 %d cm 2 0 0 3 5 7 cm /X Do Q" % r.size, entries)], {100: FONT, 101: form})

    (glyphs,) = parsed(made(parts(spark, sf_dir), make), "pdf_glyphs")
    return glyphs.select(key("p_partkey", "long"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


HIDDEN = ["render-mode", "transparent", "degenerate", "soft-mask", "empty", "shown"]


@query(f"SELECT n_nationkey, {HIDDEN}[n_nationkey % 6 + 1] AS hidden, CASE WHEN n_nationkey % 6 = 4 THEN 'Type3' ELSE 'Type1' END AS subtype FROM nation")
def pdf_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a glyph can't be seen: its mode, its opacity, its size, as part of a mask, or an empty procedure."""

    def make(r) -> bytes:
        k = r.doc_id % 6
        state = (b"3 Tr", b"/G gs", b"0 0 0 0 0 0 cm", b"", b"", b"")[k]
        shown = b"BT /F1 10 Tf 50 600 Td (a) Tj ET"
        mask = Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"BBox": [0, 0, 600, 800], b"Group": {b"S": Name(b"Transparency")}}, shown)
        three = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type3"), b"FontMatrix": [0.001, 0, 0, 0.001, 0, 0], b"FontBBox": [0, 0, 500, 500], b"FirstChar": 97, b"LastChar": 97, b"Widths": [500], b"CharProcs": {b"a": Ref(103, 0)}, b"Encoding": {b"Differences": [97, Name(b"a")]}}
        extra = {100: three if k == 4 else FONT, 101: {b"ca": 0} if k == 1 else {b"SMask": {b"S": Name(b"Alpha"), b"G": Ref(102, 0)}}, 102: mask, 103: Stream({}, b"500 0 d0")}
        entries = {b"Resources": {b"Font": {b"F1": Ref(100, 0)}, b"ExtGState": {b"G": Ref(101, 0)}}}
        return page_file([(b"/G gs" if k == 3 else state + b" " + shown, entries)], extra)

    glyphs, fonts = parsed(made(nations(spark, sf_dir), make), "pdf_glyphs", "pdf_fonts")
    return glyphs.join(fonts.select("doc_id", "subtype"), "doc_id").select(key("n_nationkey"), F.coalesce("hidden", F.lit("shown")).alias("hidden"), "subtype")


EVENTS = {
    0: (b"BX 1 2 odd EX 0 0 1 rg 0 0 9 9 re f", "fill DeviceRGB", 0), 1: (b"/S sh", "shading Separation/Gold", 0), 2: (b"BI /W 1 /H 1 /BPC 8 /CS /G ID x EI", "image Image", 0), 3: (b"/P cs /T scn 0 0 50 50 re f", "fill Pattern|fill DeviceCMYK", 0),
    4: (b"0 0 9 9 re B* 1 w (x) J", "fill DeviceGray|stroke DeviceGray", 1), 5: (b"1 2 odd 0 0 m 5 5 l 9 0 l S", "stroke DeviceGray", 1),
}


@query("SELECT n_nationkey, [" + ", ".join(f"'{v[1]}'" for v in EVENTS.values()) + "][n_nationkey % 6 + 1] AS paints, [" + ", ".join(str(v[2]) for v in EVENTS.values()) + "][n_nationkey % 6 + 1]::BIGINT AS warnings FROM nation")
def pdf_paint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills, strokes, shadings with their real space, images within content, pattern cells; and operands that are checked."""

    def make(r) -> bytes:
        gold = [Name(b"Separation"), Name(b"Gold"), Name(b"DeviceCMYK"), {b"FunctionType": 2, b"N": 1, b"Domain": [0, 1]}]
        cell = Stream({b"PatternType": 1, b"PaintType": 1, b"TilingType": 1, b"BBox": [0, 0, 9, 9], b"XStep": 9, b"YStep": 9, b"Resources": {}}, b"0 0 0 1 k 1 1 2 2 re f")
        entries = {b"Resources": {b"Shading": {b"S": {b"ShadingType": 2, b"ColorSpace": gold, b"Coords": [0, 0, 9, 9]}}, b"ColorSpace": {b"P": Name(b"Pattern")}, b"Pattern": {b"T": Ref(100, 0)}}}
        return page_file([(EVENTS[r.doc_id % 6][0], entries)], {100: cell})

    files = made(nations(spark, sf_dir), make)
    paints, warnings = parsed(files, "pdf_paints", "pdf_warnings")
    said = warnings.filter("stage = 'content'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    each = paints.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat_ws(" ", "what", "space").alias("t")))), lambda x: x["t"]), "|").alias("paints"))
    return each.join(said, "doc_id", "left").select(key("n_nationkey"), "paints", F.coalesce("n", F.lit(0)).alias("warnings"))


@query("SELECT n_nationkey, n_name AS text, length(n_name)::BIGINT AS glyphs FROM nation")
def pdf_marked_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that marked content gives instead of what its glyphs say, named in the page's properties or written in place."""

    def make(r) -> bytes:
        shown = b"(" + b"?" * len(r.name) + b") Tj EMC ET"
        inline = b"BT /F1 9 Tf 9 9 Td /Span <</ActualText (" + r.name.encode() + b")>> BDC /Inner BMC EMC " + shown
        named = b"BT /F1 9 Tf 9 9 Td /Span /M BDC " + shown
        entries = {b"Resources": {b"Font": {b"F1": Ref(100, 0)}, b"Properties": {b"M": {b"ActualText": Str(b"\xfe\xff" + r.name.encode("utf-16-be"))}}}}
        return page_file([(named if r.doc_id % 2 else inline, entries)], {100: FONT})

    (glyphs,) = parsed(made(nations(spark, sf_dir), make), "pdf_glyphs")
    count = glyphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("glyphs"))
    return documents.page_text(glyphs).join(count, "doc_id").select(key("n_nationkey"), "text", "glyphs")


@query("SELECT n_nationkey, unnest([n_name || '/x', 'Gold', 'Base', 'Sky']) AS colorant, unnest([['painted', 'selected', 'declared'], ['selected', 'declared'], ['alternate'], ['declared']]) AS uses, 8::BIGINT AS reached FROM nation")
def pdf_declared_colorants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot colours that pages paint with, choose, only declare within forms and masks, or that stand for others; and all
    resources that a page can reach, through a form that draws itself."""

    def make(r) -> bytes:
        tint = {b"FunctionType": 2, b"N": 1, b"Domain": [0, 1]}
        spot = lambda name, base: [Name(b"Separation"), Name(name), base, tint]
        base = spot(b"Base", Name(b"DeviceCMYK"))
        several = [Name(b"DeviceN"), [Name(r.name.encode() + b"/x")], base, tint]
        inner = {b"ColorSpace": {b"S": spot(b"Sky", Name(b"DeviceCMYK"))}, b"XObject": {b"X": Ref(100, 0)}}
        form = Stream({b"Subtype": Name(b"Form"), b"BBox": [0, 0, 9, 9], b"Resources": inner}, b"")
        mask = Stream({b"Subtype": Name(b"Form"), b"BBox": [0, 0, 9, 9], b"Resources": {b"Properties": {b"M": {}}}}, b"")
        shade = {b"ShadingType": 2, b"ColorSpace": Name(b"DeviceCMYK"), b"Coords": [0, 0, 1, 1], b"Function": tint}
        entries = {b"ColorSpace": {b"A": several, b"B": spot(b"Gold", Name(b"DeviceCMYK"))}, b"XObject": {b"X": Ref(100, 0)}, b"ExtGState": {b"G": {b"SMask": {b"S": Name(b"Alpha"), b"G": Ref(101, 0)}}}, b"Shading": {b"H": shade}, b"Pattern": {b"P": {b"PatternType": 2, b"Shading": shade}}}
        return page_file([(b"/A cs 1 scn 0 0 9 9 re f /B cs", {b"Resources": entries})], {100: form, 101: mask})

    paints, selects, glyphs, resources = parsed(made(nations(spark, sf_dir), make), "pdf_paints", "pdf_selects", "pdf_glyphs", "pdf_resources")
    count = resources.groupBy("doc_id").agg(F.count(F.lit(1)).alias("reached"))
    return documents.list_colorants(paints, selects, glyphs, resources).join(count, "doc_id").select(key("n_nationkey"), "colorant", "uses", "reached")


@query("SELECT p_partkey, p_size::INT AS code, p_size % 2 = 0 AS empty, CASE WHEN p_size % 3 = 0 THEN [0.0, 0.0, p_size, 9.0]::DOUBLE[] END AS box FROM part")
def pdf_type3_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph procedures that paint nothing, and the boxes that some of them state."""

    def make(r) -> bytes:
        start = b"500 0 0 0 %d 9 d1 " % r.size if r.size % 3 == 0 else b"500 0 d0 "
        font = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type3"), b"FontMatrix": [0.001, 0, 0, 0.001, 0, 0], b"FontBBox": [0, 0, 500, 500], b"FirstChar": r.size, b"LastChar": r.size, b"Widths": [500], b"CharProcs": {b"a": Ref(101, 0)}, b"Encoding": {b"Differences": [r.size, Name(b"a")]}}
        return page_file([(b"BT /F1 9 Tf <%02x> Tj ET" % r.size, F1)], {100: font, 101: Stream({}, start + (b"" if r.size % 2 == 0 else b"0 0 5 5 re f"))})

    (found,) = parsed(made(parts(spark, sf_dir), make), "pdf_type3")
    return found.select(key("p_partkey", "long"), "code", "empty", "box")


@query("SELECT n_nationkey, [1, 2, 3][n_nationkey % 3 + 1]::BIGINT AS paints, n_name AS text FROM nation")
def pdf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearances of annotations that are drawn with a page: a hidden one never, one that isn't printed only on demand; and
    text through a character map that the caller gives."""
    maps = {"Own-H": b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 begincidrange <0000> <ffff> 1 endcidrange"}

    def make(r) -> bytes:
        look = Stream({b"Subtype": Name(b"Form"), b"BBox": [0, 0, 9, 9]}, b"0 0 9 9 re f")
        note = lambda flags: {b"Subtype": Name(b"Square"), b"Rect": [50, 50, 70, 70], b"F": flags, b"AP": {b"N": Ref(103, 0)}}
        unicode = Stream({}, b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0020> <007e> <0020> endbfrange")
        font = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type0"), b"BaseFont": Name(b"X"), b"Encoding": Name(b"Own-H"), b"DescendantFonts": [{b"Subtype": Name(b"CIDFontType0"), b"BaseFont": Name(b"X")}], b"ToUnicode": Ref(104, 0)}
        shown = b"BT /F1 9 Tf <" + r.name.encode("utf-16-be").hex().encode() + b"> Tj ET 0 0 1 1 re f"
        notes = [note(2 | 4), *[note(0)] * (r.doc_id % 3)]
        return page_file([(shown, F1 | {b"Annots": notes})], {100: font, 103: look, 104: unicode})

    path = f"{shared_dir(spark)}/quire-records-{uuid.uuid4().hex}"
    names = ["pdf_paints", "pdf_glyphs"]
    paints, glyphs = pdf.write_tables(pdf.parse_files(made(nations(spark, sf_dir), make), names, annotations="all", maps=maps), path, names)
    count = paints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paints"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return count.join(glyphs.groupBy("doc_id").agg(text.alias("text")), "doc_id").select(key("n_nationkey"), "paints", "text")


# ---------------------------------------------------------------------------- structure


def packed(objects: dict[int, object], root: int) -> bytes:
    """A file whose plain objects lie in an object stream and whose section is a stream with prediction."""
    plain = {n: serialize(v) for n, v in objects.items() if not isinstance(v, Stream)}
    heads, body = [], b""
    for n, raw in plain.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += raw + b" "
    head = b" ".join(heads) + b" "
    holder, section = max(objects) + 1, max(objects) + 2
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for n, v in [*((n, v) for n, v in objects.items() if isinstance(v, Stream)), (holder, Stream({b"Type": Name(b"ObjStm"), b"N": len(plain), b"First": len(head), b"Filter": Name(b"FlateDecode")}, zlib.compress(head + body)))]:
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + serialize(v) + b"\nendobj\n"
    at = len(out)
    place = {n: (2, holder, k) for k, n in enumerate(plain)} | {n: (1, p, 0) for n, p in places.items()} | {section: (1, at, 0)}
    rows = [bytes([place.get(n, (0, 0, 0))[0]]) + place.get(n, (0, 0, 0))[1].to_bytes(3, "big") + place.get(n, (0, 0, 0))[2].to_bytes(2, "big") for n in range(section + 1)]
    up = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(r, p, strict=True)) for r, p in zip(rows, [bytes(6), *rows], strict=False))
    entries = {b"Type": Name(b"XRef"), b"Size": section + 1, b"W": [1, 3, 2], b"Root": Ref(root, 0), b"Filter": Name(b"FlateDecode"), b"DecodeParms": {b"Predictor": 12, b"Columns": 6}}
    out += b"%d 0 obj\n" % section + serialize(Stream(entries, zlib.compress(up))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


@query("SELECT n_nationkey, ['intact', 'reconstructed', 'intact', NULL, NULL][n_nationkey % 5 + 1] AS status, [NULL, NULL, NULL, 'encrypted-document', 'missing-catalog'][n_nationkey % 5 + 1] AS error, CASE WHEN n_nationkey % 5 < 3 THEN n_name END AS value FROM nation")
def pdf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as they are, found by a scan where the section is lost, with packed objects, refused as encrypted, or no files at all."""

    def make(r) -> bytes:
        k, value = r.doc_id % 5, {b"V": Str(r.name.encode())}
        if k == 2:
            content = Stream({}, b"")
            return packed({1: {b"Type": Name(b"Catalog"), b"Pages": Ref(2, 0)}, 2: {b"Type": Name(b"Pages"), b"Kids": [Ref(3, 0)], b"Count": 1}, 3: {b"Type": Name(b"Page"), b"Parent": Ref(2, 0), b"MediaBox": [0, 0, 9, 9], b"Contents": Ref(4, 0)}, 4: content, 100: value}, 1)
        f = page_file([(b"", {b"X": Ref(100, 0)})], {100: value}, trailer={b"Encrypt": {b"Filter": Name(b"Standard")}} if k == 3 else {})
        return f.replace(b"startxref\n", b"startxref\n9") if k == 1 else b"nothing of the kind" if k == 4 else f

    docs, nodes = parsed(made(nations(spark, sf_dir), make), "pdf_documents", "pdf_nodes")
    value = nodes.filter("object_number = 100 and path = '/V'").select("doc_id", F.col("bytes").alias("value"))
    return docs.join(value, "doc_id", "left").select(key("n_nationkey"), "status", F.col("error_code").alias("error"), "value")


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents")
def pdf_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a compressed stream of a file, decoded again: Flate, run lengths, or both."""

    def make(r) -> bytes:
        raw, k = (r.text or "").encode(), r.doc_id % 3
        data = zlib.compress(raw) if k == 0 else run_lengths(raw) if k == 1 else run_lengths(zlib.compress(raw))
        names = [[b"FlateDecode"], [b"RunLengthDecode"], [b"RunLengthDecode", b"FlateDecode"]][k]
        return page_file([(b"", {b"X": Ref(100, 0)})], {100: Stream({b"Filter": [Name(n) for n in names] if k == 2 else Name(names[0])}, data)})

    (objects,) = parsed(made(table(spark, sf_dir, "documents").select("doc_id", "text"), make), "pdf_objects")
    return objects.filter("object_number = 100").select(key("doc_id", "long"), F.col("decoded_digest").alias("digest"), F.col("decoded_size").alias("size"))


# ---------------------------------------------------------------------------- metadata


@query("SELECT n_nationkey, ['utf-8', 'utf-16', NULL, NULL, NULL][n_nationkey % 5 + 1] IS NOT NULL AS read, [NULL, NULL, 'xmp-doctype', 'xmp-doctype', 'xmp-entity'][n_nationkey % 5 + 1] AS finding, CASE WHEN n_nationkey % 5 < 2 THEN n_name END AS title FROM nation")
def pdf_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets in two encodings; a declaration of a document type is refused in either, behind a long comment, and so is an entity."""

    def make(r) -> bytes:
        k = r.doc_id % 5
        text = packet("&unknown;" if k == 4 else r.name).data.decode()
        if k in (2, 3):
            text = "<!--" + "x" * 120_000 + '--><!DOCTYPE a [<!ENTITY b "leak">]>' + text
        raw = text.encode("utf-16") if k in (1, 3) else text.encode()
        return page_file([(b"", {})], {101: Stream({b"Type": Name(b"Metadata"), b"Subtype": Name(b"XML")}, raw)}, {b"Metadata": Ref(101, 0)})

    properties, warnings = parsed(made(nations(spark, sf_dir), make), "pdf_properties", "pdf_warnings")
    said = warnings.filter("stage = 'metadata'").groupBy("doc_id").agg(F.min("code").alias("finding"))
    title = properties.filter("key = 'Title'").select("doc_id", F.get("xmp", F.lit(0)).alias("title"))
    return title.join(said, "doc_id", "left").select(key("n_nationkey"), F.col("finding").isNull().alias("read"), "finding", "title")


DC = "http://purl.org/dc/elements/1.1/"


@query("SELECT n_nationkey, n_name AS title, 'kept & safe' AS rights, n_name AS info, 'two' AS qualified, 2::INT AS packets FROM nation")
def pdf_set_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new title on both sides; every other property of the packet stays, and the old packet is superseded."""

    def make(r) -> bytes:
        more = f'<rdf:Description rdf:about="" xmlns:dc="{DC}" xmlns:q="urn:q" dc:rights="kept &amp; safe"><q:s rdf:parseType="Resource"><q:one>1</q:one><q:two>two</q:two></q:s></rdf:Description></rdf:RDF>'
        body = '<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?>' + packet("old").data.decode().replace("</rdf:RDF>", more) + '<?xpacket end="w"?>'
        stream = Stream({b"Type": Name(b"Metadata"), b"Subtype": Name(b"XML")}, body.encode())
        f = page_file([(b"", {})], {101: stream, 102: {b"Title": Str(b"old")}}, {b"Metadata": Ref(101, 0)}, {b"Info": Ref(102, 0)})
        return edit.set_metadata(f, {"Title": r.name})

    properties, xmp, scanned = parsed(made(nations(spark, sf_dir), make), "pdf_properties", "pdf_xmp", "pdf_packets")
    value = lambda name, out: xmp.filter(F.col("name") == name).select("doc_id", F.col("values")[0].alias(out))
    info = properties.filter("key = 'Title'").select("doc_id", "info")
    joined = value(f"{{{DC}}}title", "title").join(value(f"{{{DC}}}rights", "rights"), "doc_id").join(value("{urn:q}s/{urn:q}two", "qualified"), "doc_id").join(info, "doc_id").join(scanned, "doc_id")
    return joined.select(key("n_nationkey"), "title", "rights", "info", "qualified", (F.col("document") + F.col("superseded")).alias("packets"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS signed, CASE WHEN n_nationkey % 2 = 0 THEN 'signed-document' END AS error FROM nation")
def pdf_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms with a signature field, filled or empty, below another field that names its parent again; a signed file is not changed."""

    def make(r) -> bytes:
        field = {b"FT": Name(b"Sig"), b"Kids": [Ref(100, 0)]} | ({b"V": {b"Type": Name(b"Sig")}} if r.doc_id % 2 == 0 else {})
        return page_file([(b"", {})], {100: {b"T": Str(b"top"), b"Kids": [Ref(101, 0)]}, 101: field}, {b"AcroForm": {b"Fields": [Ref(100, 0)]}})

    files = made(nations(spark, sf_dir), make)
    (docs,) = parsed(files, "pdf_documents")
    edited = edits.edit_files(files, lambda b: edit.set_metadata(b, {"Title": "new"})).select("doc_id", "error")
    return docs.select("doc_id", "signed").join(edited, "doc_id").select(key("n_nationkey"), "signed", "error")


@query("SELECT n_nationkey, ['info', 'xmp', 'xmp', 'indeterminate'][n_nationkey % 4 + 1] AS authority FROM nation")
def pdf_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose date of change is later: the dictionary's, the packet's, the same, or one that can't be read."""

    def make(r) -> bytes:
        k = r.doc_id % 4
        old, new = (b"D:20240102030405Z", "2024-01-01T00:00:00Z") if k == 0 else (b"D:20240102030405Z", "2024-02-01T00:00:00Z") if k == 1 else (b"D:20240102030405+01'00'", "2024-01-02T02:04:05Z") if k == 2 else (b"yesterday", "2024-01-02")
        body = packet("x").data.decode().replace("</rdf:Description>", f'<m:ModifyDate xmlns:m="http://ns.adobe.com/xap/1.0/">{new}</m:ModifyDate></rdf:Description>')
        return page_file([(b"", {})], {101: Stream({b"Type": Name(b"Metadata")}, body.encode()), 102: {b"ModDate": Str(old)}}, {b"Metadata": Ref(101, 0)}, {b"Info": Ref(102, 0)})

    (properties,) = parsed(made(nations(spark, sf_dir), make), "pdf_properties")
    return documents.authority(properties).select(key("n_nationkey"), "authority")


# ---------------------------------------------------------------------------- edits, comparison, rules


@query("SELECT n_nationkey, ['intact', 'intact', 'intact', 'intact'][n_nationkey % 4 + 1] AS status, CASE n_nationkey % 4 WHEN 0 THEN [0.0, 0.0, 600.0, 800.0] WHEN 1 THEN [10.0, 10.0, 300.0, 400.0] END::DOUBLE[] AS trim, CASE WHEN n_nationkey % 4 = 2 THEN 'FOGRA39' END AS condition, CASE WHEN n_nationkey % 4 = 3 THEN 1 ELSE 2 END::INT AS sections FROM nation")
def pdf_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages prepared for print, boxes set, an intent added, each as an update; and a file written anew."""
    ink = profile(b"CMYK", b"Lab ", [(b"B2A0", b"mft1" + bytes(60))])
    change = {0: edit.prepare_pages, 1: lambda b: edit.set_boxes(b, {"TrimBox": [10, 10, 300, 400]}), 2: lambda b: edit.add_output_intent(b, ink, "FOGRA39"), 3: lambda b: rewrite(Document(b))}
    files = made(nations(spark, sf_dir), lambda r: change[r.doc_id % 4](page_file([text_page(r.name)], {100: FONT})))
    docs, pages, intents = parsed(files, "pdf_documents", "pdf_pages", "pdf_intents")
    trim = pages.select("doc_id", F.when(F.array_contains("explicit", "TrimBox"), F.col("trim")).alias("trim"))
    return docs.select("doc_id", "status", "sections").join(trim, "doc_id").join(intents.select("doc_id", "condition"), "doc_id", "left").select(key("n_nationkey"), "status", "trim", "condition", "sections")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '0 0 0 1 k' WHEN 1 THEN '0 0 0 0.5 k' ELSE '0.9 0.5 0.2 0 K' END AS set, n_name AS text FROM nation")
def pdf_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of pages in ink: black and grey as black ink alone, others by a function; pages that shared a stream no longer do."""
    colours = {0: b"0 0 0 rg ", 1: b"0.5 g ", 2: b"0.1 0.5 0.8 RG "}

    def make(r) -> bytes:
        content, entries = text_page(r.name)
        shared = entries | {b"Contents": Ref(200, 0)}
        f = page_file([(b"", shared), (b"", shared)], {100: FONT, 200: Stream({}, colours[r.doc_id % 3] + content)})
        return edit.convert_content(f, lambda x: pd.concat([pd.DataFrame(1 - x).round(6), pd.Series([0.0] * len(x))], axis=1).to_numpy())

    operations, glyphs = parsed(made(nations(spark, sf_dir), make), "pdf_operations", "pdf_glyphs")
    ink = operations.filter("page = 1 and operator in ('k', 'K')").select("doc_id", F.concat_ws(" ", "operands", "operator").alias("set"))
    return ink.join(documents.page_text(glyphs).filter("page = 1"), "doc_id").select(key("n_nationkey"), "set", "text")


@query("SELECT n_nationkey, ['page-count', 'page-fonts', 'fonts', 'page-piece', 'page-box'][k + 1] AS kind, ['', 'Type1/Courier/WinAnsiEncoding/none', 'Type1/Courier/WinAnsiEncoding/none', '/PieceInfo/App/V', 'Rotate'][k + 1] AS path FROM (SELECT n_nationkey, unnest(CASE n_nationkey % 4 WHEN 0 THEN [0] WHEN 1 THEN [1, 2] WHEN 2 THEN [3] ELSE [4] END) AS k FROM nation)")
def pdf_compare_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies with a page more, another font, other private data, or turned."""

    def make(r, changed: bool) -> bytes:
        k = r.doc_id % 4 if changed else -1
        fonts = {b"F1": Ref(100, 0)} | ({b"F2": Ref(101, 0)} if k == 1 else {})
        entries = {b"Resources": {b"Font": fonts}, b"PieceInfo": {b"App": {b"V": 2 if k == 2 else 1}}} | ({b"Rotate": 90} if k == 3 else {})
        show = b"BT /F1 9 Tf (x) Tj ET" + b" BT /F2 9 Tf ET" * (k == 1)
        content = b"BT /F1 9 Tf (x) Tj ET"
        return page_file([(show if k == 1 else content, entries)] + [(content, {})] * (k == 0), {100: FONT, 101: FONT | {b"BaseFont": Name(b"Courier")}})

    n = nations(spark, sf_dir)
    files = made(n, lambda r: make(r, False)).withColumn("doc_id", F.concat(F.lit("a"), "doc_id")).unionByName(made(n, lambda r: make(r, True)).withColumn("doc_id", F.concat(F.lit("b"), "doc_id")))
    pages, fonts, values = parsed(files, "pdf_pages", "pdf_fonts", "pdf_values")
    pairs = n.select(F.concat(F.lit("a"), "doc_id").alias("a"), F.concat(F.lit("b"), "doc_id").alias("b"))
    found = documents.compare(pairs, pages, fonts, values).filter("kind <> 'page-content'")
    return found.select(F.substring("a", 2, 9).cast("int").alias("n_nationkey"), "kind", "path")


@query("SELECT n_nationkey, ['attributes', 'attributes', 'attributes', 'attributes'][n_nationkey % 5] AS kind, CASE WHEN n_nationkey % 5 IN (1, 4) THEN 0 END::INT AS page, ['/Annots/0/Contents', '/Names/Deep/V', '/Lang', '/Look/(data)'][n_nationkey % 5] AS path FROM nation WHERE n_nationkey % 5 > 0")
def pdf_compare_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that differ behind references: in an annotation that names its page, deep in the catalog's names, whose parts
    refer back, in the catalog itself, or in a stream that is only stored in another way, or holds something else."""

    def make(r, changed: bool) -> bytes:
        k = r.doc_id % 5 if changed else 0
        note = {b"Type": Name(b"Annot"), b"Subtype": Name(b"Text"), b"P": Ref(10, 0), b"Contents": Str(b"new" if k == 1 else b"old")}
        deep = {b"V": 2 if k == 2 else 1, b"Back": Ref(101, 0)}
        data = b"other" if k == 4 else b"same data"
        stream = Stream({b"Filter": Name(b"FlateDecode")}, zlib.compress(data)) if changed else Stream({}, data)
        number = 120 if changed else 100  # object numbers never matter
        extra = {number: note, 101: {b"Deep": Ref(102, 0)}, 102: deep, 103: stream}
        return page_file([(b"", {b"Annots": [Ref(number, 0)], b"Look": Ref(103, 0)})], extra, {b"Names": Ref(101, 0), b"Lang": Str(b"de" if k == 3 else b"en")})

    n = nations(spark, sf_dir)
    files = made(n, lambda r: make(r, False)).withColumn("doc_id", F.concat(F.lit("a"), "doc_id")).unionByName(made(n, lambda r: make(r, True)).withColumn("doc_id", F.concat(F.lit("b"), "doc_id")))
    pairs = n.select(F.concat(F.lit("a"), "doc_id").alias("a"), F.concat(F.lit("b"), "doc_id").alias("b"))
    found = documents.compare(pairs, *parsed(files, "pdf_pages", "pdf_fonts", "pdf_values"))
    return found.select(F.substring("a", 2, 9).cast("int").alias("n_nationkey"), "kind", "page", "path")


#: What each file has, the rule that it breaks and how the rule ends.
BROKEN = [("none", "X4-EXTERNAL", "passed"), ("script", "X4-JS", "violation"), ("lzw", "X4-LZW", "violation"), ("inline", "X4-LZW", "violation"), ("attached", "X4-EMBEDDED", "violation"), ("lost", "X4-EMBEDDED", "passed"), ("alternate", "X4-EXTERNAL", "violation"), ("form", "X4-FORMS", "violation"), ("intent", "X4-OI-ENTRIES", "passed"), ("trapped", "X4-TRAPPED", "passed")]


@query("SELECT n_nationkey, " + str([b[1] for b in BROKEN]) + "[n_nationkey % 10 + 1] AS rule, " + str([b[2] for b in BROKEN]) + "[n_nationkey % 10 + 1] AS status, 27::BIGINT AS rules FROM nation")
def pdf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the print check: scripts, filters, attachments that the trailer leads to or not, alternates, forms, intents, trapping."""

    def make(r) -> bytes:
        what = BROKEN[r.doc_id % 10][0]
        extra: dict = {
            "script": {100: {b"S": Name(b"JavaScript"), b"JS": Str(b"1")}}, "lzw": {100: Stream({b"Filter": Name(b"LZWDecode")}, b"\x80\x0b\x60\x50\x22\x0c\x0c\x85\x01")},
            "attached": {100: {b"Type": Name(b"Filespec"), b"EF": {}}}, "lost": {101: {b"EF": {}}}, "alternate": {100: Stream({b"Subtype": Name(b"Image"), b"Alternates": []}, b"")},
        }.get(what, {})
        catalog: dict = {"form": {b"AcroForm": {b"Fields": [{b"T": Str(b"x")}]}}, "intent": {b"OutputIntents": [{b"S": Name(b"GTS_PDFX"), b"OutputConditionIdentifier": Str(b"FOGRA39")}]}}.get(what, {})
        trailer = {b"Info": {b"Trapped": Name(b"False")}} if what == "trapped" else {}
        content = b"BI /W 1 /H 1 /F /LZW ID x EI" if what == "inline" else b""
        return page_file([(content, {b"X": Ref(100, 0)} if 100 in extra else {})], extra, catalog, trailer)

    told = documents.check_rules(*parsed(made(nations(spark, sf_dir), make), *CHECKED))
    count = told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rules"))
    which = F.array(*[F.lit(b[1]) for b in BROKEN])[(F.col("doc_id").cast("int") % 10)]
    return told.filter(F.col("rule") == which).join(count, "doc_id").select(key("n_nationkey"), "rule", "status", "rules")


@query("SELECT n_nationkey, ['passed', 'violation', 'not-checked', 'violation'][n_nationkey % 4 + 1] AS profile, ['passed', 'passed', 'passed', 'violation'][n_nationkey % 4 + 1] AS entries FROM nation")
def pdf_intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents with a print profile, with one of no use, with one of another class, and an unregistered one without words or profile."""
    good = profile(b"CMYK", b"Lab ", [(b"B2A0", b"mft1" + bytes(60))])
    bad = profile(b"RGB ", b"XYZ ", [(b"rTRC", gamma_tag(2.0)), (b"wtpt", xyz_tag(0.9642, 1, 0.8249))])
    other = good[:12] + b"mntr" + good[16:]

    def make(r) -> bytes:
        k = r.doc_id % 4
        intent = {b"S": Name(b"GTS_PDFX"), b"OutputConditionIdentifier": Str(b"Own" if k == 3 else b"FOGRA51")} | ({b"DestOutputProfile": Ref(100, 0)} if k < 3 else {})
        return page_file([(b"", {})], {100: Stream({}, (good, bad, other, b"")[k])}, {b"OutputIntents": [intent]})

    told = documents.check_rules(*parsed(made(nations(spark, sf_dir), make), *CHECKED))
    one = lambda rule, out: told.filter(F.col("rule") == rule).select("doc_id", F.col("status").alias(out))
    return one("X4-OI-PROFILE", "profile").join(one("X4-OI-ENTRIES", "entries"), "doc_id").select(key("n_nationkey"), "profile", "entries")


INKS = {
    0: "fill DeviceCMYK 0.0,1.0,1.0,0.0", 1: "image Image ", 2: "fill Separation/Gold 0.5", 3: "shading DeviceCMYK ", 4: "fill DeviceCMYK 0.0,0.0,0.0,0.75", 5: "image Image |fill DeviceCMYK 0.0,0.0,0.0,1.0",
}
PIXELS = bytes([0, 255, 255, 0, 255, 255, 0, 0])


@query("SELECT n_nationkey, [" + ", ".join(f"'{v}'" for v in INKS.values()) + f"][n_nationkey % 6 + 1] AS paints, CASE WHEN n_nationkey % 6 = 1 THEN '{hashlib.md5(PIXELS).hexdigest()}' END AS pixels, 0::BIGINT AS rgb FROM nation")
def pdf_inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, images, spot alternates, shadings, spaces that are chosen by name, palettes and images within content, all in ink."""
    press = profile(b"CMYK", b"Lab ", [(b"B2A0", b"mft1" + bytes(60))])

    def make(r) -> bytes:
        k = r.doc_id % 6
        form = Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"BBox": [0, 0, 500, 500], b"Group": {b"S": Name(b"Transparency"), b"CS": Name(b"DeviceRGB")}}, b"1 0 0 rg 0 0 9 9 re f")
        image = Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": 2, b"Height": 1, b"BitsPerComponent": 8, b"ColorSpace": Name(b"DeviceRGB")}, bytes([255, 0, 0, 0, 0, 255]))
        tint = {b"FunctionType": 2, b"N": 1, b"Domain": [0, 1], b"C0": [1, 1, 1], b"C1": [1, 0.8, 0]}
        gold = [Name(b"Separation"), Name(b"Gold"), Name(b"DeviceRGB"), tint]
        shade = {b"ShadingType": 2, b"ColorSpace": Name(b"DeviceRGB"), b"Coords": [0, 0, 9, 9], b"Function": tint}
        palette = [Name(b"Indexed"), Name(b"DeviceRGB"), 1, Str(bytes([0, 0, 0, 255, 255, 255]))]
        content = (b"/X Do", b"/I Do", b"/G cs 0.5 scn 0 0 9 9 re f", b"/S sh", b"/C cs 0.25 sc 0 0 9 9 re f", b"BI /W 1 /H 1 /BPC 8 /CS /RGB ID abc EI /C cs 0 sc 0 0 9 9 re f")[k]
        spaces = {b"G": gold, b"C": [Name(b"CalGray"), {b"WhitePoint": [0.95, 1, 1.1]}], b"P": palette}
        entries = {b"Resources": {b"XObject": {b"X": Ref(100, 0), b"I": Ref(101, 0)}, b"ColorSpace": spaces, b"Shading": {b"S": shade}}}
        f = page_file([(content, entries)], {100: form, 101: image})
        return inks.convert_document(f, press, convert=lambda x: np.concatenate([1 - x, np.zeros((len(x), 1))], 1))

    paints, nodes, objects = parsed(made(nations(spark, sf_dir), make), "pdf_paints", "pdf_nodes", "pdf_objects")
    one = F.concat_ws(" ", "what", "space", F.array_join(F.transform("components", lambda x: F.round(x, 3).cast("string")), ","))
    each = paints.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", one.alias("t")))), lambda x: x["t"]), "|").alias("paints"))
    left = nodes.groupBy("doc_id").agg(F.count(F.when(F.col("bytes") == "DeviceRGB", 1)).alias("rgb"))
    pixels = objects.filter("object_number = 101").select("doc_id", F.when(F.col("doc_id") % 6 == 1, F.col("decoded_digest")).alias("pixels"))
    return each.join(left, "doc_id").join(pixels, "doc_id").select(key("n_nationkey"), "paints", "pixels", "rgb")


@query("SELECT n_nationkey, 'fill DeviceCMYK|stroke DeviceGray|fill Separation/Gold|image Image|fill DeviceCMYK' AS paints, n_name AS title, 'equal' AS agreement, CASE WHEN n_nationkey % 2 = 0 THEN 'invisible-overprint' ELSE 'no-current-point' END AS refused FROM nation")
def pdf_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files drawn by calls: paths, a spot colour, an image, a group; and what such calls refuse."""

    def make(r) -> bytes:
        doc = NewDocument({"Title": r.name}, "D:20240102030405+01'00'")
        gold = doc.separation("Gold", (0, 0.2, 0.6, 0.1))
        picture = doc.image(2, 1, bytes(6), 3)
        group = doc.group((0, 0, 50, 50), lambda c: c.fill_colour((0, 1, 0, 0)).rectangle(0, 0, 9, 9).fill())

        def draw(c):
            c.save().line_width(2).line_join("round").line_cap("butt").miter_limit(4).dash([3, 1]).fill_colour((1, 0, 0, 0)).stroke_colour((0.5,))
            c.move(10, 10).line(90, 10).curve(90, 50, 50, 90, 10, 90).close().fill_and_stroke("evenodd").restore()
            c.save().rectangle(0, 0, 300, 300).clip().graphics_state(fill_alpha=0.5, blend="Multiply").fill_colour(gold, 0.4).rectangle(20, 20, 30, 30).fill().restore()
            c.draw(picture, 40, 0, 0, 20, 100, 100)
            c.draw(group)

        doc.page(400, 400, draw, {"TrimBox": [10, 10, 390, 390]})
        return doc.write()

    def refused(k: int) -> str:
        try:
            c = Content()
            c.graphics_state(fill_overprint=True).fill_colour((0, 0, 0, 0)).rectangle(0, 0, 1, 1).fill() if k % 2 == 0 else c.line(1, 1)
        except PdfError as e:
            return e.code
        return "none"

    paints, properties = parsed(made(nations(spark, sf_dir), make), "pdf_paints", "pdf_properties")
    each = paints.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat_ws(" ", "what", "space").alias("t")))), lambda x: x["t"]), "|").alias("paints"))
    title = properties.filter("key = 'Title'").select("doc_id", F.col("info").alias("title"))
    dates = documents.agreement(properties).filter("key = 'CreationDate'").select("doc_id", "agreement")
    told = F.element_at(F.array(F.lit(refused(0)), F.lit(refused(1))), F.col("doc_id").cast("int") % 2 + 1)
    return each.join(title, "doc_id").join(dates, "doc_id").select(key("n_nationkey"), "paints", "title", "agreement", told.alias("refused"))


@query("SELECT n_nationkey, 'passed' AS version, 'passed' AS trapped, n_name AS title, 2::INT AS pages, 2::BIGINT AS drawn, true AS grouped FROM nation")
def pdf_print_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two pages made ready for print: boxes, groups, metadata, and a mark drawn on every page."""

    def make(r) -> bytes:
        f = page_file([text_page(r.name), text_page("")], {100: FONT})
        f = edit.draw_on(f, lambda c: c.fill_colour((0, 0, 0, 1)).rectangle(5, 5, 10, 10).fill())
        return edit.write_pdfx_metadata(edit.prepare_pages(f), r.name)

    files = made(nations(spark, sf_dir), make)
    paints, *t = parsed(files, "pdf_paints", *CHECKED)
    told = documents.check_rules(*t)
    one = lambda rule, out: told.filter(F.col("rule") == rule).select("doc_id", F.col("status").alias(out))
    pages, nodes, properties = t[1], t[3], t[4]
    count = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("pages"))
    drawn = paints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("drawn"))
    grouped = nodes.filter("path = '/Group/CS' and bytes = 'DeviceCMYK'").groupBy("doc_id").agg((F.count(F.lit(1)) == 2).alias("grouped"))
    title = properties.filter("key = 'Title'").select("doc_id", F.get("xmp", F.lit(0)).alias("title"))
    out = one("X4-XMP-VERSION", "version").join(one("X4-TRAPPED-XMP", "trapped"), "doc_id")
    for part in (title, count, drawn, grouped):
        out = out.join(part, "doc_id")
    return out.select(key("n_nationkey"), "version", "trapped", "title", "pages", "drawn", "grouped")


# ---------------------------------------------------------------------------- the published ceilings


@query("SELECT 'mismatch' AS status, 199800::INT AS kept, 200::INT AS missing, 200::INT AS extra")
def ceiling_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of 200,000 glyphs against one in which every thousandth character is another."""
    text = F.repeat(F.lit("abcdefghij" * 100), 200)
    found = spark.range(1).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page"), text.alias("text"))
    want = found.withColumn("text", F.repeat(F.lit("abcdefghij" * 99 + "abcdefghiZ"), 200))
    return documents.match_text(found, want).select("status", "kept", "missing", "extra")


@query("SELECT 100000::BIGINT AS glyphs, 1000::BIGINT AS lines, 100000::BIGINT AS visible")
def ceiling_interpret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 100,000 glyphs in 1,000 text objects."""
    content = b"".join(b"BT /F1 1 Tf 10 %d Td (%s) Tj ET " % (k, b"x" * 100) for k in range(1000))
    (glyphs,) = parsed(made(spark.range(1).select(F.lit("d").alias("doc_id")), lambda r: page_file([(content, F1)], {100: FONT})), "pdf_glyphs")
    return glyphs.agg(F.count(F.lit(1)).alias("glyphs"), F.countDistinct("y").alias("lines"), F.count_if(documents.visible()).alias("visible"))


@query("SELECT 10000::BIGINT AS paints")
def ceiling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form drawn 10,000 times."""
    form = Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"BBox": [0, 0, 9, 9]}, b"q 0 0 5 5 re f Q")
    f = page_file([(b"/X Do " * 10_000, {b"Resources": {b"XObject": {b"X": Ref(100, 0)}}})], {100: form})
    (paints,) = parsed(made(spark.range(1).select(F.lit("d").alias("doc_id")), lambda r: f), "pdf_paints")
    return paints.agg(F.count(F.lit(1)).alias("paints"))


@query("SELECT 524288::BIGINT AS pixels, 2097152::BIGINT AS bytes")
def ceiling_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 1024 by 512 in red, green and blue, converted to ink through two profiles and saved."""
    at = np.arange(1024 * 512)
    raw = np.stack([at % 256, at // 1024 % 256, at // 7 % 256], 1).astype(np.uint8).tobytes()
    image = Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": 1024, b"Height": 512, b"BitsPerComponent": 8, b"ColorSpace": Name(b"DeviceRGB"), b"Filter": Name(b"FlateDecode")}, zlib.compress(raw))
    screen = profile(b"RGB ", b"XYZ ", [*[(c + b"XYZ", xyz_tag(*v)) for c, v in zip((b"r", b"g", b"b"), RGB, strict=True)], *[(c + b"TRC", gamma_tag(2.2)) for c in (b"r", b"g", b"b")]])
    grid = np.zeros((9, 9, 9, 4))
    grid[..., 3] = np.linspace(1, 0, 9)[:, None, None]
    line = np.linspace(0, 65535, 2).round().astype(">u2").tobytes()
    press = profile(b"CMYK", b"Lab ", [(b"B2A0", b"mft2\0\0\0\0" + bytes([3, 4, 9, 0]) + bytes(36) + struct.pack(">HH", 2, 2) + line * 3 + (grid * 65535).round().astype(">u2").tobytes() + line * 4)])
    f = page_file([(b"/I Do", {b"Resources": {b"XObject": {b"I": Ref(100, 0)}}})], {100: image})
    (objects,) = parsed(made(spark.range(1).select(F.lit("d").alias("doc_id")), lambda r: inks.convert_document(f, press, screen)), "pdf_objects")
    return objects.filter("object_number = 100").select(F.expr("decoded_size div 4").alias("pixels"), F.col("decoded_size").alias("bytes"))


@query("SELECT 40000::BIGINT AS glyphs, 20000::BIGINT AS covered")
def ceiling_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40,000 glyphs against 40,000 later rectangles, which hide every other one."""
    k = F.col("id")
    x, y = (k % 200) * 30.0, F.floor(k / 200) * 30.0
    glyphs = spark.range(40_000).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page"), k.alias("seq"), F.array(x, y, x + 10, y + 10).alias("box"))
    covers = spark.range(40_000).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page"), (k + 40_000).alias("seq"), F.when(k % 2 == 0, F.array(x - 1, y - 1, x + 11, y + 11)).otherwise(F.array(x + 12, y, x + 20, y + 10)).alias("box"))
    return documents.covered_glyphs(glyphs, covers).agg(F.count(F.lit(1)).alias("glyphs"), F.count_if("covered").alias("covered"))
