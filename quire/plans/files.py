"""Queries that make PDF files from the driver's tables, read them back, and ask the document operators about them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import documents
from ..pdf.document import Document
from ..pdf.objects import Name, Ref, Str, Stream
from ..pdf.write import page_file, update
from ..session import shared_dir, table
from ..sources import pdf

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def made(df: DataFrame, make: Callable[[pd.Series], bytes]) -> DataFrame:
    """(doc_id, content): a file for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "content": [make(r) for r in batch.itertuples()]})

    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id").mapInPandas(run, "doc_id string, content binary")  # a small table is one partition


def parsed(files: DataFrame, *names: str) -> list[DataFrame]:
    """The named tables of the files, parsed once: the records are written by table to the shared folder, so each table reads its own alone."""
    path = f"{shared_dir(files.sparkSession)}/quire-records-{uuid.uuid4().hex}"
    return pdf.write_tables(pdf.parse_files(files, list(names)), path, list(names))


#: The tables that a print check asks.
CHECKED = ("pdf_documents", "pdf_pages", "pdf_objects", "pdf_nodes", "pdf_properties", "pdf_xmp", "pdf_intents")
FONT = {b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name(b"Helvetica"), b"Encoding": Name(b"WinAnsiEncoding"), b"FirstChar": 32, b"Widths": [500] * 224}


def text_page(text: str) -> tuple[bytes, dict]:
    shown = b" T*\n".join(b"<" + line.encode("cp1252", "replace").hex().encode() + b"> Tj" for line in text.split("\n"))
    return b"BT /F1 10 Tf 12 TL 20 780 Td\n" + shown + b"\nET", {b"Resources": {b"Font": {b"F1": Ref(100, 0)}}}


@query("SELECT item_id, replace(text, chr(10), '') AS text FROM benchmark")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts set in a page are read back from its content."""
    files = made(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), lambda r: page_file([text_page(r.text)], {100: FONT}))
    (glyphs,) = parsed(files, "pdf_glyphs")
    return documents.page_text(glyphs).select(F.col("doc_id").cast("long").alias("item_id"), "text")


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'mismatch' ELSE 'match' END AS status, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END::INT AS extra FROM benchmark")
def pdf_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against their intended texts; every third page has a character more."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    files = made(b, lambda r: page_file([text_page(r.text + ("#" if r.doc_id % 3 == 0 else ""))], {100: FONT}))
    (glyphs,) = parsed(files, "pdf_glyphs")
    want = b.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page"), "text")
    return documents.match_text(documents.page_text(glyphs), want).select(F.col("doc_id").cast("long").alias("item_id"), "status", "extra")


@query("SELECT n_nationkey, n_name AS name, n_nationkey % 2 = 0 AS updated, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END::INT AS sections FROM nation")
def pdf_latest_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In files with an appended update the newest copy of an object counts."""

    def make(r) -> bytes:
        old = page_file([(b"", {})], {100: {b"V": Str(b"old" if r.doc_id % 2 == 0 else r.name.encode())}}, {b"Extra": Ref(100, 0)})
        return update(Document(old), {100: {b"V": Str(r.name.encode())}}) if r.doc_id % 2 == 0 else old

    files = made(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name")), make)
    docs, nodes = parsed(files, "pdf_documents", "pdf_nodes")
    value = nodes.filter("object_number = 100 and path = '/V'").select("doc_id", F.col("bytes").alias("name"))
    return docs.join(value, "doc_id").select(F.col("doc_id").cast("int").alias("n_nationkey"), "name", (F.col("sections") > 1).alias("updated"), "sections")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_size > 30 THEN 'violation' ELSE 'passed' END AS status FROM part")
def pdf_box_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The print check's rule on boxes, for pages without a print box and for some that stick out."""

    def make(r) -> bytes:
        return page_file([(b"", {} if r.size % 3 == 0 else {b"TrimBox": [r.size, r.size, 570 + r.size, 700]})])

    files = made(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("size")), make)
    return documents.check_rules(*parsed(files, *CHECKED)).filter("rule = 'X4-BOXES'").select(F.col("doc_id").cast("long").alias("p_partkey"), "status")


def packet(title: str) -> Stream:
    body = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">{title}</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>'
    return Stream({b"Type": Name(b"Metadata"), b"Subtype": Name(b"XML")}, body.encode())


@query("SELECT n_nationkey, ['equal', 'different', 'info-only', 'xmp-only'][n_nationkey % 4 + 1] AS agreement FROM nation")
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in the information dictionary and in the packet: the same, another one, and on one side alone."""

    def make(r) -> bytes:
        k = r.doc_id % 4
        extra: dict = {101: packet(r.name + ("x" if k == 1 else ""))} if k != 2 else {}
        extra |= {102: {b"Title": Str(b"\xfe\xff" + r.name.encode("utf-16-be"))}} if k != 3 else {}
        return page_file([(b"", {})], extra, {b"Metadata": Ref(101, 0)}, {b"Info": Ref(102, 0)})

    files = made(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name")), make)
    (properties,) = parsed(files, "pdf_properties")
    return documents.agreement(properties).filter("key = 'Title'").select(F.col("doc_id").cast("int").alias("n_nationkey"), "agreement")


@query("SELECT n_nationkey, ['page-box', 'page-content', 'attributes'][n_nationkey % 4] AS kind, ['TrimBox', '', '/Tabs'][n_nationkey % 4] AS path FROM nation WHERE n_nationkey % 4 > 0")
def pdf_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies with one edit or none differ in just that."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name"))

    def make(r, edit: int = 0) -> bytes:
        content, entries = text_page(r.name)
        entries = entries | ({b"TrimBox": [10, 10, 500, 500]} if edit == 1 else {b"Tabs": Name(b"R")} if edit == 3 else {})
        return page_file([(content.replace(b" 780 ", b" 779 ") if edit == 2 else content + b" % a comment is no difference", entries)], {100: FONT})

    files = made(n, make).withColumn("doc_id", F.concat(F.lit("a"), "doc_id")).unionByName(made(n, lambda r: make(r, r.doc_id % 4)).withColumn("doc_id", F.concat(F.lit("b"), "doc_id")))
    pages, fonts, values = parsed(files, "pdf_pages", "pdf_fonts", "pdf_values")
    pairs = n.select(F.concat(F.lit("a"), "doc_id").alias("a"), F.concat(F.lit("b"), "doc_id").alias("b"))
    return documents.compare(pairs, pages, fonts, values).select(F.substring("a", 2, 9).cast("int").alias("n_nationkey"), "kind", "path")


@query("SELECT n_nationkey, n_name AS colorant, CASE WHEN n_nationkey % 2 = 0 THEN ['painted', 'selected'] ELSE ['selected'] END AS uses FROM nation")
def pdf_colorants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot colours that pages paint with or only choose."""

    def make(r) -> bytes:
        space = [Name(b"Separation"), Name(r.name.encode()), Name(b"DeviceCMYK"), {b"FunctionType": 2, b"N": 1, b"Domain": [0, 1]}]
        paint = b"0 0 10 10 re f" if r.doc_id % 2 == 0 else b""
        return page_file([(b"/S cs 1 scn " + paint, {b"Resources": {b"ColorSpace": {b"S": space}}})])

    files = made(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name")), make)
    paints, selects, glyphs = parsed(files, "pdf_paints", "pdf_selects", "pdf_glyphs")
    return documents.list_colorants(paints, selects, glyphs).select(F.col("doc_id").cast("int").alias("n_nationkey"), "colorant", "uses")


@query("SELECT n_nationkey, 5 AS reachable, 1 AS orphans FROM nation")
def pdf_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that the trailer leads to, through a cycle, and one that it doesn't."""
    files = made(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id")), lambda r: page_file([(b"", {b"X": Ref(100, 0)})], {100: {b"Back": Ref(10, 0)}, 101: {b"Lost": True}}))
    nodes, objects = parsed(files, "pdf_nodes", "pdf_objects")
    found = documents.reachable_objects(nodes, objects).withColumn("hit", F.lit(1))
    every = objects.filter("object_number > 0").select("doc_id", "object_number").join(found, ["doc_id", "object_number"], "left")
    return every.groupBy("doc_id").agg(F.count("hit").cast("int").alias("reachable"), (F.count(F.lit(1)) - F.count("hit")).cast("int").alias("orphans")).select(F.col("doc_id").cast("int").alias("n_nationkey"), "reachable", "orphans")


@query("SELECT n_nationkey, n_nationkey % 2 = 1 AS covered FROM nation")
def pdf_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glyph under a box that was painted after it, or before."""

    def make(r) -> bytes:
        glyph, box = b"BT /F1 10 Tf 100 700 Td (A) Tj ET ", b"90 690 40 40 re f "
        return page_file([(glyph + box if r.doc_id % 2 else box + glyph, {b"Resources": {b"Font": {b"F1": Ref(100, 0)}}})], {100: FONT})

    files = made(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id")), make)
    glyphs, covers = parsed(files, "pdf_glyphs", "pdf_covers")
    return documents.covered_glyphs(glyphs, covers).select(F.col("doc_id").cast("int").alias("n_nationkey"), "covered")


@query("SELECT r_regionkey, 'Helvetica' AS name, [0, 1] AS pages, [1] AS shown_on, r_regionkey % 2 = 0 AS reused FROM region UNION ALL SELECT r_regionkey, 'Courier', [0, 1], [0], r_regionkey % 2 = 0 FROM region")
def pdf_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts with the pages that can reach and that show them; a tag that two of them bear."""

    def make(r) -> bytes:
        tags = (b"ABCDEF+", b"ABCDEF+" if r.doc_id % 2 == 0 else b"GHIJKL+")
        fonts = {100: FONT | {b"BaseFont": Name(tags[0] + b"Helvetica")}, 101: FONT | {b"BaseFont": Name(tags[1] + b"Courier")}}
        entries = {b"Resources": {b"Font": {b"F1": Ref(100, 0), b"F2": Ref(101, 0)}}}
        show = lambda f, g: b"BT /%s 9 Tf /%s 9 Tf 0 0 Td (x) Tj ET" % (f, g)
        return page_file([(show(b"F1", b"F2"), entries), (show(b"F2", b"F1"), entries)], fonts)

    files = made(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id")), make)
    (fonts,) = parsed(files, "pdf_fonts")
    return documents.list_fonts(fonts).select(F.col("doc_id").cast("int").alias("r_regionkey"), "name", "pages", "shown_on", "reused")
