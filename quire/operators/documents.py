"""Questions about many documents, as plans over the flat tables of quire.sources.pdf."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, geometry, text as texts
from ..pdf import matching
from ..pdf.conditions import CONDITIONS
from . import relations

PAGE = ["doc_id", "page"]
#: The areas of a comparison.
AREAS = ("page-count", "page-box", "page-content", "page-fonts", "fonts", "page-piece", "attributes", "duplicate-keys")


def visible(hidden: str = "hidden", clipped: str = "clipped") -> Column:
    """The default selection of glyphs."""
    return F.col(hidden).isNull() & ~F.col(clipped)


def covered_glyphs(glyphs: DataFrame, covers: DataFrame, cell: float = 50.0) -> DataFrame:
    """glyphs with covered: whether opaque boxes painted later hold all of 5 x 5 points of the glyph's core box.

    The core box is the glyph's box less a tenth of its height on each side. Points join boxes by grid cells of their
    page, so a glyph meets only fills near it.
    """
    inset = (F.col("box")[3] - F.col("box")[1]) * 0.1
    part = lambda lo, hi, k: lo + inset + (hi - lo - inset * 2) * (k / 4)
    grid = F.array(*[F.struct(part(F.col("box")[0], F.col("box")[2], i).alias("x"), part(F.col("box")[1], F.col("box")[3], j).alias("y")) for i in range(5) for j in range(5)])
    points = glyphs.select(*PAGE, "seq", F.posexplode(grid).alias("k", "p")).select(*PAGE, "seq", "k", "p.x", "p.y")
    boxes = covers.select(*PAGE, F.col("seq").alias("c_seq"), F.col("box").alias("c"))
    points, boxes = relations.on_grids(points, boxes, cell, F.col("x"), F.col("y"), [F.col("c")[k] for k in range(4)])
    eps = 1e-6
    under = points.join(boxes, [*PAGE, "level", "cx", "cy"]).filter((F.col("c_seq") > F.col("seq")) & F.col("x").between(F.col("c")[0] - eps, F.col("c")[2] + eps) & F.col("y").between(F.col("c")[1] - eps, F.col("c")[3] + eps))
    hidden = under.select(*PAGE, "seq", "k").distinct().groupBy(*PAGE, "seq").agg(F.count(F.lit(1)).alias("under"))
    return glyphs.join(hidden, [*PAGE, "seq"], "left").withColumn("covered", F.coalesce(F.col("under") == 25, F.lit(False))).drop("under")


def page_text(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, text) of the selected glyphs in the order of the content; a span's ActualText stands for its glyphs."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    first = F.col("span").isNull() | ~F.coalesce(F.lag("span").over(w).eqNullSafe(F.col("span")), F.lit(False))
    unit = F.when(F.col("span").isNull(), F.coalesce("text", F.lit("�"))).when(first, F.col("actual")).otherwise("")
    parts = glyphs.filter(visible()).withColumn("u", unit)
    return parts.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "u"))), lambda x: x["u"]), "").alias("text"))


def evidence_level(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, level, disagreeing): glyph-checked where embedded programs confirm every selected glyph, else encoding-only."""
    seen = glyphs.filter(visible())
    sure = F.count_if(F.col("evidence") == "confirmed") == F.count(F.lit(1))
    return seen.groupBy(*PAGE).agg(F.when(sure, "glyph-checked").otherwise("encoding-only").alias("level"), F.count_if(F.col("evidence") == "disagrees").alias("disagreeing"))


def match_text(found: DataFrame, intended: DataFrame, equivalents: dict[str, str] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """found (doc_id, page, text) against intended (doc_id, page, text): status and counts of kept, missing and extra characters.

    White space is left out on both sides, folds apply to the page's text alone, nothing is normalised. equivalents:
    characters of the page and what they count as, after the folds. A page without text to compare, or, given the table
    of pages, one that couldn't be read to its end, is unverified unless its text differs. Texts that take more work to
    align than relations.WORK are a mismatch without counts.
    """
    have = texts.fold(F.col("text"))
    for a, b in (equivalents or {}).items():
        have = F.replace(have, F.lit(a), F.lit(b))
    both = intended.select(*PAGE, texts.strip_white_space(F.col("text")).alias("want")).join(found.select(*PAGE, texts.strip_white_space(have).alias("have")), PAGE, "left")
    if pages is not None:
        both = both.join(pages.select(*PAGE, "complete"), PAGE, "left")
    whole = F.coalesce("complete", F.lit(False)) if pages is not None else F.lit(True)
    steps = F.udf(_char_steps, "struct<kept:int,missing:int,extra:int>", useArrow=True)
    differ = both.withColumn("s", F.when(F.col("have").eqNullSafe(F.col("want")), F.struct(F.length("want").alias("kept"), F.lit(0).alias("missing"), F.lit(0).alias("extra"))).otherwise(steps("want", F.coalesce("have", F.lit("")))))
    status = F.when(F.col("have").isNull() & (F.length("want") > 0), "unverified").when(F.col("s.missing") + F.col("s.extra") > 0, "mismatch").when(whole, "match").otherwise("unverified")
    return differ.select(*PAGE, status.alias("status"), "s.kept", "s.missing", "s.extra")


def match_glyphs(glyphs: DataFrame, intended: DataFrame, equivalents: dict[str, str] | None = None, work: int = relations.WORK) -> DataFrame:
    """(doc_id, page, status, kept, copies, differences, notes): each page's selected glyphs against its intended text.

    Selected are glyphs that paint, and empty ones, which are reported. Folds apply to the page alone, equivalents after
    them. A page is one group, so it must fit in a task's memory. Pages without glyphs are unverified unless nothing is intended.
    """
    cols = ["seq", "code", "text", "reason", "font", "x", "y", "size", "width", "hidden", "span", "actual"]
    seen = glyphs.filter((F.col("hidden").isNull() | (F.col("hidden") == "empty")) & ~F.col("clipped")).select(*PAGE, *cols, texts.fold(F.col("text")).alias("folded"))
    want = intended.select(*PAGE, F.col("text").alias("want"))

    def run(keys: tuple, page: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = [{k: None if v is None or v != v else v for k, v in r.items()} for r in page.sort_values("seq").to_dict("records")]
        for text in wanted["want"]:
            m = matching.match(rows, text or "", relations.align, work, equivalents)
            out.append((*keys, m["status"], m["kept"], m["copies"], m["differences"], m["notes"]))
        return pd.DataFrame(out, columns=[*PAGE, "status", "kept", "copies", "differences", "notes"])

    schema = "doc_id string, page int, status string, kept int, copies int, differences array<struct<kind:string,intended:string,found:string,place:int>>, notes array<struct<kind:string,text:string,shown:string>>"
    return seen.groupBy(*PAGE).cogroup(want.groupBy(*PAGE)).applyInPandas(run, schema)


def _char_steps(want: str | None, have: str | None):
    if want is None:
        return None
    steps = relations.align(want, have or "", relations.WORK)
    if steps is None:  # too different to be counted
        return {"kept": None, "missing": None, "extra": None}
    found = [s for s, _, _ in steps]
    return {"kept": found.count("keep"), "missing": found.count("missing"), "extra": found.count("extra")}


def list_fonts(fonts: DataFrame) -> DataFrame:
    """One row for each font of a document: pages that can reach it, pages that show it, and whether its tag is used by another one."""
    per = fonts.groupBy("doc_id", "font_key", "subtype", "name", "tag", "malformed_tag", "embedded").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.sort_array(F.collect_set(F.when(F.col("shown"), F.col("page")))).alias("shown_on"), F.first("problems").alias("problems"))
    tags = per.filter("tag is not null").groupBy("doc_id", "tag").agg(F.countDistinct("font_key").alias("n")).filter("n > 1").select("doc_id", "tag", F.lit(True).alias("reused"))
    return per.join(tags, ["doc_id", "tag"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def list_colorants(paints: DataFrame, selects: DataFrame, glyphs: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, colorant, kind, uses): names of spot colours with how they occur, in a fixed order: painted, as text
    that can't be seen, only chosen, or, given the table of resources, only declared or the alternate of another one."""
    shown = glyphs.select(*PAGE, "space", F.when(visible(), "painted").otherwise("invisible-text").alias("use"))
    every = paints.select(*PAGE, "space", F.lit("painted").alias("use")).unionByName(selects.select(*PAGE, "space", F.lit("selected").alias("use"))).unionByName(shown)
    if resources is not None:
        every = every.unionByName(resources.filter("space is not null").select(*PAGE, "space", F.lit("declared").alias("use")))
        every = every.unionByName(resources.filter("alternate is not null").select(*PAGE, F.col("alternate").alias("space"), F.lit("alternate").alias("use")))
    spot = every.filter(F.col("space").rlike("(Separation|DeviceN)/"))
    parts = F.split(F.regexp_replace("space", "^.*?(Separation|DeviceN)/", ""), "/")
    name = F.replace(F.replace(F.col("part"), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    named = spot.select(*PAGE, F.regexp_extract("space", "(Separation|DeviceN)/", 1).alias("kind"), F.explode(parts).alias("part"), "use").withColumn("colorant", name)
    order = F.array(*map(F.lit, ("painted", "invisible-text", "selected", "declared", "alternate")))
    return named.groupBy(*PAGE, "colorant", "kind").agg(F.collect_set("use").alias("_u")).select(*PAGE, "colorant", "kind", F.filter(order, lambda x: F.array_contains("_u", x)).alias("uses"))


def references(nodes: DataFrame) -> DataFrame:
    """(doc_id, src, dst, path) of references between objects; 0 is the trailer."""
    return nodes.filter("kind = 'reference'").select("doc_id", F.col("object_number").alias("src"), F.col("ref_num").alias("dst"), "path", "ref_gen")


def reachable_objects(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, object_number) that the trailer leads to; a reference counts only if its generation is the current one."""
    current = objects.select("doc_id", F.col("object_number").alias("dst"), F.col("generation").alias("ref_gen"))
    edges = references(nodes).join(current, ["doc_id", "dst", "ref_gen"]).select(F.struct("doc_id", F.col("src").alias("n")).alias("src"), F.struct("doc_id", F.col("dst").alias("n")).alias("dst"))
    start = nodes.filter("object_number = 0").select(F.struct("doc_id", F.col("object_number").alias("n")).alias("node")).distinct()
    return relations.reachable(edges, start).filter("steps > 0").select("node.doc_id", F.col("node.n").alias("object_number"))


def agreement(properties: DataFrame) -> DataFrame:
    """properties with agreement: how the information dictionary and the packet agree on each key."""
    one = F.get("xmp", F.lit(0))
    date = dates.compare_dates(dates.parse_pdf_date(F.col("info")), dates.parse_xmp_date(one))
    listed = F.array_join("xmp", ";") == F.regexp_replace("info", r"\s*;\s*", ";")
    same = F.when(F.col("key").endswith("Date"), F.coalesce(date, F.lit("different"))).when((F.col("key") == "Author") & listed, "equal").when(F.col("info") == one, "equal").otherwise("different")
    alone = F.when(F.col("info").isNull() & one.isNull(), "absent").when((F.col("key") == "Trapped") & (F.col("info") == "Unknown") & one.isNull(), "equal").when(one.isNull(), "info-only").when(F.col("info").isNull(), "xmp-only")
    return properties.withColumn("agreement", F.coalesce(alone, same))


def authority(properties: DataFrame) -> DataFrame:
    """(doc_id, authority): info, xmp or indeterminate, by the later date of change."""
    mod = properties.filter("key = 'ModDate'").select("doc_id", F.col("info").alias("i"), F.get("xmp", F.lit(0)).alias("x"))
    some = properties.groupBy("doc_id").agg(F.max(F.col("info").isNotNull()).alias("has_info"), F.max(F.col("xmp").isNotNull()).alias("has_xmp"))
    di, dx = dates.parse_pdf_date(F.col("i")), dates.parse_xmp_date(F.col("x"))
    at = lambda d: F.make_date(d["year"], F.coalesce(d["month"], F.lit(1)), F.coalesce(d["day"], F.lit(1))).cast("timestamp").cast("long") + F.coalesce(d["hour"], F.lit(0)) * 3600 + F.coalesce(d["minute"], F.lit(0)) * 60 + F.coalesce(d["second"], F.lit(0)) - F.coalesce(d["offset_min"], F.lit(0)) * 60
    said = F.when(~F.col("has_xmp"), "info").when(~F.col("has_info"), "xmp").when(di.isNull() | dx.isNull(), "indeterminate").when(at(dx) >= at(di), "xmp").otherwise("info")
    return some.join(mod, "doc_id", "left").select("doc_id", said.alias("authority"))


def compare(pairs: DataFrame, pages: DataFrame, fonts: DataFrame, values: DataFrame, warnings: DataFrame | None = None, areas: tuple[str, ...] = AREAS) -> DataFrame:
    """(a, b, kind, page, path, left, right): what differs between documents a and b. Object numbers never matter.

    One plan for each area, all of them joins within a pair: page count, boxes with their explicitness, content by
    canonical operations, fonts of a page and of the document by their names, encodings and programs, private data and
    other entries of pages and of the catalog, through references; and, given the table of warnings, how many
    dictionaries name a key twice. What a page has that the other document lacks isn't compared.
    """
    side = lambda df, s: pairs.join(df.withColumnRenamed("doc_id", s), s)
    keys = ["a", "b", "page"]
    count = lambda s: side(pages, s).groupBy("a", "b").agg(F.count(F.lit(1)).alias(s + "_n"))
    counts = count("a").join(count("b"), ["a", "b"]).filter("a_n <> b_n").select("a", "b", F.lit("page-count").alias("kind"), F.lit(None).cast("int").alias("page"), F.lit("").alias("path"), F.col("a_n").cast("string").alias("left"), F.col("b_n").cast("string").alias("right"))
    names = ("media", "crop", "bleed", "trim", "art")
    label = {"media": "MediaBox", "crop": "CropBox", "bleed": "BleedBox", "trim": "TrimBox", "art": "ArtBox"}
    value = lambda n: F.when(F.array_contains("explicit", label[n]), F.to_json(F.struct(F.col(n).alias("r")))) if n != "media" else F.to_json(F.struct(F.col(n).alias("r")))
    rows = F.array(*[F.struct(F.lit(label[n]).alias("path"), value(n).alias("v")) for n in names], F.struct(F.lit("Rotate").alias("path"), F.col("rotate").cast("string").alias("v")), F.struct(F.lit("UserUnit").alias("path"), F.col("user_unit").cast("string").alias("v")))
    boxes = pages.select("doc_id", "page", F.explode(rows).alias("r")).select("doc_id", "page", "r.*")
    both = side(boxes, "a").withColumnRenamed("v", "left").join(side(boxes, "b").withColumnRenamed("v", "right"), [*keys, "path"])
    box = both.filter(~F.col("left").eqNullSafe(F.col("right"))).select("a", "b", F.lit("page-box").alias("kind"), "page", "path", "left", "right")
    digest = lambda s, n: side(pages.select("doc_id", "page", F.coalesce("content_digest", F.lit("")).alias(f"{n}_raw"), F.coalesce("tokens_digest", F.lit("")).alias(n)), s)
    content = digest("a", "left").join(digest("b", "right"), keys).filter("left_raw <> right_raw and left <> right").select("a", "b", F.lit("page-content").alias("kind"), "page", F.lit("").alias("path"), "left", "right")
    font = F.concat_ws("/", "subtype", "name", F.coalesce("encoding", F.lit("built-in")), F.coalesce("embedded", F.lit("none")), "program")
    of = lambda s, cols: side(fonts.select("doc_id", "page", font.alias("path")), s).select(*cols).distinct()
    common = side(pages.select("doc_id", "page"), "a").join(side(pages.select("doc_id", "page"), "b"), keys)

    def gone(cols: list[str], kind: str) -> DataFrame:
        own = {s: of(s, cols) if kind == "fonts" else of(s, cols).join(common, keys, "left_semi") for s in ("a", "b")}
        part = [own[x].join(own[y], cols, "left_anti").select("a", "b", F.lit(kind).alias("kind"), (F.col("page") if "page" in cols else F.lit(None)).cast("int").alias("page"), "path", F.lit("present" if x == "a" else None).alias("left"), F.lit("present" if x == "b" else None).alias("right")) for x, y in (("a", "b"), ("b", "a"))]
        return part[0].unionByName(part[1])

    entries = values.select("doc_id", "owner", F.coalesce("page", F.lit(-1)).alias("page"), "path", F.concat_ws(":", "kind", "value").alias("v"))
    ea, eb = side(entries, "a").withColumnRenamed("v", "left"), side(entries, "b").withColumnRenamed("v", "right")
    both = ea.join(eb, [*keys, "owner", "path"], "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
    both = both.join(common.unionByName(pairs.select("a", "b", F.lit(-1).alias("page"))), keys, "left_semi")
    short = lambda c: F.when(F.length(c) > 120, F.concat(F.left(c, F.lit(117)), F.lit("..."))).otherwise(F.col(c)).alias(c)
    attr = both.select("a", "b", F.when(F.col("path").startswith("/PieceInfo"), "page-piece").otherwise("attributes").alias("kind"), F.when(F.col("page") >= 0, F.col("page")).alias("page"), "path", short("left"), short("right"))
    parts = [counts, box, content, gone(["a", "b", "page", "path"], "page-fonts"), gone(["a", "b", "path"], "fonts"), attr]
    if warnings is not None:
        twice = warnings.filter("code = 'duplicate-key'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        n = lambda s, name: pairs.join(twice.select(F.col("doc_id").alias(s), F.col("n").alias(name)), s, "left")
        both = n("a", "left").join(n("b", "right"), ["a", "b"]).filter(~F.col("left").eqNullSafe(F.col("right")))
        parts.append(both.select("a", "b", F.lit("duplicate-keys").alias("kind"), F.lit(None).cast("int").alias("page"), F.lit("").alias("path"), F.col("left").cast("string").alias("left"), F.col("right").cast("string").alias("right")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("kind").isin(*areas))


#: The rules of a print check for PDF/X-4, in order.
RULES = (
    "X4-VERSION X4-PDF17-KEYS X4-ENCRYPT X4-OI-PRESENT X4-OI-ENTRIES X4-OI-PROFILE X4-OI-PROFILE-VERSION X4-XMP-VERSION X4-XMP-MM X4-TRAPPED X4-TRAPPED-XMP X4-BOXES X4-JS X4-FORMS "
    "X4-ANNOTS X4-TRANSFER X4-LZW X4-EMBEDDED X4-EXTERNAL X4-FONTS X4-SPOT-ALTERNATE X4-PS X4-BXEX X4-INTENTS X4-LIMITS X4-TRANSPARENCY X4-OC"
).split()
#: Rules that no plan here decides, and the clause of ISO 15930-7:2010 that sets what they are about.
UNCHECKED = {
    "X4-VERSION": "6.1", "X4-PDF17-KEYS": "6.1 and 6.25", "X4-OI-PROFILE-VERSION": "6.4", "X4-XMP-MM": "6.10", "X4-ANNOTS": "6.17", "X4-TRANSFER": "6.13", "X4-FONTS": "6.5", "X4-SPOT-ALTERNATE": "6.4",
    "X4-PS": "6.14", "X4-BXEX": "6.19", "X4-INTENTS": "6.23", "X4-LIMITS": "6.25", "X4-TRANSPARENCY": "6.20", "X4-OC": "6.24",
}
PDFX, XMP_MM, PDF_NS = "{http://www.npes.org/pdfx/ns/id/}", "{http://ns.adobe.com/xap/1.0/mm/}", "{http://ns.adobe.com/pdf/1.3/}"


def check_rules(documents: DataFrame, pages: DataFrame, objects: DataFrame, nodes: DataFrame, properties: DataFrame, xmp: DataFrame, intents: DataFrame) -> DataFrame:
    """(doc_id, rule, status, detail) of every rule for every readable document: passed, violation or not-checked.

    Rules about any object look at what the trailer leads to, and aren't checked where one of these can't be read.
    Of several faults of a document the detail tells the first. Files that are encrypted are refused when they are read,
    so they have no rows here.
    """
    docs = documents.filter("error_code is null").select("doc_id", "header")
    broken = lambda df, rule, detail, status="violation": df.select("doc_id", F.lit(rule).alias("rule"), F.lit(status).alias("status"), detail.cast("string").alias("detail"))
    live = objects.filter("reachable and object_number > 0").select("doc_id", "object_number", "kind")
    damaged = objects.filter("reachable and not readable").select("doc_id").distinct()
    seen = nodes.join(live.drop("kind").unionByName(docs.select("doc_id", F.lit(0).alias("object_number"))), ["doc_id", "object_number"], "left_semi")
    leaf = F.regexp_extract("path", "([^/]*)$", 1)
    number = F.format_string("object %07d", "object_number")
    is_name = lambda key, value: (leaf == key) & (F.col("kind") == "name") & (F.col("bytes") == value)
    streams = seen.filter(F.col("path").rlike("^/(Ref|Alternates|OPI)$")).join(live.filter("kind = 'stream'").select("doc_id", "object_number"), ["doc_id", "object_number"], "left_semi")
    own = F.when(F.array_contains("explicit", "TrimBox"), F.col("trim")).otherwise(F.col("art"))
    one = F.array_contains("explicit", "TrimBox") != F.array_contains("explicit", "ArtBox")
    boxes = pages.filter(~one | ~geometry.contains(F.col("media"), own) | ~geometry.contains(F.col("crop"), own) | ~geometry.contains(F.col("bleed"), own))
    root = nodes.filter("object_number = 0 and path = '/Root' and kind = 'reference'").select("doc_id", F.col("ref_num").alias("object_number"))
    catalog = nodes.join(root, ["doc_id", "object_number"])
    form = nodes.join(catalog.filter("path = '/AcroForm' and kind = 'reference'").select("doc_id", F.col("ref_num").alias("object_number")), ["doc_id", "object_number"]).select("doc_id", "path", "kind")
    form = form.unionByName(catalog.filter(F.col("path").startswith("/AcroForm/")).select("doc_id", F.expr("substring(path, 10)").alias("path"), "kind"))
    has_form = catalog.filter("path = '/AcroForm'").select("doc_id").distinct()
    listed = form.filter("path = '/Fields'").select("doc_id").distinct()
    first = intents.filter("subtype = 'GTS_PDFX'").groupBy("doc_id").agg(F.min_by(F.struct("condition", "info", "registry", "profile", "space", "class", "inverse", "relative"), "ordinal").alias("i")).select("doc_id", "i.*")
    registered = F.col("condition").isin(*[c[0] for c in CONDITIONS])
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    intent = docs.select("doc_id").join(first.withColumn("there", F.lit(True)), "doc_id", "left")
    entries = F.when(F.col("there").isNull(), "not-checked").when(empty("condition") | (~registered & empty("info")), "violation").otherwise("passed")
    odd = (F.col("profile") != "read") | ~F.col("space").isin("GRAY", "RGB", "CMYK") | ~F.coalesce("inverse", F.lit(False))
    unsure = (~F.coalesce(registered, F.lit(False)) & ~F.coalesce("relative", F.lit(False))) | (F.col("class") != "prtr")
    profile = F.when(F.col("there").isNull(), "not-checked").when(odd, "violation").when(unsure, "not-checked").otherwise("passed")
    value = lambda name: xmp.filter((F.col("name") == name) & (F.size("values") == 1)).select("doc_id", F.col("values")[0].alias("v"))
    trapped = properties.filter("key = 'Trapped'").select("doc_id", F.col("info").alias("t"))
    both = docs.select("doc_id").join(trapped, "doc_id", "left").join(value(PDF_NS + "Trapped"), "doc_id", "left")
    said = F.coalesce(F.col("t").isin("True", "False"), F.lit(False))
    mm = xmp.filter(F.col("name").isin(*[XMP_MM + n for n in ("DocumentID", "VersionID", "RenditionClass")])).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lzw = objects.filter(F.col("reachable") & (F.array_contains("filters", "LZWDecode") | F.arrays_overlap("inline_filters", F.array(F.lit("LZW"), F.lit("LZWDecode")))))
    lzw_pages = pages.filter(F.arrays_overlap("inline_filters", F.array(F.lit("LZW"), F.lit("LZWDecode"))))
    every = docs.select("doc_id", "header", F.explode(F.array(*map(F.lit, RULES))).alias("rule"))
    found = [
        broken(docs.join(first, "doc_id", "left_anti"), "X4-OI-PRESENT", F.lit("no GTS_PDFX output intent")),
        intent.select("doc_id", F.lit("X4-OI-ENTRIES").alias("rule"), entries.alias("status"), F.col("condition").alias("detail")),
        intent.select("doc_id", F.lit("X4-OI-PROFILE").alias("rule"), profile.alias("status"), F.col("profile").alias("detail")),
        broken(docs.join(value(PDFX + "GTS_PDFXVersion").filter("v = 'PDF/X-4'"), "doc_id", "left_anti"), "X4-XMP-VERSION", F.lit("no version PDF/X-4")),
        broken(both.filter(~said), "X4-TRAPPED", F.lit("neither True nor False")),
        broken(both.filter(~(said & F.coalesce(F.col("t") == F.col("v"), F.lit(False)))), "X4-TRAPPED-XMP", F.coalesce("v", F.lit("absent"))),
        broken(boxes, "X4-BOXES", F.format_string("page %05d", "page")),
        broken(seen.filter(is_name("S", "JavaScript") | F.col("path").rlike("(^|/)Names/JavaScript$")), "X4-JS", number),
        broken(seen.filter(leaf == "AA"), "X4-JS", F.lit("additional actions"), "not-checked"),
        broken(form.filter("path = '/XFA'"), "X4-FORMS", F.lit("XFA")),
        broken(form.filter("path rlike '^/Fields/'"), "X4-FORMS", F.lit("fields")),
        broken(has_form.join(listed, "doc_id", "left_anti"), "X4-FORMS", F.lit("no list of fields"), "not-checked"),
        broken(lzw, "X4-LZW", number),
        broken(lzw_pages, "X4-LZW", F.format_string("page %05d", "page")),
        broken(pages.filter("content_digest is null"), "X4-LZW", F.lit("unreadable content"), "not-checked"),
        broken(seen.filter(leaf.isin("EmbeddedFiles", "EF") | is_name("Subtype", "FileAttachment") | is_name("Type", "EmbeddedFile")), "X4-EMBEDDED", number),
        broken(streams, "X4-EXTERNAL", number),
        *[broken(damaged, r, F.lit("unreadable objects"), "not-checked") for r in ("X4-JS", "X4-LZW", "X4-EMBEDDED", "X4-EXTERNAL")],
        every.filter(F.col("rule").isin(*UNCHECKED)).join(mm, "doc_id", "left").select("doc_id", "rule", F.lit("not-checked").alias("status"), F.concat(F.lit("clause "), F.element_at(F.create_map(*[F.lit(x) for kv in UNCHECKED.items() for x in kv]), F.col("rule")), F.when(F.col("rule") == "X4-VERSION", F.concat(F.lit("; the header is "), F.coalesce("header", F.lit("?")))).when(F.col("rule") == "X4-XMP-MM", F.concat(F.lit("; identifiers present: "), F.coalesce("n", F.lit(0)))).otherwise("")).alias("detail")),
    ]
    told = found[0]
    for f in found[1:]:
        told = told.unionByName(f)
    # Unreadable objects come before violations, these before what isn't checked for other reasons.
    rank = F.when(F.col("detail") == "unreadable objects", 0).when(F.col("status") == "violation", 1).when(F.col("status") == "not-checked", 2).otherwise(3)
    told = told.groupBy("doc_id", "rule").agg(F.min(F.struct(rank.alias("rank"), "detail", "status")).alias("w"))
    return every.join(told, ["doc_id", "rule"], "left").select("doc_id", "rule", F.coalesce("w.status", F.lit("passed")).alias("status"), F.col("w.detail").alias("detail"))
