"""Dates of documents and of their metadata packets, compared at the coarser precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PDF = r"^D?:?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([Zz+-])(?:(\d\d)'?(?:(\d\d)'?)?)?)?$"
XMP = r"^(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?(Z|[+-])?(?:(\d\d):(\d\d))?)?)?)?$"


MARK = "\x01"


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parse(text: Column, pattern: str, bare_zone: bool) -> Column:
    def fields(g: Column) -> Column:
        part = lambda k: F.nullif(F.get(g, F.lit(k)), F.lit("")).try_cast("int")
        names = ("year", "month", "day", "hour", "minute", "second")
        return F.struct(*[part(k).alias(n) for k, n in enumerate(names, 1)], F.get(g, F.lit(7)).alias("sign"), F.get(g, F.lit(8)).alias("has"), F.coalesce(part(8), F.lit(0)).alias("oh"), F.coalesce(part(9), F.lit(0)).alias("om"), F.get(g, F.lit(0)).alias("all"))

    def checked(v: Column) -> Column:
        y, mo, d, h, mi, s, sign, oh, om = (v[k] for k in ("year", "month", "day", "hour", "minute", "second", "sign", "oh", "om"))
        month = F.coalesce(mo, F.lit(1))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        ok = (v["all"] != "") & month.between(1, 12) & F.coalesce(d, F.lit(1)).between(1, days) & (F.coalesce(h, F.lit(0)) <= 23) & (F.coalesce(mi, F.lit(0)) <= 59) & (F.coalesce(s, F.lit(0)) <= 59) & (oh <= 23) & (om <= 59)
        ok = ok & ~(F.lower(sign).eqNullSafe("z") & (oh + om > 0)) & ((sign == "") | h.isNotNull())
        if not bare_zone:
            ok = ok & ((sign == "") | (sign == "Z") | (v["has"] != ""))
        precision = F.when(s.isNotNull(), 6).when(mi.isNotNull(), 5).when(h.isNotNull(), 4).when(d.isNotNull(), 3).when(mo.isNotNull(), 2).otherwise(1)
        zone = F.when(sign.isin("+", "-"), (oh * 60 + om) * F.when(sign == "-", -1).otherwise(1)).when(F.lower(sign) == "z", 0)
        return F.when(ok, F.struct(y.alias("year"), mo.alias("month"), d.alias("day"), h.alias("hour"), mi.alias("minute"), s.alias("second"), zone.alias("offset_min"), precision.alias("precision")))

    # The pattern runs once: its groups are put between marks, and what doesn't match stays without any.
    marked = F.regexp_replace(text, pattern, MARK.join(f"${k}" for k in range(10)))
    groups = F.when(F.contains(marked, F.lit(MARK)) & ~F.contains(text, F.lit(MARK)), F.split(marked, MARK, -1)).otherwise(F.array_repeat(F.lit(""), 10))
    return _let(_let(groups, fields), checked)


def parse_pdf_date(text: Column) -> Column:
    """Year to second (null beyond the precision), zone in minutes (null: none) and precision 1 to 6; null for what is no date."""
    return _parse(text, PDF, True)


def parse_xmp_date(text: Column) -> Column:
    return _parse(text, XMP, False)


def format_pdf_date(d: Column) -> Column:
    """The date's text to its own precision."""
    return _let(d, _formatted)


def _formatted(d: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    zone = F.when(d["offset_min"].isNull(), "").when(d["offset_min"] == 0, "Z").otherwise(F.concat(F.when(d["offset_min"] < 0, "-").otherwise("+"), two(F.floor(F.abs(d["offset_min"]) / 60)), F.lit("'"), two(F.abs(d["offset_min"]) % 60), F.lit("'")))
    return F.concat(F.lit("D:"), F.lpad(d["year"].cast("string"), 4, "0"), *[F.coalesce(two(d[k]), F.lit("")) for k in ("month", "day", "hour", "minute", "second")], zone)


def compare_dates(pdf: Column, xmp: Column) -> Column:
    """equal, different or indeterminate at the coarser precision.

    Days and coarser compare by their fields; times as instants, where a PDF time without a zone is GMT and an XMP time
    without one can't be told.
    """
    return _let(F.struct(pdf.alias("pdf"), xmp.alias("xmp")), lambda v: _compared(v["pdf"], v["xmp"]))


def _compared(pdf: Column, xmp: Column) -> Column:
    p = F.least(pdf["precision"], xmp["precision"])
    field = lambda k, n: (p < n) | pdf[k].eqNullSafe(xmp[k])
    by_field = field("year", 1) & field("month", 2) & field("day", 3)
    zero = lambda c: F.coalesce(c, F.lit(0))
    minutes = lambda d: F.datediff(F.make_date(d["year"], F.coalesce(d["month"], F.lit(1)), F.coalesce(d["day"], F.lit(1))), F.lit("1970-01-01")) * 1440 + zero(d["hour"]) * 60 + zero(d["minute"]) - zero(d["offset_min"])
    at = lambda d: minutes(d).cast("long") * 60 + zero(d["second"])
    unit = F.when(p == 4, 3600).when(p == 5, 60).otherwise(1)
    coarse, fine = F.when(pdf["precision"] <= xmp["precision"], at(pdf)).otherwise(at(xmp)), F.when(pdf["precision"] <= xmp["precision"], at(xmp)).otherwise(at(pdf))
    by_time = (fine >= coarse) & (fine < coarse + unit)
    same = F.when(p <= 3, by_field).otherwise(by_time)
    return F.when(pdf.isNull() | xmp.isNull(), F.lit(None)).when((p > 3) & xmp["offset_min"].isNull(), "indeterminate").when(same, "equal").otherwise("different")
