"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap; boosted trees over their format and context score them, and a
calibrated threshold for each kind selects what is added to the spans of the exact rules. Column expressions only.

The trees learn which candidates the exact rules confirm, from features that these rules don't test: whether a plus or an
at sign stands there, or what stands next to a number, is no feature. So they add what looks like the confirmed ones in all
else but misses a rule by its surroundings: a number that runs into the next one, an address that is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import boosting
from .common import columns, written

KINDS = ("email", "ip", "card", "phone")
# Each rule finds what its plain form finds, leftmost and non-overlapping, but never scans a run twice: attempts start at
# a run's start (or where the last match ended), and runs aren't given back.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])(?![ -][0-9])"  # a maximal run of 13 to 19 digits
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Generators: written-out addresses; digits with separators, of any sort, or as cards, phones and addresses of hosts are written.
SPELT = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:@| ?[(\[](?i:at)[)\]] ?| (?i:at) (?=[A-Za-z0-9-]{{1,63}} (?i:dot) ))[A-Za-z0-9-]{{1,63}}(?:(?:\.| ?[(\[](?i:dot)[)\]] ?| (?i:dot) )[A-Za-z0-9-]{{1,63}}){{1,5}}"
DIGITS = r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9])"
CARDS = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONES = r"(?<![0-9])\+?[0-9]{0,3}[ .-]?\([0-9]{2,4}\) ?[0-9]{2,4}[ .-]?[0-9]{3,4}(?![0-9])"
HOSTS = r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"
RULES = {0: EMAIL, 1: IP, 2: CARD, 3: PHONE, 10: SPELT, 11: DIGITS, 12: CARDS, 13: PHONES, 14: HOSTS}
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _matches(text: Column, rule: str) -> Column:
    """(match, code points before it since the last one, the end of these, the character after it) in order."""
    found, gaps = F.regexp_extract_all(text, F.lit(rule), F.lit(0)), F.split(text, rule, -1)
    return F.transform(found, lambda s, i: F.struct(s.alias("s"), F.length(F.get(gaps, i)).alias("gap"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")))


def _valid(kind: Column, s: Column) -> Column:
    """What a match of a rule must satisfy besides."""
    number = lambda p: F.regexp_replace(p, "^0+", "")
    ip = F.forall(F.split(s, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.coalesce(number(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.reverse(F.regexp_replace(s, "[^0-9]", ""))
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)).otherwise(c.try_cast("int"))
    luhn = F.aggregate(F.transform(F.split(digits, ""), doubled), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0
    count = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return F.when(kind == 1, ip).when(kind == 2, luhn).when(kind == 3, count.between(9, 15)).otherwise(True)


def _bits(kind: Column, s: Column, before: Column, after: Column) -> Column:
    """Format and context of a candidate, a feature a bit. Written-out addresses and digits have features of their own."""
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    spelt = [
        F.contains(s, F.lit(".")), s.rlike("[^A-Za-z][A-Za-z]{2,6}$"), s.rlike("(?i)[^a-z](com|org|net|edu|gov|example|de|fr|es|eu|uk|io)$"),
        F.lower(before).rlike("mail|contact|write|reach|kontakt|correo|courriel"), s.rlike("^[^@ (\\[]*[0-9]"), s.rlike("^[^@ (\\[]*[._]"), s.rlike("^[A-Z]"), before.rlike("[:<(] ?$"),
    ]
    plain = [
        F.contains(s, F.lit("(")), F.contains(s, F.lit(" ")), F.contains(s, F.lit("-")), s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.contains(s, F.lit(".")),
        digits >= 13, digits.between(9, 12), s.rlike("^[0-9]+$"), _valid(F.lit(1), s) & s.rlike(r"^[0-9.]+$"), _valid(F.lit(2), s), before.rlike("[A-Za-z_@]$") | after.rlike("[A-Za-z_@]"),
        F.lower(before).rlike("phone|tel|call|fax|mobil|card|visa|credit|karte|carte|tarjeta|host|addr"),
    ]
    packed = lambda x: sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(x)), F.lit(0))
    return F.when(kind == 10, packed(spelt)).otherwise(packed(plain))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """One row per row of docs: its id, base and added, arrays of (kind, start, end) by kind, then start.

    Kinds are places in KINDS; offsets are code points, end exclusive. base holds what the rules find; added holds
    candidates outside of them that the trees score at least as high as calibrated, of those that overlap the one with
    the highest score (then the first, then the longest). The trees learn from the patterns of the candidates of a half
    of all rows, by a hash of the id, and are calibrated on the other half: the threshold of a kind is the lowest score
    down to which the given share of candidates is confirmed at every score. A rule confirms a candidate that is one of
    its spans; written-out addresses are also confirmed by a bracketed "at". A kind that either half lacks gets no spans
    added. Null text counts as empty; null ids and repeated rows each give a row; an empty table gives an empty
    result. Only the two named columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = columns(docs, doc_id=id_col, text=text).withColumn("rid", F.monotonically_increasing_id())
    some = F.col("text").rlike(r"[@0-9]|(?i:[(\[]at[)\]]| dot )")  # no rule or generator matches any other text
    rows = written(src.select("rid", "doc_id", F.when(some, F.col("text")).alias("text")), "texts")
    held = rows.filter("text is not null")
    each = None
    for kind, rule in RULES.items():
        few = held.filter(F.contains("text", F.lit("@"))) if kind == 0 else held.filter(F.contains("text", F.lit("+"))) if kind == 3 else held
        own = few.filter(F.col("text").rlike(rule)).select("rid", F.lit(kind).alias("kind"), F.posexplode(_matches(F.col("text"), rule)).alias("nth", "x"))
        each = own if each is None else each.unionByName(own)
    order = Window.partitionBy("rid", "kind").orderBy("nth")
    size = F.length("x.s")
    start = F.sum(F.col("x.gap") + size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size
    spans = each.select("rid", "kind", start.cast("int").alias("start"), "x")
    ok = spans.filter((F.col("kind") >= 10) | _valid(F.col("kind"), F.col("x.s")))
    span = F.struct("kind", "start", (F.col("start") + F.length("x.s")).alias("end"))
    bits = _bits(F.col("kind"), F.col("x.s"), F.col("x.before"), F.col("x.after"))
    digits = F.length(F.regexp_replace("x.s", "[^0-9]", ""))
    as_kind = F.when(F.col("kind") == 10, 0).when(F.col("x.s").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), 1).when(digits >= 13, 2).otherwise(3)
    sure = (F.col("kind") == 10) & F.col("x.s").rlike(r"(?i)[(\[]at[)\]]")
    proposed = F.struct(as_kind.alias("kind"), "start", (F.col("start") + F.length("x.s")).alias("end"), bits.alias("bits"), sure.alias("sure"))
    per_row = ok.groupBy("rid").agg(F.sort_array(F.collect_list(F.when(F.col("kind") < 10, span))).alias("base"), F.array_distinct(F.collect_list(F.when(F.col("kind") >= 10, proposed))).alias("proposed"))
    per_row = written(per_row, "candidates")
    p = F.col("p")
    confirmed = p["sure"] | F.exists("base", lambda b: (b["kind"] == p["kind"]) & F.when(p["kind"] == 0, _overlap(p, b)).otherwise((b["start"] == p["start"]) & (b["end"] == p["end"])))
    half = rows.select("rid", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2)).cast("int").alias("half"))
    seen = per_row.select("rid", "base", F.explode("proposed").alias("p")).join(half, "rid").select("half", F.col("p.kind").alias("kind"), F.col("p.bits").alias("bits"), confirmed.cast("int").alias("yes"))
    counts = seen.groupBy("half", "kind", "bits").agg(F.count(F.lit(1)).alias("n"), F.sum("yes").alias("yes")).collect()  # 2 halves x 4 kinds x 4096 patterns at most
    value = F.lit(None).cast("double")
    for family, features in (((0,), 8), ((1, 2, 3), 12)):
        total: dict[int, tuple[int, int]] = {}
        for r in counts:
            if r.kind in family and r.half == 0:
                a, b = total.get(r.bits, (0, 0))
                total[r.bits] = a + r.n, b + r.yes
        trees = boosting.train(total, features)
        for kind in family:
            least = boosting.threshold({r.bits: (r.n, r.yes) for r in counts if r.kind == kind and r.half == 1}, trees, precision) if total else float("inf")
            if least != float("inf"):
                score = boosting.score(trees, p["bits"])
                value = F.when((p["kind"] == kind) & (score >= least), score).otherwise(value)
    free = per_row.select("rid", "base", F.explode("proposed").alias("p")).filter(~F.exists("base", lambda b: _overlap(F.col("p"), b)))
    scored = free.withColumn("score", value).filter("score is not null")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), F.col("p.start").alias("start"), (-p["end"]).alias("last"), F.col("p.kind").alias("kind"), F.col("p.end").alias("end"))))
    kept = F.aggregate("ranked", F.array().cast(SPAN), lambda found, x: F.when(F.exists(found, lambda y: _overlap(x, y)), found).otherwise(F.concat(found, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))))
    more = scored.groupBy("rid").agg(ranked.alias("ranked")).select("rid", F.sort_array(kept).alias("added"))
    none = F.array().cast(SPAN)
    out = rows.select("rid", "doc_id").join(per_row.select("rid", "base"), "rid", "left").join(more, "rid", "left")
    return out.select("doc_id", F.coalesce(F.col("base").cast(SPAN), none).alias("base"), F.coalesce(F.col("added").cast(SPAN), none).alias("added"))


def _of_kind(kind: int):
    return lambda x: x["kind"] == kind  # of one argument: a second one would be the place


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans, and the count of added ones."""
    names = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
