"""Queries that drive the document kernels with the driver's tables, and the SQL that they are held against.

The tables hold no documents of ours, so inputs are derived from their columns: these queries check arithmetic and
relational shape. What the kernels do to documents is checked on generated files in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import colour, dates, geometry, lengths, text
from ..operators import relations
from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query("SELECT doc_id, md5(text) AS folded, (length(text) - length(replace(text, 'fi', 'f')))::BIGINT + (length(text) - length(replace(text, 'fl', 'f')))::BIGINT AS n_folds FROM documents WHERE text IS NOT NULL")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligatures planted in every text fold back to it."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    planted = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ"))
    return d.select("doc_id", F.md5(text.fold(planted).cast("binary")).alias("folded"), text.fold_count(planted).cast("long").alias("n_folds"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\x{9}-\\x{d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) AS stripped FROM documents WHERE text IS NOT NULL")
def strip_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.md5(text.strip_white_space(F.col("text")).cast("binary")).alias("stripped"))


@query("SELECT item_id, length(text)::BIGINT AS clusters, (length(text) - length(replace(text, 'a', '')))::BIGINT AS selectors FROM benchmark")
def variation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector planted after every a stays with its base character."""
    planted = F.replace(F.col("text"), F.lit("a"), F.lit("a️"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.clusters(planted).cast("long").alias("clusters"), (F.length(planted) - F.length(text.without_selectors(planted))).cast("long").alias("selectors"))


@query("SELECT doc_id, md5(text) AS digest, CASE WHEN length(text) > 120 THEN left(text, 117) || '...' ELSE text END AS summary FROM documents WHERE text IS NOT NULL")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), text.summary(F.col("text")).alias("summary"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ABCDEF' END AS tag, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'ABcDEF+' || p_name ELSE p_name END AS base, p_partkey % 3 = 1 AS malformed FROM part")
def subset_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.concat(F.when(k == 0, "ABCDEF+").when(k == 1, "ABcDEF+").otherwise(""), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.subset_tag(name).alias("t")).select("p_partkey", "t.*")


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') END AS number FROM part")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.format_number(F.col("p_retailprice"), 2).alias("number"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1")
def latest_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the copies of an object number the last one counts."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return relations.latest(d, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])


@query("SELECT l_orderkey, count(*) AS copies, count(DISTINCT l_returnflag || l_linestatus) AS variants FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def ambiguous_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.ambiguous(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.concat("l_returnflag", "l_linestatus"))


SIDE = "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = {}"


@query(f"SELECT 'removed' AS change, l_partkey, l_suppkey FROM ({SIDE.format(0)} EXCEPT {SIDE.format(1)}) UNION ALL SELECT 'added', l_partkey, l_suppkey FROM ({SIDE.format(1)} EXCEPT {SIDE.format(0)})")
def set_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their suppliers in even orders against those in odd ones."""
    d = table(spark, sf_dir, "lineitem").withColumn("pair", F.struct("l_partkey", "l_suppkey"))
    return relations.added_removed(d.filter("l_orderkey % 2 = 0"), d.filter("l_orderkey % 2 = 1"), "pair").select("change", "pair.*")


@query("""SELECT c_custkey AS doc, '/c_mktsegment' AS path, 'changed' AS kind, c_mktsegment AS a, 'X' || c_mktsegment AS b FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 = 0
UNION ALL SELECT c_custkey, '/c_name', 'removed', c_name, NULL FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, '/c_nationkey', 'removed', c_nationkey::VARCHAR, NULL FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, '/c_mktsegment', 'removed', c_mktsegment, NULL FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT -c_custkey, '/c_name', 'added', NULL, c_name FROM customer WHERE c_custkey % 13 = 0 AND c_custkey > 0""")
def path_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a value graph, one value a path."""
    cols = ["c_name", "c_nationkey", "c_mktsegment"]
    d = table(spark, sf_dir, "customer")
    b = d.filter("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.expr("if(c_custkey % 7 = 0, concat('X', c_mktsegment), c_mktsegment)"))
    extra = relations.path_values(d.filter("c_custkey % 13 = 0 and c_custkey > 0").withColumn("c_custkey", -F.col("c_custkey")), "c_custkey", ["c_name"])
    return relations.path_diff(relations.path_values(d, "c_custkey", cols), relations.path_values(b, "c_custkey", cols).unionByName(extra))


TURNS = "SELECT c.conv_id, c.turn, string_split(c.text, ' ') AS x, string_split(d.text, ' ') AS y FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1 WHERE c.text IS NOT NULL AND d.text IS NOT NULL"
COMMON = "coalesce(list_min(list_transform(list_filter(range(1, least(len({0}), len({1})) + 1), lambda k: {0}[k] <> {1}[k]), lambda k: k - 1)), least(len({0}), len({1})))"


@query(f"SELECT conv_id, turn, p AS prefix, least(s, least(len(x), len(y)) - p)::INT AS suffix FROM (SELECT *, {COMMON.format('x', 'y')}::INT AS p, {COMMON.format('list_reverse(x)', 'list_reverse(y)')}::INT AS s FROM ({TURNS}))")
def prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a turn shares with the next one at its start and end."""
    d = table(spark, sf_dir, "conversations").filter("text is not null")
    nxt = d.select("conv_id", (F.col("turn") - 1).alias("turn"), F.split("text", " ").alias("y"))
    both = d.select("conv_id", "turn", F.split("text", " ").alias("x")).join(nxt, ["conv_id", "turn"])
    lead, tail = relations.prefix_suffix(F.col("x"), F.col("y"))
    return both.select("conv_id", "turn", lead.alias("prefix"), tail.alias("suffix"))


BOXES = """SELECT p_partkey AS page, [0.0::DOUBLE, 0.0, 600.0, 800.0] AS media, CASE WHEN p_size % 2 = 0 THEN [10.0::DOUBLE, 10.0, 590.0, 790.0] END AS crop,
CASE WHEN p_size % 3 <> 0 THEN [p_size::DOUBLE, p_size::DOUBLE, 560.0 + p_size, 790.0] END AS trim, CASE WHEN p_size % 5 = 0 THEN [20.0::DOUBLE, 20.0, 500.0, 500.0] END AS art FROM part"""
IN_BOX = "(coalesce(trim, art)[1] >= {0}[1] AND coalesce(trim, art)[2] >= {0}[2] AND coalesce(trim, art)[3] <= {0}[3] AND coalesce(trim, art)[4] <= {0}[4])"
ONE = "((trim IS NULL) <> (art IS NULL))"


@query(f"SELECT page, 'one-of-trim-and-art' AS rule, NOT {ONE} AS broken FROM ({BOXES}) UNION ALL SELECT page, 'inside-media', {ONE} AND NOT coalesce({IN_BOX.format('media')}, true) FROM ({BOXES}) UNION ALL SELECT page, 'inside-crop', {ONE} AND NOT coalesce({IN_BOX.format('coalesce(crop, media)')}, true) FROM ({BOXES})")
def box_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda *v: F.array(*[F.lit(float(x)) if not hasattr(x, "cast") else x.cast("double") for x in v])
    s = F.col("p_size")
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), box(0, 0, 600, 800).alias("media"), F.when(s % 2 == 0, box(10, 10, 590, 790)).alias("crop"), F.when(s % 3 != 0, box(s, s, s + 560, 790)).alias("trim"), F.when(s % 5 == 0, box(20, 20, 500, 500)).alias("art"))
    return relations.box_rules(pages)


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'O') AS violations, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS not_checked,
CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'violation' WHEN count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) > 0 THEN 'not-checked' ELSE 'passed' END AS verdict FROM orders GROUP BY 1""")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "violation").otherwise("not-checked")
    return relations.rule_summary(table(spark, sf_dir, "orders").select("o_custkey", status.alias("status")), "o_custkey")


EDGES = "SELECT DISTINCT CASE WHEN l_quantity > 40 THEN l_suppkey ELSE 1000000 + l_partkey END AS src, CASE WHEN l_quantity > 40 THEN 1000000 + l_partkey WHEN l_quantity > 25 THEN 2000000 + l_orderkey ELSE l_suppkey END AS dst FROM lineitem"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link for every line: from suppliers to parts, from parts to orders, and from parts back to suppliers."""
    much = F.col("l_quantity") > 40
    part, order = F.col("l_partkey") + 1000000, F.col("l_orderkey") + 2000000
    to = F.when(much, part).when(F.col("l_quantity") > 25, order).otherwise(F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(F.when(much, F.col("l_suppkey")).otherwise(part).alias("src"), to.alias("dst")).distinct()


WALK = f"WITH RECURSIVE e AS ({EDGES}), w AS (SELECT 1::BIGINT AS node UNION SELECT e.dst FROM w JOIN e ON e.src = w.node)"


@query(f"{WALK} SELECT node FROM w")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that references lead to from the first one, over a graph with cycles."""
    start = spark.range(1, 2).select(F.col("id").alias("node"))
    return relations.reachable(_edges(spark, sf_dir), start).select("node")


@query(f"{WALK} SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) EXCEPT SELECT node FROM w")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    every = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return every.join(reachable(spark, sf_dir), "node", "left_anti")


@query("SELECT user_id, event_type, list_sort(list(DISTINCT day)) AS pages, list_sort(list(DISTINCT kind)) AS kinds FROM (SELECT user_id, event_type, extract(day FROM ts)::INT AS day, CASE WHEN value > 50 THEN 'painted' ELSE 'declared' END AS kind FROM events) GROUP BY 1, 2")
def name_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("day"), F.when(F.col("value") > 50, "painted").otherwise("declared").alias("kind"))
    return relations.usage(d, "user_id", "event_type", "day", "kind")


@query("""SELECT c_custkey, coalesce(own, nat, reg) AS value, own IS NOT NULL AS explicit, CASE WHEN own IS NOT NULL THEN NULL WHEN nat IS NOT NULL THEN 1 WHEN reg IS NOT NULL THEN 2 END AS inherited_from FROM
(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS own, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS nat, CASE WHEN r_regionkey <> 1 THEN r_name END AS reg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def inherit_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    own = c.select("c_custkey", F.expr("if(c_custkey % 4 = 0, c_mktsegment, null)").alias("value"))
    up1 = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.lit(1).alias("depth"), F.expr("if(n_nationkey % 2 = 0, n_name, null)").alias("value"))
    up2 = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey).select("c_custkey", F.lit(2).alias("depth"), F.expr("if(r_regionkey <> 1, r_name, null)").alias("value"))
    return relations.inherit(own, up1.unionByName(up2), "c_custkey", "value")


RUNS = "SELECT *, value > 30 AS f, coalesce(lag(value > 30) OVER w, false) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


@query(f"SELECT user_id, run, count(*) AS rows, min(event_id) AS first, max(event_id) AS last FROM (SELECT *, (sum(CASE WHEN f AND NOT g THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS run FROM ({RUNS})) WHERE f GROUP BY 1, 2")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.runs(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("value") > 30)


@query("""SELECT user_id, unit, min(event_id) AS first, max(event_id) AS last, count(*) AS rows FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS unit FROM
(SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 40 THEN 1 ELSE 0 END AS s FROM events)) GROUP BY 1, 2""")
def contiguous_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.contiguous(table(spark, sf_dir, "events"), ["user_id"], "event_id", 40)


PLACED = "SELECT event_id AS id, event_id AS seq, ((event_id * 7919) % 1000)::DOUBLE AS x, ((event_id * 104729) % 1000)::DOUBLE AS y, event_type FROM events"


@query(f"WITH p AS ({PLACED}), b AS (SELECT seq, x AS x0, y AS y0, x + 30 AS x1, y + 20 AS y1 FROM p WHERE event_type = 'purchase') SELECT p.id, EXISTS (SELECT 1 FROM b WHERE b.seq > p.seq AND p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1) AS covered FROM p WHERE p.event_type <> 'purchase'")
def later_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that a later box covers, by a join on grid cells."""
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 1000).cast("double").alias("x"), (F.col("event_id") * 104729 % 1000).cast("double").alias("y"), "event_type")
    boxes = d.filter("event_type = 'purchase'").select("seq", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 30).alias("x1"), (F.col("y") + 20).alias("y1"))
    return relations.covered(d.filter("event_type <> 'purchase'").drop("event_type"), boxes, 50.0)


DATE = "strftime(o_orderdate, '{}')"


@query("""SELECT o_orderkey, extract(year FROM o_orderdate)::INT AS year, CASE WHEN o_orderkey % 4 > 0 THEN extract(month FROM o_orderdate)::INT END AS month, CASE WHEN o_orderkey % 4 > 1 THEN extract(day FROM o_orderdate)::INT END AS day,
CASE WHEN o_orderkey % 4 = 3 THEN extract(hour FROM o_orderdate)::INT END AS hour, CASE WHEN o_orderkey % 4 = 3 THEN extract(minute FROM o_orderdate)::INT END AS minute, CASE WHEN o_orderkey % 4 = 3 THEN extract(second FROM o_orderdate)::INT END AS second,
CASE WHEN o_orderkey % 4 = 3 THEN -150 END AS offset_min, CASE o_orderkey % 4 WHEN 3 THEN 6 ELSE (o_orderkey % 4 + 1)::INT END AS precision FROM orders""")
def pdf_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates at four precisions, formatted and read again."""
    k = F.col("o_orderkey") % 4
    made = F.when(k == 0, F.date_format("o_orderdate", "'D:'yyyy")).when(k == 1, F.date_format("o_orderdate", "'D:'yyyyMM")).when(k == 2, F.date_format("o_orderdate", "'D:'yyyyMMdd")).otherwise(F.concat(F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss"), F.lit("-02'30'")))
    again = dates.format_pdf_date(dates.parse_pdf_date(made))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_pdf_date(again).alias("d")).select("o_orderkey", "d.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'indeterminate' WHEN o_orderkey % 5 = 1 THEN 'equal' WHEN o_orderkey % 5 = 2 THEN 'different' ELSE 'equal' END AS agreement FROM orders")
def date_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date in two notations: without a zone, as one instant in two zones, a minute off, and at the day's precision."""
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    pdf = F.when(k == 1, F.concat(F.date_format(t + F.expr("interval 2 hours"), "'D:'yyyyMMddHHmmss"), F.lit("+02'00'"))).when(k == 3, F.date_format(t, "'D:'yyyyMMdd")).otherwise(F.date_format(t, "'D:'yyyyMMddHHmmss'Z'"))
    iso = F.date_format(F.when(k == 2, t + F.expr("interval 1 minute")).otherwise(t), "yyyy-MM-dd'T'HH:mm:ss")
    xmp = F.concat(iso, F.when(k == 0, "").otherwise("Z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.compare_dates(dates.parse_pdf_date(pdf), dates.parse_xmp_date(xmp)).alias("agreement"))


@query("SELECT p_partkey, p_size::BIGINT * 360 // gcd(p_size::BIGINT * 360, 127) AS num, 127 // gcd(p_size::BIGINT * 360, 127) AS den, (p_size::BIGINT * 360 + 72 * 127) // gcd(p_size::BIGINT * 360 + 72 * 127, 127) AS plus_inch, CASE WHEN p_size * 360 > 72 * 127 THEN 1 WHEN p_size * 360 = 72 * 127 THEN 0 ELSE -1 END AS against_inch FROM part")
def exact_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Millimetres as exact points, an inch more, and compared with an inch."""
    d = table(spark, sf_dir, "part").select("p_partkey", lengths.length(F.col("p_size").cast("long"), "mm").alias("mm"), lengths.length(F.lit(1).cast("long"), "inch").alias("inch"))
    return d.select("p_partkey", "mm.num", "mm.den", lengths.add(F.col("mm"), F.col("inch"))["num"].alias("plus_inch"), lengths.compare(F.col("mm"), F.col("inch")).alias("against_inch"))


@query("SELECT p_partkey, round(0.5 * p_size - 0.25 * p_retailprice + 10, 6) AS x, round(0.75 * p_size + 2 * p_retailprice - 3, 6) AS y, p_size::DOUBLE AS back_x FROM part")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [0.5, 0.75, -0.25, 2.0, 10.0, -3.0]
    x, y = geometry.apply(m, F.col("p_size"), F.col("p_retailprice"))
    bx, _ = geometry.apply(geometry.invert(m), x, y)
    return table(spark, sf_dir, "part").select("p_partkey", r6(x).alias("x"), r6(y).alias("y"), r6(bx).alias("back_x"))


@query("SELECT p_partkey, (-p_size)::DOUBLE AS x0, 0.0::DOUBLE AS y0, round(0.5::DOUBLE * p_size, 6) AS x1, round(2.0::DOUBLE * p_size, 6) AS y1 FROM part")
def quad_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    b = geometry.box_bounds([0.5, 1.0, -1.0, 1.0, 0.0, 0.0], zero, zero, s, s)
    return table(spark, sf_dir, "part").select("p_partkey", *[r6(v).alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)])


@query("SELECT p_partkey, 0.0::DOUBLE AS low, round(0.75::DOUBLE * p_size, 6) AS high FROM part")
def bezier_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arch from 0 to 0 reaches three quarters of its handles' height."""
    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    low, high = geometry.bezier_bounds(zero, s, s, zero)
    return table(spark, sf_dir, "part").select("p_partkey", r6(low).alias("low"), r6(high).alias("high"))


STAR = [(0.0, 3.0), (2.0, -3.0), (-3.0, 1.0), (3.0, 1.0), (-2.0, -3.0)]


@query(f"""WITH p AS (SELECT event_id, ((event_id * 31) % 61) / 10.0 - 3 AS x, ((event_id * 17) % 59) / 10.0 - 2.95 AS y FROM events), e AS (SELECT * FROM (VALUES {', '.join(f'({a[0]}, {a[1]}, {b[0]}, {b[1]})' for a, b in zip(STAR, [*STAR[1:], STAR[0]], strict=True))}) t(xa, ya, xb, yb)),
w AS (SELECT event_id, sum(CASE WHEN y >= ya AND y < yb AND (x - xa) * (yb - ya) - (xb - xa) * (y - ya) < 0 THEN 1 WHEN y < ya AND y >= yb AND (x - xa) * (yb - ya) - (xb - xa) * (y - ya) > 0 THEN -1 ELSE 0 END) AS n FROM p, e GROUP BY 1)
SELECT event_id, n <> 0 AS nonzero, abs(n) % 2 = 1 AS even_odd FROM w""")
def point_in_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("event_id") * 31 % 61) / 10 - 3, (F.col("event_id") * 17 % 59) / 10 - 2.95
    return table(spark, sf_dir, "events").select("event_id", geometry.inside(STAR, x, y).alias("nonzero"), geometry.inside(STAR, x, y, True).alias("even_odd"))


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE * 50 + 50 AS l1, embedding[2]::DOUBLE * 100 AS a1, embedding[3]::DOUBLE * 100 AS b1, embedding[4]::DOUBLE * 50 + 50 AS l2, embedding[5]::DOUBLE * 100 AS a2, embedding[6]::DOUBLE * 100 AS b2 FROM embeddings),
g AS (SELECT *, 0.5 * (1 - sqrt(pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) / (pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) + pow(25, 7)))) AS g FROM v),
c AS (SELECT *, a1 * (1 + g) AS p1, a2 * (1 + g) AS p2 FROM g),
h AS (SELECT *, sqrt(p1*p1+b1*b1) AS c1, sqrt(p2*p2+b2*b2) AS c2, CASE WHEN atan2(b1, p1) < 0 THEN degrees(atan2(b1, p1)) + 360 ELSE degrees(atan2(b1, p1)) END AS h1, CASE WHEN atan2(b2, p2) < 0 THEN degrees(atan2(b2, p2)) + 360 ELSE degrees(atan2(b2, p2)) END AS h2 FROM c),
d AS (SELECT *, CASE WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cm FROM h),
e AS (SELECT *, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) AS db, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) AS t, 1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2)) AS sl, 1 + 0.045 * cm AS sc FROM d)
SELECT vec_id, round(sqrt(pow((l2 - l1) / sl, 2) + pow((c2 - c1) / sc, 2) + pow(db / (1 + 0.015 * cm * t), 2) - 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25, 7))) * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * ((c2 - c1) / sc) * (db / (1 + 0.015 * cm * t))), 4) AS delta FROM e""")
def delta_e2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda k, s, o=0: F.col("embedding")[k].cast("double") * s + o
    d = colour.delta_e2000(v(0, 50, 50), v(1, 100), v(2, 100), v(3, 50, 50), v(4, 100), v(5, 100))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(d, 4).alias("delta"))


@query("SELECT vec_id, round(100 * abs(embedding[1]::DOUBLE), 4) AS l, round(100 * embedding[2]::DOUBLE, 4) AS a, round(100 * embedding[3]::DOUBLE, 4) AS b FROM embeddings")
def xyz_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab to XYZ and back."""
    e = F.col("embedding")
    xyz = colour.lab_to_xyz(F.abs(e[0].cast("double")) * 100, e[1].cast("double") * 100, e[2].cast("double") * 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(v, 4).alias(n) for v, n in zip(colour.xyz_to_lab(*xyz), "lab", strict=True)])


@query("SELECT l_orderkey, l_linenumber, round(pow(l_discount, 2.2), 6) AS gamma, round(CASE WHEN l_discount * 10 < 1 THEN l_discount * 10 * 0.2 ELSE 0.2 + (least(l_discount * 10, 1.0) - 1) * 0.8 END, 6) AS sampled FROM lineitem")
def curve_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A power curve, and a table whose first step is a tenth of the way."""
    x = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(colour.curve(x, gamma=2.2)).alias("gamma"), r6(colour.curve(colour.clip(x * 10, 0.0, 1.0), table=[0.0, 0.1, 0.2])).alias("sampled"))


@query("SELECT l_orderkey, l_linenumber, round(0.1 + pow(l_discount, 1.5) * 0.8, 6) AS value FROM lineitem")
def exponential_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(colour.exponential(F.col("l_discount"), 0.1, 0.9, 1.5)).alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount < 0.05 THEN pow(l_discount / 0.05, 2) ELSE 1 - (l_discount - 0.05) / 0.95 * 0.5 END, 6) AS value FROM lineitem")
def stitching_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = colour.stitching(F.col("l_discount"), [0.05], [(0.0, 1.0), (0.0, 1.0)], [lambda t: colour.exponential(t, 0.0, 1.0, 2.0), lambda t: colour.exponential(t, 1.0, 0.5, 1.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(f).alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(2 * l_discount * 10 / 10 + 3 * l_tax + 0.5, 6) AS function_value, round(2 * l_discount + 3 * l_tax + 0.5, 6) AS table_value FROM lineitem")
def sampled_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane sampled at 3 x 4 points is met exactly, with either input varying fastest."""
    plane = lambda i, j: 2 * i / 2 + 3 * j / 3 + 0.5
    x = [F.col("l_discount"), F.col("l_tax")]
    first = [plane(i, j) for j in range(4) for i in range(3)]
    last = [plane(i, j) for i in range(3) for j in range(4)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(colour.sampled(x, [3, 4], first)).alias("function_value"), r6(colour.sampled(x, [3, 4], last, False)).alias("table_value"))


@query()
def align_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text against itself with words left out and put in."""
    edited = F.replace(F.regexp_replace("text", " (th[a-z]+) ", " "), F.lit(" a "), F.lit(" a new "))
    return relations.align_rows(table(spark, sf_dir, "benchmark").withColumn("edited", edited), "item_id", "text", "edited")


@query()
def reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of boxes made from parts, a page for each brand."""
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("index"), (F.col("p_partkey") * 37 % 500).cast("double").alias("left"), (F.col("p_partkey") * 91 % 700).cast("double").alias("bottom"))
    d = d.withColumn("right", F.col("left") + 12).withColumn("top", F.col("bottom") + 10 + F.col("index") % 5)
    return relations.reading_rows(d, ["page"], "page string, index long, row long, place long")


@query("""WITH b AS (SELECT p_brand AS page, p_partkey AS index, p_partkey % 7 AS col, (p_partkey * 91) % 700 AS y FROM part), c AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY col DESC) - 1 AS row FROM b)
SELECT page, index, row::BIGINT AS row, (row_number() OVER (PARTITION BY page ORDER BY row, y DESC, index) - 1)::BIGINT AS place FROM c""")
def reading_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical writing in seven columns that are a little ragged, from the right."""
    left = (F.col("p_partkey") % 7 * 60 + F.col("p_size") % 4).cast("double")
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("index"), left.alias("left"), (F.col("p_partkey") * 91 % 700).cast("double").alias("bottom"))
    d = d.withColumn("right", F.col("left") + 12).withColumn("top", F.col("bottom") + 10)
    return relations.reading_columns(d, ["page"], "page string, index long, row long, place long")


@query()
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))
