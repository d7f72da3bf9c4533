"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os
import random

import duckdb
import pytest

from quire import catalog
from quire.functions import colour, lengths, text
from quire.operators import relations

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return [plain(x) for x in v] if isinstance(v, list | tuple) else float(v) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = duck.execute(catalog.ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    mine = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(repr([plain(r[cols.index(c)]) for c in order]) for r in got.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        steps = relations.align(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert sum(s == "keep" for s, _, _ in steps) == best[-1][-1]
        assert [i for s, i, _ in steps if s != "extra"] == [*range(len(a))] and [j for s, _, j in steps if s != "missing"] == [*range(len(b))]


def test_published_colour_differences(spark):
    from pyspark.sql import functions as F

    pairs = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 2.5, 0.0, 58.0, 24.0, 15.0, 19.4535), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082), (50.0, 0.0, 0.0, 50.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(pairs, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for r in df.select(colour.delta_e2000(*[F.col(c) for c in ("l1", "a1", "b1", "l2", "a2", "b2")]).alias("d"), "want").collect():
        assert r.d == pytest.approx(r.want, abs=1e-4)


def test_scalar_rules(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    row = one.select(
        text.fold(F.lit("ﬁ⼀︐")).alias("fold"), text.clusters(F.lit("️a️b")).alias("clusters"), text.format_number(F.lit(2.5), 0).alias("even"), text.format_number(F.lit(-0.0000001)).alias("zero"),
        text.utf16_offset(F.lit("a😀b"), F.lit(2)).alias("offset"), lengths.length(F.lit(127).cast("long"), "mm").alias("mm"),
    ).first()
    assert (row.fold, row.clusters, row.even, row.zero, row.offset, row.mm.num, row.mm.den) == ("fi一，", 3, "2", "0", 3, 360, 1)
