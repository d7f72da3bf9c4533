"""Operators on flat document tables: copies, inheritance, reachability, runs, covers, differences, inventories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import can_checkpoint


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the copies of each key the one that is last in the order; a partial maximum precedes the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_"))
    return top.select(*keys, "_.*")


def ambiguous(df: DataFrame, keys: Sequence[str], content: Column) -> DataFrame:
    """Keys whose copies differ, with the number of copies and of different ones."""
    per = df.groupBy(*keys, F.md5(content.cast("binary")).alias("_")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("copies"), F.count("_").alias("variants")).filter("variants > 1")


def added_removed(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(change, key): what only b has is added, what only a has is removed."""
    gone = a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit("removed").alias("change"), key)
    new = b.select(key).distinct().join(a.select(key), key, "left_anti").select(F.lit("added").alias("change"), key)
    return gone.unionByName(new)


def path_values(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows as (doc, path, value), a row for each value that is not null."""
    pairs = F.array(*[F.struct(F.lit(f"/{c}").alias("path"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(key).alias("doc"), F.explode(pairs).alias("p")).select("doc", "p.*").filter("value is not null")


def path_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, path, kind, a, b) where two sets of (doc, path, value) differ: one full outer join on the path."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["doc", "path"], "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("doc", "path", kind.alias("kind"), "a", "b")


def prefix_suffix(a: Column, b: Column) -> tuple[Column, Column]:
    """How many items two arrays share at the start, and at the end beyond that."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), F.greatest(n, F.lit(1))), lambda p: p["x"].eqNullSafe(p["y"]))
    lead = F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n))
    ra, rb = F.reverse(a), F.reverse(b)
    back = F.transform(F.slice(F.arrays_zip(ra.alias("x"), rb.alias("y")), F.lit(1), F.greatest(n, F.lit(1))), lambda p: p["x"].eqNullSafe(p["y"]))
    tail = F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(back, False), F.lit(0)) - 1, n))
    return lead.cast("int"), F.least(tail, n - lead).cast("int")


def inherit(own: DataFrame, ancestors: DataFrame, node: str, value: str) -> DataFrame:
    """Each node's own value, else that of the nearest ancestor that has one. ancestors: (node, depth, value), depth 1 nearest."""
    near = ancestors.filter(F.col(value).isNotNull()).groupBy(node).agg(F.min_by(value, "depth").alias("_up"), F.min("depth").alias("_depth"))
    out = own.join(near, node, "left")
    explicit = F.col(value).isNotNull()
    return out.select(node, F.coalesce(value, "_up").alias(value), explicit.alias("explicit"), F.when(~explicit, F.col("_depth")).alias("inherited_from"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Every node that the edges (src, dst) lead to from the nodes of start, with the least number of steps.

    Each round joins only the new nodes and cuts lineage by a checkpoint; it ends when there are none.
    """
    can_checkpoint(edges.sparkSession)
    edges = edges.select("src", "dst").distinct().checkpoint()
    seen = start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("steps", F.lit(0)).checkpoint()
    front, step = seen, 0
    while True:
        step += 1
        front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("steps", F.lit(step)).checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front).checkpoint()


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Maximal runs of consecutive rows for which the flag holds: keys, run (from 0), rows, and the first and last order value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_starts", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    grouped = marked.withColumn("run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).filter("_on")
    return grouped.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("rows"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def contiguous(df: DataFrame, keys: Sequence[str], index: str, gap: int = 1) -> DataFrame:
    """Units of rows whose index follows the one before by at most the gap."""
    w = Window.partitionBy(*keys).orderBy(index)
    starts = F.coalesce((F.col(index) - F.lag(index).over(w) > gap).cast("int"), F.lit(0))
    units = df.withColumn("_s", starts).withColumn("unit", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return units.groupBy(*keys, "unit").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("rows"))


def on_grids(points: DataFrame, boxes: DataFrame, cell: float, x: Column, y: Column, box: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """points and boxes with level, cx and cy: a box's level is the power of two of the cell by which it touches four cells
    at most, however large it is; a point has a row for each level that occurs."""
    size = F.greatest(box[2] - box[0], box[3] - box[1], F.lit(cell))
    leveled = boxes.withColumn("level", F.least(F.ceil(F.log2(size / cell)), F.lit(1000)).cast("int"))
    levels = [r[0] for r in leveled.select("level").distinct().collect()]  # a thousand at most
    at = lambda v: F.floor(v / (F.pow(F.lit(2.0), F.col("level")) * cell)).cast("long")
    own = leveled.withColumn("cx", F.explode(F.sequence(at(box[0]), at(box[2])))).withColumn("cy", F.explode(F.sequence(at(box[1]), at(box[3]))))
    each = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    return each.withColumn("cx", at(x)).withColumn("cy", at(y)), own


def covered(points: DataFrame, covers: DataFrame, cell: float) -> DataFrame:
    """points (id, seq, x, y) with covered: whether a box (seq, x0, y0, x1, y1) that came later holds the point.

    A join on grid cells, of a size that follows the boxes, so a point meets only boxes near it and no box has more than four rows.
    """
    p, b = on_grids(points, covers.withColumnRenamed("seq", "b_seq"), cell, F.col("x"), F.col("y"), [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    hits = p.join(b, ["level", "cx", "cy"]).filter("b_seq > seq and x between x0 and x1 and y between y0 and y1").select("id").distinct().withColumn("covered", F.lit(True))
    return points.join(hits, "id", "left").select("id", F.coalesce("covered", F.lit(False)).alias("covered"))


def box_rules(pages: DataFrame) -> DataFrame:
    """(page, rule, broken) for a page's boxes media, crop, trim, art (arrays, null: absent).

    Exactly one of trim and art; it lies in the crop box, which falls back to the media box, and in the media box.
    """
    from ..functions.geometry import contains

    crop = F.coalesce("crop", "media")
    own = F.coalesce("trim", "art")
    one = F.col("trim").isNotNull() != F.col("art").isNotNull()
    held = [("one-of-trim-and-art", ~one), ("inside-media", one & ~contains(F.col("media"), own)), ("inside-crop", one & ~contains(crop, own))]
    every = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(b, F.lit(False)).alias("broken")) for n, b in held])
    return pages.select("page", F.explode(every).alias("r")).select("page", "r.*")


def rule_summary(findings: DataFrame, key: str) -> DataFrame:
    """Of findings with status passed, violation or not-checked: counts, and the worst of them as verdict."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = findings.groupBy(key).agg(n("passed").alias("passed"), n("violation").alias("violations"), n("not-checked").alias("not_checked"))
    return out.withColumn("verdict", F.when(F.col("violations") > 0, "violation").when(F.col("not_checked") > 0, "not-checked").otherwise("passed"))


def usage(df: DataFrame, key: str, name: str, page: str, kind: str) -> DataFrame:
    """For each key and name, in ascending order, the pages and the kinds of use."""
    return df.groupBy(key, name).agg(F.sort_array(F.collect_set(page)).alias("pages"), F.sort_array(F.collect_set(kind)).alias("kinds"))


def reading_rows(df: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """Rows of reading order for boxes (keys, index, left, bottom, right, top): (keys, index, row, place).

    From the top down a box joins the current row if it overlaps the row's extent by at least half of the smaller of the
    two; the extent then grows. This fold depends on its own result, so each page is one group of a pandas function.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "index"], ascending=[False, True])
        rows, low, high, row = [], 0.0, 0.0, -1
        for b, t in zip(page["bottom"], page["top"], strict=True):
            over = min(high, t) - max(low, b)
            if row >= 0 and over >= 0 and over >= min(high - low, t - b) / 2:
                low, high = min(low, b), max(high, t)
            else:
                row, low, high = row + 1, b, t
            rows.append(row)
        page["row"] = rows
        page = page.sort_values(["row", "left", "index"])
        page["place"] = range(len(page))
        return page[[*keys, "index", "row", "place"]]

    return df.groupBy(*keys).applyInPandas(fold, schema)


def reading_columns(df: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """Columns of reading order from the right to the left, each from the top down, as of vertical writing: the rows of the
    page turned by a quarter. (keys, index, row, place), where row counts the columns."""
    turned = df.select(*keys, "index", (-F.col("top")).alias("left"), F.col("left").alias("bottom"), (-F.col("bottom")).alias("right"), F.col("right").alias("top"))
    return reading_rows(turned, keys, schema)


#: Steps of search beyond which two sequences are too different to be aligned.
WORK = 2_000_000


def _middle(a: Sequence[str], b: Sequence[str], budget: list[int]) -> tuple[int, int] | None:
    """Where the searches from both ends meet on a shortest way from a to b; null if nothing is common or the budget is spent."""
    n, m = len(a), len(b)
    half, delta = (n + m + 1) // 2, n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range(half + 1):
        for far, other, odd, step in ((ahead, back, True, 1), (back, ahead, False, -1)):
            for k in range(-d, d + 1, 2):
                budget[0] -= 1
                if budget[0] < 0:
                    return None
                low, high = far.get(k - 1, -1), far.get(k + 1, -1)
                x = high if k == -d or (k != d and low < high) else low + 1
                y = x - k
                far[k] = x
                if x > n or y > m or y < 0:
                    continue
                while x < n and y < m and (a[x] == b[y] if step > 0 else a[n - 1 - x] == b[m - 1 - y]):
                    x, y = x + 1, y + 1
                far[k] = x
                opposite = other.get(delta - k)
                if (delta % 2 != 0) == odd and opposite is not None and -(d - odd) <= delta - k <= d - odd and x + opposite >= n:
                    return (x, y) if step > 0 else (n - x, m - y)
    return None


def align(a: Sequence[str], b: Sequence[str], work: int | None = None) -> list[tuple[str, int, int]] | None:
    """Steps (keep, missing, extra) that lead from a to b over a longest common subsequence, missing before extra.

    The search goes from both ends at once and the halves are aligned by themselves, so memory grows with the
    sequences alone. work: steps of search at most; beyond that the answer is null.
    """
    budget = [work if work is not None else 1 << 62]
    kept: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            kept.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            kept.append((n, m))
        if i == n or j == m:
            continue
        if n - i == 1 or m - j == 1:
            if n - i == 1:
                at = next((k for k in range(j, m) if b[k] == a[i]), None)
                kept += [(i, at)] if at is not None else []
            else:
                at = next((k for k in range(i, n) if a[k] == b[j]), None)
                kept += [(at, j)] if at is not None else []
            continue
        met = _middle(a[i:n], b[j:m], budget)
        if met is None:
            if budget[0] < 0:
                return None
            continue
        x, y = met
        if (x, y) in ((0, 0), (n - i, m - j)):  # one insertion or deletion apart from nothing in common
            continue
        todo += [(i, i + x, j, j + y), (i + x, n, j + y, m)]
    kept.sort()
    out: list[tuple[str, int, int]] = []
    pi = pj = 0
    for i, j in [*kept, (len(a), len(b))]:
        out += [("missing", k, pj) for k in range(pi, i)] + [("extra", i, k) for k in range(pj, j)]
        if i < len(a) and j < len(b):
            out.append(("keep", i, j))
        pi, pj = i + 1, j + 1
    return out


def align_rows(df: DataFrame, key: str, a: str, b: str, work: int = WORK) -> DataFrame:
    """(key, kept, missing, extra) for pairs of texts compared word by word; null counts for pairs that take more work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [align((x or "").split(" "), (y or "").split(" "), work) for x, y in zip(batch["a"], batch["b"], strict=True)]
            count = lambda s: [None if f is None else sum(x == s for x, _, _ in f) for f in found]  # noqa: B023, E731
            yield pd.DataFrame({key: batch[key], **{n: pd.array(count(s), "Int32") for n, s in (("kept", "keep"), ("missing", "missing"), ("extra", "extra"))}})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(run, f"{key} {kind}, kept int, missing int, extra int")


