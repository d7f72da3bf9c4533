"""Line dedup by pairwise alignment.

Documents that share rare lines are aligned line by line with patience diff; blocks of lines that both have, in the same
order, are deleted from the later one. Of frequent lines, what the first holder leaves is tried against the other holders.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import drop_written, latest, scratch, small, written

#: A factor of the hashes of runs of lines, and its inverse modulo 2 ** 64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in ascending order of their first, a longest run that rises in the second too."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before[k] = at[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _numbered(lines: Sequence[int]) -> list[tuple[int, int]]:
    """Each line with the number of its occurrence."""
    seen: Counter[int] = Counter()
    out = []
    for h in lines:
        out.append((h, seen[h]))
        seen[h] += 1
    return out


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both: common ends, then lines unique in both, and again between these.

    Where no line is unique in both, equal lines count as different ones by how often they have occurred so far.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        one_a, one_b = Counter(a[i:m]), Counter(b[j:n])
        place = {h: k for k, h in enumerate(b[j:n], j) if one_b[h] == 1}
        anchors = _longest_rising([(k, place[h]) for k, h in enumerate(a[i:m], i) if one_a[h] == 1 and h in place])
        if not anchors:
            left, right = _numbered(a[i:m]), {x: k for k, x in enumerate(_numbered(b[j:n]), j)}
            anchors = _longest_rising([(k, right[x]) for k, x in enumerate(left, i) if x in right])
        if not anchors:
            continue
        for p, q in [*anchors, (m, n)]:
            todo.append((i, p, j, q))  # ends before the anchor; what is common right before it is found from the end
            if p < m:
                out.append((p, q))
            i, j = p + 1, q + 1
    out.sort()
    return out


def common_blocks(a: Sequence[int], b: Sequence[int], words: Sequence[int], least: int) -> list[int]:
    """Places in b, the later document, of aligned blocks of consecutive lines that hold the least number of words together."""
    found, block, last = [], [], (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least:
                found += block
            block = []
        block.append(j)
        last = (i, j)
    return found


def _align(least: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {n: batch.column(n).to_pylist() for n in ("a", "b", "words")}
            found = [common_blocks(a, b, w, least) for a, b, w in zip(x["a"], x["b"], x["words"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(found, pa.list_(pa.int32()))], ["rid", "gone"])

    return align


def windows(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the shortest runs of lines with the least number of words that start or end at each line.

    Whatever block of so many words two documents have in common, such runs that both have cover it.
    """
    n, total = len(hashes), np.concatenate([[0], np.cumsum(words)])
    start = np.concatenate([np.arange(n), np.searchsorted(total, total[1:] - least, "right") - 1])
    end = np.concatenate([np.searchsorted(total, total[:-1] + least, "left"), np.arange(1, n + 1)])
    fits = (start >= 0) & (end <= n)
    start, end = np.unique(np.stack([start[fits], end[fits]]), axis=1) if fits.any() else (start[:0], end[:0])
    power = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * power(FACTOR)[:n], dtype=np.uint64)])
    key = (sums[end] - sums[start]) * power(INVERSE)[start] + (end - start).astype(np.uint64) * np.uint64(FACTOR)
    return key.view(np.int64), start, end


def _left(gone: list[int] | None, n: int) -> np.ndarray:
    """The number of lines that are not gone, before each place."""
    kept = np.ones(n, np.int64)
    kept[gone or []] = 0
    return np.concatenate([[0], np.cumsum(kept)])


def _frequent_windows(least: int):
    """Those that consist of frequent and blank lines; open: not deleted whole."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"w": [], "start": [], "stop": [], "open": []}
            for h, n, often, gone in zip(*[batch.column(c) for c in ("hashes", "words", "often", "gone")], strict=True):
                h, n = h.values.to_numpy(), n.values.to_numpy()
                w, start, end = windows(h, n, least)
                other = np.concatenate([[0], np.cumsum((n > 0) & ~np.isin(h, often.values.to_numpy()))])
                ok = other[end] == other[start]
                left = _left(gone.as_py(), len(h))
                for c, x in zip(out, (w, start, end, left[end] > left[start]), strict=True):
                    out[c].append(x[ok].tolist())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("key"), *[pa.array(x, pa.list_(k)) for x, k in zip(out.values(), kinds, strict=True)]], ["rid", "key", *out])

    return frequent


def _still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for runs, gone in zip(batch.column("runs").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            left = _left(gone, max([r["stop"] for r in runs] + [k + 1 for k in gone or []]))
            out.append([r for r in runs if left[r["stop"]] > left[r["start"]]])
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("key"), pa.array(out, batch.schema.field("runs").type)], ["rid", "key", "runs"])


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of a document's lines, in which runs of lines that no other document has are all the same."""
    for batch in batches:
        found = []
        for h, n, shared in zip(*[batch.column(c) for c in ("hashes", "words", "shared")], strict=True):
            h, n = h.values.to_numpy(), n.values.to_numpy()
            own = (n > 0) & ~np.isin(h, shared.values.to_numpy())
            keep = ~own | np.concatenate([[True], ~own[:-1]])
            found.append(hashlib.blake2b(np.where(own, 0, h)[keep].tobytes() + own[keep].tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(found, pa.binary())], ["rid", "outline"])


def _deleted(pairs: DataFrame, seq: DataFrame, least_words: int) -> DataFrame:
    """(rid, gone): for each pair (first, rid) that has any, the places to delete."""
    # Inner joins, and no operator after them needs a key together: AQE may split the rows of a document that many others follow.
    both = pairs.join(seq.select(F.col("rid").alias("first"), F.col("hashes").alias("a")), "first").join(seq.select("rid", F.col("hashes").alias("b"), "words"), "rid")
    return written(both.select("rid", "a", "b", "words").mapInArrow(_align(least_words), "rid long, gone array<int>").filter(F.size("gone") > 0), "gone")


def _places(gone: DataFrame) -> DataFrame:
    return gone.select("rid", F.explode("gone").alias("k")).groupBy("rid").agg(F.collect_set("k").alias("gone"))


def _left_by_first(seq: DataFrame, shared: DataFrame, gone: DataFrame, rare: int, least_words: int) -> DataFrame:
    """gone, with what other holders than the first delete of blocks of frequent lines.

    A shortest run of lines of least_words words that is not deleted whole is tried against every earlier holder of that
    run. Of holders that differ in lines of their own alone the first stands for all: the others align as it does.
    Holders are taken in order, each time four times as many, by the documents that still have such runs.
    """
    known = shared.groupBy("rid").agg(F.collect_list("h").alias("shared"), F.collect_list(F.when(F.col("n") > rare, F.col("h"))).alias("often"))
    known = written(known.filter(F.size("often") > 0), "known")
    kind = f"rid long, key {seq.schema['key'].dataType.simpleString()}"
    asked = seq.join(known.select("rid", "often"), "rid").join(_places(gone), "rid", "left").select("rid", "key", "hashes", "words", "often", "gone")
    runs = written(asked.mapInArrow(_frequent_windows(least_words), f"{kind}, w array<long>, start array<int>, stop array<int>, open array<boolean>").filter(F.size("w") > 0), "runs")
    each = runs.select("rid", "key", F.explode(F.arrays_zip("w", "start", "stop", "open")).alias("run")).select("rid", "key", "run.*")
    span = each.groupBy("w").agg(F.min("key").alias("first"), F.max(F.when(F.col("open"), F.col("key"))).alias("last"))
    span = written(span.filter(F.col("last") > F.col("first")).select("w", "first"), "spans")
    left = each.filter("open").join(small(span), "w").filter(F.col("key") > F.col("first"))
    left = written(left.groupBy("rid", "key").agg(F.collect_list(F.struct("w", "start", "stop")).alias("runs")), "left")
    held = written(each.select("w", "rid", "key").join(small(span.select("w")), "w").distinct(), "holders")
    need = seq.join(small(held.select("rid").distinct()), "rid", "left_semi").join(known.select("rid", "shared"), "rid")
    outline = need.select("rid", "hashes", "words", "shared").mapInArrow(_outline, "rid long, outline binary")
    reps = held.join(outline, "rid").groupBy("w", "outline").agg(F.min("key").alias("key"))
    reps = written(reps.select("w", F.col("key").alias("rep"), F.row_number().over(Window.partitionBy("w").orderBy("key")).alias("nth")), "reps")
    most = reps.agg(F.max("nth")).first()[0] or 0
    low, high, old = 1, 4, []
    while low <= most and left.limit(1).count():
        tried = left.select("rid", "key", F.explode("runs.w").alias("w")).distinct().join(reps.filter(F.col("nth").between(low, high)), "w")
        pairs = tried.filter(F.col("rep") < F.col("key")).select(F.col("rep.rid").alias("first"), "rid").distinct()
        more = _deleted(pairs, seq, least_words)
        gone = gone.unionByName(more)
        still = left.join(_places(more), "rid", "left").select("rid", "key", "runs", "gone").mapInArrow(_still_open, left.schema)
        left = written(still.filter(F.size("runs") > 0), "left")
        drop_written(seq.sparkSession, old)
        low, high, old = high + 1, 4 * high, latest()
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5, rare: int = 5) -> DataFrame:
    """The rows of docs, as a struct `row`, the text without the blocks that an earlier document has; and lines, deleted.

    Earlier is the lower id (null first), of equal ids the text with the lower hash; of rows that agree in both, it makes
    no difference which one keeps its text. A line that at most
    `rare` documents hold pairs each with every earlier one; any more frequent line pairs its holders with the first of
    them, and what that leaves of its blocks is tried against the others: the result is that of all pairs, while pairs
    grow with the lines wherever the first holder has the block in the same order. Blocks of fewer than
    least_words words stay; blank lines count no words. Null text stays null; a text that is wholly a copy becomes
    empty; the row stays. An empty table gives an empty result.
    """
    names = docs.columns
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("rid")), "docs")
    text = F.col(f"row.`{text_col}`")
    lines = F.split(text, "\n", -1)
    with scratch(docs.sparkSession, keep=1):
        gone = _gone(rows, id_col, text, rare, least_words)
    out = rows.join(gone.hint("shuffle_hash"), "rid", "left")
    none = F.array().cast("array<int>")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    row = F.struct(*[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])
    return out.select(row.alias("row"), F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("lines"), F.size(F.coalesce("gone", none)).alias("deleted"))


def _gone(rows: DataFrame, id_col: str, text: Column, rare: int, least_words: int) -> DataFrame:
    """(rid, gone): the places of the lines to delete, as the table written last."""
    lines = F.split(text, "\n", -1)
    seq = rows.select("rid", F.struct(F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(text).alias("same"), "rid").alias("key"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"), F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("words")).filter("hashes is not null")
    seq = written(seq, "lines")
    held = seq.select("rid", "key", F.explode(F.array_distinct(F.filter("hashes", lambda x, i: F.element_at("words", i + 1) > 0))).alias("h"))
    spread = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).filter("n > 1")
    shared = held.join(spread, "h")
    few = shared.filter(F.col("n") <= rare).select("h", "rid", "key")
    near = few.alias("a").join(few.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.rid").alias("first"), F.col("b.rid").alias("rid"))
    far = shared.filter((F.col("n") > rare) & (F.col("first") < F.col("key"))).select(F.col("first.rid").alias("first"), "rid")
    pairs = near.unionByName(far).distinct()
    return written(_places(_left_by_first(seq, shared, _deleted(pairs, seq, least_words), rare, least_words)), "places")
