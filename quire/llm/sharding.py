"""Shards of near-equal size by a minimax contiguous partition of atomic groups.

Rows with equal texts form a group that is never split. Groups are ordered by the digest of their text; the smallest
capacity is searched for with which a greedy walk over the ordered sizes needs no more shards than there are.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, written

#: Hexadecimal digits of a digest that name a block at first; groups that are fetched one by one; blocks up to which each is cut into 256.
DIGITS, FETCHED, FINE = 3, 50_000, 400
#: Rows of a shard that are numbered together.
CELL = 50_000


@dataclass(frozen=True)
class Block:
    """The groups whose digest begins with prefix; one is a group by itself."""

    prefix: str
    size: int
    groups: int


def _walk(ends: list[int], blocks: list[Block], shards: int, capacity: int, fluid: bool) -> list[int]:
    """Where a greedy walk cuts if blocks can't be cut inside, or, fluid, if those of many groups can be cut anywhere."""
    cuts = [0]
    for _ in range(shards):
        goal = cuts[-1] + capacity
        k = bisect_right(ends, goal)  # the first block that ends beyond
        if k == len(ends):
            cuts.append(ends[-1])
        elif fluid and blocks[k].groups > 1:
            cuts.append(goal)
        else:
            cuts.append(max(cuts[-1], ends[k - 1] if k else 0))
    return cuts


def _least(low: int, high: int, fits) -> int:
    """The smallest capacity that fits; high does."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def _between(ends: list[int], blocks: list[Block], shards: int, largest: int) -> tuple[list[int], list[int], bool]:
    """The lowest and the highest place of each cut of the true walk, as far as the blocks tell, and whether both walks fit the same capacity."""
    total = ends[-1]
    low, high = max(largest, -(-total // shards)), max(b.size for b in blocks) + -(-total // shards)
    least = _least(low, high, lambda c: _walk(ends, blocks, shards, c, True)[-1] == total)
    most = _least(least, high, lambda c: _walk(ends, blocks, shards, c, False)[-1] == total)
    return _walk(ends, blocks, shards, least, False), _walk(ends, blocks, shards, most, True), least == most


def minimax(groups: DataFrame, shards: int) -> list[str]:
    """The prefixes after whose groups the walk of the smallest feasible capacity cuts, in order. groups: (digest, bytes), in written rows.

    The driver holds totals of blocks of digests. They tell bounds of the capacity and of each cut; the blocks in which
    a cut may lie are then told apart further, in one job for all of them, until every cut is known.
    """
    def totals(own: DataFrame, prefix: Column) -> list[Block]:
        rows = own.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("groups"), F.max("bytes").alias("largest")).collect()
        found.append(max((r.largest for r in rows), default=0))
        return sorted((Block(r.prefix, r.size, r.groups) for r in rows), key=lambda b: b.prefix)

    found: list[int] = []
    digits = DIGITS
    blocks = totals(groups, F.substring("digest", 1, digits))  # 4097 rows at most
    largest = found[0]
    while blocks:
        ends, sofar = [], 0
        for b in blocks:
            ends.append(sofar := sofar + b.size)
        first, last, same = _between(ends, blocks, shards, largest)
        if same and first == last:
            inner = sorted({c for c in first if 0 < c < ends[-1]})
            return [blocks[bisect_right(ends, c) - 1].prefix for c in inner]
        open_ = {k for a, b in zip(first, last, strict=True) for k in range(bisect_right(ends, a), min(bisect_right(ends, b) + 1, len(ends))) if blocks[k].groups > 1}
        names = sorted(blocks[k].prefix for k in open_)
        wider = 64 if sum(blocks[k].groups for k in open_) <= FETCHED else digits + (2 if len(open_) <= FINE else 1)
        parts = totals(groups.filter(F.substring("digest", 1, digits).isin(names)), F.substring("digest", 1, wider))
        blocks = sorted([b for k, b in enumerate(blocks) if k not in open_] + parts, key=lambda b: b.prefix)
        digits = wider
    return []


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; null counts as a text of its own without bytes. The law is bytes: no other
    cut of the groups in this order has a smaller largest shard. A group larger than a shard's fair part has a shard to
    itself or nearly. Slots count from 0 in each shard without gaps. Repeated rows are told apart by nothing and take
    different slots. An empty table gives an empty result. Only the two named columns are read.
    """
    text = F.col(f"`{text_col}`")
    src = columns(docs, doc_id=id_col, size=(F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), text_crc32=F.coalesce(F.crc32(text.cast("binary")), F.lit(0)), digest=F.coalesce(F.sha2(text, 256), F.lit("")))
    rows = written(src, "rows")
    sizes = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    cut_at = minimax(written(sizes.sortWithinPartitions("digest"), "groups"), shards)
    number = sum([(F.col("digest") > (f"{p}g" if p else p)).cast("int") for p in cut_at], F.lit(0))  # g sorts after every digit; the null text's digest is empty
    # Cells deal by the id, so no group of copies, however large, meets in one of them.
    cells = rows.count() // (shards * CELL) + 1
    placed = rows.withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("offset"))
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "digest")) - 1
    numbered = placed.withColumn("inner_slot", slot).join(F.broadcast(offsets), ["shard", "cell"])  # a row for each CELL rows of docs and shard
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("inner_slot")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
