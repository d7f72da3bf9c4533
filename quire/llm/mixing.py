"""Mixing sources to target weights over a tree of domains, languages and sources.

A budget of tokens is handed down the tree by weight. What a node can't use is shared out among its siblings first; only
what a whole family can't use goes on to its ancestors' siblings. Each leaf then gives the token-prefix of its seeded epochs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Bits of the seeded hash that deal a leaf's rows into buckets.
BITS = 12
#: Leaves up to which their budgets, a short row each, are broadcast.
FEW = 20_000


def split_budget(amount: Fraction, weights: Sequence[Fraction], capacity: Sequence[Fraction]) -> list[Fraction]:
    """amount shared by weight, nobody over capacity; what is over goes to the siblings that have room, by weight.

    Siblings without weight get nothing unless all others are full.
    """
    got = [Fraction(0)] * len(weights)
    for use in ([w > 0 for w in weights], [w <= 0 for w in weights]):
        open_ = {k for k, u in enumerate(use) if u and capacity[k] > 0}
        w = [x if x > 0 else Fraction(1) for x in weights]
        while open_ and amount > 0:
            total = sum(w[k] for k in open_)
            full = {k for k in open_ if amount * w[k] / total >= capacity[k] - got[k]}
            if not full:
                for k in open_:
                    got[k] += amount * w[k] / total
                return got
            for k in full:
                amount -= capacity[k] - got[k]
                got[k] = capacity[k]
            open_ -= full
    return got


def leaf_budgets(leaves: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], amount: int, epochs: int) -> dict[tuple[str, ...], int]:
    """Whole tokens for each leaf. leaves: tokens by path; weights: by path of any depth, 1 where not given."""
    out: dict[tuple[str, ...], int] = {}

    def down(prefix: tuple[str, ...], own: list[tuple[str, ...]], amount: Fraction) -> None:
        if len(own) == 1 and own[0] == prefix:
            out[prefix] = int(amount)
            return
        families: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for path in own:
            families.setdefault(path[: len(prefix) + 1], []).append(path)
        names = sorted(families)
        room = [Fraction(sum(leaves[p] for p in families[n]) * epochs) for n in names]
        for n, part in zip(names, split_budget(amount, [Fraction(weights.get(n, 1)) for n in names], room), strict=True):
            down(n, families[n], part)

    if leaves:
        down((), sorted(leaves), min(Fraction(amount), Fraction(sum(leaves.values()) * epochs)))
    return out


def tokens_of(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The tables name no domain: sources are dealt into four by their name."""
    return F.concat(F.lit("domain"), F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")) % 4)


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], float], share: float = 0.5, epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen rows of docs, as a struct `row`, with path (of the leaf), tokens, copies, the leaf's budget and what it gives of it.

    levels: the tree's levels from the root on, as columns of docs; a null counts as the name "". weights: by path, 1
    where not given. share: the budget, of all tokens. A leaf with budget b and t tokens gives b // t whole epochs, and of
    the next one the rows before the first that would exceed the rest. Each epoch has an order of its own, a seeded hash
    of its number and the id. What a leaf's last row leaves of its budget, less than that row's tokens, is not handed on;
    given tells it. Rows of no tokens belong to the epoch that they stand in. Rows with equal ids stand together, ordered
    by their text's hash; rows that agree in both are taken together or not at all. Null text has no tokens; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    path = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in levels.values()])
    text, number = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("string")
    src = docs.select(F.struct("*").alias("_row"), path.alias("_path"), number.alias("_id"), text.alias("_text"))
    hashed = lambda epoch: F.xxhash64(F.lit(seed), epoch.cast("long"), "_id")
    bucket = lambda h: F.shiftrightunsigned(h, 64 - BITS).cast("int")
    # Tokens by leaf, epoch and bucket: as many rows for each leaf at most as there are buckets and epochs.
    dealt = F.posexplode(F.array(*[bucket(hashed(F.lit(e))) for e in range(max(1, epochs))])).alias("_epoch", "_bucket")
    sums = written(src.select("_path", tokens_of(F.col("_text")).alias("t"), dealt).groupBy("_path", "_epoch", "_bucket").agg(F.sum("t").alias("t")), "sums")
    leaves = {tuple(r._path): r.t for r in sums.filter("_epoch = 0").groupBy("_path").agg(F.sum("t").alias("t")).collect()}  # a row for each source, never for each document
    budget = leaf_budgets(leaves, weights, int(Fraction(str(share)) * sum(leaves.values())), epochs)
    rows = [(list(p), b, b // leaves[p] if leaves[p] else 0, b % leaves[p] if leaves[p] else 0, leaves[p]) for p, b in budget.items()]
    plan = spark.createDataFrame(rows, "_path array<string>, _budget long, _whole long, _rest long, _tokens long")
    small = F.broadcast if len(rows) <= FEW else (lambda x: x)
    # In which bucket each leaf's last epoch ends: one row a leaf. Rows there, a 4096th of the leaf, are summed one by one.
    upto = F.sum("t").over(Window.partitionBy("_path").orderBy("_bucket"))
    last = sums.join(small(plan), "_path").filter(F.col("_epoch") == F.col("_whole")).withColumn("upto", upto).filter(F.col("upto") > F.col("_rest"))
    cut = last.groupBy("_path").agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("x"))
    ends = plan.join(cut, "_path", "left").select("_path", "_budget", "_whole", "_rest", "_tokens", F.when(F.col("_whole") >= max(1, epochs), -1).otherwise(F.coalesce("x._bucket", F.lit(1 << BITS))).alias("_cut"), F.coalesce("x.before", F.lit(0)).alias("_before"))
    ends = written(ends, "ends")
    place = lambda h: F.struct(F.shiftrightunsigned(h, 1).alias("half"), h.alias("hash"), F.xxhash64("_text").alias("same"))
    near = src.select("_path", "_id", "_text").join(small(ends), "_path").filter(bucket(hashed(F.col("_whole"))) == F.col("_cut"))
    near = near.select("_path", "_before", "_rest", place(hashed(F.col("_whole"))).alias("_place"), tokens_of(F.col("_text")).alias("t"))
    near = near.groupBy("_path", "_before", "_rest", "_place").agg(F.sum("t").alias("t"))
    sofar = F.sum("t").over(Window.partitionBy("_path").orderBy("_place")) + F.col("_before")
    fits = near.withColumn("sofar", sofar).filter(F.col("sofar") <= F.col("_rest")).groupBy("_path").agg(F.max("_place").alias("_last"), F.max("sofar").alias("_sofar"))
    ends = ends.join(fits, "_path", "left").withColumn("_given", F.col("_whole") * F.col("_tokens") + F.when(F.col("_cut").between(0, (1 << BITS) - 1), F.coalesce("_sofar", "_before")).otherwise(F.lit(0)))
    ends = written(ends.select("_path", "_budget", "_whole", "_cut", "_last", "_given"), "plan")
    at = hashed(F.col("_whole"))
    taken = (bucket(at) < F.col("_cut")) | ((bucket(at) == F.col("_cut")) & F.coalesce(place(at) <= F.col("_last"), F.lit(False)))
    out = src.join(small(ends), "_path").withColumn("_copies", F.col("_whole") + taken.cast("long")).filter("_copies > 0")
    return out.select(F.col("_row").alias("row"), F.col("_path").alias("path"), tokens_of(F.col("_text")).alias("tokens"), F.col("_copies").alias("copies"), F.col("_budget").alias("budget"), F.col("_given").alias("given"))
