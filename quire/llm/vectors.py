"""Approximate nearest neighbours and near-duplicates of embeddings, by robust-pruned graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, written
from .components import components
from .graph import Graph

#: Vectors that balls are sought among, and members of a block.
SHARD, BLOCK = 4096, 4096
#: Bytes that the vectors of a graph's shard, or the queries of a block, may take as doubles, and shards that a small table has.
SHARD_BYTES, FEW_SHARDS = 1 << 25, 8


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not zero, without null or non-finite components."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~odd & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a cogroup with another descendant of the same table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _none(**kinds: str) -> pd.DataFrame:
    return pd.DataFrame({c: np.empty(0, k) for c, k in kinds.items()})


# ---------------------------------------------------------------------------- nearest neighbours


def fitting(dim: int) -> int:
    """Vectors of dim components that a task holds at a time, with their graph: what memory allows, whatever the table's size."""
    return max(1024, min(1 << 17, SHARD_BYTES // (8 * max(1, dim))))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", spare: int = 21, degree: int = 32, beam: int = 64) -> DataFrame:
    """The index as a table: shard, dim, vec, its ids (the `spare` smallest of equal vectors) and its links, by place in the shard.

    Equal vectors are one entry. Shards are dealt by the vector's hash and hold as many entries as memory allows; small
    tables have a few shards, so that they are built side by side. For the largest inner product, vectors, brought to
    components of 1 at most, are lifted to equal length by one more component before distances are taken.
    """
    src = columns(vectors, vec_id=F.col(id_col).cast("long"), vec=F.col(vector_col).cast("array<double>")).filter(usable(F.col("vec")) & F.col("vec_id").isNotNull()).distinct()
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    kept = src.withColumn("nth", nth).filter(F.col("nth") <= spare)  # ids beyond can't be among the nearest: as many smaller ones are as near
    entries = written(kept.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    size, top, dim = entries.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("vec", F.abs))), F.max(F.size("vec"))).first()
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / (top or 1.0)) * (x / (top or 1.0)))
    longest = entries.agg(F.max(norm)).first()[0]
    shards = max(1, -(-size // fitting(dim or 1)), min(FEW_SHARDS, -(-size // 1024)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        x = _rows(group["vec"]) / top
        lifted = np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], 1)
        g = Graph(lifted, degree, beam)
        return pd.DataFrame({"shard": group["shard"], "dim": group["dim"], "place": np.arange(len(x)), "entry": g.entry, "top": top, "extra": lifted[:, -1], "vec": group["vec"], "ids": group["ids"], "links": [r[r >= 0] for r in g.links]})

    dealt = entries.select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.size("vec").alias("dim"), "vec", "ids")
    return dealt.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, place int, entry int, top double, extra double, vec array<double>, ids array<long>, links array<int>")


def _graph(part: pd.DataFrame, lifted: np.ndarray, degree: int) -> Graph:
    links = np.full((len(part), degree), -1, np.int32)
    for k, r in enumerate(part["links"]):
        links[k, : len(r)] = r
    g = Graph(lifted, degree, links=links)
    g.entry = int(part["entry"].iloc[0])
    return g


def search(index: DataFrame, queries: DataFrame, k: int = 20, degree: int = 32, beam: int = 128, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (query_id, vec) the k nearest entries found by inner product in
    double precision, ties to the smaller id, without the query's own. A beam searches every shard; exact: every entry
    is compared. index and queries are written tables. Shards and blocks of queries are as large as memory allows."""
    shards, dim = index.agg(F.max("shard"), F.max("dim")).first()
    blocks = max(1, -(-queries.count() // fitting(dim or 1)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards or 0))).alias("shard"), F.size("vec").alias("dim"), block.alias("block"), "query_id", "vec")  # every query goes to every shard
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if part.empty or asked.empty:
            return _none(query_id="int64", vec_id="int64", score="float64")
        part = part.sort_values("place", ignore_index=True)
        x, q = _rows(part["vec"]), _rows(asked["vec"])
        most = max(beam, 2 * k)
        if exact:
            near = np.concatenate([_top(q[at : at + 256] @ x.T, most) for at in range(0, len(q), 256)])
        else:
            g = _graph(part, np.concatenate([x / part["top"].iloc[0], part["extra"].to_numpy()[:, None]], 1), degree)
            size = np.maximum(np.abs(q).max(1, keepdims=True), 1e-300)  # a query's length doesn't change what is nearest
            near, _ = g.search(np.concatenate([q / size, np.zeros((len(q), 1))], 1), most)
        ids, out = part["ids"].to_numpy(), []
        for who, v, row in zip(asked["query_id"].to_numpy(), q, near, strict=True):
            row = row[row >= 0]
            score = x[row] @ v
            order = np.argsort(-score, kind="stable")
            taken = row[order][: k + 1]
            last = score[order][min(k, len(order) - 1)]
            taken = np.concatenate([taken, row[order][k + 1 :][score[order][k + 1 :] == last]])
            at = np.concatenate([ids[r] for r in taken])
            s = np.repeat(x[taken] @ v, [len(ids[r]) for r in taken])
            s, at = s[at != who], at[at != who]
            first = np.lexsort((at, -s))[:k]
            out.append((np.full(len(first), who), at[first], s[first]))
        return pd.DataFrame({"query_id": np.concatenate([a for a, _, _ in out]), "vec_id": np.concatenate([b for _, b, _ in out]), "score": np.concatenate([c for _, _, c in out])})

    found = _fresh(held).groupBy("shard", "dim", "block").cogroup(_fresh(asked).groupBy("shard", "dim", "block")).applyInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(score: np.ndarray, most: int) -> np.ndarray:
    """The places of the largest scores of each row, and of those that tie with the last of them, -1 beyond."""
    if score.shape[1] <= most:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    least = np.partition(score, -most, axis=1)[:, -most]
    rows = [np.flatnonzero(r >= x) for r, x in zip(score, least, strict=True)]
    out = np.full((len(rows), max(map(len, rows))), -1, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def recall(index: DataFrame, queries: DataFrame, found: DataFrame, k: int = 20, size: int = 64) -> float:
    """The share of the k best entries that found has, or others as near, by comparing a bounded sample of queries, those with the lowest hashes, with every entry."""
    sample = written(queries.orderBy(F.xxhash64(F.lit(9), "query_id"), "query_id").limit(size), "sample")
    best = search(index, sample, k, exact=True).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    good = F.col("score") >= F.col("least") - F.abs("least") * 1e-12
    got = best.join(found.select("query_id", "score"), "query_id", "left").groupBy("query_id", "n").agg(F.count(F.when(good, 1)).alias("same"))
    total, same = got.agg(F.sum("n"), F.sum(F.least("same", "n"))).first()
    return same / total if total else 1.0


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = 128, target: float = 0.95) -> DataFrame:
    """search() of the rows whose id is divisible by `every` against all rows.

    Unusable vectors and rows without an id take no part. Rows that agree in id and vector count once; vectors of other
    lengths than a query's are no candidates for it. An empty table gives an empty result. A bounded sample of the
    queries is held against brute force: below the target the beam is four times as wide, and after that every
    entry is compared.
    """
    q = columns(vectors, query_id=F.col(id_col).cast("long"), vec=F.col(vector_col).cast("array<double>"))
    q = written(q.filter((F.col("query_id") % every == 0) & usable(F.col("vec"))).distinct(), "queries")
    index = written(build_index(vectors, id_col, vector_col, k + 1), "index")
    for width in (beam, 4 * beam):
        found = written(search(index, q, k, beam=width), "nearest")
        if recall(index, q, found, k) >= target:
            return found
    return search(index, q, k, exact=True)


# ---------------------------------------------------------------------------- near-duplicates

#: Centroids at most, and vectors that they are fitted on at most.
CENTROIDS, SAMPLE = 2048, 20_000
EPS = 1e-6


def centroids(nodes: DataFrame, size: int, dim: int) -> np.ndarray:
    """Unit centroids by a few rounds of spherical k-means on a bounded sample, the vectors with the lowest hashes."""
    k = max(1, min(CENTROIDS, -(-size // 1024)))
    share = min(1.0, 1.2 * SAMPLE / max(1, size))
    low = nodes.filter((F.size("vec") == dim) & (F.pmod(F.xxhash64(F.lit(5), "vec"), F.lit(1_000_000)) < int(share * 1_000_000)))
    x = np.array([r.vec for r in low.select("vec").limit(SAMPLE).collect()])
    if not len(x):
        return np.zeros((1, dim))
    c = x[np.random.default_rng(3).permutation(len(x))[:k]]
    for _ in range(6):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.maximum(length, 1e-12), c)
    return c


def _assign(c: dict[int, np.ndarray], many: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("vec"):
                x = v.values.to_numpy()
                near = np.argsort(-(c[len(x)] @ x), kind="stable")[:many]
                out.append((len(x) * CENTROIDS + near).tolist())
            yield batch.append_column("clusters", pa.array(out, pa.list_(pa.int32())))

    return assign


def _cover(ball: float):
    """Leaders whose balls, of cosine `ball`, hold every vector of a group. Vectors alone are their own leaders."""

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        x = _rows(group["vec"])
        node = group["node"].to_numpy()
        leader = np.arange(len(x))
        order = np.argsort(node, kind="stable")
        company = np.zeros(len(x), bool)
        for part in np.array_split(order, -(-len(order) // 1024)):
            company[part] = ((x[part] @ x.T) >= ball).sum(1) > 1
        open_ = order[company[order]]
        while len(open_):
            first = open_[0]
            near = x[open_] @ x[first] >= ball
            near[0] = True
            leader[open_[near]] = first
            open_ = open_[~near]
        cos = np.einsum("ij,ij->i", x, x[leader])
        return pd.DataFrame({"node": node, "leader": node[leader], "cos": np.where(leader == np.arange(len(x)), 1.0, np.minimum(cos, 1.0))})

    return cover


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = 16, beam: int = 32, target: float = 0.99) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Unusable vectors link with nothing. A null id is never a component's id unless it is alone. Equal vectors are one
    node; rows with equal ids are linked only by their vectors. An empty table gives an empty result.

    Nodes within a small ball around a leader all link with one another, so balls are never expanded into pairs.
    Leaders go to the shards of their two nearest centroids; each shard builds a robust-pruned graph, a leader's links
    from all its shards are united, and a range-expanding greedy search from each shard's medoid finds the leaders
    near enough for links. By the balls' radii two balls link wholly, not at all, or are compared member by member,
    in blocks. The found links are audited against brute force for a bounded sample; below the target the beams and
    the shards of a leader are doubled and the graphs built again, and if that ends below it too, all leaders are
    compared with one another, in blocks.
    """
    src = columns(vectors, vec_id=F.col(id_col).cast("long"), vec=F.col(vector_col).cast("array<double>")).withColumn("rid", F.monotonically_increasing_id())
    rows = written(src, "vectors")
    good = rows.filter(usable(F.col("vec")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    nodes = good.groupBy("vec").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    # Components whose squares would vanish or overflow are first brought to 1 at most.
    top = F.array_max(F.transform("vec", F.abs))
    nodes = nodes.withColumn("raw", F.col("vec")).withColumn("top", F.when(length.between(1e-140, 1e140), 1.0).otherwise(top)).withColumn("vec", F.transform("vec", lambda x: x / F.col("top")))
    nodes = written(nodes.withColumn("length", length).withColumn("vec", F.transform("vec", lambda x: x / F.col("length"))).drop("length", "top"), "nodes")
    sizes = {r.dim: r.n for r in nodes.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    middle = {d: centroids(nodes, n, d) for d, n in sizes.items()}
    theta, ball = math.acos(least), math.cos(0.44 * math.acos(least))
    near = nodes.select("node", "vec", "times").mapInArrow(_assign(middle, 1), "node long, vec array<double>, times long, clusters array<int>")
    near = written(near, "assigned")
    # Rows of a cluster, dealt into as many parts as keep each about a shard's size, even if one cluster holds everything.
    held = near.groupBy(F.col("clusters")[0].alias("cluster")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each centroid
    cuts = {r.cluster: -(-r.n // SHARD) for r in held if r.n > SHARD}
    salt = F.pmod(F.xxhash64("node"), F.coalesce(_lookup(cuts, F.col("clusters")[0]), F.lit(1))).cast("int")
    covered = near.select(F.col("clusters")[0].alias("cluster"), salt.alias("salt"), "node", "vec").groupBy("cluster", "salt").applyInPandas(_cover(ball), "node long, leader long, cos double")
    covered = written(covered, "balls")
    stats = covered.join(nodes.select("node", "times"), "node").groupBy("leader").agg(F.min("cos").alias("cos"), F.sum("times").alias("total"), F.count(F.lit(1)).alias("members"))
    leaders = written(stats.join(near.select(F.col("node").alias("leader"), "vec", "clusters"), "leader").select("leader", "vec", "total", "members", F.acos(F.least(F.col("cos"), F.lit(1.0))).alias("radius")), "leaders")
    many = 2
    while True:
        exact = beam > 512
        dealt = leaders.withColumn("clusters", F.array(F.size("vec"))) if exact else written(leaders.mapInArrow(_assign(middle, many), "leader long, vec array<double>, total long, members long, radius double, clusters array<int>"), "dealt")
        pairs = written(_leader_pairs(dealt, theta, degree, beam, exact), "pairs")
        found = _linked(pairs, leaders, covered, nodes, theta, least)
        per_node = written(found[0], "links")
        if exact or audit(nodes, per_node.join(covered, "node"), least) >= target:
            break
        many, beam, degree = many * 2, beam * 2, degree * 2
    comps = components(found[1])
    own = covered.join(comps.withColumnRenamed("node", "leader"), "leader", "left").select("node", F.coalesce("comp", "leader").alias("comp"))
    of_node = written(nodes.select("node", "raw", "least").join(own, "node").join(per_node, "node"), "placed")
    names = of_node.groupBy("comp").agg(F.min("least").alias("component_id"))
    placed = of_node.join(names, "comp").select(F.col("raw").alias("vec"), "n_links", "component_id")
    linked = good.join(placed, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col("vec"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _lookup(values: dict[int, int], key: Column) -> Column:
    """values[key], null for other keys; of a dict that the number of centroids bounds."""
    if not values:
        return F.lit(None).cast("int")
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _leader_pairs(leaders: DataFrame, theta: float, degree: int, beam: int, exact: bool = False) -> DataFrame:
    """(a, b, cos) with a < b: leaders met whose balls can hold links; exact: every leader meets all of its shard, without a graph."""
    each = leaders.select("leader", "vec", "radius", F.explode("clusters").alias("cluster"))
    held = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("vec")).alias("dim")).collect()  # a row for each centroid
    cuts = {r.cluster: -(-r.n // fitting(r.dim)) for r in held if r.n > fitting(r.dim)}
    count = F.coalesce(_lookup(cuts, F.col("cluster")), F.lit(1))
    each = written(each.withColumn("salt", F.pmod(F.xxhash64("leader"), count).cast("int")).withColumn("salts", count), "shards")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        g = Graph(_rows(group["vec"]), degree, beam)
        ids = group["leader"].to_numpy()
        return pd.DataFrame({"leader": ids, "links": [ids[r[r >= 0]] for r in g.links]})

    if exact:
        held = each.withColumn("links", F.array().cast("array<bigint>"))
    else:
        built = each.groupBy("cluster", "salt").applyInPandas(build, "leader long, links array<long>")
        united = built.groupBy("leader").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))  # a few shards a leader
        held = written(each.join(united, "leader"), "united")
    asked = held.select(F.col("cluster").alias("cluster"), "leader", "vec", "radius", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("leader"), F.col("salts")).cast("int").alias("block"))
    shards = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def find(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = _none(a="int64", b="int64", cos="float64")
        if part.empty or asked.empty:
            return none
        x, ids = _rows(part["vec"]), part["leader"].to_numpy()
        place = {i: k for k, i in enumerate(ids.tolist())}
        rows = [[p for i in r if (p := place.get(i)) is not None] for r in part["links"]]
        links = np.full((len(ids), max(1, *map(len, rows))), -1, np.int32)
        for k, r in enumerate(rows):
            links[k, : len(r)] = r
        g = Graph(x, links.shape[1], links=links)
        q, who = _rows(asked["vec"]), asked["leader"].to_numpy()
        radius = part["radius"].to_numpy()
        reach = np.minimum(theta + asked["radius"].to_numpy() + radius.max() + 1e-4, math.pi)
        out = []
        for k in range(0, len(q), 1024):
            if exact:
                met = (np.flatnonzero(r) for r in q[k : k + 1024] @ x.T >= np.cos(reach[k : k + 1024])[:, None] - 1e-5)
            else:
                met = g.within(q[k : k + 1024].astype(np.float32), (2 - 2 * np.cos(reach[k : k + 1024])).astype(np.float32) + np.float32(1e-5), beam)
            for j, near in enumerate(met, k):
                cos = x[near] @ q[j]
                ok = np.arccos(np.clip(cos, -1, 1)) <= theta + asked["radius"].iloc[j] + radius[near] + EPS
                out += [(min(who[j], ids[n]), max(who[j], ids[n]), c) for n, c in zip(near[ok].tolist(), cos[ok].tolist(), strict=True) if ids[n] != who[j]]
        return pd.DataFrame(out, columns=["a", "b", "cos"]).drop_duplicates(["a", "b"]) if out else none

    found = _fresh(shards).groupBy("cluster", "salt", "block").cogroup(_fresh(asked).groupBy("cluster", "salt", "block")).applyInPandas(find, "a long, b long, cos double")
    return found.groupBy("a", "b").agg(F.max("cos").alias("cos"))


def _linked(pairs: DataFrame, leaders: DataFrame, covered: DataFrame, nodes: DataFrame, theta: float, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) for every node, and the links (u, v) between leaders."""
    ball = leaders.select("leader", "radius", "total", "members")
    side = lambda s: ball.select(F.col("leader").alias(s), F.col("radius").alias(f"radius_{s}"), F.col("total").alias(f"total_{s}"), F.ceil(F.col("members") / BLOCK).alias(f"blocks_{s}"), F.col("members").alias(f"members_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("angle", F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))))
    alone = (F.col("radius_a") == 0) & (F.col("radius_b") == 0)
    both = both.withColumn("whole", F.when(alone, F.col("cos") >= least).otherwise(F.col("angle") + F.col("radius_a") + F.col("radius_b") <= theta - EPS))
    both = written(both.withColumn("mixed", ~F.col("whole") & ~alone), "judged")
    whole = both.filter("whole")
    gained = whole.select(F.col("a").alias("leader"), F.col("total_b").alias("n")).unionByName(whole.select(F.col("b").alias("leader"), F.col("total_a").alias("n"))).groupBy("leader").agg(F.sum("n").alias("n"))
    # Balls that link in part: members against members, a block of each side at a time.
    member = covered.join(nodes.select("node", "vec", "times"), "node").select("leader", "node", "vec", "times")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mixed = both.filter("mixed")
    wide = leaders.select("leader", blocks.alias("blocks"))
    member = member.join(wide, "leader").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = mixed.select(F.col("a").alias("a"), F.col("b").alias("b")).join(member.select(F.col("leader").alias("a"), F.col("node"), "vec", "times", F.col("block").alias("block_a")), "a")
    right = mixed.select(F.col("a").alias("a"), F.col("b").alias("b")).join(member.select(F.col("leader").alias("b"), F.col("node"), "vec", "times", F.col("block").alias("block_b")), "b")
    many = lambda s: wide.select(F.col("leader").alias(s), F.col("blocks").alias("other"))
    left = left.join(many("b"), "b").withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("other") - 1))).drop("other")
    right = right.join(many("a"), "a").withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("other") - 1))).drop("other")

    rows = left.select("a", "b", "block_a", "block_b", F.lit(0).alias("side"), "node", "vec", "times").unionByName(right.select("a", "b", "block_a", "block_b", F.lit(1).alias("side"), "node", "vec", "times"))
    # Many pairs of balls are compared in a group; one pair of blocks stays together.
    size = mixed.agg(F.sum(F.col("members_a") * F.col("blocks_b") + F.col("members_b") * F.col("blocks_a"))).first()[0] or 0
    groups = max(1, -(-size // (4 * BLOCK)))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("a", "b", "block_a", "block_b"), F.lit(groups)))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["a", "b", "block_a", "block_b", "side"], kind="stable", ignore_index=True)
        keys = group[["a", "b", "block_a", "block_b"]].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        which, node, times, vec = (group[c].to_numpy() for c in ("side", "node", "times", "vec"))
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for i, j in zip(begin, [*begin[1:], len(group)], strict=True):
            m = i + int((which[i:j] == 0).sum())
            if m in (i, j):
                continue
            near = np.stack(vec[i:m]) @ np.stack(vec[m:j]).T >= least
            n = np.concatenate([near @ times[m:j], times[i:m] @ near])
            some = np.flatnonzero(n)
            if len(some):
                out.append((keys[i, 0], keys[i, 1], node[i:j][some], n[some]))
        if not out:
            return _none(a="int64", b="int64", node="int64", n="int64")
        sizes = [len(x) for _, _, x, _ in out]
        return pd.DataFrame({"a": np.repeat([x[0] for x in out], sizes), "b": np.repeat([x[1] for x in out], sizes), "node": np.concatenate([x[2] for x in out]), "n": np.concatenate([x[3] for x in out])})

    counted = written(rows.groupBy("deal").applyInPandas(compare, "a long, b long, node long, n long"), "mixed")
    extra = counted.groupBy("node").agg(F.sum("n").alias("extra"))
    per_node = covered.select("node", "leader").join(ball.select("leader", "total"), "leader").join(gained, "leader", "left").join(extra, "node", "left")
    per_node = per_node.select("node", (F.col("total") - 1 + F.coalesce("n", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long").alias("n_links"))
    edges = whole.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(counted.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    return per_node, edges


def audit(nodes: DataFrame, per_node: DataFrame, least: float, size: int = 1024) -> float:
    """The share found of the links of a bounded sample of nodes, which is compared with every node: the mean over the
    nodes of a ball, then over balls, so that a hot group counts as any other. A node's own copies don't count."""
    rate = F.xxhash64(F.lit(9), "node")
    sample = nodes.select("node", "vec").orderBy(rate).limit(size).collect()
    if not sample:
        return 1.0
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r.vec) for r in sample}:
        own = [r for r in sample if len(r.vec) == d]
        by_dim[d] = np.array([r.node for r in own]), np.array([r.vec for r in own])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in by_dim.items()}
        for batch in batches:
            times, dim = batch.column("times").to_numpy(), np.array([len(v) for v in batch.column("vec")])
            for d, (_, q) in by_dim.items():
                own = np.flatnonzero(dim == d)
                for at in np.array_split(own, -(-len(own) // 1024)) if len(own) else []:
                    x = np.stack([batch.column("vec")[int(k)].values.to_numpy() for k in at])
                    total[d] += times[at] @ (x @ q.T >= least)
        for d, (ids, _) in by_dim.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[d], pa.int64())], ["node", "n"])

    truth = nodes.select("vec", "times").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    both = truth.join(nodes.select("node", "times"), "node").join(per_node, "node")
    want, got = F.col("n") - F.col("times"), F.col("n_links") - F.col("times") + 1
    share = both.filter(want > 0).groupBy("leader").agg(F.avg(F.least(got, want) / want).alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share
