import numpy as np
import pytest

from quire.llm import vectors
from quire.llm.components import components

from .helpers import smallest_linked


def table(spark, x, extra=()):
    return spark.createDataFrame([(k, [float(v) for v in r], 1, "c") for k, r in enumerate(x)] + [(*r, 1, "c") for r in extra], "vec_id long, embedding array<float>, node int, vec string")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16))
    center = rng.normal(size=16)
    x[100:400] = center + rng.normal(size=(300, 16)) * 0.12  # a dense group: some of its pairs link, some don't
    x[400:440] = x[0] * np.linspace(1, 3, 40)[:, None]  # one direction
    x[440:460] = x[1]  # equal vectors
    return x.astype(np.float32).astype(np.float64)


ODD = [(9000, None), (9001, [0.0] * 16), (9002, [1.0, None] + [0.0] * 14), (9003, [float("nan")] * 16), (9004, [float("inf")] + [0.0] * 15), (9005, []), (9006, [1.0, 2.0]), (9020, [2.0, 1.0])]


def test_links_against_brute_force(spark, cloud):
    got = {r.vec_id: r for r in vectors.near_duplicates(table(spark, cloud, ODD)).collect()}
    u = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = smallest_linked(range(len(u)), zip(*[a.tolist() for a in np.nonzero(near)], strict=True))
    found = sum(min(got[k].n_links, int(near[k].sum())) for k in range(len(u)))
    assert found >= 0.99 * near.sum() and all(got[k].n_links <= near[k].sum() for k in range(len(u)))
    assert sum(got[k].component_id != comp[k] for k in range(len(u))) <= 3
    assert all(got[k].kept == (got[k].component_id == k) for k in range(len(u)))
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k, _ in ODD)


def test_search_against_brute_force(spark, cloud):
    extra = [*ODD, (20, cloud[20].tolist())]  # and a repeated row
    got = vectors.nearest(table(spark, cloud, extra)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert set(by) == {*range(0, 900, 20), 9020}
    hit = 0
    for q in range(0, 900, 20):
        s = cloud @ cloud[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        assert [x[2] for x in by[q]] == [*range(1, 21)]
        assert all(x[1] == pytest.approx(cloud[x[0]] @ cloud[q], abs=1e-12) for x in by[q])
        hit += len({x[0] for x in by[q]} & set(want.tolist()))
    assert hit >= 0.95 * 20 * 45
    assert by[9020] == [(9006, 4.0, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, node int, vec string")
    assert vectors.near_duplicates(none).count() == 0
    assert vectors.nearest(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(149, 200), (300, 300), (5, 4)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = smallest_linked({x for e in edges for x in e}, edges)
    del want[300]
    assert got == want


def test_search_over_several_shards_and_blocks(spark, cloud, monkeypatch):
    monkeypatch.setattr(vectors, "fitting", lambda dim: 16)
    monkeypatch.setattr(vectors, "FEW_SHARDS", 4)
    small = cloud[:300]
    got = {}
    for r in vectors.nearest(table(spark, small), every=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == {*range(0, 300, 7)}
    hit = 0
    for q, found in got.items():
        s = small @ small[q]
        s[q] = -np.inf
        hit += len({*found.values()} & set(np.lexsort((np.arange(300), -s))[:20].tolist()))
    assert hit >= 0.95 * 20 * len(got)


def test_a_recall_that_is_never_met_ends_in_every_entry(spark, cloud, monkeypatch):
    monkeypatch.setattr(vectors, "recall", lambda *a, **b: 0.0)
    got = {}
    for r in vectors.nearest(table(spark, cloud, [(20, cloud[20].tolist())])).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in range(0, 900, 20):
        s = cloud @ cloud[q]
        s[q] = -np.inf
        assert sorted(s[list(got[q].values())]) == pytest.approx(sorted(s)[-20:])


def test_lengths_beyond_the_squares_of_doubles(spark):
    x = np.random.default_rng(2).normal(size=(40, 8))
    for scale in (1e-200, 1e200):
        rows = [(k, (r * scale).tolist()) for k, r in enumerate(x)] + [(k + 100, (r * scale).tolist()) for k, r in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.9
        assert [got[k][0] for k in range(40)] == (2 * near.sum(1) - 1).tolist() and all(got[k + 100][1] <= k for k in range(40))
        if scale < 1:
            found = vectors.nearest(df, every=1, k=1).collect()
            assert len(found) == 80


def test_dense_vectors_of_few_dimensions(spark):
    """Every ball overlaps many others: their pairs are compared many at a time."""
    x = np.random.default_rng(1).normal(size=(1200, 4))
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_recall_counts_entries_and_not_ranks(spark):
    x = np.eye(30)[:, :30] + 0.01 * np.arange(30)[:, None]
    index = vectors.written(vectors.build_index(table(spark, x)), "index")
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(5)], "query_id long, vec array<double>")
    best = vectors.search(index, asked, 10, exact=True)
    assert vectors.recall(index, asked, best, 10) == 1.0
    assert vectors.recall(index, asked, best.filter("rank > 2"), 10) == 0.8
