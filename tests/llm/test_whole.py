"""Cases in which an operator once did less than its whole job."""

import hashlib
import random

import numpy as np

from quire.llm import linededup, ngramjoin, pii, vectors

from .helpers import shingle_set, smallest_linked

# ------------------------------------------------------------------ n-gram join


def families(count):
    """Near copies of unequal lengths, a family at a time; families share no words."""
    rng = random.Random(12)
    for f in range(count):
        size = rng.randint(20, 60)
        base = [f"w{f}x{k}" for k in range(size)]
        rows = []
        for d in range(rng.randint(4, 9)):
            own = base[rng.randint(0, 4) : size - rng.randint(0, 4)]
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = f"v{f}x{d}"
            rows.append((f * 100 + d, " ".join(own + [f"z{f}x{d}x{k}" for k in range(rng.choice([0, 0, 1, 2, 4]))])))
        rng.shuffle(rows)
        yield rows


def test_jaccard_groups_of_families_of_unequal_sizes(spark):
    every, want = [], {}
    for rows in families(1500):
        sets = [(k, shingle_set(t, 4)) for k, t in rows]
        linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 100 * len(x & y) >= 85 * len(x | y)]
        want |= smallest_linked([k for k, _ in sets], linked)
        every += rows
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_groups(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    wrong = sorted({k // 100 for k in want if got[k] != want[k]})
    assert not wrong, f"{len(wrong)} families"


# ------------------------------------------------------------------ line dedup


def by_all_pairs(docs, least=5):
    """Each text without what any earlier one deletes."""
    split = [t.split("\n") for t in docs]
    out = []
    for k, b in enumerate(split):
        gone = {p for a in split[:k] for p in linededup.common_blocks(a, b, [len(x.split()) for x in b], least)}
        out.append("\n".join(x for p, x in enumerate(b) if p not in gone))
    return out


def test_frequent_lines_are_tried_against_every_holder(spark):
    p, q = "one line of five words", "another line of six words here"
    docs = [f"{p}\n{q}", f"{q}\n{p}"] + [f"own {k} a\n{q}\n{p}\nown {k} b" for k in range(8)] + [f"{p}\nodd\n{p}", f"{p}\nodd\n{p}\nown c"]
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).select("row.*").collect()
    want = by_all_pairs(docs)
    assert want[2] == "own 0 a\nown 0 b"
    assert {r.doc_id: r.text for r in got} == dict(enumerate(want))


def test_line_dedup_is_that_of_all_pairs(spark):
    rng = random.Random(9)
    for size in (1, 3):
        pool = ["", " ", "a", "b c", "d e f", "g h i j", *[f"frequent line number {k} of them" for k in range(5)]] + [f"seldom {k}" for k in range(10)]
        pool = pool if size == 1 else pool[:8]
        docs = []
        for k in range(150):
            docs.append("\n".join(rng.choice([*pool, f"own {k}"]) for _ in range(rng.randint(1, 5 * size))))
        got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)).select("row.*").collect()
        assert {r.doc_id: r.text for r in got} == dict(enumerate(by_all_pairs(docs)))


# ------------------------------------------------------------------ near-duplicates of vectors


def test_links_across_many_centroids(spark):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = unit(rng.normal(size=(3500, 12)))
    other = unit(rng.normal(size=(3500, 12)))
    other = unit(other - (other * pairs).sum(1, keepdims=True) * pairs)
    x = np.concatenate([pairs, pairs * 0.91 + other * np.sqrt(1 - 0.91**2), unit(rng.normal(size=12) + rng.normal(size=(3000, 12)) * 0.02)])
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    true = (x @ x.T >= 0.9).sum(1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= true).all()
    own = true[:7000] > 0
    assert (found[:7000][own] / true[:7000][own]).mean() >= 0.98


def test_an_audit_that_is_never_met_ends_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "audit", lambda *a, **b: 0.0)
    x = np.random.default_rng(1).normal(size=(600, 5))
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>"), beam=512).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[k] for k in range(600)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


# ------------------------------------------------------------------ personal data


def test_phones_of_digits_far_apart(spark):
    text = "+4 - 9 - 1 - 7 - 0 - 1 - 2 - 3 - 4 - 5"
    (got,) = pii.digest(pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert got.n_phone == 1 and got.base_sha256 == hashlib.sha256(f"phone:0:{len(text)}".encode()).hexdigest()
