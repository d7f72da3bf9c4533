"""Gradient-boosted trees over yes/no features, trained on counts of feature patterns.

With k such features all training rows fall into at most 2**k patterns, so the counts of each hold everything that the
training needs, however many rows there are. The trees are applied as a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

#: (feature, (feature or None, value without, value with), the same with the first feature set)
Side = tuple[int | None, float, float]
Tree = tuple[int, Side, Side]


def _leaf(rows: Sequence[tuple[int, float, float]]) -> float:
    return sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + 1.0)


def _gain(rows: Sequence[tuple[int, float, float]]) -> float:
    return sum(g for _, g, _ in rows) ** 2 / (sum(h for _, _, h in rows) + 1.0)


def _best(rows: Sequence[tuple[int, float, float]], features: Sequence[int]) -> tuple[float, int | None]:
    found = (1e-9, None)
    for f in features:
        off, on = [r for r in rows if not r[0] >> f & 1], [r for r in rows if r[0] >> f & 1]
        if off and on and (gain := _gain(off) + _gain(on) - _gain(rows)) > found[0]:
            found = (gain, f)
    return found


def _side(rows: Sequence[tuple[int, float, float]], features: Sequence[int], rate: float) -> Side:
    _, f = _best(rows, features) if rows else (0, None)
    if f is None:
        return None, rate * _leaf(rows), rate * _leaf(rows)
    return f, rate * _leaf([r for r in rows if not r[0] >> f & 1]), rate * _leaf([r for r in rows if r[0] >> f & 1])


def value(trees: Sequence[Tree], bits: int) -> float:
    """The log odds of a pattern."""
    total = 0.0
    for f, off, on in trees:
        g, a, b = on if bits >> f & 1 else off
        total += b if g is not None and bits >> g & 1 else a
    return total


def train(counts: Mapping[int, tuple[int, int]], features: int, rounds: int = 24, rate: float = 0.4) -> list[Tree]:
    """Trees of two levels for log loss by Newton steps. counts: rows and positive rows of each pattern."""
    trees: list[Tree] = []
    for _ in range(rounds):
        rows = []
        for bits, (n, yes) in counts.items():
            p = 1 / (1 + math.exp(-value(trees, bits)))
            rows.append((bits, yes - n * p, n * p * (1 - p)))
        _, f = _best(rows, range(features))
        if f is None:
            break
        trees.append((f, *(_side([r for r in rows if r[0] >> f & 1 == on], range(features), rate) for on in (0, 1))))
    return trees


def threshold(counts: Mapping[int, tuple[int, int]], trees: Sequence[Tree], precision: float) -> float:
    """The lowest score down to which the rows of every single score have that share of positive ones; infinite if the highest hasn't."""
    by_score: dict[float, tuple[int, int]] = {}
    for bits, (n, yes) in counts.items():
        s = round(value(trees, bits), 9)
        a, b = by_score.get(s, (0, 0))
        by_score[s] = a + n, b + yes
    found = math.inf
    for s in sorted(by_score, reverse=True):
        n, yes = by_score[s]
        if yes < precision * n:
            break
        found = s
    return found


def score(trees: Sequence[Tree], bits: Column) -> Column:
    """value() as a column, rounded alike."""
    on = lambda f: bits.bitwiseAND(F.lit(1 << f)) != 0
    side = lambda s: F.lit(s[1]) if s[0] is None else F.when(on(s[0]), F.lit(s[2])).otherwise(F.lit(s[1]))
    total = F.lit(0.0)
    for f, a, b in trees:
        total = total + F.when(on(f), side(b)).otherwise(side(a))
    return F.round(total, 9)
