"""Matrices, boxes, curves and paths as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def apply(m: Sequence[Column | float], x: Column, y: Column) -> tuple[Column, Column]:
    """The point under the matrix [a b c d e f]."""
    a, b, c, d, e, f = (v if isinstance(v, Column) else F.lit(float(v)) for v in m)
    return a * x + c * y + e, b * x + d * y + f


def multiply(m: Sequence, n: Sequence) -> list:
    """First m, then n."""
    return [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]


def invert(m: Sequence) -> list:
    """The matrix that undoes m; null where m is singular (for columns)."""
    det = m[0] * m[3] - m[1] * m[2]
    det = F.nullif(det, F.lit(0.0)) if isinstance(det, Column) else det
    return [m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det]


def box_bounds(m: Sequence, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """The upright box around a box under a matrix."""
    pts = [apply(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    return F.least(*[p[0] for p in pts]), F.least(*[p[1] for p in pts]), F.greatest(*[p[0] for p in pts]), F.greatest(*[p[1] for p in pts])


def bezier_bounds(p0: Column, p1: Column, p2: Column, p3: Column) -> tuple[Column, Column]:
    """Least and greatest value of one coordinate of a cubic curve: its ends and where its derivative is zero."""
    a, b, c = -p0 + p1 * 3 - p2 * 3 + p3, (p0 - p1 * 2 + p2) * 2, p1 - p0
    root = F.sqrt(F.greatest(b * b - a * c * 4, F.lit(0.0)))
    linear = F.when(F.abs(b) > 1e-12, -c / b)
    ts = [F.when(F.abs(a) > 1e-12, (-b + root) / (a * 2)).otherwise(linear), F.when(F.abs(a) > 1e-12, (-b - root) / (a * 2)).otherwise(linear)]
    real = (F.abs(a) <= 1e-12) | (b * b - a * c * 4 >= 0)
    at = lambda t: p0 * F.pow(1 - t, 3) + p1 * 3 * t * F.pow(1 - t, 2) + p2 * 3 * t * t * (1 - t) + p3 * F.pow(t, 3)
    inner = [F.coalesce(F.when(real & (t > 0) & (t < 1), at(t)), p0) for t in ts]
    return F.least(p0, p3, *inner), F.greatest(p0, p3, *inner)


def winding(points: Sequence[tuple[float, float]], x: Column, y: Column) -> Column:
    """Times that a closed polygon winds around a point."""
    total = F.lit(0)
    for (xa, ya), (xb, yb) in zip(points, [*points[1:], points[0]], strict=True):
        side = (x - xa) * (yb - ya) - (xb - xa) * (y - ya)
        total = total + F.when((y >= ya) & (y < yb) & (side < 0), 1).when((y < ya) & (y >= yb) & (side > 0), -1).otherwise(0)
    return total


def inside(points: Sequence[tuple[float, float]], x: Column, y: Column, even_odd: bool = False) -> Column:
    """Whether a point is inside under the nonzero or the even-odd rule."""
    w = winding(points, x, y)
    return F.abs(w) % 2 == 1 if even_odd else w != 0


def contains(outer: Column, inner: Column, slack: float = 0.0) -> Column:
    """Whether box [x0 y0 x1 y1] holds another."""
    return (inner[0] >= outer[0] - slack) & (inner[1] >= outer[1] - slack) & (inner[2] <= outer[2] + slack) & (inner[3] <= outer[3] + slack)


def quadratic_to_cubic(p0: Column, p1: Column, p2: Column) -> tuple[Column, Column]:
    """One coordinate of the two handles of the cubic curve that a quadratic one is."""
    return p0 + (p1 - p0) * 2 / 3, p2 + (p1 - p2) * 2 / 3


def miter(ax: Column, ay: Column, bx: Column, by: Column, width: Column, limit: float = 10.0) -> Column:
    """How far a join's point reaches from the corner between two unit directions: half the width where the limit bevels it."""
    half = F.sqrt(F.greatest((F.lit(1.0) - (ax * bx + ay * by)) / 2, F.lit(0.0)))  # the sine of half the angle between the legs, turned
    sine = F.sqrt(F.greatest(F.lit(1.0) - half * half, F.lit(0.0)))
    ratio = F.lit(1.0) / F.nullif(sine, F.lit(0.0))
    return F.when(ratio <= limit, width / 2 * ratio).otherwise(width / 2)
