"""Colour arithmetic and document functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, functions as F

from .dates import _let

#: The D50 white of the connection space.
D50 = (0.9642, 1.0, 0.8249)


def xyz_to_lab(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)
    fx, fy, fz = (f(v / w) for v, w in zip((x, y, z), D50, strict=True))
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def lab_to_xyz(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    fy = (l + 16) / 116
    g = lambda t: F.when(t * t * t > 216 / 24389, t * t * t).otherwise((t * 116 - 16) / (24389 / 27))
    return tuple(g(t) * w for t, w in zip((fy + a / 500, fy, fy - b / 200), D50, strict=True))


def delta_e2000(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    """The CIEDE2000 difference of two colours. What is used more than once is worked out once."""
    hyp = lambda p, q: F.sqrt(p * p + q * q)
    cos = lambda t: F.cos(F.radians(t))
    hue = lambda p, q: F.when((p == 0) & (q == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(q, p)) + 360.0, F.lit(360.0)))
    power7 = lambda c: c * c * c * c * c * c * c

    def chroma(v: Column) -> Column:
        g = (F.lit(1.0) - F.sqrt(v["m"] / (v["m"] + 25.0**7))) * 0.5
        return _let(F.struct(*[v[k].alias(k) for k in ("l1", "b1", "l2", "b2")], (v["a1"] * (g + 1)).alias("p1"), (v["a2"] * (g + 1)).alias("p2")), hues)

    def hues(v: Column) -> Column:
        parts = [((v["l1"] + v["l2"]) / 2 - 50).alias("lm"), (v["l2"] - v["l1"]).alias("dl"), hyp(v["p1"], v["b1"]).alias("c1"), hyp(v["p2"], v["b2"]).alias("c2"), hue(v["p1"], v["b1"]).alias("h1"), hue(v["p2"], v["b2"]).alias("h2")]
        return _let(F.struct(*parts), means)

    def means(v: Column) -> Column:
        c1, c2, h1, h2 = (v[k] for k in ("c1", "c2", "h1", "h2"))
        grey, far = c1 * c2 == 0, F.abs(h2 - h1) > 180
        dh = F.when(grey, 0.0).when(~far, h2 - h1).when(h2 > h1, h2 - h1 - 360).otherwise(h2 - h1 + 360)
        hm = F.when(grey, h1 + h2).when(~far, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
        parts = [v["lm"].alias("lm"), v["dl"].alias("dl"), (c2 - c1).alias("dc"), (F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2)) * 2).alias("db"), ((c1 + c2) / 2).alias("cm"), hm.alias("hm")]
        return _let(F.struct(*parts), weighed)

    def weighed(v: Column) -> Column:
        lm, cm, hm = v["lm"], v["cm"], v["hm"]
        t = F.lit(1.0) - cos(hm - 30) * 0.17 + cos(hm * 2) * 0.24 + cos(hm * 3 + 6) * 0.32 - cos(hm * 4 - 63) * 0.2
        turn = -F.sin(F.radians(F.exp(-F.pow((hm - 275) / 25, 2)) * 60)) * F.sqrt(power7(cm) / (power7(cm) + 25.0**7)) * 2
        parts = [(v["dl"] / (lm * lm * 0.015 / F.sqrt(lm * lm + 20) + 1)).alias("l"), (v["dc"] / (cm * 0.045 + 1)).alias("c"), (v["db"] / (cm * t * 0.015 + 1)).alias("h"), turn.alias("r")]
        return _let(F.struct(*parts), lambda x: F.sqrt(x["l"] * x["l"] + x["c"] * x["c"] + x["h"] * x["h"] + x["r"] * x["c"] * x["h"]))

    first = [c.alias(n) for n, c in zip(("l1", "a1", "b1", "l2", "a2", "b2"), (l1, a1, b1, l2, a2, b2), strict=True)]
    return _let(F.struct(*first, power7((hyp(a1, b1) + hyp(a2, b2)) / 2).alias("m")), chroma)


def exponential(x: Column, c0: float, c1: float, n: float) -> Column:
    """c0 + x**n (c1 - c0), x clipped to 0 to 1."""
    return F.lit(c0) + F.pow(clip(x, 0.0, 1.0), F.lit(n)) * (c1 - c0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def stitching(x: Column, bounds: Sequence[float], encode: Sequence[tuple[float, float]], parts: Sequence, domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """The part whose interval holds x, of x mapped into its domain. Intervals are half open but the last."""
    x = clip(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for k in reversed(range(len(parts))):
        lo, hi = edges[k], edges[k + 1]
        e0, e1 = encode[k]
        mapped = F.lit(e0) if hi == lo else F.lit(e0) + (x - lo) * ((e1 - e0) / (hi - lo))
        own = parts[k](mapped)
        out = own if out is None else F.when(x < hi, own).otherwise(out)
    return out


def sampled(inputs: Sequence[Column], sizes: Sequence[int], samples: Sequence[float], first_fastest: bool = True) -> Column:
    """Multilinear interpolation in a grid over 0 to 1. In functions the first input varies fastest, in colour tables the last."""
    table = F.array(*[F.lit(float(s)) for s in samples])
    place = [clip(x, 0.0, 1.0) * (n - 1) for x, n in zip(inputs, sizes, strict=True)]
    low = [F.least(F.floor(p), F.lit(max(n - 2, 0))) for p, n in zip(place, sizes, strict=True)]
    part = [p - q for p, q in zip(place, low, strict=True)]
    order = range(len(sizes)) if first_fastest else reversed(range(len(sizes)))
    step, stride = 1, [0] * len(sizes)
    for k in order:
        stride[k], step = step, step * sizes[k]
    out = F.lit(0.0)
    for corner in product((0, 1), repeat=len(sizes)):
        if any(c and n == 1 for c, n in zip(corner, sizes, strict=True)):
            continue
        at = sum(((q + c) * s for q, c, s in zip(low, corner, stride, strict=True)), F.lit(0))
        weight = F.lit(1.0)
        for f, c in zip(part, corner, strict=True):
            weight = weight * (f if c else F.lit(1.0) - f)
        out = out + F.get(table, at.cast("int")) * weight
    return out


def curve(x: Column, table: Sequence[float] | None = None, gamma: float | None = None) -> Column:
    """A tone curve: identity, a power, or a table between whose entries values are interpolated."""
    x = clip(x, 0.0, 1.0)
    if table is not None and len(table) > 1:
        return sampled([x], [len(table)], table)
    return x if gamma is None else F.pow(x, F.lit(gamma))


def parametric(x: Column, kind: int, p: Sequence[float]) -> Column:
    """The five parametric curve forms, 0 to 4, with parameters g a b c d e f."""
    g, a, b, c, d, e, f = [*p, *[0.0] * (7 - len(p))]
    power = F.pow(F.greatest(x * a + b, F.lit(0.0)), F.lit(g)) if kind else F.pow(x, F.lit(g))
    if kind == 0:
        return power
    if kind in (1, 2):
        return F.when(x >= -b / a, power + (c if kind == 2 else 0.0)).otherwise(F.lit(c if kind == 2 else 0.0))
    return F.when(x >= d, power + (e if kind == 4 else 0.0)).otherwise(x * c + (f if kind == 4 else 0.0))


def promoted_grey(g: Column) -> Column:
    """Grey as process colour: black ink alone."""
    return F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0) - g)


def calibrated_rgb(a: Column, b: Column, c: Column, gamma: Sequence[float] = (1.0, 1.0, 1.0), matrix: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> tuple[Column, Column, Column]:
    """XYZ of a calibrated RGB colour: each component to its power, then the matrix, given by columns for a, b and c."""
    p = [F.pow(clip(x, 0.0, 1.0), F.lit(float(g))) for x, g in zip((a, b, c), gamma, strict=True)]
    return tuple(p[0] * float(matrix[k]) + p[1] * float(matrix[3 + k]) + p[2] * float(matrix[6 + k]) for k in range(3))


def calibrated_grey(a: Column, white: Sequence[float], gamma: float = 1.0) -> tuple[Column, Column, Column]:
    """XYZ of a calibrated grey."""
    p = F.pow(clip(a, 0.0, 1.0), F.lit(float(gamma)))
    return tuple(p * float(w) for w in white)
