"""Exact lengths in points, as reduced fractions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Points of a unit, as numerator and denominator.
UNITS = {"pt": (1, 1), "inch": (72, 1), "mm": (360, 127)}


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, a step for each number of a sequence that is long enough for 64 bits."""
    step = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return step["a"]


def reduced(num: Column, den: Column) -> Column:
    num, den = num.cast("long"), den.cast("long")
    g = _gcd(num, den)
    return F.struct(_quotient(num, g).alias("num"), _quotient(den, g).alias("den"))


def _quotient(a: Column, b: Column) -> Column:
    return ((a - a % b) / b).cast("long")


def length(value: Column, unit: str) -> Column:
    """A whole number of units."""
    n, d = UNITS[unit]
    return reduced(value * n, F.lit(d))


def add(a: Column, b: Column) -> Column:
    return reduced(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def multiply(a: Column, k: Column) -> Column:
    return reduced(a["num"] * k, a["den"])


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum((a["num"] * b["den"] - b["num"] * a["den"]).cast("double")).cast("int")
