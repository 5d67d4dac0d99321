"""Special functions and the tests that stand on them, as Column expressions: no Python worker takes part.

Continued fractions and series run a fixed number of steps by ``aggregate`` over a
sequence, which the engine evaluates row by row in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 300
TINY = 1e-300

# Lanczos' approximation with g = 7 and nine terms.
_G = 7
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0; smaller x go up by gamma(x + 1) = x gamma(x)."""

    def upper(z: Column) -> Column:  # gamma(z + 1), z >= 0
        total = F.lit(_LANCZOS[0])
        for k in range(1, len(_LANCZOS)):
            total = total + F.lit(_LANCZOS[k]) / (z + float(k))
        t = z + (_G + 0.5)
        return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)

    return let(x.cast("double"), lambda v: upper(v) - F.log(v))


def _kept(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _beta_fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def once(at: Column, term: Column) -> Column:
            d, c = 1 / _kept(1 + term * at["d"]), _kept(1 + term / at["c"])
            return let(F.struct(c.alias("c"), d.alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (at["h"] * n["c"] * n["d"]).alias("h")))

        return let(once(acc, even), lambda half: once(half, odd))

    first = 1 / _kept(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, m: step(acc, m.cast("double")), lambda acc: acc["h"])


def beta_regularised(a: Column, b: Column, x: Column, steps: int = STEPS) -> Column:
    """I_x(a, b) for a, b > 0 and 0 <= x <= 1; null where an argument is missing or outside."""
    p = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x"))

    def value(v: Column) -> Column:
        swap = v["x"] > (v["a"] + 1) / (v["a"] + v["b"] + 2)
        s = F.struct(F.when(swap, v["b"]).otherwise(v["a"]).alias("a"), F.when(swap, v["a"]).otherwise(v["b"]).alias("b"), F.when(swap, 1 - v["x"]).otherwise(v["x"]).alias("x"))

        def front(u: Column) -> Column:
            ln = log_gamma(u["a"] + u["b"]) - log_gamma(u["a"]) - log_gamma(u["b"]) + u["a"] * F.log(u["x"]) + u["b"] * F.log1p(-u["x"])
            return F.exp(ln) * _beta_fraction(u["a"], u["b"], u["x"], steps) / u["a"]

        inside = let(s, front)
        return F.when((v["a"] <= 0) | (v["b"] <= 0) | (v["x"] < 0) | (v["x"] > 1), None).when(v["x"] == 0, 0.0).when(v["x"] == 1, 1.0).when(swap, 1 - inside).otherwise(inside)

    return let(p, value)


def gamma_upper(a: Column, x: Column, steps: int = STEPS) -> Column:
    """Q(a, x), the regularised upper incomplete gamma function, for a > 0 and x >= 0; a series below a + 1, a continued fraction above."""
    p = F.struct(a.cast("double").alias("a"), x.cast("double").alias("x"))

    def value(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        one = 1 / a
        series = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(one.alias("term"), one.alias("sum")), lambda acc, m: let(acc["term"] * x / (a + m), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum"))), lambda acc: acc["sum"])
        b = x + 1 - a

        def step(acc: Column, m: Column) -> Column:
            term, at = -m * (m - a), b + 2 * m
            d, c = 1 / _kept(term * acc["d"] + at), _kept(at + term / acc["c"])
            return let(F.struct(c.alias("c"), d.alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (acc["h"] * n["c"] * n["d"]).alias("h")))

        first = 1 / _kept(b)
        fraction = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(1 / TINY).alias("c"), first.alias("d"), first.alias("h")), lambda acc, m: step(acc, m.cast("double")), lambda acc: acc["h"])
        return F.when((a <= 0) | (x < 0), None).when(x == 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return let(p, value)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return beta_regularised(df / 2, F.lit(0.5), df / (df + t * t))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    """Upper p-value of Fisher's F."""
    return beta_regularised(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_p_value(x: Column, df: Column) -> Column:
    return gamma_upper(df / 2, x / 2)


def normal_p_value(z: Column) -> Column:
    """Two-sided p-value of the standard normal distribution."""
    return gamma_upper(F.lit(0.5), z * z / 2)
