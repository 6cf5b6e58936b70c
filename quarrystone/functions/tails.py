"""Tails of distributions as column expressions, without Python in the plan.

Probabilities of large counts come from deviances and the error of Stirling's
formula, not from differences of large logarithms, so that they are right to
about 1e-13 of themselves; sums run over an ``aggregate`` by ratios of
neighbouring terms, the largest first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
#: Error of Stirling's formula for n! up to 15, by its definition; beyond, by its series.
_SMALL = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - _HALF_LOG_2PI for n in range(1, 16)]
#: Coefficients of that series in 1 / n: Bernoulli numbers B_2k / (2k (2k - 1)).
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _series(n: Column) -> Column:
    """The error of Stirling's formula for the gamma function at ``n`` (10 or more), by its series."""
    out, square = F.lit(_SERIES[-1]), n * n
    for s in reversed(_SERIES[:-1]):
        out = F.lit(s) + out / square
    return out / n


def log_gamma(x: Column | str) -> Column:
    """The logarithm of the gamma function of a positive number: Stirling's series, from 10 up; smaller ones are moved up by 10."""

    def large(y: Column) -> Column:
        return (y - 0.5) * F.log(y) - y + _HALF_LOG_2PI + _series(y)

    def value(v: Column) -> Column:
        product = v
        for k in range(1, 10):
            product = product * (v + k)
        return F.when(v >= 10, large(v)).otherwise(large(v + 10) - F.log(product))

    return let(_column(x).cast("double"), value)


def _stirling_error(n: Column) -> Column:
    return F.when(n < len(_SMALL), F.element_at(F.array(*map(F.lit, _SMALL)), n.cast("int") + 1)).otherwise(_series(n))


def _deviance(x: Column, m: Column) -> Column:
    """x log(x / m) + m - x, also where x and m are close."""

    def near(v: Column) -> Column:
        w, out = v * v, F.lit(1 / 23)
        for j in range(10, 0, -1):
            out = F.lit(1 / (2 * j + 1)) + out * w
        return (x - m) * v + 2 * x * v * w * out

    return F.when(x == 0, m).when(F.abs(x - m) < 0.1 * (x + m), let((x - m) / (x + m), near)).otherwise(x * F.log(x / m) + m - x)


def log_hypergeometric(x: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """The log probability of x marked ones among ``drawn`` of ``population``,
    for a possible x: of three binomials, x of the marked, the rest of the
    others, less all drawn of the population, each with the chance to be drawn.

    Each formula stands once, in a ``transform`` over what it is needed for.
    """
    pair = lambda x, n: F.struct(x.alias("x"), n.alias("n"))

    def binomial(s: Column, p: Column, q: Column) -> Column:
        x, n = s["x"], s["n"]
        errors = F.transform(F.array(n, x, n - x), _stirling_error)
        deviances = F.transform(F.array(pair(x, n * p), pair(n - x, n * q)), lambda d: _deviance(d["x"], d["n"]))
        inner = F.when((x > 0) & (x < n), _HALF_LOG_2PI + 0.5 * (F.log(x) + F.log1p(-x / n))).otherwise(0.0)
        return F.aggregate(errors, 2 * F.get(errors, F.lit(0)), lambda acc, e: acc - e) - F.aggregate(deviances, F.lit(0.0), lambda acc, d: acc + d) - inner

    def value(s: Column) -> Column:
        x, n, k, d = (s[c] for c in "xnkd")
        logs = F.transform(F.array(pair(x, k), pair(d - x, n - k), pair(d, n)), lambda b: binomial(b, d / n, (n - d) / n))
        return F.when((d == 0) | (d == n), F.lit(0.0)).otherwise(F.aggregate(logs, -2 * F.element_at(logs, 3), lambda acc, v: acc + v))

    numbers = {"x": x, "n": population, "k": marked, "d": drawn}
    return let(F.struct(*[c.cast("double").alias(name) for name, c in numbers.items()]), value)


def _sum_of_ratios(first: Column, steps: Column, ratio: Callable[[Column], Column]) -> Column:
    """``first`` and all terms after it, each by its ratio to the one before."""
    state = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * ratio(i.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(steps, state, step)["total"]


def _range(a: Column, b: Column, way: int = 1) -> Column:
    return F.when(a <= b if way > 0 else a >= b, F.sequence(a, b, F.lit(way).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric_tail(population: Column | str, marked: Column | str, drawn: Column | str, hits: Column | str) -> Column:
    """P(X >= hits) of ``drawn`` from ``population`` with ``marked``."""

    def value(s: Column) -> Column:
        n, k, d, x = (s[c] for c in "nkdx")
        low, high = F.greatest(F.lit(0).cast("bigint"), d - (n - k)), F.least(k, d)
        mode = F.floor((d + 1) * (k + 1) / (n + 2))

        def summed(first: Column) -> Column:
            up = _sum_of_ratios(first, _range(x, high - 1), lambda i: (k - i) * (d - i) / ((i + 1) * (n - k - d + i + 1)))
            down = _sum_of_ratios(first, _range(x - 1, low + 1, -1), lambda i: i * (n - k - d + i) / ((k - i + 1) * (d - i + 1)))
            return F.when(x > mode, F.least(F.lit(1.0), up)).otherwise(F.greatest(F.lit(0.0), 1.0 - down))

        # From the mode up the terms at and beyond the hits, below it those short of them: the first is the largest.
        start = F.when(x > mode, x).otherwise(x - 1)
        some = let(F.exp(log_hypergeometric(start, n, k, d)), summed)
        return F.when(high < low, 0.0).when(x <= low, 1.0).when(x > high, 0.0).otherwise(some)

    numbers = {"n": population, "k": marked, "d": drawn, "x": hits}
    return let(F.struct(*[_column(c).cast("bigint").alias(name) for name, c in numbers.items()]), value)


def two_sided_normal(z: Column | str) -> Column:
    """P(|Z| >= |z|): a power series below 3, a continued fraction from there on."""

    def value(v: Column) -> Column:
        density = F.exp(-0.5 * v * v) / math.sqrt(2 * math.pi)
        series = _sum_of_ratios(v, F.sequence(F.lit(1), F.lit(60)), lambda k: v * v / (2 * k + 1))
        fraction = F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, k: k / (v + acc))
        return F.when(F.isnan(v), v).when(v < 3, 1.0 - 2 * density * series).otherwise(2 * density / (v + fraction))

    return let(F.abs(_column(z).cast("double")), lambda v: F.when(v.isNotNull(), value(v)))


def _gamma_ratio(a: Column) -> Column:
    """log(gamma(a + 1/2) / gamma(a)), without the difference of large numbers."""
    return F.when(a >= 10, 0.5 * F.log(a) + a * F.log1p(0.5 / a) - 0.5 + _series(a + 0.5) - _series(a)).otherwise(log_gamma(a + 0.5) - log_gamma(a))


def _beta_fraction(a: Column, b: Column, x: Column, steps: int = 400) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz."""
    tiny = lambda v: F.when(F.abs(v) > 1e-30, v).otherwise(F.lit(1e-30))
    first = 1 / tiny(1 - (a + b) * x / (a + 1))
    state = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(acc: Column, factor: Column) -> Column:
        new = let(F.struct((1 / tiny(1 + factor * acc["d"])).alias("d"), tiny(1 + factor / acc["c"]).alias("c")), lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (acc["h"] * s["c"] * s["d"]).alias("h")))
        return new

    def step(acc: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(half(acc, even), lambda s: half(s, odd))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)["h"]


def two_sided_student(t: Column | str, df: Column | str) -> Column:
    """P(|T| >= |t|) of Student's t: the incomplete beta function of df / (df + t t)."""

    def value(s: Column) -> Column:
        t, df = s["t"], s["df"]
        a, b, x, y = df / 2, F.lit(0.5), df / (df + t * t), t * t / (df + t * t)
        # log1p where x is near 1: a large power of it.
        front = F.exp(_gamma_ratio(a) - 0.5 * math.log(math.pi) + a * F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(x)) + 0.5 * F.log(y))
        tail = F.when(x < (a + 1) / (a + 2.5), front * _beta_fraction(a, b, x) / a).otherwise(1 - 2 * front * _beta_fraction(b, a, y))
        return F.when(F.isnan(t) | F.isnan(df) | (df <= 0) | t.isNull() | df.isNull(), float("nan")).when(t == float("inf"), 0.0).when(t == 0, 1.0).otherwise(F.least(F.lit(1.0), tail))

    return let(F.struct(F.abs(_column(t).cast("double")).alias("t"), _column(df).cast("double").alias("df")), value)


#: The logarithm of a double that is not 0 is above this.
_LEAST_LOG = -746.0


def _furthest(near: Column, far: Column, good: Callable[[Column], Column]) -> Column:
    """The last number from ``near`` on to ``far`` that is ``good``, by halving:
    ``near`` is, and past the first that is not there are no more."""

    def half(acc: Column, _: Column) -> Column:
        def moved(mid: Column) -> Column:
            return let(good(mid), lambda g: F.struct(F.when(g, mid).otherwise(acc["good"]).alias("good"), F.when(g, acc["bad"]).otherwise(mid).alias("bad")))

        return let((acc["good"] + acc["bad"]).cast("bigint"), lambda both: let(F.floor(both / 2), lambda mid: F.when(F.abs(acc["bad"] - acc["good"]) > 1, moved(mid)).otherwise(acc)))

    past = far + F.when(far < near, -1).otherwise(1)
    state = F.struct(near.cast("bigint").alias("good"), past.cast("bigint").alias("bad"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), state, half)["good"]


def fisher_exact(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """Two-sided p and the conditional maximum-likelihood odds ratio of 2 x 2 tables, as struct of ``p_value`` and ``odds_ratio``.

    The ratio is where the mean of the noncentral distribution meets the first
    cell, found by halving; 0 or infinite at the ends of the cell's range.

    Log probabilities are concave in the cell, so those that are not 0 as
    doubles are neighbours, some 40 standard deviations either way however
    large the table; no others are worked out, as they would add nothing.
    """

    def value(s: Column) -> Column:
        a, b, c, d = (s[x] for x in "abcd")
        m, n, k = a + b, c + d, a + c
        low, high = F.greatest(F.lit(0).cast("bigint"), k - n), F.least(k, m)
        mode = F.least(high, F.greatest(low, F.floor((k + 1) * (m + 1) / (m + n + 2))))
        return let(F.struct(*[x.cast("bigint").alias(name) for name, x in {"a": a, "m": m, "n": n, "k": k, "low": low, "high": high, "mode": mode}.items()]), solved)

    def solved(s: Column) -> Column:
        a, m, n, k, low, high, mode = (s[x] for x in ("a", "m", "n", "k", "low", "high", "mode"))
        log = lambda i: log_hypergeometric(i, m + n, m, k)
        # The logarithm of the step from a place to the next; null beyond the ends.
        step = lambda i: F.log((m - i).cast("double")) + F.log((k - i).cast("double")) - F.log((i + 1).cast("double")) - F.log((n - k + i + 1).cast("double"))

        def spans(seen: Column) -> Column:
            """The logarithms round the mode as they are, and round the cell as tilted by the log odds at which it is the
            mode and its neighbours are as likely as each other. Both by one expression, for the plan's size."""
            part = lambda middle, less, tilt: F.struct(middle.alias("middle"), less.alias("less"), tilt.alias("tilt"))
            parts = F.array(part(mode, F.lit(0.0), F.lit(0.0)), part(a, seen, -(step(a - 1) + step(a)) / 2))

            def terms(x: Column) -> Column:
                at = lambda i: log(i) - x["less"] + (i - a) * x["tilt"]
                ends = F.transform(F.array(low, high), lambda end: _furthest(x["middle"], end, lambda i: at(i) > _LEAST_LOG))
                places = let(ends, lambda e: F.sequence(F.get(e, F.lit(0)), F.get(e, F.lit(1))))
                return F.struct(x["tilt"].alias("tilt"), F.transform(places, lambda i: F.struct((i - a).cast("double").alias("i"), at(i).alias("log"))).alias("terms"))

            return let(F.transform(parts, terms), lambda both: results(F.get(both, F.lit(0))["terms"], F.get(both, F.lit(1)), seen))

        def results(plain: Column, tilted: Column, seen: Column) -> Column:
            p = let(seen + math.log1p(1e-7), lambda most: F.aggregate(plain, F.lit(0.0), lambda acc, v: acc + F.when(v["log"] <= most, F.exp(v["log"])).otherwise(0.0)))

            def half(acc: Column, _: Column) -> Column:
                def moved(mid: Column) -> Column:
                    short = F.aggregate(tilted["terms"], F.lit(0.0), lambda x, v: x + v["i"] * F.exp(v["log"] + v["i"] * mid)) < 0
                    return let(short, lambda under: F.struct(F.when(under, mid).otherwise(acc["left"]).alias("left"), F.when(under, acc["right"]).otherwise(mid).alias("right")))

                return let((acc["left"] + acc["right"]) / 2, moved)

            # The mean meets the cell within a few units of the tilt.
            ends = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-5.0).alias("left"), F.lit(5.0).alias("right")), half)
            inside = let(ends, lambda e: F.exp(tilted["tilt"] + (e["left"] + e["right"]) / 2))
            ratio = F.when(a == low, 0.0).when(a == high, float("inf")).otherwise(inside)
            return F.struct(F.least(F.lit(1.0), p).alias("p_value"), ratio.alias("odds_ratio"))

        return let(log(a), spans)

    cells = {"a": a, "b": b, "c": c, "d": d}
    return let(F.struct(*[_column(x).cast("bigint").alias(name) for name, x in cells.items()]), value)
