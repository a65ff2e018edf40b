"""Estimators over counts and arrays as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """The unbiased estimate that one of k of n samples, c of them right, is right; null where the numbers cannot be."""
    n, c, k = n.cast("int"), c.cast("int"), k.cast("int")
    fine = (n >= 1) & (c >= 0) & (c <= n) & (k >= 1) & (k <= n)
    factors = F.sequence(n - c + 1, n)
    missed = F.aggregate(factors, F.lit(1.0), lambda a, i: a * (1.0 - k / i.cast("double")))
    return F.when(fine, F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1.0 - missed))


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both excluded, from the hash of the parts."""
    digits = F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


#: Below this mean a binomial draw adds up probabilities; above it, it is a corrected normal one.
SMALL_MEAN, SMALL_TERMS = 30, 110
#: The rational approximation of the normal quantile, within 0.00045.
NORMAL_TOP, NORMAL_BOTTOM = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for all its places."""
    return F.transform(F.array(value), use)[0]


def normal_quantile(u: Column) -> Column:
    def of(t: Column) -> Column:
        top, bottom = (sum((c * F.pow(t, F.lit(float(i))) for i, c in enumerate(cs)), F.lit(0.0)) for cs in (NORMAL_TOP, NORMAL_BOTTOM))
        return F.when(u < 0.5, top / bottom - t).otherwise(t - top / bottom)

    return let(F.sqrt(-2.0 * F.log(F.least(u, 1.0 - u))), of)


def binomial(n: Column, p: Column, u: Column) -> Column:
    """The u-quantile of the number of n trials that succeed with probability p: exact for a mean (of successes or of
    failures) under SMALL_MEAN, else by the normal quantile corrected for skewness. n is a whole double, p in [0, 1]."""

    def few(x: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            more = lambda term: F.struct(term.alias("term"), (state["sum"] + term).alias("sum"), j.alias("k"))
            return F.when(state["sum"] < x["u"], let(state["term"] * (x["n"] - j + 1.0) / j * (x["q"] / (1.0 - x["q"])), more)).otherwise(state)

        start = let(F.exp(x["n"] * F.log(1.0 - x["q"])), lambda none: F.struct(none.alias("term"), none.alias("sum"), F.lit(0.0).alias("k")))
        return F.aggregate(F.array(*[F.lit(float(j)) for j in range(1, SMALL_TERMS + 1)]), start, step)["k"]

    def many(x: Column, z: Column) -> Column:
        spread = F.sqrt(x["n"] * x["q"] * (1.0 - x["q"])) * z
        return F.floor(x["n"] * x["q"] + spread + (1.0 - 2.0 * x["q"]) * (z * z - 1.0) / 6.0 + 0.5).cast("double")

    def drawn(x: Column) -> Column:
        found = F.when((x["n"] <= 0) | (x["q"] <= 0), 0.0).when(x["n"] * x["q"] < SMALL_MEAN, few(x)).otherwise(let(normal_quantile(x["u"]), lambda z: many(x, z)))
        found = F.greatest(F.lit(0.0), F.least(x["n"], found))
        return let(found, lambda k: F.when(x["p"] > 0.5, x["n"] - k).otherwise(k))

    return let(F.struct(n.alias("n"), p.alias("p"), u.alias("u"), F.least(p, 1.0 - p).alias("q")), drawn)


def argmax(scores: Column) -> Column:
    """The first index of the largest score; null without a finite one, or with NaN or +infinity among them."""
    odd = F.exists(scores, lambda x: F.isnan(x) | (x == float("inf")))
    top = F.array_max(scores)
    return F.when(F.coalesce(odd, F.lit(False)) | top.isNull() | (top == float("-inf")), None).otherwise(F.array_position(scores, top) - 1)


def majority(votes: Column) -> Column:
    """The most frequent of an array's values, the earliest of several; null for an empty array."""
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-F.array_position(votes, v)).alias("first"), v.alias("vote")))
    return F.array_max(counted)["vote"]
