"""Metric values with bootstrap uncertainty."""

from __future__ import annotations

import random
from statistics import fmean, pstdev

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.estimators import binomial, let, uniform
from lumenfold.functions.predicates import is_finite

METRIC = "value double, count long, stderr double, ci_low double, ci_high double"


#: Different values whose draws are split in one row; metrics of more values are split into blocks first.
BLOCK = 1024


def _split(parts: Column, n: Column, *key: Column) -> Column:
    """How often each of an array of (value, count) is drawn in n draws: binomials of what is left, one after the other."""

    def step(state: Column, part: Column) -> Column:
        share = F.least(F.lit(1.0), part["count"] / state["rest"])
        after = lambda k: F.struct(
            (state["left"] - k).alias("left"), (state["rest"] - part["count"]).alias("rest"), (state["i"] + 1).alias("i"), F.concat(state["drawn"], F.array(k)).alias("drawn")
        )
        return let(binomial(state["left"], share, uniform(*key, state["i"])), after)

    rest = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["count"])
    start = F.struct(n.alias("left"), rest.alias("rest"), F.lit(0).alias("i"), F.array().cast("array<double>").alias("drawn"))
    return F.aggregate(parts, start, step)["drawn"]


def histograms(observations: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, block, values: array of (value, count), n): finite values, in blocks of about BLOCK different ones."""
    counted = observations.filter(is_finite(F.col(value))).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").cast("double").alias("count"))
    blocks = counted.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("__blocks"))
    both = counted.join(F.broadcast(blocks), by) if by else counted.join(F.broadcast(blocks))  # a row for each metric
    block = F.pmod(F.xxhash64("value"), F.col("__blocks")).alias("block")
    return both.groupBy(*by, block).agg(F.sort_array(F.collect_list(F.struct("value", "count"))).alias("values"), F.sum("count").alias("n"))


def resampled_once(blocks: DataFrame, by: str | None) -> DataFrame:
    """(by, parts: array of (block, count), n, __all: the metrics that it stands for) of one metric of each digest.

    The digest of a metric is made of the hashes of its blocks, whatever their order: equal counts of equal values
    give equal digests.
    """
    same = F.xxhash64("block", "values").cast("decimal(38,0)")
    whole = blocks.groupBy(*([by] if by else [])).agg(  # a row for each metric
        F.sort_array(F.collect_list(F.struct(F.col("block").alias("value"), F.col("n").alias("count")))).alias("parts"), F.sum("n").alias("n"),
        F.struct(F.sum(same).alias("a"), F.bit_xor(F.xxhash64(F.lit("x"), "block", "values")).alias("b"), F.sum("n").alias("c")).alias("__digest"),
    )
    if not by:
        return whole.withColumn("__all", F.array(F.lit(None).cast("string"))).drop("__digest")
    first = whole.groupBy("__digest").agg(F.min(by).alias(by), F.collect_list(by).alias("__all"))
    return whole.drop("__digest").join(F.broadcast(first.select(by, "__all")), by)


def bootstrap(observations: DataFrame, resamples: int = 1000, confidence: float = 0.95, seed: int = 42, value: str = "value", by: str | None = None) -> DataFrame:
    """One row (value, count, stderr, ci_low, ci_high), or one for each `by`, of observations.

    A resample draws as many observations as there are, with replacement: how often each value is drawn is a
    multinomial variable over the values' counts, which binomials split as hashes of (seed, resample, block, place) say.
    So the cost is that of resamples times different values, whatever the number of observations, which are
    counted where they are. Metrics of equal counts of equal values are resampled once. Fewer than two resamples
    give no uncertainty; values that are null or not finite are left out, and no others give a value of 0.
    """
    keys = [by] if by else []
    fine = F.when(is_finite(F.col(value)), F.col(value))
    plain = observations.groupBy(*keys).agg(F.coalesce(F.avg(fine), F.lit(0.0)).alias("value"), F.count(value).alias("count"))
    if resamples < 2:
        nothing = [F.lit(None).cast("double").alias(c) for c in ("stderr", "ci_low", "ci_high")]
        return plain.select(*keys, "value", "count", *nothing)
    blocks = histograms(observations, keys, value)
    whole = resampled_once(blocks, by)
    run = whole.select(*keys, "__all", "parts", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("__b"))
    draws = F.arrays_zip(F.col("parts.value").alias("block"), _split(F.col("parts"), F.col("n"), F.lit(seed), F.col("__b"), F.lit("blocks")).alias("k"))
    run = run.select(*keys, "__all", "n", "__b", F.explode(draws).alias("d")).select(*keys, "__all", "n", "__b", "d.block", "d.k")
    joined = run.join(blocks.select(*keys, "block", "values"), [*keys, "block"])
    drawn = joined.withColumn("__k", _split(F.col("values"), F.col("k"), F.lit(seed), F.col("__b"), F.col("block")))
    total = F.aggregate(F.arrays_zip("values", "__k"), F.lit(0.0), lambda a, x: a + x["values"]["value"] * x["__k"])
    means = drawn.select(*keys, "__all", "__b", "n", total.alias("t")).groupBy(*keys, "__all", "__b", "n").agg((F.sum("t") / F.col("n")).alias("m"))
    tail = (1 - confidence) / 2
    spread = means.groupBy(*keys, "__all").agg(F.stddev_pop("m").alias("stderr"), F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))
    spread = spread.select(F.explode("__all").alias("__of"), "stderr", "ci")
    both = plain.join(F.broadcast(spread), F.col(by) == F.col("__of"), "left") if by else plain.join(F.broadcast(spread), F.lit(True), "left")  # a row for each metric
    return both.select(*keys, "value", "count", "stderr", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def _percentile(ordered: list[float], share: float) -> float:
    at = share * (len(ordered) - 1)
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


def exact_bootstrap(observations: DataFrame, by: str = "metric", resamples: int = 1000, confidence: float = 0.95, seed: int = 42, value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """(metric, value, count, stderr, ci_low, ci_high) with draws of Python's generator over the observations in order.

    For parity with single-process runs: a metric's observations are one group in one task, so this is for
    benchmark-sized metrics; bootstrap() is for any size.
    """

    def resample(group: pd.DataFrame) -> pd.DataFrame:
        seen = group.sort_values(ordinal)[value].tolist()
        row = {by: group[by].iloc[0], "value": fmean(seen), "count": len(seen), "stderr": None, "ci_low": None, "ci_high": None}
        if resamples > 1:
            source = random.Random(seed)
            means = sorted(fmean(source.choice(seen) for _ in seen) for _ in range(resamples))
            tail = (1 - confidence) / 2
            row |= {"stderr": pstdev(means), "ci_low": _percentile(means, tail), "ci_high": _percentile(means, 1 - tail)}
        return pd.DataFrame([row])

    return observations.groupBy(by).applyInPandas(resample, f"`{by}` string, {METRIC}")


def check_counts(counts: dict[str, int]) -> None:
    """Fails unless the four counts are whole, not negative, and the last three add up to the first."""
    names = ("sample_count", "effective_count", "failed_count", "excluded_count")
    values = [counts[n] for n in names]
    if any(type(v) is not int or v < 0 for v in values) or values[0] != sum(values[1:]):
        raise ValueError(f"counts do not add up: {dict(zip(names, values))}")
