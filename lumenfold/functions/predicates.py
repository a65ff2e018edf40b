"""Predicates and redaction over columns of run logs and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of keys whose values are credentials, and phrases of servers that a prompt is too long for.
SENSITIVE = ["api_key", "api-token", "api_token", "authorization", "cookie", "password", "secret", "access_token", "refresh_token"]
TOO_LONG = ["maximum context length", "max context length", "context length exceeded", "context window", "context_length"]
# Benchmarks by group; those of SINGLE are sampled once.
GROUPS = {"ALL": ["gsm8k", "math500", "hmmt25", "gpqa_diamond", "aime24", "aime25", "aime26"], "HARD": ["aime24", "aime25", "aime26", "hmmt25", "gpqa_diamond"], "QUICK": ["gsm8k", "math500"]}
SINGLE = ["gsm8k", "math500"]


def is_local_endpoint(url: Column) -> Column:
    """Whether a URL's host is this machine."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.isin("localhost", "127.0.0.1", "::1", "[::1]") | host.endswith(".localhost"), F.lit(False))


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def _any_of(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(text), p))


def is_context_overflow(message: Column) -> Column:
    return F.coalesce(_any_of(message, TOO_LONG), F.lit(False))


def is_final_status(status: Column) -> Column:
    """Whether an HTTP status is a client error that no retry can save; timeouts and rate limits may pass."""
    return F.coalesce(status.between(400, 499) & ~status.isin(408, 429), F.lit(False))


def redacted(config: Column) -> Column:
    """A map of strings with the values of credential-like keys hidden."""
    return F.transform_values(config, lambda k, v: F.when(_any_of(k, SENSITIVE), F.lit("***")).otherwise(v))


def benchmark_groups(spark: SparkSession, n_samples: int) -> DataFrame:
    """(name, benchmark, task, n_samples) of the named groups."""
    rows = [(g, b, f"math_opensource/{b}", 1 if b in SINGLE else n_samples) for g, names in GROUPS.items() for b in names]
    return spark.createDataFrame(rows, "name string, benchmark string, task string, n_samples int")
