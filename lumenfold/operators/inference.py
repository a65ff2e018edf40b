"""Generation through a client inside executors: retries, seeds, and choices by log-probability."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import choice_continuations, choice_tokens, once, strip


class Client(Protocol):
    """What a model server is to the engine; made once in each task from a factory."""

    def generate(self, prompt: str, system: str | None, seed: int) -> str | None: ...

    def alternatives(self, prompt: str) -> dict[str, float]: ...

    def echo(self, text: str) -> tuple[list[int], list[str], list[float | None]]: ...


class FatalRequest(Exception):
    """A request that no retry can save."""


class Overloaded(Exception):
    """A request that failed and may do better later: a cut connection, a rate limit, a fault of the server."""


class ContextOverflow(Exception):
    """A prompt too long for the model; its answer is null."""


def backoff(attempt: int, jitter: float = 0.0) -> float:
    """Seconds before the next attempt (from 0): doubling from two, a minute at most, plus jitter."""
    return min(60.0, 2.0 ** (attempt + 1)) + jitter


def retryable(status: int | None) -> bool:
    """Client errors are final, but for timeouts and rate limits; all else may pass."""
    return status is None or not 400 <= status < 500 or status in (408, 429)


#: Mistakes of a program, which no retry mends.
MISTAKES = (TypeError, KeyError, AttributeError, NameError, AssertionError)


def with_retry(call: Callable[[], str | None], attempts: int, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """call()'s answer, or null for a prompt that is too long; final errors and mistakes of the program are raised at once."""
    for attempt in range(attempts):
        try:
            return call()
        except ContextOverflow:
            return None
        except (FatalRequest, *MISTAKES):
            raise
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(backoff(attempt, random.uniform(0, 5)))
    raise ValueError("attempts must be 1 at least")


def generate(requests: DataFrame, factory: Callable[[], Client], attempts: int = 3, in_flight: int = 8, system: str | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests (prompt, seed, ...) with gen and error. A task keeps `in_flight` requests open; a failed request has an
    error and no generation, so a later run makes it again."""
    names = requests.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()

        def one(prompt: str, seed: int) -> tuple[str | None, str | None]:
            try:
                return with_retry(lambda: client.generate(prompt, system, seed), attempts, sleep), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                out = frame[names].copy()
                answers = list(pool.map(one, frame["prompt"], frame["seed"]))
                out["gen"], out["error"] = zip(*answers) if answers else ((), ())
                yield out

    return requests.mapInPandas(run, f"{schema}, gen string, error string")


#: What a client says of each choice: spellings of a next token, or the tokens of an echoed text.
_SAID = {"first_token": "map<string,double>", "continuation": "array<struct<offsets: array<bigint>, tokens: array<string>, logprobs: array<double>>>"}


def score_choices(requests: DataFrame, factory: Callable[[], Client], mode: str, attempts: int = 3, in_flight: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests (prompt, choices, gold, ...) with choice_tokens, logprobs (null: not among the alternatives), scoring_mode and error.

    first_token: client.alternatives(prompt) gives the log-probabilities of next tokens. continuation: client.echo(text)
    gives (offsets, tokens, logprobs) of a text, once for each choice. Choices, gold and scores that do not fit, and
    requests that fail, have an error. The client's answers are read in the JVM.
    """
    if mode not in _SAID:
        raise ValueError(f"mode must be one of {tuple(_SAID)}")
    given = F.col("choice_tokens") if "choice_tokens" in requests.columns else F.lit(None).cast("array<string>")
    tokens = choice_tokens(given, F.col("choices"))
    if mode == "continuation":
        tokens = choice_continuations(F.col("prompt"), tokens)
    asked = requests.withColumn("choice_tokens", tokens)
    names = asked.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()

        def one(prompt: str, tokens) -> tuple[object, str | None]:
            try:
                if mode == "first_token":
                    return with_retry(lambda: client.alternatives(prompt), attempts, sleep), None
                texts = [prompt + t for t in (tokens if tokens is not None else ())]
                said = [with_retry(lambda t=t: client.echo(t), attempts, sleep) for t in texts]
                if None in said:
                    return None, "ContextOverflow: a prompt with a choice is too long"
                return [dict(zip(("offsets", "tokens", "logprobs"), x)) for x in said], None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                out = frame[names].copy()
                answers = list(pool.map(one, frame["prompt"], frame["choice_tokens"]))
                out["__said"], out["__error"] = zip(*answers) if answers else ((), ())
                yield out

    said = asked.mapInPandas(run, f"{schema}, __said {_SAID[mode]}, __error string")
    if mode == "first_token":
        scores = spelled_logprobs(F.col("__said"), F.col("choice_tokens"))
    else:
        pairs = F.arrays_zip(F.col("__said").alias("s"), F.col("choice_tokens").alias("t"))
        scores = F.transform(pairs, lambda x: aligned_logprob(x["s"]["offsets"], x["s"]["tokens"], x["s"]["logprobs"], F.col("prompt"), x["t"]))
    said = once(said, {"__scores": scores})
    scores = F.col("__scores")
    scored = said.withColumn("logprobs", F.transform(scores, lambda x: F.when(x != float("-inf"), x)))
    least = F.forall if mode == "continuation" else F.exists  # every continuation must align
    n = F.size("choices")
    fault = (
        F.when((F.coalesce(n, F.lit(0)) < 1) | F.coalesce(F.exists("choices", lambda c: F.coalesce(strip(c), F.lit("")) == ""), F.lit(False)), "choices must be texts that are not blank")
        .when(~F.coalesce((F.col("gold") >= 0) & (F.col("gold") < n), F.lit(False)), "gold is outside the choices")
        .when(F.coalesce(F.size("choice_tokens"), F.lit(-1)) != n, "not a token for each choice")
        .when(F.col("__error").isNotNull(), F.col("__error"))
        .when(F.coalesce(F.exists(scores, lambda x: F.isnan(x) | (x == float("inf"))), F.lit(False)), "a log-probability is NaN or infinite")
        .when(~F.coalesce(least(scores, lambda x: x.isNotNull()) & F.exists("logprobs", lambda x: x.isNotNull()), F.lit(False)), "no log-probability of a choice, or tokens that do not spell it")
    )
    return scored.withColumns({"scoring_mode": F.lit(mode), "error": fault}).drop("__said", "__scores", "__error")


def spelled_logprobs(alternatives: Column, tokens: Column) -> Column:
    """For each choice token the best log-probability among a map's spellings of it (case, a space before), else null."""
    cases = lambda t: F.array(t, F.upper(t), F.lower(t))
    spellings = lambda t: F.concat(cases(t), F.transform(cases(t), lambda s: F.concat(F.lit(" "), s)))
    return F.transform(tokens, lambda t: F.array_max(F.transform(spellings(t), lambda s: F.try_element_at(alternatives, s))))


def aligned_logprob(offsets: Column, tokens: Column, logprobs: Column, context: Column, continuation: Column) -> Column:
    """The sum of the log-probabilities of the tokens that spell the continuation after the context; null if none do.

    Servers count offsets in characters or in UTF-8 bytes: characters are tried first. The tokens that begin inside the
    continuation must follow one another without a gap from its begin to its end, have log-probabilities, and be its text.
    """
    items = F.arrays_zip(offsets.alias("o"), tokens.alias("t"), logprobs.alias("p"))

    def counted(length: Callable[[Column], Column]) -> Column:
        begin = length(context).cast("long")
        end = begin + length(continuation)
        inside = F.filter(items, lambda x: (x["o"] >= begin) & (x["o"] < end))
        state = lambda at, total, text, fine: F.struct(at.alias("at"), total.alias("sum"), text.alias("text"), fine.alias("fine"))
        step = lambda s, x: state((s["at"] + length(x["t"])).cast("long"), s["sum"] + F.coalesce(x["p"], F.lit(0.0)), F.concat(s["text"], x["t"]), s["fine"] & (x["o"] == s["at"]) & x["p"].isNotNull())
        last = F.aggregate(inside, state(begin, F.lit(0.0), F.lit(""), F.lit(True)), step)
        return F.when((F.size(inside) > 0) & last["fine"] & (last["at"] == end) & (last["text"] == continuation), last["sum"])

    return F.coalesce(counted(F.length), counted(F.octet_length))


def continuation_logprob(offsets: Column, logprobs: Column, start: Column, length: Column) -> Column:
    """The sum of log-probabilities of tokens that tile [start, start + length) exactly; null if they do not.

    offsets: array<struct<begin, end>> of the tokens in the joined text.
    """
    zipped = F.filter(F.arrays_zip(offsets.alias("o"), logprobs.alias("p")), lambda x: (x["o"]["end"] > start) & (x["o"]["begin"] < start + length))
    initial = F.struct(start.cast("long").alias("at"), F.lit(0.0).alias("sum"), F.lit(True).alias("fine"))
    done = F.aggregate(zipped, initial, lambda s, x: F.struct(x["o"]["end"].cast("long").alias("at"), (s["sum"] + x["p"]).alias("sum"), (s["fine"] & (x["o"]["begin"] == s["at"])).alias("fine")))
    return F.when(done["fine"] & (done["at"] == start + length), done["sum"])
