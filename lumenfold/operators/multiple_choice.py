"""Multiple-choice scoring: log-likelihood argmax and generated letters, four ways to judge a question's samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.estimators import argmax, majority
from lumenfold.functions.text import answer_letter, strip_reasoning

AGGREGATIONS = ("first", "majority_vote", "any_correct", "per_sample")


def score_loglikelihood(rows: DataFrame, logprobs: str = "logprobs", gold: str = "gold", choices: str | None = None) -> DataFrame:
    """rows with prediction (index of the largest log-probability, the first of several), status and correct.

    A null log-probability is minus infinity. Rows without a finite one, with NaN or +infinity, with gold
    outside the choices, or with another number of choices than log-probabilities are failed.
    """
    scores = F.transform(F.col(logprobs), lambda x: F.coalesce(x.cast("double"), F.lit(float("-inf"))))
    best = F.when(F.size(scores) > 0, argmax(scores))
    fits = (F.col(gold) >= 0) & (F.col(gold) < F.size(scores))
    if choices:
        fits = fits & (F.col(choices).isNull() | (F.size(choices) == F.size(scores)))
    done = F.coalesce(fits & best.isNotNull(), F.lit(False))
    return rows.withColumns({
        "prediction": F.when(done, best).cast("int"),
        "status": F.when(done, "completed").otherwise("failed"),
        "correct": F.coalesce(done & (best == F.col(gold)), F.lit(False)),
    })


def merge_samples(rows: DataFrame, problem: str = "problem", index: str = "sample_index", text: str = "gen", error: str = "error") -> DataFrame:
    """One row per problem: gens, errors and indexes as arrays in the order of the samples, and n_samples and complete."""
    item = F.struct(F.col(index).alias("i"), F.col(text).alias("gen"), F.col(error).alias("error"))
    merged = rows.groupBy(problem).agg(F.array_sort(F.collect_list(item)).alias("s"), F.max("n_samples").alias("n_samples"), F.bool_and("complete").alias("complete"), F.min_by("gold", index).alias("gold"))
    return merged.select(problem, F.col("s.gen").alias("gens"), F.col("s.error").alias("errors"), F.col("s.i").alias("indexes"), "n_samples", "complete", "gold")


def predictions(gens: Column) -> Column:
    """The letters of generations; null for a null generation, '' where none is found."""
    return F.transform(gens, lambda g: F.when(g.isNotNull(), answer_letter(strip_reasoning(g))))


def score_generations(merged: DataFrame, aggregation: str) -> DataFrame:
    """merge_samples() rows with prediction, status, correct, weight, correct_weight and eligible, under an aggregation.

    first judges sample 0, majority_vote the most frequent letter (the earliest of several; '' is a letter),
    any_correct whether any is right, per_sample each one. A missing generation, an error or a blank gold
    fails the question; first looks at its first sample alone. first needs sample 0, majority_vote and
    any_correct need all samples.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
    votes, gold = F.col("votes"), F.col("gold")
    found = merged.withColumn("votes", predictions(F.col("gens")))
    gens, errors = ("gens", "errors") if aggregation != "first" else (F.slice("gens", 1, 1), F.slice("errors", 1, 1))
    failed = F.exists(gens, lambda g: g.isNull()) | F.exists(errors, lambda e: F.coalesce(e, F.lit("")) != "") | (F.coalesce(gold, F.lit("")) == "")
    hits = F.size(F.filter(votes, lambda v: v == gold))
    chosen = {
        "first": F.try_element_at(votes, F.lit(1)),
        "majority_vote": majority(votes),
        "any_correct": F.when(hits > 0, gold).otherwise(F.coalesce(F.try_element_at(F.filter(votes, lambda v: v != ""), F.lit(1)), F.lit(""))),
        "per_sample": F.try_element_at(votes, F.lit(1)),
    }[aggregation]
    eligible = {"first": F.array_contains("indexes", 0), "per_sample": F.lit(True)}.get(aggregation, F.col("complete"))
    weight = F.size("gens") if aggregation == "per_sample" else F.lit(1)
    right = hits if aggregation == "per_sample" else (chosen == gold).cast("int")
    return found.withColumns({
        "prediction": F.when(~failed, chosen),
        "status": F.when(failed, "failed").otherwise("completed"),
        "correct": ~failed & (chosen == gold),
        "weight": weight,
        "correct_weight": F.when(failed, 0).otherwise(right),
        "eligible": ~failed & eligible,
    })


def with_letters(rows: DataFrame, text: str = "gen", error: str = "error") -> DataFrame:
    """rows with vote, the letter of the generation, and bad (none there, or an error), without the generation and the error."""
    vote = F.when(F.col(text).isNotNull(), answer_letter(strip_reasoning(F.col(text))))
    bad = F.col(text).isNull() | (F.coalesce(F.col(error), F.lit("")) != "")
    return rows.withColumns({"vote": vote, "bad": bad}).drop(text, error)


def score_letters(rows: DataFrame, aggregation: str, problem: str = "problem", index: str = "sample_index") -> DataFrame:
    """What score_generations() gives for the samples of with_letters(), a row for each problem; under per_sample a row
    for each sample, which fails alone.

    Samples are counted by letter, so a problem of any number of samples is a row for each letter.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
    if aggregation == "per_sample":
        failed = F.col("bad") | (F.coalesce(F.col("gold"), F.lit("")) == "")
        right = ~failed & (F.col("vote") == F.col("gold"))
        return rows.withColumns({
            "prediction": F.when(~failed, F.col("vote")), "status": F.when(failed, "failed").otherwise("completed"), "correct": right,
            "weight": F.lit(1).cast("long"), "correct_weight": right.cast("long"), "eligible": ~failed,
        })
    tally = rows.groupBy(problem, "gold", "vote").agg(
        F.count("*").alias("n"), F.min(index).alias("first"), F.count_if("bad").alias("bad"), F.bool_or(F.col(index) == 0).alias("zero"), F.bool_and("complete").alias("complete"),
        F.min_by("bad", index).alias("first_bad"),
    )
    found = tally.groupBy(problem).agg(
        F.min_by("gold", "first").alias("gold"), F.sum("bad").alias("bad"), F.min_by("first_bad", "first").alias("first_bad"), F.bool_or("zero").alias("zero"), F.bool_and("complete").alias("complete"),
        F.collect_list(F.struct("vote", "n", "first")).alias("tally"),
    )
    gold = F.col("gold")
    votes = F.sort_array(F.transform("tally", lambda t: F.struct(t["first"].alias("first"), t["vote"].alias("vote"), t["n"].alias("n"))))
    total = lambda v: F.aggregate(F.filter("tally", lambda t: t["vote"] == v), F.lit(0).cast("long"), lambda a, t: a + t["n"])
    most = F.array_max(F.transform(votes, lambda t: F.struct(total(t["vote"]).alias("n"), (-t["first"]).alias("first"), t["vote"].alias("vote"))))["vote"]
    hits, earliest = total(gold), F.try_element_at(votes, F.lit(1))["vote"]
    chosen = {
        "first": earliest,
        "majority_vote": most,
        "any_correct": F.when(hits > 0, gold).otherwise(F.coalesce(F.try_element_at(F.filter(votes, lambda t: t["vote"] != ""), F.lit(1))["vote"], F.lit(""))),
    }[aggregation]
    failed = (F.col("first_bad") if aggregation == "first" else F.col("bad") > 0) | (F.coalesce(gold, F.lit("")) == "")
    eligible = F.col("zero") if aggregation == "first" else F.col("complete")
    return found.select(
        problem, F.when(~failed, chosen).alias("prediction"), F.when(failed, "failed").otherwise("completed").alias("status"), (~failed & (chosen == gold)).alias("correct"),
        F.lit(1).cast("long").alias("weight"), F.when(failed, 0).otherwise((chosen == gold).cast("long")).alias("correct_weight"), (~failed & eligible).alias("eligible"),
    )


def accuracy_summary(scored: DataFrame) -> DataFrame:
    """One row: acc over eligible weight, and sample, effective, failed and excluded counts, which add up."""
    on = F.col("eligible")
    w = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    return scored.agg(
        (F.coalesce(F.sum(F.when(on, F.col("correct_weight"))), F.lit(0)) / F.greatest(w(on), F.lit(1))).alias("acc"),
        w(F.lit(True)).alias("sample_count"), w(on).alias("effective_count"), w(F.col("status") == "failed").alias("failed_count"),
        w((F.col("status") == "completed") & ~on).alias("excluded_count"),
    )
