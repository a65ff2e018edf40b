"""Math scoring: compared forms, a numeric verifier, accuracy and problem-level metrics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lumenfold.functions import expressions
from lumenfold.functions.text import ground_truth, once, strip_reasoning, with_math_forms

Verifier = Callable[[str, str], bool]


def verdict(verify: Verifier, gold: str | None, answer: str | None) -> bool | None:
    """What a verifier says of two forms; None where it raises, which fails the row and not the job."""
    try:
        return bool(gold and answer and verify(gold, answer))
    except Exception:
        return None


def one_label(rows: DataFrame, label: str, dataset: str) -> Column:
    """The label as a text: the first of a list of them, which only olympiadbench has; null for an empty or another list."""
    if not isinstance(rows.schema[label].dataType, ArrayType):
        return F.col(label)
    return F.try_element_at(label, F.lit(1)).cast("string") if dataset.lower() == "olympiadbench" else F.lit(None).cast("string")


def score_answers(rows: DataFrame, dataset: str = "", label: str = "answer", text: str = "gen", error: str | None = None, verify: Verifier | None = None) -> DataFrame:
    """rows with gold, prediction (compared forms), prediction_key, accuracy (0 or 1), status.

    An error, a missing generation, an unusable label or a verifier that raises fails the row; an empty or unparsable answer is
    completed and wrong. Equal forms are right, and so are forms of equal keys (see functions/expressions.py); what
    is left goes to `verify`, a function of two forms, where one is given.
    """
    rows = rows.drop(*[c for c in ("gold", "prediction") if c != label]).withColumn("__label", ground_truth(one_label(rows, label, dataset), dataset))
    lost = F.col("__label").isNull() | F.col(text).isNull()
    if error:
        lost = lost | (F.coalesce(F.col(error), F.lit("")) != "")
    # Whether a row failed is told here, so that texts that nobody asks for later are not carried along.
    rows = rows.withColumn("__lost", lost)
    found = with_math_forms(rows, {"gold": F.col("__label"), "prediction": strip_reasoning(F.col(text))})
    found = expressions.with_keys(found.drop("prediction_key"), {"__gold_key": "gold", "prediction_key": "prediction"})
    failed = F.col("__lost")
    right = (F.col("__gold_key") == F.col("prediction_key")) & (F.col("gold") != "")
    if verify:

        @F.pandas_udf("boolean")
        def verified(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([verdict(verify, x, y) for x, y in zip(a, b)], dtype="boolean")

        # Words without a digit on both sides are settled by their texts.
        ask = ~right & F.col("gold").rlike("[0-9]") & F.col("prediction").rlike("[0-9]")
        found = once(found, {"__asked": ask}).withColumn("__same", verified(F.when(F.col("__asked"), F.col("gold")), F.when(F.col("__asked"), F.col("prediction"))))
        failed = failed | (F.col("__asked") & F.col("__same").isNull())
        right = right | F.coalesce("__same", F.lit(False))
    out = found.withColumn("status", F.when(failed, "failed").otherwise("completed")).withColumn("accuracy", F.when(~failed & right, 1.0).otherwise(0.0))
    return out.drop("__label", "__lost", "__gold_key", "__asked", "__same")


def accuracy_counts(scored: DataFrame) -> DataFrame:
    """One row: accuracy of completed samples (0 without one), and sample, effective, wrong and failed counts."""
    done = F.col("status") == "completed"
    return scored.agg(
        F.coalesce(F.avg(F.when(done, F.col("accuracy"))), F.lit(0.0)).alias("accuracy"), F.count("*").alias("sample_count"),
        F.count_if(done).alias("effective_count"), F.count_if(done & (F.col("accuracy") < 1)).alias("wrong_count"), F.count_if(~done).alias("failed_count"),
    )


#: Answers that begin so are no votes (fixed values).
NO_VOTE = ("Error", "Format Error", "Timeout")


def tallies(scored: DataFrame, problem: str = "problem") -> DataFrame:
    """One row per problem and answer key: votes, the first sample and its form, whether one of them is right, and what
    problem_rollup() sums. Only completed samples vote. Samples are added up before they are shuffled."""
    done = F.col("status") == "completed"
    key = F.col("prediction_key") if "prediction_key" in scored.columns else F.col("prediction")
    says = F.coalesce(F.col("prediction"), F.lit(""))
    vote = done & ~F.greatest(*[says.startswith(x) for x in NO_VOTE])
    return scored.withColumn("__key", F.coalesce(key, F.lit(""))).groupBy(problem, "__key").agg(
        F.count_if(vote).alias("votes"), F.min(F.when(vote, F.col("sample_index"))).alias("first"), F.min_by("prediction", F.when(vote, F.col("sample_index"))).alias("form"),
        F.max(F.when(vote, F.col("accuracy"))).alias("right"), F.sum(F.when(done, F.col("accuracy"))).alias("correct"), F.count_if(done).alias("done"), F.count("*").alias("samples"),
        F.max("n_samples").alias("n"), F.bool_and("complete").alias("all_there"),
    )


def problem_rollup(scored: DataFrame, problem: str = "problem", same: Verifier | None = None) -> DataFrame:
    """One row per problem: k (its depth), correct and completed samples, complete, passed, the majority's answer and whether it is right.

    A problem is complete if every sample of its depth is there and completed. Completed samples vote by the key of
    their answer, so that equal answers are one however they are written; of equal votes the answer seen first wins;
    the vote is right if any of its samples is. `same`, a function of two forms that says more answers equal,
    joins keys further: see joined_votes().
    """
    votes = tallies(scored, problem)
    rank = F.when(F.col("votes") > 0, F.struct("votes", -F.col("first")))
    found = votes.groupBy(problem).agg(
        F.max("n").alias("k"), F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("correct_samples"), F.sum("done").alias("completed_samples"), F.sum("samples").alias("available"),
        F.bool_and("all_there").alias("all_there"), F.max_by("form", rank).alias("majority"), F.max_by("right", rank).alias("majority_right"),
    )
    if same:
        found = found.drop("majority", "majority_right").join(joined_votes(votes.filter("votes > 0"), same, problem), problem, "left")
    complete = F.col("all_there") & (F.col("completed_samples") == F.col("k"))
    right = F.coalesce(F.col("majority_right").cast("double"), F.lit(0.0))
    return found.select(problem, "k", "correct_samples", "completed_samples", complete.alias("complete"), (F.col("correct_samples") > 0).alias("passed"), "majority", right.alias("majority_right"))


def cohort_metrics(problems: DataFrame) -> DataFrame:
    """(k, problems, complete_problems, pass_at_k, majority_at_k) of each depth; 0 where no problem of a depth is complete."""
    on = F.col("complete")
    mean = lambda c: F.coalesce(F.avg(F.when(on, c)), F.lit(0.0))
    return problems.groupBy("k").agg(F.count("*").alias("problems"), F.count_if(on).alias("complete_problems"), mean(F.col("passed").cast("double")).alias("pass_at_k"), mean(F.col("majority_right")).alias("majority_at_k"))


def joined_votes(votes: DataFrame, same: Verifier, problem: str = "problem") -> DataFrame:
    """(problem, majority, majority_right) by greedy clusters: an answer joins the first cluster whose first answer it equals.

    Equality need not be transitive, so the different answers of a problem are walked by their first samples, which
    gives what walking all samples would: a later sample of an answer meets the clusters that its first one met. A
    group holds a row for each different answer, whatever the number of samples.
    """

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list] = []
        for form, n, right in group.sort_values("first")[["form", "votes", "right"]].itertuples(index=False):
            mine = next((c for c in clusters if c[0] == form or verdict(same, c[0], form)), None)
            if mine is None:
                clusters.append([form, n, right])
            else:
                mine[1:] = [mine[1] + n, max(mine[2], right)]
        best = max(clusters, key=lambda c: c[1])
        return pd.DataFrame({problem: [group[problem].iloc[0]], "majority": [best[0]], "majority_right": [float(best[2])]})

    kind = votes.schema[problem].dataType.simpleString()
    return votes.select(problem, "form", "votes", "first", "right").groupBy(problem).applyInPandas(walk, f"`{problem}` {kind}, majority string, majority_right double")
