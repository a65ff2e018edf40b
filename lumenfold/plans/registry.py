"""Tasks by family: from sample rows to a result of metrics and counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import filter_pipeline, gold_letter, strip, strip_reasoning
from lumenfold.operators import code_answers, math_answers, multiple_choice
from lumenfold.operators.metrics import bootstrap, check_counts, exact_bootstrap
from lumenfold.operators.samples import normalize_samples, problem_identity
from lumenfold.plans.settings import number, whole
from lumenfold.sources import committed


@dataclass
class Scored:
    """metric -> value without observations, observations (metric, value, ordinal), and the four counts in one row."""

    metrics: dict[str, float]
    observations: DataFrame
    counts: DataFrame
    #: problem, complete and more, for the result's details; None where there are no problems of several samples.
    problems: DataFrame | None = None
    #: Scored rows with ordinal and status, for the tables of details.
    rows: DataFrame | None = None
    #: What the scorer keeps for a while; evaluate() lets it go.
    held: DataFrame | None = None


@dataclass
class Options:
    dataset: str = ""
    aggregation: str = "first"
    ks: tuple[int, ...] = (1,)
    allow_code_execution: bool = False
    resamples: int = 1000
    confidence: float = 0.95
    seed: int = 42
    #: Draws of Python's generator over all observations of a metric in one task, for parity with single-process runs.
    exact: bool = False
    #: For math: says of two forms whose keys differ whether they are equal all the same.
    verify: math_answers.Verifier | None = None
    #: Ids of incomplete problems that a result lists, the first ones by place; all are counted, and the table has all.
    listed: int = 100

    def __post_init__(self):
        if self.aggregation not in multiple_choice.AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {multiple_choice.AGGREGATIONS}")
        for k in self.ks:
            whole("k", k, least=1)
        whole("resamples", self.resamples, least=0)
        whole("listed", self.listed, least=0)
        whole("seed", self.seed)
        number("confidence", self.confidence, above=0)
        if self.confidence >= 1:
            raise ValueError(f"confidence must be below 1: {self.confidence!r}")


def _prepared(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    for name, kind in (("sample_index", "int"), ("n_samples", "int"), ("error", "string"), ("doc_id", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    problem = problem_identity(F.col("doc_id"), F.col("ordinal")) if key == "doc_id" else F.col(key).cast("string")
    return normalize_samples(rows.withColumn("problem", problem), [f for f in fields if f in rows.columns])


def _observed(rows: DataFrame, value, metric: str) -> DataFrame:
    return rows.select(F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.col("ordinal").cast("long").alias("ordinal"))


def score_math(rows: DataFrame, options: Options) -> Scored:
    scored = math_answers.score_answers(_prepared(rows, "doc_id", ["answer", "prompt"]), options.dataset, error="error", verify=options.verify).cache()
    counts = math_answers.accuracy_counts(scored)
    problems = math_answers.problem_rollup(scored, same=options.verify)
    first = scored.groupBy("problem").agg(F.min("ordinal").alias("ordinal"))
    complete = problems.filter("complete").join(first, "problem")
    parts = [_observed(scored.filter("status = 'completed'"), F.col("accuracy"), "accuracy")]
    metrics = {"accuracy": 0.0}
    for r in math_answers.cohort_metrics(problems).orderBy("k").collect():  # a row for each depth
        metrics |= {f"problem_pass@{r.k}": r.pass_at_k, f"problem_majority@{r.k}": r.majority_at_k}
        cohort = complete.filter(F.col("k") == r.k)
        parts += [_observed(cohort, F.col("passed"), f"problem_pass@{r.k}"), _observed(cohort, F.col("majority_right"), f"problem_majority@{r.k}")]
    observations = parts[0]
    for p in parts[1:]:
        observations = observations.unionByName(p)
    return Scored(metrics, observations, counts.withColumn("excluded_count", F.lit(0)), problems, scored, scored)


def score_choices(rows: DataFrame, options: Options) -> Scored:
    if "logprobs" in rows.columns:
        state = rows.agg(F.count("*").alias("n"), F.count("logprobs").alias("with")).first()
        if state["with"] not in (0, state["n"]):
            raise ValueError("some rows have logprobs and some have none")
        if state["with"]:
            scored = multiple_choice.score_loglikelihood(rows, choices="choices" if "choices" in rows.columns else None)
            scored = scored.withColumns({"eligible": F.col("status") == "completed", "weight": F.lit(1), "correct_weight": F.col("correct").cast("int")})
            scored = scored.withColumn("scoring_mode", F.lit("loglikelihood"))
            return Scored({"acc": 0.0}, _observed(scored.filter("eligible"), F.col("correct"), "acc"), multiple_choice.accuracy_summary(scored), rows=scored)
    options_ = F.col("choices") if "choices" in rows.columns else F.lit(None).cast("array<string>")
    samples = _prepared(rows.withColumn("gold", gold_letter(F.col("answer"), options_)), "doc_id", ["answer", "prompt"])
    # Texts are read once, for their letters, which all that follows shares.
    lettered = multiple_choice.with_letters(samples).cache()
    scored = multiple_choice.score_letters(lettered, options.aggregation)
    if options.aggregation != "per_sample":
        scored = scored.join(lettered.groupBy("problem").agg(F.min("ordinal").alias("ordinal")), "problem")
    problems = lettered.groupBy("problem").agg(F.bool_and("complete").alias("complete"))
    scored = scored.withColumn("scoring_mode", F.lit("generate"))
    return Scored({"acc": 0.0}, _observed(scored.filter("eligible"), F.col("correct"), "acc"), multiple_choice.accuracy_summary(scored), problems, scored, lettered)


def score_programs(rows: DataFrame, options: Options) -> Scored:
    samples = _prepared(rows, "task_id", ["answer", "prompt"])
    scored = code_answers.score_code(samples, options.allow_code_execution).cache()
    tasks = code_answers.task_rollup(scored)
    metrics = {f"pass@{r.k}": r.pass_at_k for r in code_answers.pass_at_k_metrics(tasks, options.ks).collect()}  # a row for each k
    first = scored.groupBy("task_id").agg(F.min("ordinal").alias("ordinal"))
    ranked = tasks.filter("counts").join(first, "task_id")
    from lumenfold.functions.estimators import pass_at_k

    observations = None
    for k in sorted({1, *options.ks}):
        part = _observed(ranked.filter(F.col("n") >= k), pass_at_k(F.col("n"), F.col("c"), F.lit(k)), f"pass@{k}")
        observations = part if observations is None else observations.unionByName(part)
    return Scored(metrics, observations, code_answers.code_counts(scored), tasks.select(F.col("task_id").alias("problem"), F.col("counts").alias("complete")), scored, scored)


Scorer = Callable[[DataFrame, Options], Scored]
FAMILIES: dict[str, Scorer] = {"math_opensource": score_math, "mc": score_choices, "code": score_programs}
#: Metrics that a family's results always have.
DECLARED: dict[str, tuple[str, ...]] = {"math_opensource": ("accuracy",), "mc": ("acc",), "code": ("pass@1",)}


def register(family: str, scorer: Scorer, metrics: Sequence[str] = ()) -> None:
    """Adds a family; its results must have the metrics named."""
    FAMILIES[family], DECLARED[family] = scorer, tuple(metrics)


def resolve(task: str) -> Scorer:
    """The scorer of 'family' or 'family/name'; any name goes."""
    family = task.split("/", 1)[0]
    if family not in FAMILIES:
        raise KeyError(f"unknown task family {family!r}; known: {sorted(FAMILIES)}")
    return FAMILIES[family]


def prepared(rows: DataFrame, task: str, label: str = "answer") -> DataFrame:
    """rows with ordinal and task; fails where the label is no column. Choices by log-probability need none."""
    if label not in rows.columns and "logprobs" not in rows.columns:
        raise ValueError(f"rows of {task} have no {label!r}; there are {rows.columns}")
    if "ordinal" not in rows.columns:
        rows = rows.withColumn("ordinal", F.monotonically_increasing_id())
    return rows.withColumn("task", F.lit(task))


def evaluate(rows: DataFrame, task: str, options: Options | None = None, path: str | None = None) -> dict:
    """The result of a task as a dict: metrics with bootstrap uncertainty, counts that add up, and details of incomplete problems.

    With path, the result and its tables (see artifacts()) are committed there together.
    """
    options = options or Options()
    scorer = resolve(task)
    scored = scorer(prepared(rows, task), options)
    try:
        resample = exact_bootstrap if options.exact else bootstrap
        found = {r["metric"]: r.asDict() for r in resample(scored.observations, by="metric", resamples=options.resamples, confidence=options.confidence, seed=options.seed).collect()}
        if missing := set(DECLARED[task.split("/", 1)[0]]) - set(scored.metrics):
            raise ValueError(f"the scorer of {task} left out {sorted(missing)}")
        if unknown := set(found) - set(scored.metrics):
            raise ValueError(f"the scorer of {task} observes {sorted(unknown)}, which are no metrics of it")
        none = {"count": 0, "stderr": None, "ci_low": None, "ci_high": None}
        metrics = {m: {k: v for k, v in found.get(m, {"value": value, **none}).items() if k != "metric"} for m, value in scored.metrics.items()}
        row = scored.counts.first().asDict()
        counts = {c: int(row[c]) for c in ("sample_count", "effective_count", "failed_count", "excluded_count")}
        check_counts(counts)
        result = {"task": task, "metrics": metrics, **counts, "details": incomplete(placed_problems(scored), options.listed) if scored.problems is not None else {}}
        if path:
            committed.commit_tables(artifacts(scored, rows), path, result=result)
        return result
    finally:
        if scored.held is not None:
            scored.held.unpersist()


#: The steps that responses go through, by name, for traces.
RESPONSE_STEPS = [("strip_reasoning", strip_reasoning), ("strip", strip)]


def problem_table(problems: DataFrame, rows: DataFrame) -> DataFrame:
    """problems with place, the least ordinal of their rows: all of them, complete or not, to be read in file order."""
    return problems.join(rows.groupBy("problem").agg(F.min("ordinal").alias("place")), "problem")


def placed_problems(scored: Scored) -> DataFrame:
    return problem_table(scored.problems, scored.held if scored.held is not None else scored.rows)


def traced(rows: DataFrame, text: str = "gen") -> DataFrame:
    """rows with filter_trace: what each step made of the response."""
    return rows.withColumn("filter_trace", filter_pipeline(F.col(text), "response", RESPONSE_STEPS)[1])


def artifacts(scored: Scored, rows: DataFrame) -> dict[str, DataFrame]:
    """problems: a row for each, with its place; rows: scored rows with the trace of their response, where they hold
    one. Both are sorted by place over all files."""
    tables = {}
    if scored.rows is not None:
        found = traced(scored.rows) if "gen" in scored.rows.columns else scored.rows
        tables["rows"] = found.drop("raw").repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    if scored.problems is not None:
        tables["problems"] = placed_problems(scored).repartitionByRange("place").sortWithinPartitions("place")
    return tables


def incomplete(problems: DataFrame, listed: int) -> dict:
    """Counts of complete and incomplete problems, and the ids of the first incomplete ones by place; the table of
    problems has them all."""
    n = problems.agg(F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete")).first()
    ids = problems.filter(~F.col("complete")).orderBy("place").limit(listed).collect() if n["incomplete"] else []
    return {"complete_problem_count": n["complete"], "incomplete_problem_count": n["incomplete"], "incomplete_problem_ids": [r["problem"].removeprefix("doc:") for r in ids]}


def primary_value(result: dict) -> float:
    return next(iter(result["metrics"].values()))["value"]


def summary_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    """(task, metric, value, stderr, ci_low, ci_high, count, samples, failed) of several results, a row for each metric."""
    rows = [
        (r["task"], m, float(v["value"]), v.get("stderr"), v.get("ci_low"), v.get("ci_high"), int(v.get("count") or 0), r["sample_count"], r["failed_count"])
        for r in results for m, v in r["metrics"].items()
    ]
    return spark.createDataFrame(rows, "task string, metric string, value double, stderr double, ci_low double, ci_high double, count long, samples long, failed long")


def first_failures(scored: DataFrame, n: int = 10) -> DataFrame:
    """The first n failed rows of a scorer by their place: what a log of a run shows."""
    return scored.filter("status = 'failed'").orderBy("ordinal").limit(n)
