"""Runs of a model over questions: what a run still lacks is requested, appended to its output, and counted.

A run is its questions and a depth; the manifest beside the output names them. A second start of the same run
makes only the requests without a usable output row. Requests that fail leave no row: the run raises after the
others' rows are written, and the next start makes them again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import has_chat_template, strip
from lumenfold.operators import inference, requests
from lumenfold.plans.settings import whole
from lumenfold.sources import committed, jsonl

MODES = ("generate", "first_token", "continuation")


class IncompleteRun(RuntimeError):
    """Some requests failed; `counts` has how many, and the rows of the others are written."""

    def __init__(self, counts: dict):
        super().__init__(f"{counts['failed']} of {counts['requested']} requests failed, such as: {counts['example']}")
        self.counts = counts


@dataclass
class Run:
    output: str
    n_samples: int = 1
    seed: int = 42
    mode: str = "generate"
    attempts: int = 3
    #: Open requests at a time: tasks x in_flight.
    tasks: int = 8
    in_flight: int = 8
    system: str | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        for name in ("n_samples", "attempts", "tasks", "in_flight"):
            whole(name, getattr(self, name), least=1)
        whole("seed", self.seed, least=0)

    @property
    def manifest(self) -> str:
        return f"{self.output.rstrip('/')}.manifest"


def outputs_of(spark: SparkSession, run: Run) -> DataFrame:
    """The rows a run has written so far, in columns; none where it has not begun."""
    fs, place = jsonl._hadoop(spark, run.output)
    raw = F.col("raw")
    if fs.exists(place):
        lines = jsonl.read_resumable(spark, run.output, repair=True)
    else:
        lines = spark.createDataFrame([], "value string, ordinal long").select(F.try_parse_json("value").alias("raw"), "ordinal")
    arrays = [F.try_variant_get(raw, f"$.{c}", f"array<{t}>").alias(c) for c, t in (("logprobs", "double"), ("choices", "string"), ("choice_tokens", "string"))]
    whole_numbers = [jsonl.field(raw, c, "int").alias(c) for c in ("sample_index", "n_samples", "gold")]
    texts = [jsonl.field(raw, c).alias(c) for c in ("doc_id", "prompt")]
    return lines.select(*texts, *whole_numbers, *arrays, jsonl.single_generation(raw).alias("gen"), "ordinal")


def left_of(questions: DataFrame, run: Run) -> DataFrame:
    """The requests a run still lacks; fails where ids are blank or repeated, or outputs belong to another run."""
    spark = questions.sparkSession
    if not requests.valid_ids(questions).first()["valid"]:
        raise ValueError("every question needs an id of its own that is not blank")
    unfit = F.when(F.coalesce(strip(F.col("prompt")), F.lit("")) == "", "is blank").when(has_chat_template(F.col("prompt")), "already carries a chat template, which the server adds")
    told = questions.select("doc_id", unfit.alias("fault")).filter("fault is not null").head(1)
    if told:
        raise ValueError(f"the prompt of {told[0]['doc_id']} {told[0]['fault']}")
    questions = questions.withColumn("doc_id", F.col("doc_id").cast("string"))
    committed.write_manifest(questions, run.manifest, run.n_samples, run.output)
    usable = requests.usable_outputs if run.mode == "generate" else requests.usable_logprobs
    done = requests.resume_state(outputs_of(spark, run), usable=usable)
    faults = requests.drift(questions, done, run.n_samples).head(1)
    if faults:
        raise ValueError(f"{run.output} belongs to another run: {faults[0]['fault']} of {faults[0]['doc_id']} differs")
    return requests.with_seeds(requests.remaining(questions, done, run.n_samples), run.seed)


def with_demonstrations(questions: DataFrame, pool: DataFrame, shots: int, seed: int = 42) -> DataFrame:
    """questions whose prompts follow `shots` demonstrations of the pool; ids must be different."""
    if shots < 1:
        return questions
    prefixes = requests.few_shot_prefixes(questions, pool, shots, seed)
    joined = questions.join(prefixes.withColumnRenamed("prefix", "__prefix"), "doc_id")
    return joined.withColumn("prompt", F.concat("__prefix", "prompt")).select(*questions.columns)


def execute(questions: DataFrame, run: Run, factory: Callable[[], object]) -> dict:
    """Makes the requests a run lacks and appends their rows. Returns requested, failed and an example of a failure.

    questions: doc_id, prompt and further columns, which are written along; choices and gold for log-probabilities.
    """
    left = left_of(questions, run)
    if left.isEmpty():
        return {"requested": 0, "failed": 0, "example": None}
    spread = left.repartition(run.tasks, "doc_id", "sample_index")
    if run.mode == "generate":
        answered = inference.generate(spread, factory, run.attempts, run.in_flight, run.system)
        answered = answered.withColumn("error", F.coalesce("error", F.when(F.col("gen").isNull(), F.lit("no generation"))))
    else:
        answered = inference.score_choices(spread, factory, run.mode, run.attempts, run.in_flight)
    seen = Observation()
    counted = answered.observe(seen, F.count(F.lit(1)).alias("requested"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min("error").alias("example"))
    jsonl.append_jsonl(counted.filter("error is null").drop("error", "seed"), run.output)
    counts = dict(seen.get)
    if counts["failed"]:
        raise IncompleteRun(counts)
    return counts


def is_complete(questions: DataFrame, run: Run) -> Column | bool:
    """Whether a run's usable outputs match its manifest: nothing missing, unexpected or written twice."""
    usable = requests.usable_outputs if run.mode == "generate" else requests.usable_logprobs
    ids, n_samples = committed.read_manifest(questions.sparkSession, run.manifest)
    found = requests.reconcile(ids, usable(outputs_of(questions.sparkSession, run)), n_samples).first()
    return found["missing"] == found["unexpected"] == found["duplicates"] == 0
