"""Command lines: score an output (evaluate), ask a model server (infer), write a benchmark (prepare)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import preparation
from lumenfold.operators.multiple_choice import AGGREGATIONS
from lumenfold.plans import runner
from lumenfold.plans.registry import Options, evaluate, primary_value
from lumenfold.sources.jsonl import field, in_file_order, load_pool, load_questions, read_jsonl, single_generation, write_summary
from lumenfold.sources.model_server import ModelServer

#: Kinds of benchmarks and what makes their rows.
KINDS = {"math": preparation.math_rows, "choice": preparation.choice_rows, "function": preparation.function_rows, "task": preparation.task_rows, "harness": preparation.harness_rows}


def parser() -> argparse.ArgumentParser:
    """Of the evaluator, whose name may be left out."""
    p = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    p.add_argument("input")
    p.add_argument("--task", required=True, help="family or family/name: math_opensource, mc, code")
    p.add_argument("--output", help="a JSON file for the result")
    p.add_argument("--artifacts", help="a folder for the result with its tables of rows and problems")
    p.add_argument("--dataset", default="")
    p.add_argument("--aggregation", default="first", choices=AGGREGATIONS)
    p.add_argument("--k", type=int, nargs="+", default=[1])
    p.add_argument("--resamples", type=int, default=1000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--allow-code-execution", action="store_true")
    return p


def infer_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenfold infer")
    p.add_argument("input")
    p.add_argument("--output", required=True)
    p.add_argument("--url", required=True, help="of the server, such as http://host:8000/v1")
    p.add_argument("--model", required=True)
    p.add_argument("--name", default="questions", help="names questions without an id")
    p.add_argument("--mode", default="generate", choices=runner.MODES)
    p.add_argument("--n-samples", type=int, default=1)
    p.add_argument("--shots", type=int, default=0)
    p.add_argument("--pool", help="a file of demonstrations")
    p.add_argument("--system")
    p.add_argument("--temperature", type=float, default=0.0)
    p.add_argument("--top-p", type=float, default=1.0)
    p.add_argument("--max-tokens", type=int, default=4096)
    p.add_argument("--timeout", type=float, default=600.0)
    p.add_argument("--extra", type=json.loads, default={}, help="a JSON object of further fields")
    p.add_argument("--attempts", type=int, default=3)
    p.add_argument("--tasks", type=int, default=8)
    p.add_argument("--in-flight", type=int, default=8)
    p.add_argument("--seed", type=int, default=42)
    return p


def prepare_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenfold prepare")
    p.add_argument("name")
    p.add_argument("input", help="JSON lines of the source's rows")
    p.add_argument("--output", required=True, help="the folder of benchmarks")
    p.add_argument("--kind", required=True, choices=KINDS)
    return p


def load(spark: SparkSession, path: str, label: bool = True) -> DataFrame:
    """The columns that scorers read. With label, a row without the key `answer` fails the job and names its keys; a row
    of log-probabilities needs none."""
    raw = F.col("raw")
    rows = in_file_order(read_jsonl(spark, path))
    strings = [field(raw, c).alias(c) for c in ("doc_id", "task_id", "prompt", "prompt_mode", "error")]
    numbers = [field(raw, c, "int").alias(c) for c in ("sample_index", "n_samples", "gold")]
    arrays = [F.try_variant_get(raw, "$.logprobs", "array<double>").alias("logprobs"), F.try_variant_get(raw, "$.choices", "array<string>").alias("choices")]
    held = lambda c: F.try_variant_get(raw, f"$.{c}", "variant").isNotNull()
    kind = F.schema_of_variant(F.try_variant_get(raw, "$.answer", "variant"))
    # Of a list of labels the first one counts; an empty one is no label.
    answer = F.when(kind.startswith("ARRAY"), F.try_variant_get(raw, "$.answer[0]", "string")).otherwise(F.try_variant_get(raw, "$.answer", "string"))
    if label:
        fault = F.raise_error(F.concat(F.lit("a row has no answer: "), F.substring(F.to_json(raw), 1, 200))).cast("string")
        answer = F.when(held("answer") | held("logprobs"), answer).otherwise(fault)
    return rows.select(*strings, *numbers, *arrays, answer.alias("answer"), single_generation(raw).alias("gen"), "ordinal")


def score(spark: SparkSession, args: list[str]) -> int:
    a = parser().parse_args(args)
    rows = load(spark, a.input)
    if rows.isEmpty():
        print(f"{a.input} has no rows", file=sys.stderr)
        return 1
    options = Options(dataset=a.dataset, aggregation=a.aggregation, ks=tuple(a.k), allow_code_execution=a.allow_code_execution, resamples=a.resamples, seed=a.seed)
    if rows.filter("logprobs is not null").isEmpty():
        rows = rows.drop("logprobs")
    result = evaluate(rows, a.task, options, a.artifacts)
    if a.output:
        write_summary(spark, a.output, result)
    print(f"{a.task}: {primary_value(result):.6f}")
    return 0


def infer(spark: SparkSession, args: list[str]) -> int:
    a = infer_parser().parse_args(args)
    if bool(a.pool) != (a.shots > 0):
        raise SystemExit("--shots and --pool go together")
    if a.mode == "continuation" and a.system:
        raise SystemExit("continuations cannot carry a system prompt")
    server = ModelServer(a.url, a.model, a.max_tokens, a.temperature, a.top_p, a.timeout, extra=a.extra)
    run = runner.Run(a.output, a.n_samples, a.seed, a.mode, a.attempts, a.tasks, a.in_flight, a.system)
    questions = load_questions(spark, a.input, a.name, choices=a.mode != "generate")
    if questions.isEmpty():
        print(f"{a.input} has no rows", file=sys.stderr)
        return 1
    if a.shots:
        questions = runner.with_demonstrations(questions, load_pool(spark, a.pool, a.shots), a.shots, a.seed)
    try:
        counts = runner.execute(questions, run, server)
    except runner.IncompleteRun as e:
        print(e, file=sys.stderr)
        return 1
    print(f"{counts['requested']} requests made; complete: {runner.is_complete(questions, run)}")
    return 0


def prepare(spark: SparkSession, args: list[str]) -> int:
    a = prepare_parser().parse_args(args)
    path = f"{a.output.rstrip('/')}/{a.name}"
    wrote = preparation.publish(spark, path, lambda: KINDS[a.kind](spark.read.json(a.input), a.name))
    print(f"{preparation.published(spark, path)}: {'written' if wrote else 'there'}")
    return 0


COMMANDS = {"evaluate": score, "infer": infer, "prepare": prepare}


def main(args: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    command = COMMANDS[args.pop(0)] if args and args[0] in COMMANDS else score
    spark = SparkSession.builder.appName("lumenfold").getOrCreate()
    try:
        return command(spark, args)
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
