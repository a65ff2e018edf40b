"""Benchmark rows in their prompt formats, and length filters over generations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.names import fresh
from lumenfold.functions.text import choice_label, choice_prompt, strip, strip_end, word_count
from lumenfold.operators.requests import number_rows, valid_ids

# What ends prompts.
MATH_INSTRUCTION = "Please reason step by step, and put your final answer within \\boxed{}."
ENDINGS = {"mmlu": "Answer:", "mmlu_pro": "Answer:", "ceval": "答案："}
CODE_TEMPLATE = ("You are an expert Python programmer.  Write a function that satisfies the following description.\n\n", "\n\nYour code should pass these tests:\n\n", "\n\n[BEGIN]\n")


def math_rows(rows: DataFrame, name: str, question: str = "question", answer: str = "answer", source_id: str = "id") -> DataFrame:
    """(doc_id, prompt, answer) with the instruction to reason. A row without an id is named by its task_id, or else by
    its place (from 0) in the order of a column `ordinal`, or as the rows are read."""
    names = [c for c in (source_id, "task_id") if c in rows.columns]
    given = F.coalesce(*[F.col(c).cast("string") for c in names], F.lit(None).cast("string"))
    if not names or not rows.filter(given.isNull()).isEmpty():
        order = F.col("ordinal") if "ordinal" in rows.columns else F.monotonically_increasing_id()
        (place,) = fresh(rows.columns, "__place")
        rows = number_rows(rows, order, place)
        given = F.coalesce(given, F.col(place).cast("string"))
    prompt = F.concat(strip(F.col(question)), F.lit("\n" + MATH_INSTRUCTION))
    return rows.select(F.concat(F.lit(f"{name}:"), given).alias("doc_id"), prompt.alias("prompt"), strip(F.col(answer).cast("string")).alias("answer"))


def choice_rows(rows: DataFrame, name: str, question: str = "question", choices: str = "choices", gold: str = "gold", source_id: str = "id") -> DataFrame:
    """(doc_id, prompt, answer, choices, choice_tokens, gold); a gold index outside the choices fails the job."""
    labels = F.transform(F.sequence(F.lit(0), F.size(choices) - 1), choice_label)
    index = F.col(gold).cast("int")
    fine = (index >= 0) & (index < F.size(choices))
    checked = F.when(fine, index).otherwise(F.raise_error(F.concat(F.lit("gold index outside the choices: "), F.coalesce(F.col(source_id).cast("string"), F.lit("null")))).cast("int"))
    return rows.select(
        F.concat(F.lit(f"{name}:"), F.col(source_id).cast("string")).alias("doc_id"), choice_prompt(F.col(question), F.col(choices), ENDINGS[name]).alias("prompt"),
        choice_label(index).alias("answer"), F.col(choices).alias("choices"), labels.alias("choice_tokens"), checked.alias("gold"),
    )


def function_rows(rows: DataFrame, name: str, mode: str = "human_eval") -> DataFrame:
    """Code rows whose prompt is the head of a function, checked by check(entry_point) after the test."""
    answer = F.concat(F.lit("\n"), strip_end(F.col("test")), F.lit("\ncheck("), F.col("entry_point"), F.lit(")"))
    return _code_rows(rows, name, F.col("prompt"), answer, mode)


def task_rows(rows: DataFrame, name: str, tests: str = "test_list", text: str = "text", mode: str = "mbpp") -> DataFrame:
    """Code rows whose prompt is a task in words with its tests."""
    joined = F.array_join(F.col(tests), "\n")
    prompt = F.concat(F.lit(CODE_TEMPLATE[0]), F.col(text), F.lit(CODE_TEMPLATE[1]), joined, F.lit(CODE_TEMPLATE[2]))
    return _code_rows(rows, name, prompt, F.concat(F.lit("\n"), joined), mode)


def harness_rows(rows: DataFrame, name: str, mode: str = "mbpp_plus") -> DataFrame:
    """Code rows that come with a whole harness in `test`."""
    return _code_rows(rows, name, F.col("prompt"), F.concat(F.lit("\n"), strip_end(F.col("test"))), mode)


def _code_rows(rows: DataFrame, name: str, prompt: Column, answer: Column, mode: str) -> DataFrame:
    task = F.col("task_id").cast("string")
    return rows.select(F.concat(F.lit(f"{name}:"), task).alias("doc_id"), task.alias("task_id"), prompt.alias("prompt"), answer.alias("answer"), F.lit(mode).alias("prompt_mode"))


def required(rows: DataFrame, name: str, texts: list[str], ids: list[str] = ()) -> DataFrame:
    """rows, or a failed job that names the first column without a text (of any kind, for ids) that is not blank."""
    blank = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == ""
    kinds = dict(rows.dtypes)
    wrong = [c for c in texts if kinds.get(c) != "string"] + [c for c in ids if c not in kinds]
    if wrong:
        raise ValueError(f"{name} needs {wrong[0]}")
    checked = rows
    for c in [*texts, *ids]:
        fault = F.raise_error(F.concat(F.lit(f"{name} has a row with a blank {c}: "), F.to_json(F.struct(*rows.columns)).substr(1, 200)))
        checked = checked.withColumn(c, F.when(blank(c), fault.cast(kinds[c])).otherwise(F.col(c)))
    return checked


def union_of_configs(configs: dict[str, DataFrame], order: Callable[[DataFrame], Column]) -> DataFrame:
    """The rows of all configs with id = 'config:place', the places (from 0) by `order` within each.

    Configs may lack columns of others; all rows are numbered in one pass over the union.
    """
    if not configs:
        raise ValueError("no configs")
    parts = [rows.withColumn("config", F.lit(name)).withColumn("__order", order(rows)) for name, rows in configs.items()]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p, allowMissingColumns=True)
    numbered = number_rows(together, F.col("__order"), "__place", group="config")
    return numbered.withColumn("id", F.concat("config", F.lit(":"), F.col("__place").cast("string"))).drop("__place", "__order")


def publish(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> bool:
    """Commits a benchmark as JSON lines under path, unless one with valid ids is there; whether it wrote.

    The rows are written as a version of their own and checked (some rows, ids unique and not blank) before the pointer
    names them, so a crash leaves the old benchmark, or none, until the new one holds. published() reads it.
    """
    from lumenfold.sources import committed  # which numbers rows with this package

    ids = lambda: committed.read(spark, path, "doc_id string")
    if committed.current(spark, path) and valid_ids(ids()).first()["valid"]:
        return False

    def check(folder: str) -> None:
        found = valid_ids(spark.read.schema("doc_id string").json(folder)).first()
        if not found["valid"]:
            raise ValueError(f"no benchmark for {path}: {found['rows']} rows, {found['distinct']} ids, {found['blank']} blank")

    committed.commit(make(), path, "json", check=check)
    return True


def published(spark: SparkSession, path: str) -> str:
    """The folder of JSON lines of the benchmark that holds under path."""
    from lumenfold.sources import committed

    return committed.folder(spark, path)


def publish_all(spark: SparkSession, benchmarks: dict[str, Callable[[], DataFrame]], folder: str) -> dict[str, str]:
    """publish() for each benchmark, going on past failures: 'written', 'there' or the error by name."""
    state = {}
    for name, make in benchmarks.items():
        try:
            state[name] = "written" if publish(spark, f"{folder.rstrip('/')}/{name}", make) else "there"
        except Exception as e:
            state[name] = f"{type(e).__name__}: {e}"[:500]
    return state


def length_filter(rows: DataFrame, most: int, prompt: str = "prompt", text: str = "gen", tokens=word_count) -> DataFrame:
    """rows with prompt_length, gen_length, total_length, has_boxed and keep; `tokens` maps a text column to its length."""
    lengths = rows.withColumns({"prompt_length": tokens(F.col(prompt)), "gen_length": tokens(F.col(text))})
    total = F.col("prompt_length") + F.col("gen_length")
    end = F.right(F.col(text), F.lit(1000))
    lengths = lengths.withColumns({"total_length": total, "has_boxed": F.contains(end, F.lit("boxed{"))})
    return lengths.withColumn("keep", F.col("has_boxed") & (F.col("total_length") <= most))


def kept_generations(rows: DataFrame, most: int, prompt: str = "prompt", text: str = "gen", tokens=word_count) -> DataFrame:
    """The rows length_filter() keeps, without the generation."""
    return length_filter(rows, most, prompt, text, tokens).filter("keep").drop(text, "keep")


def removal_counts(filtered: DataFrame) -> DataFrame:
    """One row (initial, kept, removed, removed_percent) of length_filter() rows."""
    found = filtered.agg(F.count("*").alias("initial"), F.count_if("keep").alias("kept"))
    removed = F.col("initial") - F.col("kept")
    return found.select("initial", "kept", removed.alias("removed"), F.coalesce(F.try_divide(removed * 100.0, F.col("initial")), F.lit(0.0)).alias("removed_percent"))
