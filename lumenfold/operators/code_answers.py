"""Code scoring: candidate programs run in child processes, and unbiased pass@k.

Running model-written code is dangerous and no sandbox; it must be allowed by the caller. A task keeps one fresh
interpreter that forks a child for each program (child_server.py), with resource limits, an empty folder, a time
limit, and without the functions and modules that programs are not to use; nothing runs in the worker.
"""

from __future__ import annotations

import ast
import json
import pkgutil
import select
import subprocess
import sys
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.estimators import pass_at_k
from lumenfold.functions.text import check_programs, code_block, needs_prefix, strip_reasoning

PREFIX_LINES = 500
MEMORY_MB = 2048


def longest_valid_prefix(code: str) -> str:
    """The most leading lines that parse as Python; the code itself if none do. At most PREFIX_LINES lines are tried."""
    lines = code.rstrip().splitlines()[:PREFIX_LINES]
    while lines:
        part = "\n".join(lines).rstrip()
        try:
            if part:
                ast.parse(part)
                return part
        except (SyntaxError, ValueError):
            pass
        lines.pop()
    return code.rstrip()


def valid_prefix(code: Column) -> Column:
    """longest_valid_prefix() of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def parse(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: None if c is None else longest_valid_prefix(c))

    return parse(code)


def extract_code(rows: DataFrame, text: str = "gen", into: str = "code") -> DataFrame:
    """rows with the code of each response; only code without a fence goes through Python, for its valid prefix."""
    kept = strip_reasoning(F.col(text))
    block, cut = code_block(kept), needs_prefix(kept)
    return rows.withColumn(into, F.coalesce(valid_prefix(F.when(cut, block)), block, F.lit("")))


class Children:
    """The interpreter of a task that forks children; one that is lost is started again for the next program."""

    def __init__(self, seconds: float = 3.0, memory_mb: int = MEMORY_MB):
        self.seconds, self.memory_mb = seconds, memory_mb
        self.source = pkgutil.get_data(__package__, "child_server.py").decode("utf-8")
        self.server: subprocess.Popen | None = None

    def _start(self) -> subprocess.Popen:
        if self.server is None or self.server.poll() is not None:
            env = {"PATH": "", "OMP_NUM_THREADS": "1", "PYTHONDONTWRITEBYTECODE": "1", "TMPDIR": tempfile.gettempdir()}
            self.server = subprocess.Popen([sys.executable, "-I", "-c", self.source], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env)
        return self.server

    def run(self, program: str) -> tuple[str, str]:
        """(status, result) of a program: completed with passed, failed: ..., timed out or died of a signal; failed where
        no child could be started."""
        raw = program.encode("utf-8", "surrogateescape")
        try:
            server = self._start()
            asked = json.dumps({"bytes": len(raw), "seconds": self.seconds, "memory_mb": self.memory_mb})
            server.stdin.write(asked.encode() + b"\n" + raw)
            server.stdin.flush()
            # The server itself ends a child in time; one that has stopped answering is given up.
            ready = select.select([server.stdout], [], [], self.seconds + 10)[0]
            line = server.stdout.readline() if ready else b""
            if not line:
                self.close()
                return "failed", "could not start: the server of children was lost"
            result = json.loads(line)["result"]
        except OSError as e:
            self.close()
            return "failed", f"could not start: {e}"
        return ("failed" if result.startswith("could not start") else "completed"), result

    def close(self) -> None:
        if self.server is not None:
            self.server.kill()
            self.server.communicate()
            self.server = None

    def __enter__(self) -> Children:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def run_program(program: str, seconds: float = 3.0, memory_mb: int = MEMORY_MB) -> tuple[str, str]:
    """Children.run() of a single program."""
    with Children(seconds, memory_mb) as children:
        return children.run(program)


def score_code(rows: DataFrame, allow_code_execution: bool = False, seconds: float = 3.0, text: str = "gen", test: str = "answer") -> DataFrame:
    """rows with code, passed, status and result; candidates run in turn until one passes.

    A blank test harness, an error or a missing generation is failed; an empty generation is completed and
    wrong. A completed candidate outweighs one whose child could not be started.
    """
    if not allow_code_execution:
        raise PermissionError("scoring code runs model-written programs; pass allow_code_execution=True to allow it")
    columns = set(rows.columns)
    optional = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    coded = extract_code(rows, text).withColumn("__programs", check_programs(F.coalesce(optional("prompt"), F.lit("")), F.col("code"), F.col(test), optional("prompt_mode")))
    failed = (F.coalesce(F.trim(F.col(test)), F.lit("")) == "") | F.col(text).isNull() | (F.coalesce(optional("error"), F.lit("")) != "")
    coded = coded.withColumn("__run", ~failed & (F.col("code") != ""))
    names = [f.name for f in rows.schema] + ["code"]
    schema = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in names)
    coded = coded.withColumn("__failed", failed)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Children(seconds) as children:
            yield from judged(frames, children)

    def judged(frames: Iterable[pd.DataFrame], children: Children) -> Iterator[pd.DataFrame]:
        for frame in frames:
            outcomes = []
            for programs, go, broken in zip(frame["__programs"], frame["__run"], frame["__failed"]):
                if broken or not go:
                    outcomes.append((False, "failed" if broken else "completed", "not scorable" if broken else "no code"))
                    continue
                tried = []
                for p in programs:
                    tried.append(children.run(p["program"]))
                    if tried[-1] == ("completed", "passed"):
                        break
                status, result = min(tried, key=lambda t: (t[1] != "passed", t[0] != "completed"))
                outcomes.append((result == "passed", status, result))
            out = frame[names].copy()
            out["passed"], out["status"], out["result"] = zip(*outcomes) if outcomes else ((), (), ())
            yield out

    return coded.mapInPandas(run, f"{schema}, passed boolean, status string, result string")


def task_rollup(scored: DataFrame, task: str = "task_id") -> DataFrame:
    """One row per task: n, c, and whether it counts (complete, and every sample completed)."""
    return scored.groupBy(task).agg(F.count("*").cast("int").alias("n"), F.count_if("passed").cast("int").alias("c"), F.bool_and(F.col("complete") & (F.col("status") == "completed")).alias("counts"))


def pass_at_k_metrics(tasks: DataFrame, ks: Sequence[int] = (1,)) -> DataFrame:
    """(k, tasks, pass_at_k): the mean estimate over counting tasks with k samples or more; k = 1 is always there."""
    wanted = sorted({1, *ks})
    rows = tasks.filter("counts").select("n", "c", F.explode(F.array(*[F.lit(k) for k in wanted])).alias("k")).filter("n >= k")
    found = rows.groupBy("k").agg(F.count("*").alias("tasks"), F.avg(pass_at_k(F.col("n"), F.col("c"), F.col("k"))).alias("pass_at_k"))
    one = tasks.sparkSession.createDataFrame([(1,)], "k int")
    whole = found.join(one, "k", "full_outer")
    return whole.select("k", F.coalesce("tasks", F.lit(0)).alias("tasks"), F.coalesce("pass_at_k", F.lit(0.0)).alias("pass_at_k"))


def code_counts(scored: DataFrame, task: str = "task_id") -> DataFrame:
    """One row: sample, effective, failed and excluded counts; completed samples of tasks that do not count are excluded."""
    done = F.col("status") == "completed"
    marked = scored.join(task_rollup(scored, task).select(task, "counts"), task)
    return marked.agg(F.count("*").alias("sample_count"), F.count_if(done & F.col("counts")).alias("effective_count"), F.count_if(~done).alias("failed_count"), F.count_if(done & ~F.col("counts")).alias("excluded_count"))
