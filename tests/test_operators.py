import hashlib
import itertools
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import expressions
from lumenfold.functions.estimators import argmax, binomial, majority, pass_at_k
from lumenfold.operators import code_answers, inference, math_answers, metrics, multiple_choice, preparation, requests, samples
from lumenfold.plans import registry, runner, settings
from lumenfold.plans.registry import Options, evaluate, first_failures, summary_table
from lumenfold.sources import committed, jsonl
from lumenfold.streaming import outputs


@pytest.mark.parametrize("n,c,k,want", [(1, 1, 1, 1.0), (1, 0, 1, 0.0), (2, 1, 1, 0.5), (2, 1, 2, 1.0), (3, 0, 2, 0.0), (5, 1, 5, 1.0), (5, 0, 5, 0.0), (0, 0, 1, None), (5, -1, 1, None), (2, 3, 1, None), (2, 1, 0, None), (2, 1, 3, None)])
def test_pass_at_k(spark, n, c, k, want):
    assert spark.createDataFrame([(n, c, k)], "n int, c int, k int").select(pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("x")).first().x == want


def test_argmax_and_majority(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],), ([float("-inf")],), ([float("nan"), 1.0],), ([],)], "a array<double>")
    assert [r.x for r in df.select(argmax(F.col("a")).alias("x")).collect()] == [1, None, None, None]
    df = spark.createDataFrame([(["b", "a", "a", "b"],), (["", "a"],), ([],)], "a array<string>")
    assert [r.x for r in df.select(majority(F.col("a")).alias("x")).collect()] == ["b", "", None]


def lowest_unused(given):
    used, out = {i for i in given if i is not None}, []
    for i in given:
        if i is None:
            i = next(k for k in itertools.count() if k not in used)
            used.add(i)
        out.append(i)
    return out


def test_sample_indexes_against_a_loop(spark):
    rng = random.Random(3)
    groups = {f"p{g}": [rng.choice([None, i]) for i in rng.sample(range(9), rng.randint(1, 6))] for g in range(60)}
    rows = [(p, o, i) for p, given in groups.items() for o, i in enumerate(given)]
    found = samples.assign_sample_index(spark.createDataFrame(rows, "problem string, ordinal int, sample_index int")).collect()
    got = {p: [r.sample_index for r in sorted((r for r in found if r.problem == p), key=lambda r: r.ordinal)] for p in groups}
    assert got == {p: lowest_unused(g) for p, g in groups.items()}


def numbered(spark, rows):
    return spark.createDataFrame(rows, "problem string, ordinal int, sample_index int, n_samples int, answer string")


def test_normalize_orders_samples_in_their_slots(spark):
    rows = [("a", 0, 1, None, "x"), ("b", 1, None, None, "y"), ("a", 2, 0, None, "x")]
    found = samples.normalize_samples(numbered(spark, rows), ["answer"]).orderBy("ordinal").collect()
    assert [(r.problem, r.ordinal, r.sample_index, r.n_samples, r.complete) for r in found] == [("a", 0, 0, 2, True), ("b", 1, 0, 1, True), ("a", 2, 1, 2, True)]
    gap = samples.normalize_samples(numbered(spark, [("a", 0, 0, None, "x"), ("a", 1, 2, None, "x")]), ["answer"]).collect()
    assert [(r.n_samples, r.complete) for r in gap] == [(3, False)] * 2


@pytest.mark.parametrize("rows", [
    [("a", 0, 0, None, "x"), ("a", 1, 0, None, "x")], [("a", 0, -1, None, "x")], [("a", 0, 2, 2, "x")], [("a", 0, 0, 1, "x"), ("a", 1, 1, 2, "x")], [("a", 0, 0, None, "x"), ("a", 1, 1, None, "y")],
    [("a", 0, 0, None, "x"), ("a", 1, 1, None, None)],
])
def test_normalize_refuses(spark, rows):
    with pytest.raises(Exception, match="sample index|conflicting"):
        samples.normalize_samples(numbered(spark, rows), ["answer"]).collect()


def test_loglikelihood(spark):
    rows = [(1, [-1.0, -0.5, -2.0]), (1, [-0.5, -0.1, None]), (5, [-1.0]), (0, []), (0, [float("nan")])]
    found = multiple_choice.score_loglikelihood(spark.createDataFrame(rows, "gold int, logprobs array<double>")).collect()
    assert [(r.prediction, r.status) for r in found] == [(1, "completed"), (1, "completed"), (None, "failed"), (None, "failed"), (None, "failed")]


def merged(spark, gens, gold="B", complete=True, indexes=None):
    row = ("q", gens, [None] * len(gens), indexes or list(range(len(gens))), len(gens), complete, gold)
    return spark.createDataFrame([row], "problem string, gens array<string>, errors array<string>, indexes array<int>, n_samples int, complete boolean, gold string")


@pytest.mark.parametrize("aggregation,acc", [("first", 0.0), ("majority_vote", 1.0), ("any_correct", 1.0), ("per_sample", 2 / 3)])
def test_generated_choices(spark, aggregation, acc):
    found = multiple_choice.accuracy_summary(multiple_choice.score_generations(merged(spark, ["Answer: A", "Answer: B", "B"]), aggregation)).first()
    assert found.acc == pytest.approx(acc)
    assert found.sample_count == (3 if aggregation == "per_sample" else 1) == found.effective_count


@pytest.mark.parametrize("aggregation", ["first", "majority_vote", "any_correct"])
def test_letters_as_arrays(spark, aggregation):
    kinds = [["B", "A", "A", ""], ["", "C", "B"], ["", ""], ["B", None], ["A", "D", "D", "A"]]
    rows = [(f"q{k}{gold}{start}", i + start, g, "lost" if (k, i, start) == (4, 1, 1) else None, k != 1, gold) for k, gens in enumerate(kinds) for gold in ("B", "D", "", None) for start in (0, 1) for i, g in enumerate(gens)]
    df = spark.createDataFrame(rows, "problem string, sample_index int, gen string, error string, complete boolean, gold string")
    columns = ["problem", "prediction", "status", "correct", "weight", "correct_weight", "eligible"]
    want = multiple_choice.score_generations(multiple_choice.merge_samples(df.withColumn("n_samples", F.lit(4))), aggregation).select(columns).collect()
    got = multiple_choice.score_letters(multiple_choice.with_letters(df), aggregation).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 40


def evaluated(spark, rows, aggregation, schema="doc_id string, sample_index int, answer string, gen string, error string, choices array<string>"):
    return registry.evaluate(spark.createDataFrame(rows, schema), "mc/x", registry.Options(aggregation=aggregation, resamples=0))


def test_per_sample_gives_an_observation_for_each_sample(spark):
    rows = [("p", 0, "B", "A", None, None), ("p", 1, "B", "B", None, None), ("p", 2, "B", "A", None, None), ("q", 0, "A", "A", None, None)]
    found = evaluated(spark, rows, "per_sample")
    assert (found["metrics"]["acc"]["value"], found["metrics"]["acc"]["count"], found["sample_count"]) == (0.5, 4, 4)


def test_lost_samples_fail_alone(spark):
    rows = [("q0", 0, "B", "Answer: B", None, None), ("q0", 1, "B", "", "context_length_exceeded", None)]
    each, first = evaluated(spark, rows, "per_sample"), evaluated(spark, rows, "first")
    assert (each["metrics"]["acc"]["value"], each["sample_count"], each["effective_count"], each["failed_count"]) == (1.0, 2, 1, 1)
    assert (first["metrics"]["acc"]["value"], first["effective_count"]) == (1.0, 1)
    swapped = [("q0", 1, "B", "Answer: B", None, None), ("q0", 0, "B", "", "context_length_exceeded", None)]
    first = evaluated(spark, swapped, "first")
    assert (first["effective_count"], first["failed_count"]) == (0, 1)


@pytest.mark.parametrize("answer,choices,gen,acc,failed", [("invalid", None, "Answer: A", 0.0, 1), ("1", ["a", "b"], "Answer: A", 1.0, 0), ("2", ["a", "b"], "Answer: B", 1.0, 0), ("5", ["a", "b"], "Answer: A", 0.0, 1), ("Paris", ["London", "Paris"], "Answer: B", 1.0, 0), ("A", None, None, 0.0, 1)])
def test_golds_of_choices(spark, answer, choices, gen, acc, failed):
    found = evaluated(spark, [("q", None, answer, gen, None, choices)], "first")
    assert (found["metrics"]["acc"]["value"], found["failed_count"], found["sample_count"]) == (acc, failed, 1)


def test_incomplete_problems_are_listed(spark):
    df = spark.createDataFrame([("x", 0, 2, "4", "4"), ("y", 0, 1, "4", "4")], "doc_id string, sample_index int, n_samples int, answer string, gen string")
    found = registry.evaluate(df, "math_opensource", registry.Options(resamples=0))
    assert found["details"] == {"complete_problem_count": 1, "incomplete_problem_count": 1, "incomplete_problem_ids": ["x"]}


def test_places_in_groups(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i) for i in range(400)]
    found = requests.number_rows(spark.createDataFrame(rows, "g string, i int").repartition(5), F.col("i"), "at", "g").collect()
    want = {i: sum(h == g and j < i for h, j in rows) for g, i in rows}
    assert {r.i: r["at"] for r in found} == want and len(found) == 400


def test_incomplete_questions_are_excluded(spark):
    found = multiple_choice.accuracy_summary(multiple_choice.score_generations(merged(spark, ["B"], complete=False), "any_correct")).first()
    assert tuple(found) == (0.0, 1, 0, 0, 1)
    found = multiple_choice.accuracy_summary(multiple_choice.score_generations(merged(spark, ["B"], indexes=[1]), "first")).first()
    assert tuple(found) == (0.0, 1, 0, 0, 1)


def test_math_result(spark):
    rows = [(p, i, 3, "4", g) for p, answers in (("x", ["4", "4", "5"]), ("y", ["\\boxed{4.0}", "6", "6"])) for i, g in enumerate(answers)]
    df = spark.createDataFrame(rows, "doc_id string, sample_index int, n_samples int, answer string, gen string")
    result = registry.evaluate(df, "math_opensource/aime24", registry.Options(resamples=20))
    value = {k: v["value"] for k, v in result["metrics"].items()}
    assert value == {"accuracy": 0.5, "problem_pass@3": 1.0, "problem_majority@3": 0.5}
    assert result["sample_count"] == 6 and registry.primary_value(result) == 0.5
    json.dumps(result, allow_nan=False)


def test_incomplete_math_problem(spark):
    df = spark.createDataFrame([("x", 0, 2, "4", "4")], "doc_id string, sample_index int, n_samples int, answer string, gen string")
    metrics_ = registry.evaluate(df, "math_opensource", registry.Options(resamples=0))["metrics"]
    assert metrics_["accuracy"]["value"] == 1.0
    assert metrics_["problem_pass@2"] == {"value": 0.0, "count": 0, "stderr": None, "ci_low": None, "ci_high": None}


def test_math_statuses(spark):
    rows = [("4", "4", None), ("4", None, None), ("4", "", None), ("4", "4", "lost"), ("", "4", None), ("1/2", "0.5", None), ("1/3", "\\frac{1}{3}", None), ("50\\%", "0.5", None)]
    found = math_answers.score_answers(spark.createDataFrame(rows, "answer string, gen string, error string"), error="error").collect()
    assert [(r.status, r.accuracy) for r in found] == [("completed", 1.0), ("failed", 0.0), ("completed", 0.0), ("failed", 0.0), ("failed", 0.0), ("completed", 1.0), ("completed", 1.0), ("completed", 1.0)]


def test_verifiers_that_raise_fail_their_row(spark):
    def verify(gold, answer):
        raise RuntimeError("no")

    df = spark.createDataFrame([("4", "5"), ("4", "4"), ("4", "x")], "answer string, gen string")
    found = math_answers.score_answers(df, verify=verify).collect()
    assert [(r.status, r.accuracy) for r in found] == [("failed", 0.0), ("completed", 1.0), ("completed", 0.0)]


def test_huge_exponents_are_no_numbers():
    assert expressions.number_of("1e99999999") is None and expressions.number_of("1e3") == 1000 and expressions.number_of("9" * 5000) is None


def test_greedy_clusters(spark):
    near = lambda a, b: abs(float(a) - float(b)) <= 1
    rows = [("p", i, f, a) for i, (f, a) in enumerate([("1", 0.0), ("2", 1.0), ("3", 0.0), ("4", 0.0), ("Timeout", 0.0)])]
    df = spark.createDataFrame(rows, "problem string, sample_index int, prediction string, accuracy double")
    df = df.withColumns({"status": F.lit("completed"), "n_samples": F.lit(5), "complete": F.lit(True)})
    found = math_answers.problem_rollup(df, same=near).first()
    assert (found.majority, found.majority_right, found.complete, found.k) == ("1", 1.0, True, 5)
    assert math_answers.problem_rollup(df).first().majority == "1"


def test_votes_are_joined_as_samples_would_be(spark):
    near = lambda a, b: abs(float(a) - float(b)) <= 1
    source, rows, want = random.Random(5), [], {}
    for p in range(30):
        clusters = []
        for i in range(12):
            form, right = str(source.randint(0, 9)), source.random() < 0.3
            rows.append((f"p{p}", i, form, float(right), "completed", 12, True))
            mine = next((c for c in clusters if near(c[0], form)), None) or clusters.append([form, 0, 0.0]) or clusters[-1]
            mine[1:] = [mine[1] + 1, max(mine[2], float(right))]
        want[f"p{p}"] = tuple(max(clusters, key=lambda c: c[1])[::2])
    df = spark.createDataFrame(rows, "problem string, sample_index int, prediction string, accuracy double, status string, n_samples int, complete boolean")
    assert {r.problem: (r.majority, r.majority_right) for r in math_answers.problem_rollup(df, same=near).collect()} == want


def test_majority_of_equal_answers_in_results(spark):
    rows = [("a", "1/2", g, None) for g in ("0.5", "\\boxed{\\frac{1}{2}}", "3", "3")] + [("b", "2", g, e) for g, e in (("Error: x", None), ("Timeout", None), ("2", None), ("7", None))]
    result = evaluate(spark.createDataFrame(rows, "doc_id string, answer string, gen string, error string").coalesce(1), "math_opensource/x", Options(resamples=0))
    assert result["metrics"]["problem_majority@4"]["value"] == 1.0 and result["metrics"]["accuracy"]["value"] == 3 / 8


EQUAL = [
    ("x+1", "1+x"), (r"\sqrt{8}", r"2\sqrt{2}"), ("(a+b)^2", "a^2+2ab+b^2"), (r"\frac{1}{2}", "0.5"), ("0.333333333", r"\frac{1}{3}"), (r"x\sqrt{8}", r"2x\sqrt2"), (r"\frac12", "1/2"),
    (r"\left(1,\frac{1}{2}\right)", "(1,0.5)"), ("[1,2)", "[1, 2.0)"), (r"\{2,1\}", r"\{1,2\}"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"2\pi r", r"2r\pi"), ("1,2", "2,1"), ("1,000", "1000"),
    (r"(-\infty,2)\cup(3,\infty)", r"(3,\infty)\cup(-\infty,2)"), (r"2\frac{1}{2}", "2.5"), (r"\sqrt[3]{8}", "2"), (r"x^{1/2}x^{1/2}", "x"), (r"\sqrt{4x}", r"2\sqrt{x}"), (r"\sqrt{-4}", "2i"),
    (r"\sin^2(x)", r"\sin(x)\sin(x)"), ("-x^2", "-(x^2)"), ("x_1+x_2", "x_{2}+x_{1}"), (r"y(1+\sqrt2)^2", r"(3+2\sqrt2)y"), (r"y\sqrt6", r"y\sqrt2\sqrt3"), (r"50\%", "0.5"), ("3!", "6"),
]
DIFFERENT = [
    ("x+1", "x+2"), (r"\sqrt{8}", r"2\sqrt{3}"), ("(a+b)^2", "a^2+b^2"), ("(1,2)", "(2,1)"), ("[1,2)", "(1,2)"), (r"\{1,2\}", r"\{1,3\}"), ("12", "1,2"), ("x", "y"), ("-x^2", "(-x)^2"), ("cat", "act"),
    (r"\pi", "3.14"), (r"\frac{1}{0}", "0"), ("2x", "x^2"), ("1.000001", "1.000002"), ("", "0"), ("x^", "x"),
]


@pytest.mark.parametrize("pairs,right", [(EQUAL, 1.0), (DIFFERENT, 0.0)])
def test_answers_by_key(spark, pairs, right):
    rows = spark.createDataFrame([(a, b) for a, b in pairs] + [(b, a) for a, b in pairs if b], "a string, b string")
    found = rows.select("a", "b", (expressions.key(F.col("a")) == expressions.key(F.col("b"))).cast("double").alias("same")).collect()
    assert [(r.a, r.b) for r in found if r.same != right] == []


def test_keys_agree_with_and_without_python(spark):
    forms = ["0", "-0", "-0.0", "5.10", "0.0000005", "0.0000015", "1.0000025", "-2.5000005", "123456789012345.123456789012345", "00012", "7.", "words only", "", "999999999999999.9999999"]
    found = spark.createDataFrame([(f,) for f in forms], "f string").select("f", expressions.key(F.col("f")).alias("k")).collect()
    assert {r.f: r.k for r in found} == {f: expressions.answer_key(f) if f != "words only" else "s:words only" for f in forms}


@pytest.mark.parametrize("text", ["2^{2^{2^{2^{2^{9}}}}}", "(" * 300 + "x" + ")" * 300, "9" * 5000, "x^{1999}" * 40, "e^{e^{e^{e^9}}}", "-" * 390 + "1", "\\sqrt" * 60 + "2", "1000!!", "{" * 10, "\\", "\\frac", "()", ",", "x^", "1e999999"])
def test_keys_take_bounded_time(text):
    began = time.time()
    assert expressions.answer_key(text) and time.time() - began < 0.5



@pytest.mark.parametrize("program,result", [("assert 1", "passed"), ("assert 0", "failed"), ("while True: pass", "timed out"), ("import signal; signal.raise_signal(11)", "died of signal 11"), ("x = bytearray(1 << 33)", "failed: MemoryError"), ("open('f', 'wb').write(b'0' * (1 << 21))", "")])
def test_programs_in_children(program, result):
    status, found = code_answers.run_program(program, seconds=2)
    assert status == "completed" and (found.startswith(result) if result else found != "passed")


@pytest.mark.parametrize("program", [
    "import os; os._exit(0)", "import posix; posix._exit(0)", "import sys; sys.exit(0)", "exit()", "raise SystemExit", "import os; os.kill(os.getppid(), 9)", "import os; os.fork()", "import os; os.system('true')",
    "import subprocess", "import ctypes", "import socket", "import urllib.request", "from multiprocessing import Pool", "import shutil; shutil.rmtree('.')", "open('/etc/passwd')", "import io; io.open('x', 'w')",
    "import os; os.remove('x')", "import os; os.execv('/bin/true', ['true'])", "import os; os.posix_spawn('/bin/true', ['true'], {})", "input()", "import os; os.listdir('/')", "import resource",
])
def test_ways_out_are_refused(program):
    with code_answers.Children(2) as children:
        assert children.run("x = 1") == ("completed", "passed")
        status, result = children.run(program)
        assert status == "completed" and result.startswith("failed")
        assert children.run("assert [i for i in range(3)] == [0, 1, 2]") == ("completed", "passed")


def test_children_are_kept_apart_and_quick():
    with code_answers.Children(2) as children:
        assert children.run("import builtins, sys; builtins.x = 1; sys.modules['json'] = None") == ("completed", "passed")
        assert children.run("import json; x")[1].startswith("failed: NameError") and children.run("import json") == ("completed", "passed")
        began = time.time()
        assert all(children.run(f"assert {i} + 1 == {i + 1}")[1] == "passed" for i in range(100))
        assert time.time() - began < 5
        children.server.kill()
        assert children.run("x = 1")[1] in ("passed", "could not start: the server of children was lost") and children.run("x = 1") == ("completed", "passed")


def test_code_result(spark):
    rows = [("t", 0, 2, "\nassert f() == 1", "def f():\n    return 0"), ("t", 1, 2, "\nassert f() == 1", "def f():\n    return 1")]
    df = spark.createDataFrame(rows, "task_id string, sample_index int, n_samples int, answer string, gen string").withColumn("prompt_mode", F.lit("mbpp"))
    with pytest.raises(PermissionError):
        registry.evaluate(df, "code/mbpp")
    result = registry.evaluate(df, "code/mbpp", registry.Options(ks=(2,), allow_code_execution=True, resamples=0))
    assert {k: v["value"] for k, v in result["metrics"].items()} == {"pass@1": 0.5, "pass@2": 1.0}
    assert (result["sample_count"], result["effective_count"]) == (2, 2)


def test_registry_refuses_unknown_and_mixed(spark):
    with pytest.raises(KeyError):
        registry.resolve("nothing/x")
    df = spark.createDataFrame([("A", [-1.0], "A", 0), ("A", None, "A", 0)], "answer string, logprobs array<double>, gen string, gold int")
    with pytest.raises(ValueError, match="logprobs"):
        registry.evaluate(df, "mc/mmlu")


def test_bootstrap(spark):
    df = spark.createDataFrame([("m", float(v), i) for i, v in enumerate([0, 1, 1, 0])], "metric string, value double, ordinal long")
    a, b, c = (metrics.exact_bootstrap(df, seed=s).first() for s in (7, 7, 8))
    assert a == b != c and (a.value, a["count"]) == (0.5, 4)
    assert metrics.exact_bootstrap(df, resamples=1).first().stderr is None
    found = metrics.bootstrap(df, 200).first()
    assert found.value == 0.5 and 0.1 < found.stderr < 0.4 and found.ci_low < 0.5 < found.ci_high
    assert metrics.bootstrap(df.limit(0)).first().value == 0.0
    two = df.unionByName(df.select(F.lit("z").alias("metric"), (F.col("value") + 1).alias("value"), "ordinal"))
    by = {r.metric: r for r in metrics.bootstrap(two, 200, by="metric").collect()}
    assert by["m"].stderr == pytest.approx(found.stderr) and by["z"].value == 1.5 and by["z"].ci_low == pytest.approx(found.ci_low + 1)
    many = spark.range(2000).selectExpr("cast(id % 2 as double) as value")
    assert metrics.bootstrap(many, 300).first().stderr == pytest.approx(0.5 / 2000**0.5, rel=0.15)


def test_bootstrap_of_many_values_and_odd_ones(spark):
    rows = spark.range(3000).selectExpr("cast(id as double) as value").unionByName(spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "value double"))
    found = metrics.bootstrap(rows, 100).first()  # more values than a block holds
    assert found.value == 1499.5 and found["count"] == 3002 and found.stderr == pytest.approx((3000**2 / 12) ** 0.5 / 3000**0.5, rel=0.3)
    one = metrics.bootstrap(spark.createDataFrame([(0.25,)], "value double"), 50).first()
    assert (one.value, one.stderr, one.ci_low, one.ci_high) == (0.25, 0.0, 0.25, 0.25)


def test_equal_metrics_are_resampled_once(spark):
    rows = spark.createDataFrame([(m, v) for m in "abc" for v in ([0.0, 1.0, 1.0] if m != "b" else [1.0, 1.0, 1.0])], "metric string, value double")
    found = {r.metric: tuple(r)[1:] for r in metrics.bootstrap(rows.orderBy(F.rand(3)), 60, by="metric").collect()}
    assert found["a"] == found["c"] != found["b"] and found["b"][2:] == (0.0, 1.0, 1.0)
    blocks = metrics.histograms(rows, ["metric"], "value")
    assert metrics.resampled_once(blocks, "metric").select("metric", F.array_sort("__all").alias("of")).orderBy("metric").collect() == [("a", ["a", "c"]), ("b", ["b"])]


@pytest.mark.parametrize("n,p", [(1, 0.5), (40, 0.02), (40, 0.9), (500, 0.5), (10_000, 0.001), (10_000, 0.6)])
def test_binomial_quantiles(spark, n, p):
    draws = spark.range(2000).select(binomial(F.lit(float(n)), F.lit(p), (F.col("id") + 0.5) / 2000.0).alias("k")).agg(F.avg("k").alias("m"), F.var_pop("k").alias("v"), F.min("k").alias("a"), F.max("k").alias("b")).first()
    assert draws.m == pytest.approx(n * p, rel=0.01, abs=0.01) and draws.v == pytest.approx(n * p * (1 - p), rel=0.05) and 0 <= draws.a <= draws.b <= n
    assert spark.range(1).select(binomial(F.lit(7.0), F.lit(1.0), F.lit(0.3)).alias("k")).first().k == 7.0


@pytest.mark.parametrize("counts,fine", [((3, 1, 1, 1), True), ((3, 1, 1, 0), False), ((1, 2, -1, 0), False), ((True, 1, 0, 0), False), ((1.0, 1, 0, 0), False)])
def test_counts(counts, fine):
    row = dict(zip(("sample_count", "effective_count", "failed_count", "excluded_count"), counts))
    if fine:
        metrics.check_counts(row)
    else:
        with pytest.raises(ValueError):
            metrics.check_counts(row)


def test_manifest_counts(spark):
    rows = [("q1", 0, 2), ("q1", 0, 2), ("q3", 0, 2), ("q2", 5, 2), (None, None, None)]
    found = requests.reconcile(spark.createDataFrame([("q1",), ("q2",)], "doc_id string"), spark.createDataFrame(rows, "doc_id string, sample_index int, n_samples int"), 2).first()
    assert (found.missing, found.unexpected, found.duplicates) == (3, 3, 1)


def test_few_shot_is_stable_and_never_the_question(spark):
    pool = spark.createDataFrame([(str(i), f"P{i}", "A") for i in range(5)], "doc_id string, prompt string, answer string")
    q = spark.createDataFrame([("0", "P0"), ("9", "other"), ("8", "more")], "doc_id string, prompt string")
    once, again = ({r.doc_id: r.prefix for r in requests.few_shot_prefixes(q, pool, 2, 9).collect()} for _ in range(2))
    assert once == again and "P0" not in once["0"] and len(set(once.values())) > 1
    with pytest.raises(Exception, match="too few"):
        requests.few_shot_prefixes(q, pool, 5).collect()


def test_length_filter(spark):
    df = spark.createDataFrame([("a b c d e", "x boxed{ z"), ("a", "none")], "prompt string, gen string")
    found = preparation.length_filter(df, 8).collect()
    assert [(r.total_length, r.has_boxed, r.keep) for r in found] == [(8, True, True), (2, False, False)]
    assert preparation.kept_generations(df, 8).columns == ["prompt", "prompt_length", "gen_length", "total_length", "has_boxed"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "x", "n": 1, "gen": ["g"]}\n\n{"doc_id": 3, "n": true, "gen": []}\n{"n": 1.0, "gen": ["a", "b"]}\n')
    rows = jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    raw = F.col("raw")
    found = rows.orderBy("ordinal").select(jsonl.field(raw, "doc_id"), jsonl.field(raw, "n", "int"), jsonl.single_generation(raw)).collect()
    assert [tuple(r) for r in found] == [("x", 1, "g"), (None, None, ""), (None, None, None)]
    for bad, fault in ((b"[1]", "not a JSON object"), (b'{"a": NaN}', "invalid JSON"), (b"{", "invalid JSON"), (b'{"a": "\xff"}', "invalid UTF-8")):
        (tmp_path / "b.jsonl").write_bytes(b'{"ok": 1}\n \n' + bad + b"\n")
        with pytest.raises(Exception, match=fault):
            jsonl.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
        assert jsonl.read_jsonl(spark, str(tmp_path / "b.jsonl"), strict=False).count() == 1
        assert [(r.line, r.fault) for r in jsonl.line_faults(spark, str(tmp_path / "b.jsonl")).collect()] == [(3, fault)]
    (tmp_path / "b.jsonl").write_text('{"gen": "a", "gen": "b"}\n')
    assert [r[0] for r in jsonl.read_jsonl(spark, str(tmp_path / "b.jsonl")).select(jsonl.field(raw, "gen")).collect()] == ["b"]


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "d").mkdir()
    wrong = {"a": [1, 700, 2999, 3000], "b": [1500]}
    for name, at in wrong.items():
        lines = [b"{" if i in at else b"" if i % 7 == 0 else b'{"n": %d}' % i for i in range(1, 3001)]
        (tmp_path / "d" / name).write_bytes(b"\n".join(lines) + b"\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = jsonl.line_faults(spark, str(tmp_path / "d")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted((r.file[-1], r.line) for r in found) == sorted((k, i) for k, at in wrong.items() for i in at)


def test_interrupted_output(spark, tmp_path):
    path = tmp_path / "o.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert jsonl.read_resumable(spark, str(path)).count() == 2 and path.read_text().endswith('{"a": ')
    for text, told in (
        (b'{"a": 1}\n{"a": \n{"a": 2}\n', "invalid JSON in .* at line 2"), (b'{"a": 1}\nbroken\n', "invalid JSON in .* at line 2"), (b'{"a": 1}\n\n[1]', "not a JSON object in .* at line 3"),
        (b'{"a": 1}\n{"a": "\xff"}\n{"a": ', "invalid UTF-8 in .* at line 2"), (b'{"a": "\xff"}\n', "invalid UTF-8 in .* at line 1"), (b'{"a": NaN}\n{}', "invalid JSON in .* at line 1"),
    ):
        path.write_bytes(text)
        with pytest.raises(ValueError, match=told):
            jsonl.read_resumable(spark, str(path), repair=True)
        assert path.read_bytes() == text


@pytest.mark.parametrize("text,left", [
    (b'{"a": 1}\n{"a": ', b'{"a": 1}\n'), (b'{"a": 1}\n{"a": "\xe4\xb8', b'{"a": 1}\n'), (b'{"a": 1}', b'{"a": 1}\n'), (b'{"a": 1}\n', b'{"a": 1}\n'), (b'{"a', b""), (b'{"a": 1}\n  ', b'{"a": 1}\n  \n'),
    (b'{"a": "' + b"x" * 100_000 + b'"}\n{"b": "' + b"y" * 150_000, b'{"a": "' + b"x" * 100_000 + b'"}\n'),
])
def test_ends_of_interrupted_files_are_put_right(spark, tmp_path, text, left):
    (tmp_path / "o").mkdir()
    path = tmp_path / "o" / "part 1"
    path.write_bytes(text)
    (tmp_path / "o" / "part-2").write_bytes(b'{"a": 9}\n')
    assert jsonl.read_resumable(spark, str(tmp_path / "o"), repair=True).count() == (2 if b"1}" in left or b"x" in left else 1)
    assert path.read_bytes() == left and (tmp_path / "o" / "part-2").read_bytes() == b'{"a": 9}\n'


def test_questions_are_named_by_their_places(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/b.jsonl").write_text("".join(f'{{"prompt": "b{i}", "answer": {i}}}\n' for i in range(3)))
    (tmp_path / "q/a.jsonl").write_text("".join(f'{{"prompt": "a{i}", "answer": "{"x" * 50}"}}\n' for i in range(40)))
    found = jsonl.load_questions(spark, str(tmp_path / "q"), "set").orderBy("ordinal").collect()
    assert [r.prompt for r in found] == [*(f"a{i}" for i in range(40)), *(f"b{i}" for i in range(3))]
    assert [r.doc_id for r in found] == [f"set:{i}" for i in range(43)]


def test_summary_files(spark, tmp_path):
    jsonl.write_summary(spark, str(tmp_path / "s.json"), {"a": 0})
    jsonl.write_summary(spark, str(tmp_path / "s.json"), {"a": 1})
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1}
    with pytest.raises(ValueError):
        jsonl.write_summary(spark, str(tmp_path / "s.json"), {"a": float("nan")})


def test_manifests_hold_ids_in_order(spark, tmp_path):
    path = str(tmp_path / "m")
    q = spark.createDataFrame([(f"q{(7 * i) % 50}", i) for i in range(50)], "doc_id string, ordinal int").repartition(5)
    assert committed.write_manifest(q, path, 2) and committed.write_manifest(q.repartition(2), path, 2)
    ids, n = committed.read_manifest(spark, path)
    assert [r.doc_id for r in ids.orderBy("place").collect()] == [f"q{(7 * i) % 50}" for i in range(50)] and n == 2
    other = [(q, 3), (q.withColumn("ordinal", -F.col("ordinal")), 2), (q.filter("ordinal < 49"), 2), (q.withColumn("doc_id", F.concat("doc_id", F.lit("x"))), 2)]
    for rows, depth in other:
        with pytest.raises(ValueError, match="another run"):
            committed.write_manifest(rows, path, depth)
    for rows, told in ((q.withColumn("doc_id", F.lit("a")), "repeated"), (q.withColumn("doc_id", F.lit(" ")), "blank"), (q.withColumn("doc_id", F.lit(None).cast("string")), "missing")):
        with pytest.raises(ValueError, match=told):
            committed.write_manifest(rows, str(tmp_path / "n"), 2)
    for depth in (0, True, 1.0):
        with pytest.raises(ValueError, match="positive"):
            committed.write_manifest(q, str(tmp_path / "n"), depth)


def test_manifests_are_checked_when_read(spark, tmp_path):
    path = str(tmp_path / "m")
    for rows, n, told in (([(0, "a"), (2, "b")], 1, "gaps"), ([(0, "a"), (1, "a")], 1, "repeated"), ([(0, " ")], 1, "blank"), ([(0, "a")], 0, "n_samples"), ([(0, "a")], True, "n_samples")):
        committed.commit(spark.createDataFrame(rows, "place long, doc_id string"), path, n_samples=n)
        with pytest.raises(ValueError, match=told):
            committed.read_manifest(spark, path)
    with pytest.raises(FileNotFoundError):
        committed.read_manifest(spark, str(tmp_path / "none"))
    jsonl.write_text_atomically(spark, f"{path}/{committed.POINTER}", "[1]")
    with pytest.raises(ValueError, match="broken"):
        committed.read_manifest(spark, path)


def test_outputs_without_a_manifest_go_on_without_one(spark, tmp_path):
    q = spark.createDataFrame([("a",)], "doc_id string")
    (tmp_path / "out").mkdir()
    assert committed.write_manifest(q, str(tmp_path / "m1"), 1, str(tmp_path / "out"))  # nothing was written yet
    (tmp_path / "out" / "part").write_text("{}\n")
    assert not committed.write_manifest(q, str(tmp_path / "m2"), 1, str(tmp_path / "out")) and not (tmp_path / "m2").exists()


def test_a_crash_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda x: spark.createDataFrame([(x,)], "x string")
    seen = lambda: committed.read(spark, path).first().x
    committed.commit(rows("old"), path)

    def crash(*_):
        raise RuntimeError("crash")

    with pytest.raises(RuntimeError):
        committed.commit(rows("bad"), path, check=crash)
    assert seen() == "old"
    monkeypatch.setattr(committed, "write_text_atomically", crash)  # after the files, before the pointer
    with pytest.raises(RuntimeError):
        committed.commit(rows("new"), path)
    assert seen() == "old"
    monkeypatch.undo()
    held = committed.read(spark, path)
    committed.commit(rows("new"), path)
    assert seen() == "new" and held.first().x == "old"  # who reads the version before goes on
    committed.commit(rows("newer"), path)
    assert seen() == "newer" and len(list((tmp_path / "t").glob("v-*"))) == 2


def test_generation(spark):
    class Echo:
        def generate(self, prompt, system, seed):
            if prompt == "long":
                raise inference.ContextOverflow
            if prompt == "bad":
                raise inference.FatalRequest("no")
            return f"{prompt}:{seed}"

    df = spark.createDataFrame([("a", 1), ("long", 2), ("bad", 3)], "prompt string, seed long")
    found = {r.prompt: (r.gen, r.error) for r in inference.generate(df, Echo).collect()}
    assert found == {"a": ("a:1", None), "long": (None, None), "bad": (None, "FatalRequest: no")}


def test_retry():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert inference.with_retry(flaky, 3, slept.append) == "ok" and len(slept) == 2
    assert [inference.backoff(a) for a in (0, 1, 9)] == [2.0, 4.0, 60.0]
    assert inference.retryable(429) and inference.retryable(None) and not inference.retryable(400)


def test_choice_logprobs(spark):
    df = spark.createDataFrame([({" A": -1.0, "a": -2.0, "B": -3.0}, ["A", "B", "C"])], "m map<string,double>, t array<string>")
    assert df.select(inference.spelled_logprobs(F.col("m"), F.col("t")).alias("x")).first().x == [-1.0, -3.0, None]
    df = spark.createDataFrame([([(0, 3), (3, 5), (5, 8)], [-1.0, -2.0, -4.0])], "o array<struct<begin:int,end:int>>, p array<double>")
    at = lambda a, n: df.select(inference.continuation_logprob(F.col("o"), F.col("p"), F.lit(a), F.lit(n)).alias("x")).first().x
    assert (at(3, 5), at(4, 4), at(3, 6)) == (-6.0, None, None)


def test_streamed_outputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"doc_id": "x", "sample_index": 0}\n{"doc_id": "x", "sample_index": 0}\n')
    stream = lambda: outputs.first_of_each_sample(outputs.read_outputs(spark, str(tmp_path / "in"), "doc_id string, sample_index int"))
    sink = lambda batch: batch.write.mode("append").json(str(tmp_path / "out"))
    outputs.append_once(stream(), sink, str(tmp_path / "check")).awaitTermination()
    (tmp_path / "in/b.json").write_text('{"doc_id": "x", "sample_index": 0}\n{"doc_id": "x", "sample_index": 1}\n')
    outputs.append_once(stream(), sink, str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def lengths(*bad):
    """A factory of clients; its class is local, so that workers need not import this module."""

    class Lengths:
        def generate(self, prompt, system, seed):
            if prompt in bad:
                raise inference.FatalRequest("no")
            return None if prompt == "none" else str(len(prompt))

    return Lengths


def test_run_goes_on_where_it_failed(spark, tmp_path):
    q = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "zzz")], "doc_id string, prompt string")
    run = runner.Run(str(tmp_path / "out"), n_samples=2)
    with pytest.raises(runner.IncompleteRun) as failed:
        runner.execute(q, run, lengths("yy"))
    assert (failed.value.counts["requested"], failed.value.counts["failed"]) == (6, 2) and "FatalRequest" in failed.value.counts["example"]
    assert not runner.is_complete(q, run)
    assert runner.execute(q, run, lengths()) == {"requested": 2, "failed": 0, "example": None}
    assert runner.execute(q, run, lengths())["requested"] == 0
    assert runner.is_complete(q, run)
    found = sorted((r.doc_id, r.sample_index, r.n_samples, r.gen) for r in runner.outputs_of(spark, run).collect())
    assert found == [(d, i, 2, g) for d, g in (("a", "1"), ("b", "2"), ("c", "3")) for i in (0, 1)]


def test_run_refuses_what_is_not_its_own(spark, tmp_path):
    q = spark.createDataFrame([("a", "x")], "doc_id string, prompt string")
    run = runner.Run(str(tmp_path / "out"))
    runner.execute(q, run, lengths())
    with pytest.raises(ValueError, match="another run"):
        runner.execute(q, runner.Run(run.output, n_samples=2), lengths())
    with pytest.raises(ValueError, match="prompt of a"):
        runner.execute(q.withColumn("prompt", F.lit("y")), run, lengths())
    with pytest.raises(ValueError, match="id of its own"):
        runner.execute(q.union(q), runner.Run(str(tmp_path / "two")), lengths())
    with pytest.raises(ValueError):
        runner.Run("x", mode="chat")
    with pytest.raises(runner.IncompleteRun, match="no generation"):
        runner.execute(q.withColumn("prompt", F.lit("none")), runner.Run(str(tmp_path / "three")), lengths())


def choices_client():
    class Choices:
        def alternatives(self, prompt):
            return {" A": -1.0, "b": -0.5} if prompt != "deaf" else {"Z": -1.0}

        def echo(self, text):
            """Tokens of two characters, placed by bytes."""
            parts = [text[i : i + 2] for i in range(0, len(text), 2)]
            places = [len("".join(parts[:i]).encode()) for i in range(len(parts))]
            return places, parts, [None, *[-1.0] * (len(parts) - 1)]

    return Choices


@pytest.mark.parametrize("mode", ["first_token", "continuation"])
def test_run_of_choices(spark, tmp_path, mode):
    rows = [("a", "üü", ["x", "y"], 1), ("b", "deaf", ["x", "y", "z"], 0), ("c", "üü", ["x"], 1), ("d", "üü", None, 0), ("e", "odd", ["x"], 0)]
    q = spark.createDataFrame(rows, "doc_id string, prompt string, choices array<string>, gold int")
    run = runner.Run(str(tmp_path / "out"), mode=mode)
    with pytest.raises(runner.IncompleteRun) as failed:
        runner.execute(q, run, choices_client())
    found = {r.doc_id: r.logprobs for r in runner.outputs_of(spark, run).collect()}
    # One token " A" follows the prompt; after an odd one no token begins where the continuation does.
    want = {"first_token": {"a": [-1.0, -0.5], "e": [-1.0]}, "continuation": {"a": [-1.0, -1.0], "b": [-1.0] * 3}}[mode]
    assert found == want and failed.value.counts["failed"] == 5 - len(want)
    assert runner.left_of(q, run).count() == 5 - len(want)
    acc = evaluate(runner.outputs_of(spark, run), "mc")["metrics"]["acc"]["value"]
    assert acc == {"first_token": 1.0, "continuation": 0.5}[mode]


@pytest.mark.parametrize(
    "offsets, tokens, logprobs, want",
    [
        ([0, 2, 4], ["é:", " a", "b"], [None, -1.0, -2.0], -3.0),  # characters
        ([0, 3, 5], ["é:", " a", "b"], [None, -1.0, -2.0], -3.0),  # bytes
        ([0, 2, 4], ["é:", " a", "b"], [None, -1.0, None], None),
        ([0, 2, 4], ["é:", " a", "c"], [None, -1.0, -2.0], None),
        ([0, 2, 5], ["é:", " a", "b"], [None, -1.0, -2.0], None),
        ([0, 1], ["é", ": ab"], [None, -1.0], None),
        ([None, 2, 4], ["é:", " a", "b"], [None, -1.0, -2.0], -3.0),
        ([], [], [], None),
    ],
)
def test_aligned_continuations(spark, offsets, tokens, logprobs, want):
    df = spark.createDataFrame([(offsets, tokens, logprobs)], "o array<bigint>, t array<string>, p array<double>")
    assert df.select(inference.aligned_logprob(F.col("o"), F.col("t"), F.col("p"), F.lit("é:"), F.lit(" ab")).alias("x")).first().x == want


def test_usable_logprobs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [-1.0, None], 0), ("b", [None, None], 0), ("c", [nan, -1.0], 0), ("d", [-inf, -1.0], 0), ("e", [], 0), ("f", [-1.0, -2.0], 2), ("g", [-1.0], 0), ("h", None, 0), (" ", [-1.0, -1.0], 0)]
    df = spark.createDataFrame(rows, "doc_id string, logprobs array<double>, gold int").withColumn("choices", F.array(F.lit("x"), F.lit("y"))).withColumn("sample_index", F.lit(0))
    assert [r.doc_id for r in requests.usable_logprobs(df).collect()] == ["a"]


def permuted(x, n, key):
    """requests._permuted() for one number."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = x % a, x // a
        for k in range(requests.ROUNDS):
            h = lambda d: int(hashlib.sha256(f"{key}:{k}:{d}".encode()).hexdigest()[:8], 16)  # noqa: E731, B023
            left, right = (left, (right + h(left)) % b) if k % 2 else ((left + h(right)) % a, right)
        x = left + a * right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 97])
def test_permutations(spark, n):
    found = spark.range(n).select(requests._permuted(F.col("id"), F.lit(n), F.lit("k")).alias("y")).collect()
    assert [r.y for r in found] == [permuted(x, n, "k") for x in range(n)] and sorted(r.y for r in found) == list(range(n))


def test_few_shot_looks_at_few_of_the_pool(spark):
    pool = [(f"i{k % 37}" if k % 5 else None, f"P{k % 11}", f"A{k}") for k in range(80)]
    asked = [(f"i{k}", f"P{k % 13}") for k in range(40)] * 2 + [(None, "P1")]
    p = spark.createDataFrame(pool, "doc_id string, prompt string, answer string")
    q = spark.createDataFrame(asked, "doc_id string, prompt string").repartition(3)
    ordered = sorted(((prompt, i, f"{prompt} {answer}") for i, prompt, answer in pool), key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2]))

    def prefix(i, prompt):
        own = [k for k, x in enumerate(ordered) if x[0] == prompt]
        n, key = len(ordered) - len(own), hashlib.sha256(":".join(["7", *([i] if i else []), prompt]).encode()).hexdigest()
        at = [permuted(x, n, key) for x in range(n)]
        rest = [k for k in range(len(ordered)) if k not in own]
        return "".join(d + "\n\n" for d in [ordered[rest[y]][2] for y in at if i is None or ordered[rest[y]][1] != i][:3])

    found = requests.few_shot_prefixes(q, p, 3, 7)
    assert sorted((r.doc_id or "", r.prefix) for r in found.collect()) == sorted((i or "", prefix(i, prompt)) for i, prompt in asked)


def test_numbering_works_rows_out_once_and_keeps_names(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(1000).select(counted(F.col("id").cast("int")).alias("x"), F.lit("p").alias("__part"), F.lit("k").alias("__key"), F.lit("b").alias("__before"))
    found = requests.number_rows(rows, -F.col("x"), "at")
    assert sorted((r.at, r.x) for r in found.collect()) == [(i, 999 - i) for i in range(1000)] and seen.value == 1000
    assert found.columns == ["x", "__part", "__key", "__before", "at"] and found.select("__part", "__key", "__before").distinct().collect() == [("p", "k", "b")]


def test_samples_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([("a", 0, None, "u", "v", "w", "s")], "problem string, ordinal int, sample_index int, __used string, __nth string, __n string, __slots string")
    found = samples.in_sample_order(samples.assign_sample_index(rows)).first()
    assert (found["__used"], found["__nth"], found["__n"], found["__slots"], found.sample_index) == ("u", "v", "w", "s", 0)



def test_benchmarks_are_published_once(spark, tmp_path):
    made = []

    def make(rows):
        def f():
            made.append(1)
            return spark.createDataFrame(rows, "doc_id string, prompt string")

        return f

    path = str(tmp_path / "b")
    good = make([("a", "x"), ("b", None)])
    assert preparation.publish(spark, path, good) and not preparation.publish(spark, path, good) and len(made) == 1
    assert sorted(map(tuple, spark.read.json(preparation.published(spark, path)).select("doc_id", "prompt").collect())) == [("a", "x"), ("b", None)]
    for rows in ([], [("a", "x"), ("a", "y")], [(" ", "x")]):
        with pytest.raises(ValueError, match="no benchmark"):
            preparation.publish(spark, str(tmp_path / "bad"), make(rows))
    assert not list((tmp_path / "bad").glob("[!.]*"))
    committed.commit(spark.createDataFrame([("a",), ("a",)], "doc_id string"), str(tmp_path / "old"), "json")
    assert preparation.publish(spark, str(tmp_path / "old"), good)
    state = preparation.publish_all(spark, {"b": good, "none": make([]), "new": good}, str(tmp_path))
    assert (state["b"], state["new"]) == ("there", "written") and state["none"].startswith("ValueError")


def test_required_texts(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, " ", "y")], "task_id int, prompt string, test string")
    assert preparation.required(df, "b", ["test"], ["task_id"]).count() == 2
    with pytest.raises(Exception, match="b has a row with a blank prompt"):
        preparation.required(df, "b", ["prompt"], ["task_id"]).collect()
    for texts, ids in ((["task_id"], []), (["gone"], []), ([], ["gone"])):
        with pytest.raises(ValueError, match="b needs"):
            preparation.required(df, "b", texts, ids)


def test_configs_in_one_table(spark):
    one = spark.createDataFrame([("b", 1), ("a", 2)], "q string, n int")
    two = spark.createDataFrame([("c",)], "q string")
    found = sorted((r.id, r.q, r.n) for r in preparation.union_of_configs({"x": one, "y": two}, lambda df: F.col("q")).collect())
    assert found == [("x:0", "a", 2), ("x:1", "b", 1), ("y:0", "c", None)]


def test_summaries_of_results(spark):
    rows = spark.createDataFrame([("a", "Answer: B", "B"), ("b", None, "A")], "doc_id string, gen string, answer string")
    result = evaluate(rows, "mc")
    found = summary_table(spark, [result, result | {"task": "other"}]).orderBy("task").collect()
    assert [(r.task, r.metric, r.value, r.samples, r.failed) for r in found] == [("mc", "acc", 1.0, 2, 1), ("other", "acc", 1.0, 2, 1)]
    scored = spark.createDataFrame([(i, "failed" if i % 2 else "completed") for i in range(9)], "ordinal int, status string")
    assert [r.ordinal for r in first_failures(scored, 3).collect()] == [1, 3, 5]


def test_settings():
    assert settings.whole("n", 3, least=1, most=3) == 3 and settings.number("p", 1, above=0) == 1.0
    for bad in (True, 1.0, "1", 0, 4):
        with pytest.raises(ValueError, match="n "):
            settings.whole("n", bad, least=1, most=3)
    for bad in (False, float("nan"), float("inf"), "1", 0, 2):
        with pytest.raises(ValueError, match="p "):
            settings.number("p", bad, above=0, most=1)
    settings.field_names(a="x", b="y")
    for bad in ({"a": " "}, {"a": 1}, {"a": "x", "b": "x"}):
        with pytest.raises(ValueError):
            settings.field_names(**bad)
    with pytest.raises(ValueError):
        Options(aggregation="best")
    nested = {"Api_Key": 1, "extra_body": '{"a": [{"my_secret": 2}], "b": 3}', "c": [{"cookie": 4}, 5]}
    assert settings.redacted(nested) == {"Api_Key": "***", "extra_body": {"a": [{"my_secret": "***"}], "b": 3}, "c": [{"cookie": "***"}, 5]}
    assert settings.redacted({"extra_body": "{"}) == {"extra_body": "***"} and "my_secret" in nested["extra_body"]
