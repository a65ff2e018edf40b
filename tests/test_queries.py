"""Every evaluation query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenfold.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, tables, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    rows = tables.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["extract_answer_letter", "math_normalize", "strip_reasoning", "sample_index_assign", "boxed_extract", "resume_anti_join", "mc_generate_majority"])
def test_relational_queries_stay_in_the_jvm(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_numbering_shuffles_once(spark, sf_dir):
    plan = QUERIES["sample_index_assign"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


@pytest.mark.parametrize("name", ["mc_generate_first", "mc_generate_majority", "mc_generate_any", "mc_generate_per_sample"])
def test_generated_choices_group_no_texts(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    executed = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in (plan + executed).splitlines() if any(x in line for x in ("Join", "Window", "Aggregate", "Exchange", "Sort"))]
    assert "collect_list(named_struct(i" not in plan and not any("gen#" in line or "text#" in line for line in moved)
    assert bool(windows) == (name != "mc_generate_per_sample")  # single samples need no places
    assert all("__part" in w.split("], [")[1] for w in windows)


def test_math_forms_are_computed_once(spark, sf_dir):
    plan = QUERIES["math_score"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000 and plan.count("lambdafunction") < 20


@pytest.mark.parametrize("name", ["math_score", "math_evaluate_majority", "math_symbolic"])
def test_math_code_is_small_enough_to_be_compiled(spark, sf_dir, name):
    """Java interprets methods of over 8,000 bytes for good; texts stay behind before the keys are asked for."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        asked = next(line for line in plan.toString().split("ArrowEvalPython [")[1].splitlines() if "Generate" in line)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8_000
    assert "gen#" not in asked
