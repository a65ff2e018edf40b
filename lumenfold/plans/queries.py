"""A query for each group of evaluation operators over the star-schema and text tables.

The tables hold no model outputs, so the queries derive them: an order is a problem and its lines are
samples, return flags are answers, documents are generations, markers are put around texts by rule.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.window import Window

from lumenfold.functions import predicates as P
from lumenfold.functions import text as T
from lumenfold.functions.estimators import NORMAL_BOTTOM, NORMAL_TOP, SMALL_MEAN, SMALL_TERMS, majority, pass_at_k
from lumenfold.operators import code_answers, inference, math_answers, metrics, multiple_choice, preparation, requests, samples
from lumenfold.plans import registry, runner

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_TOTAL = ", ".join(LINE_ORDER)
_SAMPLES = f"""s AS (SELECT l_orderkey AS problem, l_returnflag AS flag, l_linenumber AS line, l_quantity AS qty,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TOTAL}) - 1 AS i,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as numbered samples: problem, sample_index, n_samples, flag."""
    lines = _read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "problem")  # renamed first, so that later operators by problem need no shuffle
    by = Window.partitionBy("problem")
    index = F.row_number().over(by.orderBy(*LINE_ORDER)) - 1
    return lines.select("problem", index.alias("sample_index"), F.count("*").over(by).cast("int").alias("n_samples"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))


@query("""
WITH t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1),
k AS (SELECT unnest([1, 2, 4]) AS k)
SELECT k::INTEGER AS k, count(*) AS tasks, round(avg(CASE WHEN n - c < k THEN 1.0 ELSE
  1.0 - coalesce(list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - k / i::DOUBLE)), 1.0) END), 9) AS pass_at_k
FROM t, k WHERE n >= k GROUP BY k""")
def pass_at_k_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    scored = lines.select(F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") == "R").alias("passed"), F.lit("completed").alias("status"), F.lit(True).alias("complete"))
    found = code_answers.pass_at_k_metrics(code_answers.task_rollup(scored), (1, 2, 4))
    return found.select("k", "tasks", F.round("pass_at_k", 9).alias("pass_at_k"))


QUERIES["pass_at_k"], SQL["pass_at_k"] = pass_at_k_by_order, SQL["pass_at_k_by_order"]
del QUERIES["pass_at_k_by_order"], SQL["pass_at_k_by_order"]


@query(f"""
WITH {_SAMPLES},
v AS (SELECT problem, flag, count(*) AS votes, min(i) AS first, any_value(n) AS n,
  count(*) FILTER (WHERE flag = chr((65 + 4 * (problem % 3))::INTEGER)) AS ok FROM s GROUP BY 1, 2),
p AS (SELECT problem, max(n) AS k, sum(ok) > 0 AS passed, arg_max(ok > 0, (votes, -first)) AS right_ FROM v GROUP BY 1)
SELECT k::INTEGER AS k, count(*) AS problems, count(*) AS complete_problems, round(avg(passed::INTEGER), 9) AS pass_at_k, round(avg(right_::INTEGER), 9) AS majority_at_k
FROM p GROUP BY k""")
def problem_pass_majority_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_samples(spark, sf_dir).withColumns({
        "prediction": F.col("flag"), "complete": F.lit(True), "status": F.lit("completed"),
        "accuracy": (F.col("flag") == F.chr((F.lit(65) + 4 * (F.col("problem") % 3)).cast("long"))).cast("double"),
    })
    found = math_answers.cohort_metrics(math_answers.problem_rollup(rows))
    return found.select("k", "problems", "complete_problems", F.round("pass_at_k", 9).alias("pass_at_k"), F.round("majority_at_k", 9).alias("majority_at_k"))


@query(f"""
WITH {_SAMPLES}
SELECT count(*) AS sample_count, count(*) FILTER (WHERE line % 7 <> 0) AS effective_count, count(*) FILTER (WHERE line % 7 = 0) AS failed_count,
  count(*) FILTER (WHERE line % 7 <> 0 AND flag <> 'A') AS wrong_count, round(avg(CASE WHEN line % 7 <> 0 THEN (flag = 'A')::INTEGER END), 9) AS accuracy FROM s""")
def math_accuracy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_samples(spark, sf_dir).withColumns({"status": F.when(F.col("line") % 7 == 0, "failed").otherwise("completed"), "accuracy": (F.col("flag") == "A").cast("double")})
    return math_answers.accuracy_counts(rows).withColumn("accuracy", F.round("accuracy", 9))


_IMPLICIT = f"""WITH {_SAMPLES},
g AS (SELECT problem, i AS ordinal, CASE WHEN (problem + i) % 3 = 0 THEN i END AS given FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY problem, given IS NULL ORDER BY ordinal) AS nth,
  list(given) FILTER (WHERE given IS NOT NULL) OVER (PARTITION BY problem) AS used, count(*) OVER (PARTITION BY problem) AS cnt FROM g),
a AS (SELECT problem, ordinal, coalesce(given, list_filter(range(0, 2 * cnt + 20), lambda x: NOT list_contains(coalesce(used, []), x))[nth]) AS sample_index FROM u)"""


def _implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_samples(spark, sf_dir).withColumn("ordinal", F.col("sample_index"))
    given = F.when((F.col("problem") + F.col("ordinal")) % 3 == 0, F.col("ordinal"))
    return samples.assign_sample_index(rows.withColumn("sample_index", given))


@query(_IMPLICIT + " SELECT problem, ordinal, sample_index::INTEGER AS sample_index FROM a")
def sample_index_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implicit(spark, sf_dir).select("problem", "ordinal", "sample_index")


@query(f"""WITH {_SAMPLES},
h AS (SELECT problem, i, n FROM s WHERE (problem + i) % 5 <> 0),
c AS (SELECT problem, count(DISTINCT i) AS available, max(n) AS expected, list(DISTINCT i) AS have FROM h GROUP BY 1)
SELECT problem, available::INTEGER AS available, expected::INTEGER AS expected, expected - available AS n_missing,
  list_sort(list_filter(range(0, expected), lambda x: NOT list_contains(have, x)))[1]::INTEGER AS first_missing, expected = available AS complete FROM c""")
def sample_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_samples(spark, sf_dir).filter((F.col("problem") + F.col("sample_index")) % 5 != 0)
    found = samples.completeness(rows)
    return found.select("problem", "available", "expected", F.size("missing").cast("long").alias("n_missing"), F.try_element_at("missing", F.lit(1)).alias("first_missing"), "complete")


@query("""
WITH r AS (SELECT l_orderkey AS problem, l_returnflag, l_linestatus FROM lineitem)
SELECT problem, field FROM (
  SELECT problem, 'l_returnflag' AS field FROM r GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 UNION ALL
  SELECT problem, 'l_linestatus' FROM r GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1)""")
def conflict_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.conflicts(_read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey").withColumnRenamed("l_orderkey", "problem")


@query("""
WITH r AS (SELECT l_orderkey AS problem, l_linenumber AS i, 1 + l_linenumber % 5 AS n FROM lineitem),
a AS (SELECT problem, count(i) AS g, count(DISTINCT i) AS d, max(i) AS most, min(n) AS lo, max(n) AS hi FROM r GROUP BY 1)
SELECT problem, 'duplicate' AS fault FROM a WHERE g > d UNION ALL SELECT problem, 'conflicting_n' FROM a WHERE lo < hi
UNION ALL SELECT problem, 'out_of_range' FROM a WHERE most >= lo""")
def sample_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("problem"), F.col("l_linenumber").alias("sample_index"), (1 + F.col("l_linenumber") % 5).alias("n_samples"))
    return samples.sample_faults(rows)


@query(_IMPLICIT + """,
o AS (SELECT problem, sample_index, row_number() OVER (PARTITION BY problem ORDER BY sample_index) AS j FROM a),
l AS (SELECT problem, ordinal, row_number() OVER (PARTITION BY problem ORDER BY ordinal) AS j FROM a)
SELECT problem, ordinal, sample_index::INTEGER AS sample_index FROM o JOIN l USING (problem, j)""")
def samples_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.in_sample_order(_implicit(spark, sf_dir)).select("problem", "ordinal", "sample_index")


@query("""
WITH e AS (SELECT vec_id, label % 4 AS gold, CASE WHEN vec_id % 17 = 0 THEN []::DOUBLE[] ELSE
    [coalesce(CASE WHEN (vec_id + j) % 11 <> 0 THEN embedding[j]::DOUBLE END, '-inf'::DOUBLE) FOR j IN range(1, 5)] END AS p FROM embeddings),
b AS (SELECT *, CASE WHEN len(p) > 0 AND list_max(p) > '-inf'::DOUBLE THEN list_position(p, list_max(p)) - 1 END AS best FROM e)
SELECT vec_id, best::INTEGER AS prediction, CASE WHEN best IS NULL THEN 'failed' ELSE 'completed' END AS status, coalesce(best = gold, false) AS correct FROM b""")
def mc_loglikelihood_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    scores = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: F.when((F.col("vec_id") + j) % 11 != 0, F.element_at("embedding", j).cast("double")))
    rows = rows.select("vec_id", (F.col("label") % 4).alias("gold"), F.when(F.col("vec_id") % 17 == 0, F.array().cast("array<double>")).otherwise(scores).alias("logprobs"))
    return multiple_choice.score_loglikelihood(rows).select("vec_id", "prediction", "status", "correct")


@query("""
WITH e AS (SELECT label % 4 AS gold, [embedding[j]::DOUBLE FOR j IN range(1, 5)] AS p FROM embeddings)
SELECT round(avg((list_position(p, list_max(p)) - 1 = gold)::INTEGER), 9) AS acc, count(*) AS sample_count, count(*) AS effective_count, 0::BIGINT AS failed_count, 0::BIGINT AS excluded_count FROM e""")
def mc_loglikelihood_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("gold"), F.slice("embedding", 1, 4).alias("logprobs"))
    scored = multiple_choice.score_loglikelihood(rows).withColumns({"eligible": F.col("status") == "completed", "weight": F.lit(1).cast("long"), "correct_weight": F.col("correct").cast("int")})
    return multiple_choice.accuracy_summary(scored).withColumn("acc", F.round("acc", 9))


_W = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]*"
_LETTER = rf"""coalesce(upper(regexp_extract_all(x, '(?im)(?:Answer|答案){_W}[:：]{_W}([A-J]){_W}[.。]?{_W}$', 1)[-1]),
  upper(list_filter(string_split_regex(x, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Ja-j]') AND w NOT IN ('I', 'a'))[-1]), '')"""


@query(f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || 'Answer: ' || chr((65 + doc_id % 10)::INTEGER) ELSE text END AS x FROM documents) SELECT doc_id, {_LETTER} AS letter FROM d")
def extract_answer_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("text", F.lit("\nAnswer: "), F.chr((F.lit(65) + F.col("doc_id") % 10).cast("long")))
    return _read(spark, sf_dir, "documents").select("doc_id", T.answer_letter(F.when(F.col("doc_id") % 4 == 0, marked).otherwise(F.col("text"))).alias("letter"))


_GENERATED = f"""WITH d AS (SELECT source, doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || 'Answer: ' || chr((65 + doc_id % 4)::INTEGER) ELSE text END AS x,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
v AS (SELECT source, i, {_LETTER} AS vote, chr((65 + length(source) % 4)::INTEGER) AS gold FROM d)"""


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of the documents as samples of their source; texts end at the scan."""
    docs = _read(spark, sf_dir, "documents")
    marked = F.concat("text", F.lit("\nAnswer: "), F.chr((F.lit(65) + F.col("doc_id") % 4).cast("long")))
    rows = docs.select(
        F.col("source").alias("problem"), "doc_id", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("text")).alias("gen"),
        F.lit(None).cast("string").alias("error"), F.lit(True).alias("complete"), F.chr((F.lit(65) + F.length("source") % 4).cast("long")).alias("gold"),
    )
    return multiple_choice.with_letters(rows)


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_letters() with the samples' places: keys alone are numbered, by ranges, and letters joined with them by id."""
    keys = _read(spark, sf_dir, "documents").select(F.col("source").alias("problem"), "doc_id")
    places = requests.number_rows(keys, F.col("doc_id"), "sample_index", "problem")
    return _letters(spark, sf_dir).join(places.select("doc_id", "sample_index"), "doc_id")


def _judged(spark: SparkSession, sf_dir: str, aggregation: str) -> DataFrame:
    return multiple_choice.score_letters(_generated(spark, sf_dir), aggregation).select(F.col("problem").alias("source"), "prediction", "correct")


@query(_GENERATED + " SELECT source, vote AS prediction, vote = gold AS correct FROM v WHERE i = 0")
def mc_generate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, "first")


@query(_GENERATED + """, c AS (SELECT source, vote, any_value(gold) AS gold, count(*) AS n, min(i) AS f FROM v GROUP BY 1, 2)
SELECT source, vote AS prediction, vote = gold AS correct FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1""")
def mc_generate_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, "majority_vote")


@query(_GENERATED + """ SELECT source, CASE WHEN bool_or(vote = gold) THEN any_value(gold) ELSE coalesce(arg_min(vote, i) FILTER (WHERE vote <> ''), '') END AS prediction,
bool_or(vote = gold) AS correct FROM v GROUP BY 1""")
def mc_generate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, "any_correct")


@query(_GENERATED + " SELECT round(avg((vote = gold)::INTEGER), 9) AS acc, count(*) AS sample_count, count(*) AS effective_count, 0::BIGINT AS failed_count, 0::BIGINT AS excluded_count FROM v")
def mc_generate_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple_choice.accuracy_summary(multiple_choice.score_letters(_letters(spark, sf_dir), "per_sample")).withColumn("acc", F.round("acc", 9))


@query("""
WITH d AS (SELECT doc_id, upper(trim(CASE doc_id % 4 WHEN 0 THEN chr((65 + doc_id % 12)::INTEGER) WHEN 1 THEN (doc_id % 6)::VARCHAR WHEN 2 THEN ' ' || lang ELSE 'none' END)) AS l, ['en', 'FR', ' de ', 'es'] AS c FROM documents),
p AS (SELECT doc_id, CASE WHEN regexp_full_match(l, '[A-J]') THEN ascii(l) - 64 WHEN regexp_full_match(l, '[0-9]+') THEN l::INTEGER ELSE list_position([upper(trim(x)) FOR x IN c], l) END AS n FROM d)
SELECT doc_id, CASE WHEN n BETWEEN 1 AND 4 THEN chr((64 + n)::INTEGER) END AS gold FROM p""")
def gold_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("doc_id") % 4
    label = F.when(way == 0, F.chr((F.lit(65) + F.col("doc_id") % 12).cast("long"))).when(way == 1, (F.col("doc_id") % 6).cast("string")).when(way == 2, F.concat(F.lit(" "), "lang")).otherwise(F.lit("none"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.gold_letter(label, F.array(*map(F.lit, ["en", "FR", " de ", "es"]))).alias("gold"))


_TAGGED = """d AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '<think>' || text || '</think>' || role WHEN 1 THEN '<answer> ' || role || ' </answer> x <ANSWER>' || text || '</answer> y'
  WHEN 2 THEN text || '<answer>  </answer>' ELSE text END AS s FROM conversations)"""
_WS = r"'^[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]+$', '', 'g'"
_STRIPPED = rf"""coalesce(list_filter([regexp_replace(x, {_WS}) FOR x IN regexp_extract_all(s, '(?is)<answer>(.*?)</answer>', 1)], lambda x: x <> '')[-1],
  CASE WHEN regexp_matches(s, '(?i)</think\s*>') THEN nullif(regexp_replace(string_split_regex(s, '(?i)</think\s*>')[-1], {_WS}), '') END, s)"""


def _tagged() -> F.Column:
    way = (F.col("conv_id") + F.col("turn")) % 4
    return (
        F.when(way == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>"), "role"))
        .when(way == 1, F.concat(F.lit("<answer> "), "role", F.lit(" </answer> x <ANSWER>"), "text", F.lit("</answer> y")))
        .when(way == 2, F.concat("text", F.lit("<answer>  </answer>"))).otherwise(F.col("text"))
    )


@query(f"WITH {_TAGGED} SELECT conv_id, turn, {_STRIPPED} AS kept FROM d")
def strip_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_reasoning(_tagged()).alias("kept"))


@query(f"""WITH {_TAGGED}, a AS (SELECT conv_id, turn, s, {_STRIPPED} AS r FROM d)
SELECT conv_id, turn, replace(r, 'e', 'E') AS result, length(s) AS input_length, length(r) AS output_length, r <> s AS strip_changed, replace(r, 'e', 'E') <> r AS capital_changed FROM a""")
def filter_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, trace = T.filter_pipeline(_tagged(), "response", [("strip_reasoning", T.strip_reasoning), ("capital_e", lambda x: F.replace(x, F.lit("e"), F.lit("E")))])
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", result.alias("result"), trace.alias("t"))
    return rows.select("conv_id", "turn", "result", F.col("t.input_length").cast("long").alias("input_length"), F.col("t.output_length").cast("long").alias("output_length"), F.col("t.filters")[0]["changed"].alias("strip_changed"), F.col("t.filters")[1]["changed"].alias("capital_changed"))


@query(r"""
WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS way, floor(o_totalprice)::BIGINT::VARCHAR AS v FROM orders),
e AS (SELECT o_orderkey, way, v, CASE way WHEN 0 THEN 'so \boxed{1} then \boxed{' || v || '{x}}.' WHEN 1 THEN 'it is \boxed ' || v || '$ ok' WHEN 2 THEN '\fbox{' || v || '} end' ELSE 'plain \boxed{' || v END AS s FROM d)
SELECT o_orderkey, CASE way WHEN 0 THEN v || '{x}' WHEN 1 THEN v WHEN 2 THEN v END AS inside FROM e""")
def boxed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    way, v = F.col("o_orderkey") % 4, F.floor("o_totalprice").cast("string")
    s = (
        F.when(way == 0, F.concat(F.lit("so \\boxed{1} then \\boxed{"), v, F.lit("{x}}.")))
        .when(way == 1, F.concat(F.lit("it is \\boxed "), v, F.lit("$ ok"))).when(way == 2, F.concat(F.lit("\\fbox{"), v, F.lit("} end"))).otherwise(F.concat(F.lit("plain \\boxed{"), v))
    )
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.boxed(s).alias("inside"))


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_sql(x: str) -> str:
    out = f"string_split({x}, '=')[-1]"
    for before, after in [*T.SUBSTITUTIONS, *[(r, "") for r in T.REMOVED]]:
        out = f"replace({out}, {_sql_literal(before)}, {_sql_literal(after)})"
    out = rf"regexp_replace({out}, '(.*?)(\$)(.*?)(\$)(.*)', '$\3$', 'g')"
    for wrapper, inner in (("text", ".*?"), ("textbf", ".*?"), ("overline", ".*?"), ("boxed", ".*")):
        out = rf"regexp_replace({out}, '\\{wrapper}\{{({inner})\}}', '\1', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(frac)([^{{])(.)', 'frac{{\2}}{{\3}}', 'g'), '(sqrt)([^{{])', 'sqrt{{\2}}', 'g')"
    return f"replace({out}, '$', '')"


_MATHS = r"""d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT::VARCHAR AS v, (l_orderkey + l_linenumber) % 6 AS way FROM lineitem),
e AS (SELECT *, CASE way WHEN 0 THEN 'x = $' || v || '$ dollars' WHEN 1 THEN '\frac12 + \sqrt' || v WHEN 2 THEN '\text{an ' || v || '} units' WHEN 3 THEN '1,' || v || ',000'
  WHEN 4 THEN '\overline{a b} = \textbf{' || v || '}^\circ' ELSE 'the ' || v || ' points.' END AS s FROM d)"""


def _math_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    way, v = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.floor("l_extendedprice").cast("string")
    s = (
        F.when(way == 0, F.concat(F.lit("x = $"), v, F.lit("$ dollars"))).when(way == 1, F.concat(F.lit("\\frac12 + \\sqrt"), v))
        .when(way == 2, F.concat(F.lit("\\text{an "), v, F.lit("} units"))).when(way == 3, F.concat(F.lit("1,"), v, F.lit(",000")))
        .when(way == 4, F.concat(F.lit("\\overline{a b} = \\textbf{"), v, F.lit("}^\\circ"))).otherwise(F.concat(F.lit("the "), v, F.lit(" points.")))
    )
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s"))


@query(rf"""WITH {_MATHS}, c AS (SELECT *, {_clean_sql("s")} AS r FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(CASE WHEN regexp_full_match(replace(r, ',', ''), '[0-9]+') THEN replace(r, ',', '') ELSE r END) AS form FROM c""")
def math_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _math_strings(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.clean_answer(F.col("s")).alias("form"))


@query("SELECT o_orderkey, o_orderpriority AS reasoning, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::VARCHAR END AS answer FROM orders")
def gsm8k_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("o_orderpriority", F.lit(" #### "), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")).otherwise(F.lit(" ")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.reasoning_of(label).alias("reasoning"), T.ground_truth(label, "gsm8k").alias("answer"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR || ' ' || p_brand END AS answer FROM part")
def final_answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("We see.\nfinal answer: The final answer is "), F.col("p_size").cast("string"), F.lit(" "), "p_brand", F.when(F.col("p_size") % 3 == 1, F.lit(". I hope it is correct.")).otherwise(F.lit("")))
    return _read(spark, sf_dir, "part").select("p_partkey", T.final_answer(F.when(F.col("p_size") % 3 != 0, said).otherwise(F.col("p_name"))).alias("answer"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'def f():' || chr(10) || '    return ' || p_size WHEN 1 THEN 'import os' || chr(10) || 'x = ' || p_size ELSE p_name END AS code FROM part""")
def code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    gen = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Here:\n```python\ndef f():\n    return "), size, F.lit("\n```\nDone.")))
        .when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("\nimport os\nx = "), size, F.lit("\nprint(x)\nmore"))).otherwise(F.concat("p_name", F.lit("  \n")))
    )
    return code_answers.extract_code(_read(spark, sf_dir, "part").select("p_partkey", gen.alias("gen"))).select("p_partkey", "code")


@query("""
WITH d AS (SELECT p_partkey, ['human_eval', 'mbpp', ''][1 + p_size % 3] AS m, CASE WHEN p_size % 2 = 0 THEN 'def f():' || chr(10) || '    return 1' ELSE '    return 1' END AS c, 'def f():  ' AS p, 'assert f()' AS t FROM part)
SELECT p_partkey, CASE WHEN m = 'mbpp' THEN 'code_only' WHEN starts_with(c, 'def') THEN 'prompt_plus_code,code_only' ELSE 'prompt_plus_code' END AS variants,
  CASE WHEN m = 'mbpp' THEN c || chr(10) || t ELSE 'def f():' || chr(10) || c || chr(10) || t END AS first_program FROM d""")
def code_check_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ["human_eval", "mbpp", ""])), 1 + F.col("p_size") % 3)
    code = F.when(F.col("p_size") % 2 == 0, F.lit("def f():\n    return 1")).otherwise(F.lit("    return 1"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", T.check_programs(F.lit("def f():  "), code, F.lit("assert f()"), mode).alias("p"))
    return rows.select("p_partkey", F.array_join("p.variant", ",").alias("variants"), F.col("p")[0]["program"].alias("first_program"))


@query("""SELECT doc_id, i AS sample_index FROM documents, range(4) r(i) WHERE NOT (doc_id IN (SELECT doc_id FROM labels) AND i < 2)""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("prompt"))
    outputs = requests.expand(_read(spark, sf_dir, "labels").select("doc_id", F.lit("p").alias("prompt"), F.lit("g").alias("gen")), 2).withColumn("ordinal", F.col("sample_index"))
    return requests.remaining(docs, requests.resume_state(outputs), 4).select("doc_id", F.col("sample_index").cast("long").alias("sample_index"))


@query("""SELECT doc_id, i AS sample_index, ('0x' || substr(sha256(concat_ws(chr(0), '7', doc_id, lang, i)), 1, 8))::UBIGINT & 2147483647 AS seed FROM documents, range(3) r(i)""")
def request_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.expand(_read(spark, sf_dir, "documents").select("doc_id", "lang"), 3)
    return requests.with_seeds(rows, 7, "lang").select("doc_id", F.col("sample_index").cast("long").alias("sample_index"), "seed")


@query("""SELECT doc_id, 'prompt' AS fault FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'out_of_range' FROM labels WHERE doc_id % 7 = 0""")
def resume_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _read(spark, sf_dir, "documents").select("doc_id", F.lit("p").alias("prompt"))
    done = _read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "q").otherwise("p").alias("prompt"), F.when(F.col("doc_id") % 7 == 0, 5).otherwise(1).alias("sample_index"), F.lit(2).alias("n_samples"))
    return requests.drift(questions, done, 2)


@query("""
WITH w AS (SELECT doc_id, i FROM documents, range(2) r(i)),
o AS (SELECT doc_id, 0 AS i FROM labels UNION ALL SELECT doc_id, 1 FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM labels WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id + 100000000, 0 FROM labels WHERE doc_id % 3 = 0),
a AS (SELECT doc_id, i, count(*) AS n FROM o GROUP BY 1, 2),
m AS (SELECT count(*) AS matched FROM a SEMI JOIN w USING (doc_id, i))
SELECT (SELECT count(*) FROM w) AS expected, matched, (SELECT count(*) FROM w) - matched AS missing, (SELECT count(*) FROM a) - matched AS unexpected, (SELECT sum(n)::BIGINT - count(*) FROM a) AS duplicates FROM m""")
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select("doc_id")
    part = lambda keep, i, shift=0: labels.filter(keep).select((F.col("doc_id") + shift).alias("doc_id"), F.lit(i).alias("sample_index"))
    outputs = part("true", 0).unionByName(part("doc_id % 2 = 0", 1)).unionByName(part("doc_id % 4 = 0", 1)).unionByName(part("doc_id % 3 = 0", 0, 100000000))
    return requests.reconcile(_read(spark, sf_dir, "documents"), outputs.withColumn("n_samples", F.lit(2)), 2)


def _permuted_sql(x: str) -> str:
    """A walk of requests._permuted() in DuckDB, from the number x with the columns a, b and key."""
    l, r = f"({x} % a)", f"({x} // a)"
    for k in range(requests.ROUNDS):
        hashed = f"('0x' || substr(sha256(concat_ws(':', key, '{k}', {l if k % 2 else r})), 1, 8))::BIGINT"
        l, r = (l, f"(({r} + {hashed}) % b)") if k % 2 else (f"(({l} + {hashed}) % a)", r)
    return f"({l} + a * {r})"


@query(f"""
WITH RECURSIVE p AS (SELECT id, prompt, demo, row_number() OVER (ORDER BY prompt, id, demo) - 1 AS number
  FROM (SELECT item_id::VARCHAR AS id, text AS prompt, text || ' ' || 'A' || item_id AS demo FROM benchmark)),
q AS (SELECT doc_id, sha256('9:' || doc_id || ':' || lang) AS key, (SELECT count(*) FROM p) AS n, 3 + (SELECT count(*) FROM p WHERE id = doc_id::VARCHAR) AS want FROM documents),
c AS (SELECT *, ceil(sqrt(n::DOUBLE))::BIGINT AS a, ceil(n / ceil(sqrt(n::DOUBLE)))::BIGINT AS b FROM q),
w AS (SELECT doc_id, key, n, a, b, place, {_permuted_sql("place")} AS y FROM (SELECT *, unnest(range(want)) AS place FROM c)
  UNION ALL SELECT doc_id, key, n, a, b, place, {_permuted_sql("y")} FROM w WHERE y >= n),
f AS (SELECT doc_id, demo, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM w JOIN p ON p.number = w.y WHERE y < n AND p.id <> doc_id::VARCHAR)
SELECT doc_id, string_agg(demo, chr(10) || chr(10) ORDER BY r) || chr(10) || chr(10) AS prefix FROM f WHERE r <= 3 GROUP BY 1""")
def few_shot_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("prompt"), F.concat(F.lit("A"), F.col("item_id").cast("string")).alias("answer"))
    return requests.few_shot_prefixes(_read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("prompt")), pool, 3, 9)


def _binomial_sql(n: str, p: str, u: str) -> str:
    """functions.estimators.binomial() in DuckDB."""
    q = f"least({p}, 1 - {p})"
    t = f"sqrt(-2.0::DOUBLE * ln(least({u}, 1 - {u})))"
    top, bottom = ("(" + " + ".join(f"{c}::DOUBLE * pow({t}, {i})" for i, c in enumerate(cs)) + ")" for cs in (NORMAL_TOP, NORMAL_BOTTOM))
    z = f"(CASE WHEN {u} < 0.5 THEN {top} / {bottom} - {t} ELSE {t} - {top} / {bottom} END)"
    term = f"s[1] * ({n} - e[1] + 1) / e[1] * ({q} / (1 - {q}))"
    none = f"exp({n} * ln(1 - {q}))"
    few = f"list_reduce(list_transform(range(1, {SMALL_TERMS + 1}), lambda j: [j::DOUBLE]), lambda s, e: CASE WHEN s[2] < {u} THEN [{term}, s[2] + {term}, e[1]] ELSE s END, [{none}, {none}, 0.0::DOUBLE])[3]"
    many = f"floor({n} * {q} + sqrt({n} * {q} * (1 - {q})) * {z} + (1 - 2 * {q}) * ({z} * {z} - 1) / 6 + 0.5)"
    found = f"greatest(0.0::DOUBLE, least({n}, CASE WHEN {n} <= 0 OR {q} <= 0 THEN 0.0::DOUBLE WHEN {n} * {q} < {SMALL_MEAN} THEN {few} ELSE {many} END))"
    return f"CASE WHEN {p} > 0.5 THEN {n} - {found} ELSE {found} END"


@query(f"""
WITH RECURSIVE o AS (SELECT 'quality' AS metric, quality::DOUBLE AS v FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels
  UNION ALL SELECT 'quantity', l_quantity::DOUBLE FROM lineitem UNION ALL SELECT 'size', p_size::DOUBLE FROM part),
f AS (SELECT * FROM o WHERE v IS NOT NULL), c AS (SELECT metric, v, count(*)::DOUBLE AS c FROM f GROUP BY ALL),
h AS (SELECT metric, v, c, row_number() OVER w - 1 AS i, sum(c) OVER (PARTITION BY metric ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(c) OVER (PARTITION BY metric) AS n FROM c WINDOW w AS (PARTITION BY metric ORDER BY v)),
d AS (SELECT metric, b, 0::BIGINT AS i, n AS left_, 0.0::DOUBLE AS total FROM (SELECT DISTINCT metric, n FROM h), range(100) t(b)
  UNION ALL SELECT metric, b, i + 1, left_ - x, total + v * x FROM (SELECT metric, b, i, left_, total, v, {_binomial_sql("left_", "p", "u")} AS x
    FROM (SELECT d.metric, b, d.i, left_, total, v, least(1.0::DOUBLE, c / rest) AS p, (('0x' || substr(sha256(concat_ws(':', '42', b, 0, d.i)), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u
      FROM d JOIN h ON h.metric = d.metric AND h.i = d.i))),
m AS (SELECT d.metric, total / n AS m FROM d JOIN (SELECT metric, max(i) + 1 AS i, any_value(n) AS n FROM h GROUP BY metric) e ON d.metric = e.metric AND d.i = e.i),
s AS (SELECT metric, stddev_pop(m) AS e, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY metric),
a AS (SELECT metric, avg(v) AS value, count(*) AS count FROM f GROUP BY metric)
SELECT z.metric, count, round(value, 9) AS value, round(e, 9) AS stderr, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high
FROM (SELECT metric, metric AS of FROM a UNION ALL SELECT 'size_again', 'size') z JOIN a ON a.metric = z.of JOIN s ON s.metric = z.of""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two, fifty and other numbers of values; two of them are equal and resampled once."""
    labels, lines, parts = (_read(spark, sf_dir, t) for t in ("labels", "lineitem", "part"))
    one = lambda rows, name, c: rows.select(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
    observed = one(labels, "quality", "quality").unionByName(one(labels, "toxic", "toxic")).unionByName(one(lines, "quantity", "l_quantity"))
    observed = observed.unionByName(one(parts, "size", "p_size")).unionByName(one(parts, "size_again", "p_size"))
    found = metrics.bootstrap(observed, 100, 0.95, 42, by="metric")
    return found.select("metric", "count", *[F.round(c, 9).alias(c) for c in ("value", "stderr", "ci_low", "ci_high")])


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with golds that are letters, numbers or texts of choices, or none of these, and samples that were lost."""
    lines = order_samples(spark, sf_dir)
    way = F.col("problem") % 3
    gold = F.when(F.col("problem") % 11 == 0, F.lit("none of them")).when(way == 0, F.lit(" a ")).when(way == 1, F.lit("3")).otherwise(F.lit("second"))
    vote = F.when(F.col("flag") == "A", "A").when(F.col("flag") == "N", "B").otherwise("C")
    choices = F.array(*map(F.lit, ["first", "Second", "third"]))
    rows = lines.select(
        "problem", "sample_index", T.gold_letter(gold, choices).alias("gold"), F.concat(F.lit("<think>D</think>Answer: "), vote).alias("gen"),
        F.when(F.col("qty") % 5 == 0, "lost").alias("error"), F.lit(True).alias("complete"),
    )
    return multiple_choice.with_letters(rows)


_GOLDS = """WITH s AS (SELECT l_orderkey AS problem, l_quantity % 5 = 0 AS bad, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS vote,
  CASE WHEN l_orderkey % 11 <> 0 THEN ['A', 'C', 'B'][1 + l_orderkey % 3] END AS gold, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + _TOTAL + """) - 1 AS i FROM lineitem)"""


@query(_GOLDS + """, f AS (SELECT *, bad OR gold IS NULL AS failed FROM s)
SELECT round(coalesce(avg((vote = gold)::INTEGER) FILTER (WHERE NOT failed), 0), 9) AS acc, count(*) AS sample_count, count(*) FILTER (WHERE NOT failed) AS effective_count,
  count(*) FILTER (WHERE failed) AS failed_count, 0::BIGINT AS excluded_count FROM f""")
def mc_evaluate_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple_choice.accuracy_summary(multiple_choice.score_letters(_evaluated(spark, sf_dir), "per_sample")).withColumn("acc", F.round("acc", 9))


@query(_GOLDS + """, f AS (SELECT *, bad OR gold IS NULL AS failed FROM s WHERE i = 0)
SELECT round(coalesce(avg((vote = gold)::INTEGER) FILTER (WHERE NOT failed), 0), 9) AS acc, count(*) AS sample_count, count(*) FILTER (WHERE NOT failed) AS effective_count,
  count(*) FILTER (WHERE failed) AS failed_count, 0::BIGINT AS excluded_count FROM f""")
def mc_evaluate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple_choice.accuracy_summary(multiple_choice.score_letters(_evaluated(spark, sf_dir), "first")).withColumn("acc", F.round("acc", 9))


@query(_GOLDS + """, c AS (SELECT problem, vote, any_value(gold) AS gold, count(*) AS n, min(i) AS f, bool_or(bad) AS bad FROM s GROUP BY 1, 2),
m AS (SELECT problem, arg_max(vote, (n, -f)) AS pick, any_value(gold) AS gold, bool_or(bad) OR any_value(gold) IS NULL AS failed FROM c GROUP BY 1)
SELECT round(coalesce(avg((pick = gold)::INTEGER) FILTER (WHERE NOT failed), 0), 9) AS acc, count(*) AS sample_count, count(*) FILTER (WHERE NOT failed) AS effective_count,
  count(*) FILTER (WHERE failed) AS failed_count, 0::BIGINT AS excluded_count FROM m""")
def mc_evaluate_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple_choice.accuracy_summary(multiple_choice.score_letters(_evaluated(spark, sf_dir), "majority_vote")).withColumn("acc", F.round("acc", 9))


@query("SELECT doc_id, (ntile(7) OVER (ORDER BY doc_id) - 1)::INTEGER AS shard FROM documents")
def equal_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.equal_shards(_read(spark, sf_dir, "documents").select("doc_id"), 7, F.col("doc_id"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 5)::INTEGER AS worker, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::INTEGER AS batch FROM documents")
def round_robin_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    return requests.batches(requests.round_robin(docs, 5, F.col("doc_id")), 32, F.col("doc_id"))


_WORDS = r"len(list_filter(string_split_regex({}, '[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{0b}}]+'), lambda w: w <> ''))"
_LENGTHS = rf"""WITH d AS (SELECT doc_id, source AS prompt, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' boxed{{1}}' END AS gen FROM documents),
l AS (SELECT doc_id, {_WORDS.format("prompt")} + {_WORDS.format("gen")} AS total_length, contains(right(gen, 1000), 'boxed{{') AS has_boxed FROM d)"""


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" boxed{1}")))
    return preparation.length_filter(_read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("prompt"), gen.alias("gen")), 400)


@query(_LENGTHS + " SELECT doc_id, total_length::INTEGER AS total_length, has_boxed, has_boxed AND total_length <= 400 AS keep FROM l")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).select("doc_id", "total_length", "has_boxed", "keep")


@query(_LENGTHS + """, c AS (SELECT count(*) AS initial, count(*) FILTER (WHERE has_boxed AND total_length <= 400) AS kept FROM l)
SELECT initial, kept, initial - kept AS removed, round((initial - kept) * 100.0::DOUBLE / initial, 9) AS removed_percent FROM c""")
def length_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.removal_counts(_lengths(spark, sf_dir)).withColumn("removed_percent", F.round("removed_percent", 9))


@query("""
SELECT 'mmlu:' || p_partkey AS doc_id, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_size || chr(10) || 'Answer:' AS prompt,
  ['A', 'B', 'C'][1 + p_partkey % 3] AS answer, (p_partkey % 3)::INTEGER AS gold FROM part""")
def mc_prompt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("choices"), (F.col("p_partkey") % 3).alias("gold"))
    return preparation.choice_rows(rows, "mmlu").select("doc_id", "prompt", "answer", "gold")


@query("""SELECT 'humaneval:' || p_partkey AS doc_id, chr(10) || 'def check(c): assert c()' || chr(10) || 'check(f' || p_size || ')' AS answer, 'human_eval' AS prompt_mode FROM part""")
def humaneval_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("prompt"), F.lit("def check(c): assert c()\n\n").alias("test"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("entry_point"))
    return preparation.function_rows(rows, "humaneval").select("doc_id", "answer", "prompt_mode")


@query("""SELECT 'mbpp:' || p_partkey AS doc_id, chr(10) || 'assert f(' || p_size || ')' || chr(10) || 'assert g()' AS answer,
true AS has_head, length(p_name) + """ + str(sum(map(len, preparation.CODE_TEMPLATE))) + """ + length('assert f(' || p_size || ')' || chr(10) || 'assert g()') AS prompt_length FROM part""")
def mbpp_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = F.array(F.concat(F.lit("assert f("), F.col("p_size").cast("string"), F.lit(")")), F.lit("assert g()"))
    rows = preparation.task_rows(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("text"), tests.alias("test_list")), "mbpp")
    return rows.select("doc_id", "answer", F.contains("prompt", F.lit("expert")).alias("has_head"), F.length("prompt").cast("long").alias("prompt_length"))


@query("""
SELECT conv_id, turn, (conv_id + turn) % 6 IN (0, 1, 2, 3) AS templated FROM conversations""")
def chat_template_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = (F.col("conv_id") + F.col("turn")) % 6
    s = (
        F.when(way == 0, F.concat(F.lit("<|im_start|>"), "text")).when(way == 1, F.concat(F.lit("[INST] "), "text", F.lit(" [/INST]")))
        .when(way == 2, F.concat(F.lit("### Human: "), "text")).when(way == 3, F.concat(F.lit("Human: "), "text", F.lit("\nAssistant: ok")))
        .when(way == 4, F.concat(F.lit("Human: x[INST]y "), "text")).otherwise(F.col("text"))
    )
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.has_chat_template(s).alias("templated"))


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS distinct, 0::BIGINT AS blank, count(*) = count(DISTINCT doc_id) AS valid FROM documents")
def doc_id_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.valid_ids(_read(spark, sf_dir, "documents"))


@query("SELECT DISTINCT n, c, k, CASE WHEN c BETWEEN 0 AND n AND k <= n THEN round(CASE WHEN n - c < k THEN 1.0 ELSE 1.0 - coalesce(list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - k / i::DOUBLE)), 1.0) END, 9) END AS estimate FROM (SELECT (1 + p_size % 12)::INTEGER AS n, (p_partkey % 14)::INTEGER AS c, (1 + p_partkey % 5)::INTEGER AS k FROM part)")
def pass_at_k_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select((1 + F.col("p_size") % 12).cast("int").alias("n"), (F.col("p_partkey") % 14).cast("int").alias("c"), (1 + F.col("p_partkey") % 5).cast("int").alias("k")).distinct()
    return rows.select("n", "c", "k", F.round(pass_at_k(F.col("n"), F.col("c"), F.col("k")), 9).alias("estimate"))


@query(f"WITH {_SAMPLES}, c AS (SELECT problem, flag, count(*) AS n, min(i) AS f FROM s GROUP BY 1, 2) SELECT problem, flag AS vote FROM c QUALIFY row_number() OVER (PARTITION BY problem ORDER BY n DESC, f) = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = order_samples(spark, sf_dir).groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("sample_index", "flag"))).alias("s"))
    return votes.select("problem", majority(F.col("s.flag")).alias("vote"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN l_linenumber % 3 <> 0 AND l_quantity % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM lineitem")
def math_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers n as \\boxed{n} or as n.0: half of them equal by form or by number, the others off by one."""
    q = F.col("l_quantity").cast("int")
    told = F.when(q % 2 == 0, F.concat(q.cast("string"), F.lit(".0"))).otherwise((q + 1).cast("string"))
    gen = F.concat(F.lit("<think>1</think> so \\boxed{"), told, F.lit("}"))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.cast("string").alias("answer"), gen.alias("gen"), F.when(F.col("l_linenumber") % 3 == 0, "lost").alias("error"))
    return math_answers.score_answers(rows, error="error").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status", "accuracy")


@query(f"""
WITH {_SAMPLES}, o AS (SELECT problem, i, n, qty::INTEGER % 4 AS v, line % 7 = 0 AS lost, qty::INTEGER % 4 = problem % 4 AS good FROM s),
c AS (SELECT problem, v, count(*) AS votes, min(i) AS f, any_value(good) AS good FROM o WHERE NOT lost GROUP BY 1, 2),
m AS (SELECT problem, arg_max(good, (votes, -f)) AS r FROM c GROUP BY 1)
SELECT problem, any_value(n)::INTEGER AS k, count(*) FILTER (good AND NOT lost) AS correct_samples, count(*) FILTER (NOT lost) AS completed_samples, NOT bool_or(lost) AS complete,
  bool_or(good AND NOT lost) AS passed, coalesce(any_value(r)::INTEGER, 0)::DOUBLE AS majority_right FROM o LEFT JOIN m USING (problem) GROUP BY problem""")
def math_evaluate_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number written in four ways is one vote; lost samples have none."""
    v = (F.col("qty").cast("int") % 4).cast("string")
    double = (2 * (F.col("qty").cast("int") % 4)).cast("string")
    ways = [F.concat(v, F.lit(".0")), F.concat(F.lit("\\frac{"), double, F.lit("}{2}")), v, F.concat(F.lit("\\sqrt{"), v, F.lit("^2}"))]
    told = F.element_at(F.array(*ways), (1 + F.col("sample_index") % 4).cast("int"))
    rows = order_samples(spark, sf_dir).select(
        "problem", "sample_index", "n_samples", F.lit(True).alias("complete"), (F.col("problem") % 4).cast("string").alias("answer"),
        F.concat(F.lit("so \\boxed{"), told, F.lit("}")).alias("gen"), F.when(F.col("line") % 7 == 0, "lost").alias("error"),
    )
    return math_answers.problem_rollup(math_answers.score_answers(rows, error="error")).drop("majority")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2, 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM part")
def math_symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares multiplied out, roots, tuples and intervals: the answers of three of five ways equal their golds."""
    a, b, way = F.col("p_size").cast("int"), (F.col("p_partkey") % 7 + 2).cast("int"), F.col("p_partkey") % 5
    say = lambda form, *x: F.format_string(form, *x)
    golds = [say("(x+%d)^2", a), say("(x+%d)^2", a), say("%d\\sqrt{%d}", a, b), say("(%d,\\frac{1}{%d})", a, b), say("[%d,%d)", a, a + b)]
    told = [
        say("x^2+%dx+%d", 2 * a, a * a), say("x^2+%dx+%d", 2 * a, a * a + 1), say("\\sqrt{%d}", a * a * b), say("(\\frac{%d}{2},\\frac{3}{%d})", 2 * a, 3 * b), say("(%d,%d]", a, a + b)
    ]
    pick = lambda x: F.element_at(F.array(*x), (way + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", pick(golds).alias("answer"), F.concat(F.lit("It is \\boxed{"), pick(told), F.lit("}")).alias("gen"))
    return math_answers.score_answers(rows).select("p_partkey", "accuracy")


@query(f"""
WITH {_SAMPLES}, o AS (SELECT problem, i, n, row_number() OVER (ORDER BY qty, problem, i) AS ordinal, line % 7 = 0 AS lost FROM s WHERE (problem + i) % 9 <> 0),
p AS (SELECT problem, min(ordinal) AS place, count(*) < max(n) OR bool_or(lost) AS open_ FROM o GROUP BY problem)
SELECT problem, row_number() OVER (ORDER BY place) AS nth FROM p WHERE open_""")
def incomplete_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems with lost or missing samples, numbered in the order in which a file of samples by quantity has them."""
    rows = order_samples(spark, sf_dir).filter((F.col("problem") + F.col("sample_index")) % 9 != 0)
    rows = rows.withColumns({
        "complete": F.count("*").over(Window.partitionBy("problem")) == F.col("n_samples"), "status": F.when(F.col("line") % 7 == 0, "failed").otherwise("completed"), "prediction": F.col("flag"), "accuracy": F.lit(0.0),
        "ordinal": F.struct("qty", "problem", "sample_index"),
    })
    table = registry.problem_table(math_answers.problem_rollup(rows), rows).filter("not complete").select("problem", "place")
    return requests.number_rows(table, F.col("place"), "nth").select("problem", (F.col("nth") + 1).alias("nth"))


@query("SELECT n_nationkey::VARCHAR AS task_id, n_nationkey % 3 = 0 AS passed, 'completed' AS status FROM nation")
def code_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five generated functions, run against their tests in child processes."""
    n = F.col("n_nationkey").cast("string")
    told = F.when(F.col("n_nationkey") % 3 == 0, n).when(F.col("n_nationkey") % 3 == 1, F.lit("-1")).otherwise(F.lit("1/0"))
    rows = _read(spark, sf_dir, "nation").select(
        n.alias("task_id"), F.concat(F.lit("```python\ndef f():\n    return "), told, F.lit("\n```")).alias("gen"), F.concat(F.lit("\nassert f() == "), n).alias("answer"), F.lit("mbpp").alias("prompt_mode"),
        F.lit("task").alias("prompt"), F.lit(True).alias("complete"),
    )
    return code_answers.score_code(rows, allow_code_execution=True).select("task_id", "passed", "status")


@query("""
SELECT page_id, page_id % 4 IN (0, 1) AS local, page_id % 3 = 0 AS too_long, page_id % 500 BETWEEN 400 AND 499 AND page_id % 500 NOT IN (408, 429) AS final,
  page_id % 7 <> 0 AS finite, '***' AS hidden, url AS shown FROM pages""")
def log_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    way, url = F.col("page_id") % 4, F.col("url")
    endpoint = F.when(way == 0, F.lit("http://LOCALHOST:8000/v1")).when(way == 1, F.lit("https://a.localhost/v1")).otherwise(url)
    message = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("This model's Maximum context length is "), url)).otherwise(F.lit("bad request"))
    value = F.when(F.col("page_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("page_id").cast("double"))
    config = P.redacted(F.create_map(F.lit("my_API_KEY"), url, F.lit("base_url"), url))
    return _read(spark, sf_dir, "pages").select(
        "page_id", P.is_local_endpoint(endpoint).alias("local"), P.is_context_overflow(message).alias("too_long"), P.is_final_status(F.col("page_id") % 500).alias("final"),
        P.is_finite(value).alias("finite"), config["my_API_KEY"].alias("hidden"), config["base_url"].alias("shown"),
    )


@query("""
WITH g AS (SELECT 'mmlu:' || p_partkey AS doc_id, (p_partkey % 5)::INTEGER AS way, p_name FROM part)
SELECT doc_id, CASE WHEN way = 0 THEN [' A', 'B'] WHEN way = 1 THEN [' x', ' y'] ELSE [' A', ' B'] END AS follow FROM g""")
def choice_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("p_partkey") % 5
    tokens = F.when(way == 0, F.array(F.lit(" A"), F.lit("B"))).when(way == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(T.choice_tokens(F.lit(None).cast("array<string>"), F.array("p_brand", "p_type")))
    prompt = F.when(way == 0, F.lit("Q: ")).otherwise(F.concat("p_name", F.lit(" Answer:")))
    return _read(spark, sf_dir, "part").select(F.concat(F.lit("mmlu:"), F.col("p_partkey").cast("string")).alias("doc_id"), T.choice_continuations(prompt, tokens).alias("follow"))


@query("""
WITH t AS (SELECT p_partkey, p_size % 5 = 0 AS broken, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS n FROM part)
SELECT p_partkey, CASE WHEN NOT broken THEN -0.125::DOUBLE * n * (n + 1) / 2 END AS logprob FROM t""")
def continuation_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a name as tokens after a context that is longer in bytes than in characters; offsets count bytes for every other part."""
    part = _read(spark, sf_dir, "part")
    context = F.lit("\u00fc: ")
    tokens = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit(" "), w, F.lit("\u00e9")))
    said = part.select("p_partkey", "p_size", tokens.alias("tokens"))
    sizes = lambda length: F.transform("tokens", lambda t, i: length(context) + length(F.array_join(F.slice("tokens", F.lit(1), i), "")))
    offsets = F.when(F.col("p_partkey") % 2 == 0, sizes(F.octet_length)).otherwise(sizes(F.length)).cast("array<bigint>")
    n = F.size("tokens")
    logprobs = F.transform("tokens", lambda t, i: F.when((F.col("p_size") % 5 != 0) | (i < n - 1), (i + 1) * F.lit(-0.125).cast("double")))
    return said.select("p_partkey", inference.aligned_logprob(offsets, F.col("tokens"), logprobs, context, F.array_join("tokens", "")).alias("logprob"))


@query("""
SELECT l_linenumber, count(*) AS usable FROM lineitem
WHERE l_linenumber <= 3 AND (l_tax <> 0 OR l_discount <> 0) AND l_quantity::INTEGER % 4 <> 0 GROUP BY 1""")
def choice_resume_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three log-probabilities, null where zero and infinite for a quarter; golds beyond the choices are of no use."""
    none = F.lit(None).cast("double")
    score = lambda c: F.when(F.col(c) != 0, -F.col(c).cast("double"))
    third = F.when(F.col("l_quantity").cast("int") % 4 == 0, F.lit(float("inf"))).otherwise(none)
    rows = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("sample_index"), "l_linenumber", F.array(score("l_tax"), score("l_discount"), third).alias("logprobs"),
        F.array(*map(F.lit, "ABC")).alias("choices"), (F.col("l_linenumber") - 1).alias("gold"),
    )
    return requests.usable_logprobs(rows).groupBy("l_linenumber").agg(F.count("*").alias("usable"))


class _Lengths:
    """A client that says how long a prompt is; a flaky one fails for prompts of an even length."""

    def __init__(self, flaky: bool):
        self.flaky = flaky

    def generate(self, prompt: str, system: str | None, seed: int) -> str:
        if self.flaky and len(prompt) % 2 == 0:
            raise inference.FatalRequest("even")
        return str(len(prompt))


@query("SELECT item_id::VARCHAR AS doc_id, i::INTEGER AS sample_index, length(text)::VARCHAR AS gen FROM benchmark, range(2) t(i)")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that fails for a part of its requests and is started again: each sample has one row in the end."""
    questions = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.col("text").alias("prompt"))
    run = runner.Run(requests.scratch(spark, "run"), n_samples=2)
    try:
        runner.execute(questions, run, lambda: _Lengths(True))
    except runner.IncompleteRun:
        runner.execute(questions, run, lambda: _Lengths(False))
    return runner.outputs_of(spark, run).select("doc_id", "sample_index", "gen")


@query("""
SELECT 'nation:' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || ':' || n_regionkey AS id, n_name FROM nation""")
def config_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as a config of a benchmark, numbered by their keys."""
    nations = _read(spark, sf_dir, "nation")
    configs = {str(k): nations.filter(F.col("n_regionkey") == k) for k in range(5)}
    rows = preparation.union_of_configs(configs, lambda df: F.col("n_nationkey"))
    place, config = F.split_part("id", F.lit(":"), F.lit(2)), F.split_part("id", F.lit(":"), F.lit(1))
    return rows.select(F.concat(F.lit("nation:"), place, F.lit(":"), config).alias("id"), "n_name")
