import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators.code_answers import extract_code, longest_valid_prefix


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,letter", [
    ("Some text\nAnswer: B", "B"), ("Reasoning...\n答案：D", "D"), ("I think A and B but choose D", "D"), ("no letters here", ""), ("", ""),
    ("Answer: A\nmore\nAnswer: B", "B"), ("answer: c.", "C"), ("I a i", "I"), ("éa Bé C", "C"), (None, ""),
])
def test_answer_letter(spark, text, letter):
    assert one(spark, T.answer_letter(F.col("s")), s=text) == letter


@pytest.mark.parametrize("text,kept", [
    ("<answer> x </answer>", "x"), ("<answer>a</answer><answer> </answer>", "a"), ("<think>t</think> y ", "y"), ("<think>t</think>  ", "<think>t</think>  "),
    ("plain", "plain"), ("", ""), ("a</THINK >b", "b"),
])
def test_strip_reasoning(spark, text, kept):
    assert one(spark, T.strip_reasoning(F.col("s")), s=text) == kept


@pytest.mark.parametrize("text,inside", [
    (r"\boxed{1} and \boxed{\frac{a}{b}}", r"\frac{a}{b}"), (r"\fbox{x}", "x"), (r"\boxed{open", None), (r"so \boxed 5$ .", "5"), (r"\boxed{a}\boxed ", ""), ("none", None),
    (r"\boxed{" + "{" * 9 + "x" + "}" * 9 + "}", "{" * 9 + "x" + "}" * 9),
])
def test_boxed(spark, text, inside):
    assert one(spark, T.boxed(F.col("s")), s=text) == inside


@pytest.mark.parametrize("text,form", [
    ("x = 5", "5"), (r"\frac12", r"\frac{1}{2}"), (r"\sqrt3", r"\sqrt{3}"), ("1,234", "1234"), (r"$12$ dollars", "12"), (r"\text{abc}", "abc"), ("90^\\circ", "90"),
    (r"\boxed{7}", "7"), ("Final Answer: The final answer is 42. I hope it is correct.", "42"), ("", ""), (None, ""),
])
def test_math_form(spark, text, form):
    assert one(spark, T.math_form(F.col("s")), s=text) == form


@pytest.mark.parametrize("label,name,answer", [("why #### 12", "gsm8k", "12"), ("no mark", "gsm8k", None), ("a #### ", "GSM8K", None), ("$3$", "olympiadbench", "3"), (" 7 ", "other", "7"), (" ", "other", None)])
def test_ground_truth(spark, label, name, answer):
    assert one(spark, T.ground_truth(F.col("s"), name), s=label) == answer


@pytest.mark.parametrize("label,choices,letter", [("b", ["x", "y"], "B"), ("C", ["x", "y"], None), ("2", ["x", "y"], "B"), ("3", ["x", "y"], None), (" Y", ["x", "y"], "B"), ("D", None, "D"), ("4", None, None), ("", ["x"], None)])
def test_gold_letter(spark, label, choices, letter):
    df = spark.createDataFrame([(label, choices)], "s string, c array<string>")
    assert df.select(T.gold_letter(F.col("s"), F.col("c")).alias("x")).first().x == letter


@pytest.mark.parametrize("text,code", [
    ("```python\nx = 1\n```", "x = 1"), ("```\ny\n```", "y"), ("talk\ndef f():\n    return 1\nprint(f())", "def f():\n    return 1"), ("def f():\n    return 1\nand so on", "def f():\n    return 1"),
    ("    return a + b  \n", "    return a + b"), ("", ""), (None, ""),
])
def test_code(spark, text, code):
    df = spark.createDataFrame([(text,)], "gen string")
    assert extract_code(df).first().code == code


def test_valid_prefix():
    assert longest_valid_prefix("x = 1\ny = (") == "x = 1"
    assert longest_valid_prefix("not python at all") == "not python at all"
    assert longest_valid_prefix("") == ""


@pytest.mark.parametrize("mode,code,variants", [
    ("human_eval", "    return 1", ["prompt_plus_code"]), ("HumanEval ", "def f():\n    pass", ["prompt_plus_code", "code_only"]), ("mbpp", "def f(): pass", ["code_only"]), ("", "x", ["prompt_plus_code"]),
])
def test_check_programs(spark, mode, code, variants):
    found = one(spark, T.check_programs(F.lit("# note\ndef f():\n"), F.col("c"), F.lit("f()"), F.col("m")), c=code, m=mode)
    assert [p.variant for p in found] == variants


@pytest.mark.parametrize("text,applied", [
    ("<|im_start|>x", True), ("<s> x", True), ("a<s>b", False), ("x[INST]y", False), ("[INST] y [/INST]", True), ("### Human: x", True), ("Human: x", False), ("Human: x\nAssistant: y", True), ("", False), (None, False),
])
def test_chat_template(spark, text, applied):
    assert one(spark, T.has_chat_template(F.col("s")), s=text) == applied


def test_labels_and_continuations(spark):
    labels = spark.range(30).select(T.choice_label(F.col("id")).alias("x")).collect()
    assert [r.x for r in labels][:3] == ["A", "B", "C"] and [r.x for r in labels][26:28] == ["AA", "AB"]
    assert one(spark, T.choice_continuations(F.col("p"), F.col("t")), p="Q:", t=["A", " B"]) == [" A", " B"]
    assert one(spark, T.choice_continuations(F.col("p"), F.col("t")), p="Q: ", t=["A"]) == ["A"]
    assert one(spark, T.choice_tokens(F.lit(None).cast("array<string>"), F.col("c")), c=["b", "c"]) == ["B", "C"]
    assert one(spark, T.choice_tokens(F.lit(None).cast("array<string>"), F.col("c")), c=["long", "words"]) == ["A", "B"]
    assert one(spark, T.choice_tokens(F.lit(None).cast("array<string>"), F.col("c")), c=["w"] * 11) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab<>/ \n\tétinkswer", max_size=30), min_size=1, max_size=20))
def test_strip_reasoning_keeps_untagged_text(spark, texts):
    plain = [t for t in texts if "</think" not in t and "<answer" not in t]
    df = spark.createDataFrame([(t,) for t in plain], "s string")
    assert [r.x for r in df.select(T.strip_reasoning(F.col("s")).alias("x")).collect()] == plain


@pytest.mark.parametrize("depth", [1, 2, 5, 6, 9])
def test_boxed_braces_of_any_depth(spark, depth):
    inside = "a{b}" * depth + "{" * depth + "x" + "}" * depth
    assert one(spark, T.boxed(F.col("s")), s="{ \\boxed{" + inside + "} }") == inside
    assert one(spark, T.boxed(F.col("s")), s="\\boxed{" + inside) is None


@pytest.mark.parametrize("text", ["-12.50", "\\frac{1}{x}", "(a+b)^{2}", "\\sqrt{2}!", "[3]", "x*y/|z|"])
def test_settled_answers_need_no_cleaning(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    whole = T.plain_number(T.without_units(F.col("s")))
    assert df.select(F.col("s").rlike(T.SETTLED), whole, T.clean_answer(F.col("s"))).first() == (True, text, text)


@pytest.mark.parametrize("text", ["ab", "1,000", "x=1", "$1$", "1 2", "\\pi", "\\frac12", "\\sqrt2", "1\n", "", "5\\%"])
def test_other_answers_are_cleaned(spark, text):
    assert not one(spark, F.col("s").rlike(T.SETTLED), s=text)


def test_long_texts_are_stripped_and_searched(spark):
    inside = "{a}" * 100_000
    long = "<think>" + " {x" * 200_000 + "</think>\u3000\n \\boxed{" + inside + "} \x85\n"
    df = spark.createDataFrame([(long,)], "s string").select(T.strip_reasoning(F.col("s")).alias("s"))
    kept, box = df.select("s", T.boxed(F.col("s"))).first()
    assert kept == "\\boxed{" + inside + "}" and box == inside
    assert one(spark, T.strip(F.col("s")), s="\u2003\r\n") == "" and one(spark, T.strip(F.col("s")), s=None) is None
