"""Text filters and answer extraction as Column expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Clean-up tables for final math answers, in the order they apply.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""),
    ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "points",
    "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "\\text{s}",
    "\\text{.}", "\\text{}^2", "\\text{}^3", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!",
    "{,}", '"', "\\dots",
]
# Prompts that stand before a conversation.
SYSTEM_PROMPTS = {
    "deepseek_r1": "A conversation between User and Assistant. The User asks a question, and the Assistant solves it. The Assistant first thinks about the reasoning process in the mind and then provides the User with the answer. The reasoning process is enclosed within <think> </think> and the answer is enclosed within <answer> </answer>.",
    "amthinking": "You are a helpful assistant. To answer the user's question, you first think about the reasoning process and then provide the user with the answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think> <answer> answer here </answer>.",
    "openr1": "You are a helpful AI Assistant that provides well-reasoned and detailed responses. You first think about the reasoning process as an internal monologue and then provide the user with the answer. Respond in the following format: <think>\n...\n</think>\n<answer>\n...\n</answer>",
    "default": "You are a helpful assistant.",
    "empty": None,
}
# Prompt modes of code benchmarks, and what begins a program of its own.
PREFIX_MODES = ["human_eval", "humaneval", "human_eval_plus", "humaneval_plus", "human_eval_prefix"]
INSTRUCTION_MODES = ["mbpp", "mbpp_plus", "instruction"]
TOP_LEVEL = r"^(?:def |from |import |class |@)"

#: White space of all of Unicode, as (?U)\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space (of all of Unicode) at both ends."""
    return F.btrim(text, F.lit(WHITE))


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def strip_reasoning(text: Column) -> Column:
    """The last <answer> that is not blank, else what follows the last </think> if that is not blank, else the text."""
    tagged = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1)), strip)
    kept = F.when(text.rlike(r"(?i)</answer>"), last(F.filter(tagged, lambda x: x != "")))
    after = last(F.filter(F.array(strip(F.regexp_extract(text, r"(?isU)^.*</think\s*>(.*)$", 1))), lambda x: x != ""))
    return F.when(F.contains(text, F.lit("</")), F.coalesce(kept, after, text)).otherwise(text)


def filter_pipeline(text: Column, name: str, steps: Sequence[tuple[str, Callable[[Column], Column]]]) -> tuple[Column, Column]:
    """(result, trace) of named text filters in order; the trace has each step's lengths and whether it changed the text."""
    start = now = F.coalesce(text.cast("string"), F.lit(""))
    entries = []
    for step, apply in steps:
        new = F.coalesce(apply(now), F.lit(""))
        entries.append(F.struct(F.lit(step).alias("name"), (new != now).alias("changed"), F.length(now).alias("input_length"), F.length(new).alias("output_length")))
        now = new
    trace = F.struct(F.lit(name).alias("pipeline"), F.array(*entries).alias("filters"), F.length(start).alias("input_length"), F.length(now).alias("output_length"))
    return now, trace


def answer_letter(text: Column) -> Column:
    """The letter of the last 'Answer: X' line, else the last single letter A-J or a-j (but I and a) that stands alone, else ''."""
    marked = F.regexp_extract_all(text, F.lit(r"(?imdU)(?:Answer|答案)\s*[:：]\s*([A-J])\s*[.。]?\s*$"), F.lit(1))
    alone = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Ja-j]$") & ~w.isin("I", "a"))
    return F.coalesce(F.upper(last(marked)), F.upper(last(alone)), F.lit(""))


def gold_letter(answer: Column, choices: Column) -> Column:
    """A gold label as a letter: the letter itself, a number from 1, or the text of one of the first ten choices.

    Null where it is none of these, or beyond the choices; without choices only a letter counts.
    """
    label = F.upper(strip(F.coalesce(answer.cast("string"), F.lit(""))))
    options = F.transform(F.slice(choices, 1, 10), lambda c: F.upper(strip(c)))
    n = F.coalesce(F.size(options), F.lit(0))
    place = (
        F.when(label.rlike("^[A-J]$"), F.ascii(label) - 64)
        .when(label.rlike("^[0-9]+$"), F.try_to_number(label, F.lit("999999")).cast("int"))
        .otherwise(F.array_position(options, label).cast("int"))
    )
    letter = F.chr((F.lit(64) + place).cast("long"))
    return F.when(choices.isNull(), F.when(label.rlike("^[A-J]$"), label)).when((place >= 1) & (place <= n), letter)


def final_answer(text: Column) -> Column:
    """What 'Final Answer: The final answer is ...' says, or null without the phrase."""
    pattern = r"(?isd)Final Answer:\s*The final answer is(.*?)(?:\.?\s*I hope it is correct\.)?$"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def _nested(depth: int) -> str:
    """A pattern of braces that hold braces, to that depth; it never goes back."""
    return r"\{[^{}]*+\}" if depth == 1 else r"\{[^{}]*+(?:" + _nested(depth - 1) + r"[^{}]*+)*+\}"


def _balanced(tail: Column) -> Column:
    """The head of a text up to the brace that closes its first one; null if none does. Only a text whose braces are
    nested deeper than five is walked through."""
    flat = F.regexp_extract(tail, "^[^{}]*+" + _nested(5), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state: Column, c: Column) -> Column:
        depth = state["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closed = (c == "}") & (depth == 0) & (state["end"] == 0)
        return F.struct(depth.alias("depth"), (state["at"] + 1).alias("at"), F.when(closed, state["at"] + 1).otherwise(state["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step)["end"]
    return F.when(flat != "", flat).when(end > 0, F.substring(tail, F.lit(1), end))


def boxed_part(text: Column) -> Column:
    r"""From the last \boxed, or else \fbox, to the brace that closes its first one; else null."""
    since = lambda mark: F.concat(F.lit(mark), F.substring_index(text, mark, -1))
    return _balanced(F.when(F.contains(text, F.lit("\\boxed")), since("\\boxed")).when(F.contains(text, F.lit("\\fbox")), since("\\fbox")))


def boxed(text: Column, part: Column | None = None) -> Column:
    r"""The content of the last \boxed or \fbox with balanced braces; '\boxed x' up to a dollar sign comes first; else null.

    part is boxed_part(text), where that is there already.
    """
    found = boxed_part(text) if part is None else part
    spaced = F.split_part(last(F.split(text, r"\\boxed ")), F.lit("$"), F.lit(1))
    out = F.when(F.contains(text, F.lit("\\boxed ")), spaced)
    for mark in ("\\boxed{", "\\fbox{"):
        out = out.when(F.startswith(found, F.lit(mark)), F.substring(found, F.lit(len(mark) + 1), F.length(found) - len(mark) - 1))
    return out


#: Answers that clean_answer() leaves as they are, as no step finds anything there: digits, signs, braced fractions and
#: roots, single letters. The steps look for '=', ',', '$', '"', white space, letters side by side and other commands.
SETTLED = r"^(?:[0-9.+\-*/()|!^{}\[\]]++|\\(?:frac|sqrt)\{|[A-Za-z](?![A-Za-z])){1,60}+\z"


def clean_answer(text: Column) -> Column:
    """A final math answer in its compared form: after the last '=', without units and wrappers, fractions and roots braced."""
    return F.when(text.rlike(SETTLED), text).otherwise(plain_number(without_units(text)))


def without_units(text: Column) -> Column:
    """clean_answer() but for thousands separators and white space at the ends. A plain decimal stays as it is."""
    out = last(F.split(text, "="))
    for before, after in SUBSTITUTIONS:
        out = F.replace(out, F.lit(before), F.lit(after))
    for gone in REMOVED:
        out = F.replace(out, F.lit(gone), F.lit(""))
    out = F.regexp_replace(out, r"(?d)(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for wrapper, inner in (("text", ".*?"), ("textbf", ".*?"), ("overline", ".*?"), ("boxed", ".*")):
        out = F.regexp_replace(out, rf"(?d)\\{wrapper}\{{({inner})\}}", "$1")
    out = F.regexp_replace(out, r"(?d)(frac)([^{])(.)", "frac{$2}{$3}")
    out = F.regexp_replace(out, r"(sqrt)([^{])", "sqrt{$2}")
    return F.when(text.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), text).otherwise(F.replace(out, F.lit("$"), F.lit("")))


def plain_number(text: Column) -> Column:
    """A whole number without its commas, any other text as it is; stripped."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    return strip(F.when(bare.rlike(r"^[0-9]+$"), bare).otherwise(text))


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with more columns, each computed once however often later ones use it: the generator keeps the optimizer
    from writing an expression out at every use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_math_forms(rows: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """rows with math_form() of each text, text by text and stage by stage.

    A stage names what later ones use several times, which keeps the optimizer from writing it out; a walk through
    braces stands between the stages of two texts, whose code is small enough to be compiled for that.
    """
    done = {}
    for n, t in texts.items():
        raw, easy, all_, part, said, settled, bare = (f"__{n}_{k}" for k in range(7))
        rows = rows.withColumn(raw, F.coalesce(t.cast("string"), F.lit("")))
        rows = rows.withColumn(easy, F.col(raw).rlike(SETTLED))
        rows = rows.withColumn(all_, F.when(F.col(easy), F.col(raw)).otherwise(strip(F.col(raw)))).drop(raw)
        rows = rows.withColumn(part, F.when(~F.col(easy), boxed_part(F.col(all_))))
        rows = rows.withColumn(said, F.when(F.col(easy), F.col(all_)).otherwise(F.coalesce(final_answer(F.col(all_)), boxed(F.col(all_), F.col(part)), F.col(all_)))).drop(easy, all_, part)
        rows = rows.withColumn(settled, F.col(said).rlike(SETTLED))
        rows = rows.withColumn(bare, F.when(F.col(settled), F.col(said)).otherwise(without_units(F.col(said)))).drop(said)
        done[n] = F.when(F.col(settled), F.col(bare)).otherwise(F.coalesce(F.nullif(plain_number(F.col(bare)), F.lit("[invalidanswer]")), F.lit("")))
    return once(rows, done).drop(*[f"__{n}_{k}" for n in texts for k in range(7)])


def math_form(text: Column) -> Column:
    """The compared form of a response: of its declared final answer, else of its boxed one, else of all of it."""
    stripped = strip(F.coalesce(text.cast("string"), F.lit("")))
    form = clean_answer(F.coalesce(final_answer(stripped), boxed(stripped), stripped))
    return F.when(form == "[invalidanswer]", F.lit("")).otherwise(form)


def ground_truth(label: Column, dataset: str) -> Column:
    """The answer in a label of a dataset; null where the label has none."""
    text = strip(label.cast("string"))
    if dataset.lower() == "gsm8k":
        text = F.when(F.contains(text, F.lit("####")), strip(F.element_at(F.split(text, "####", 2), 2)))
    elif dataset.lower() == "olympiadbench":
        text = strip(F.regexp_replace(label.cast("string"), r"^\$+|\$+$", ""))
    return F.nullif(text, F.lit(""))


def reasoning_of(label: Column) -> Column:
    """The worked solution before '####' in a gsm8k label."""
    return F.when(F.contains(label, F.lit("####")), strip(F.element_at(F.split(label, "####", 2), 1)))


FENCE = r"(?sU)```(?:\w+)?\s*\n(.*?)\n?\s*```"


def code_block(text: Column) -> Column:
    """Code of a response: its first fenced block, else from the first line that looks like code to a top-level print or
    main guard, else all of it. Without white space at the end."""
    fenced = F.regexp_extract(text, FENCE, 1)
    start = r"(?smdU)^(\s*(?:def |from |import |class |@).*)"
    body = F.regexp_replace(F.regexp_extract(text, start, 1), r"(?smdU)^(?:if __name__|print\b).*", "")
    return strip_end(F.when(text.rlike(FENCE), fenced).when(text.rlike(start), body).otherwise(F.coalesce(text, F.lit(""))))


def needs_prefix(text: Column) -> Column:
    """Whether code_block() took the part from the first code line, whose longest valid prefix is still to be found."""
    return ~text.rlike(FENCE) & text.rlike(r"(?mdU)^\s*(?:def |from |import |class |@)")


def first_meaningful_line(text: Column) -> Column:
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: (strip(x) != "") & ~strip(x).startswith("#"))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def starts_top_level(text: Column) -> Column:
    return first_meaningful_line(text).rlike(TOP_LEVEL)


def check_programs(prompt: Column, code: Column, test: Column, mode: Column) -> Column:
    """array<struct<variant, program>> to run for a sample, without repeated programs, in the order to try them."""
    mode = F.lower(strip(F.coalesce(mode, F.lit(""))))
    joined = F.struct(F.lit("prompt_plus_code").alias("variant"), F.concat(strip_end(prompt), F.lit("\n"), code, F.lit("\n"), test).alias("program"))
    alone = F.struct(F.lit("code_only").alias("variant"), F.concat(strip_end(code), F.lit("\n"), test).alias("program"))
    as_prefix = mode.isin(PREFIX_MODES) | (~mode.isin(INSTRUCTION_MODES) & starts_top_level(prompt))
    both = as_prefix & starts_top_level(code) & (joined["program"] != alone["program"])
    return F.when(both, F.array(joined, alone)).when(as_prefix, F.array(joined)).otherwise(F.array(alone))


def has_chat_template(text: Column) -> Column:
    """Whether a prompt is a serialized conversation: a marker, a control token that stands alone, or role lines."""
    marker = text.rlike(r"<\|(?:im_start|im_end|user|assistant)\|>")
    control = text.rlike(r"(?mU)(?:^|(?<=\s))</?s>(?=\s|$)|(?<!\w)\[/?INST\](?!\w)")
    hashed = text.rlike(r"(?mU)^\s*###\s*(?:Human|Assistant)\s*:")
    roles = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?mU)^\s*(Human|Assistant)\s*:"), F.lit(1)))
    return F.coalesce(marker | control | hashed | (F.size(roles) == 2), F.lit(False))


def chat_messages(system: Column, user: Column) -> Column:
    """array<struct<role, content>>: the system prompt, unless null or empty, then the user's."""
    said = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.filter(said, lambda m: (m["role"] == "user") | (F.coalesce(m["content"], F.lit("")) != ""))


def choice_label(index: Column) -> Column:
    """A..Z, AA..ZZ for 0..701."""
    tens = F.when(index >= 26, F.chr((F.lit(64) + F.floor(index / 26)).cast("long"))).otherwise(F.lit(""))
    return F.concat(tens, F.chr((F.lit(65) + index % 26).cast("long")))


def choice_tokens(explicit: Column, choices: Column) -> Column:
    """Tokens that stand for choices: given ones, or the choices where each is a letter A-J, or A, B, ... (null beyond ten)."""
    trimmed = F.transform(choices, strip)
    letters = F.forall(trimmed, lambda c: F.upper(c).rlike("^[A-J]$"))
    numbered = F.transform(F.sequence(F.lit(0), F.size(choices) - 1), choice_label)
    return F.when(explicit.isNotNull(), explicit).when(letters, F.transform(trimmed, F.upper)).when(F.size(choices) <= 10, numbered)


def choice_continuations(prompt: Column, tokens: Column) -> Column:
    """Tokens as they follow the prompt: with a space before them unless there is one."""
    spaced = F.transform(tokens, lambda t: F.when(t.rlike(r"(?U)^\s"), t).otherwise(F.concat(F.lit(" "), t)))
    return F.when(prompt.rlike(r"(?sU)\s\z"), tokens).otherwise(spaced)


def choice_prompt(question: Column, choices: Column, ending: str = "Answer:") -> Column:
    """The question, a line for each choice, and the line that asks for the answer."""
    lines = F.transform(choices, lambda c, i: F.concat(choice_label(i), F.lit(". "), c))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n" + ending))


def request_seed(seed: int, doc_id: Column, prompt: Column, index: Column) -> Column:
    """A 31-bit seed of a request: the first four bytes of SHA-256 of its parts between NULs."""
    parts = F.concat_ws("\0", F.lit(str(seed)), doc_id.cast("string"), prompt, index.cast("string"))
    return F.conv(F.substring(F.sha2(parts, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def word_count(text: Column) -> Column:
    """Words between white space; the default of token lengths."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
