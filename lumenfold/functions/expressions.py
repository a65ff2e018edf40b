"""Keys of math answers: two answers are equal if their keys are.

A key is found for each answer alone, so votes are grouped and pairs compared by key, without pairs of answers.
Real constants are keyed by their value, rounded to DIGITS decimals. Other expressions are keyed by their value at
fixed pseudo-random points of the field of P^2 elements, where equal expressions have equal values: an identity test
that different expressions pass by chance once in about 10^38. Tuples, intervals, unions and sets are keyed by
their parts. What cannot be read as an expression is keyed by its text.
"""

from __future__ import annotations

import hashlib
import math
import re
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import once

DIGITS = 6
#: Characters of a text that is read as an expression, and of a plain number.
MOST_CHARACTERS, MOST_DIGITS = 400, 4_000
#: The largest whole exponent and factorial that are worked out.
MOST_POWER = 2_000
#: A prime whose half is a prime, and which leaves 3 when divided by 4: odd roots are unique, and -1 has no square root.
P = 2**127 - 2721
_EXPONENT = re.compile(r"[eE]([+-]?\d+)")
_THOUSANDS = re.compile(r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?%?")
_FRACTION = re.compile(r"(-?)\\?d?frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}")
_TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|\.\d+|\\[A-Za-z]+|\\[{}|]|[A-Za-z]+|\S)")
_FUNCTIONS = {"sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "ln", "log", "exp"}
_SPACING = re.compile(r"\\(?:left|right|displaystyle|quad|qquad|limits|[,;:! ])|[$~]|\^\{?\\circ\}?|°")
_WRITTEN = {"−": "-", "–": "-", "×": "*", "·": "*", "÷": "/", "π": "\\pi ", "√": "\\sqrt ", "∞": "\\infty ", "²": "^2", "³": "^3", "**": "^"}
_COMMANDS = {"\\cdot": "*", "\\times": "*", "\\ast": "*", "\\div": "/", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "frac": "\\frac", "sqrt": "\\sqrt", "pi": "\\pi", "\\lvert": "|", "\\rvert": "|", "\\vert": "|", "\\lbrace": "\\{", "\\rbrace": "\\}"}


class Unreadable(Exception):
    """The text is no expression that is known here."""


def number_of(form: str | None) -> Fraction | None:
    """The exact number that a compared form is: decimal, percentage, a/b or a LaTeX fraction; else None."""
    if not form:
        return None
    text = form.strip().replace("\\%", "%").replace("$", "")
    if "," in text and not _THOUSANDS.fullmatch(text):
        return None
    text = text.replace(",", "")
    if len(text) > MOST_DIGITS or (m := _EXPONENT.search(text)) and len(m[1].lstrip("+-0")) > 3:
        return None  # 1e99999999 would be a number of so many digits
    try:
        if m := _FRACTION.fullmatch(text):
            value = Fraction(m[2]) / Fraction(m[3])
            return -value if m[1] else value
        if text.endswith("%"):
            return Fraction(text[:-1]) / 100
        return Fraction(text)
    except (ValueError, ZeroDivisionError):
        return None


# --- reading


class _Reader:
    """Recursive descent over the tokens of one answer; nodes are tuples that begin with their kind."""

    def __init__(self, text: str):
        for written, meant in _WRITTEN.items():
            text = text.replace(written, meant)
        text = _SPACING.sub(" ", text)
        self.tokens: list[str] = []
        for t in _TOKEN.findall(text):
            t = _COMMANDS.get(t, t)
            if t.isascii() and t.isalpha() and t not in _FUNCTIONS:
                self.tokens += list(t)  # letters side by side are a product
            else:
                self.tokens.append(t)
        self.at = 0
        self.depth = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        t = self.peek()
        if not t or wanted and t not in wanted:
            raise Unreadable(t)
        self.at += 1
        return t

    def sum(self) -> tuple:
        self.depth += 1
        if self.depth > 60:
            raise Unreadable("too deep")
        node = self.product()
        while self.peek() in ("+", "-") and self.peek():
            sign = self.take()
            node = (sign, node, self.product())
        self.depth -= 1
        return node

    def product(self) -> tuple:
        node = self.signed()
        while True:
            t = self.peek()
            if t in ("*", "/") and t:
                node = (self.take(), node, self.signed())
            elif self._begins(t):
                if re.fullmatch(r"[\d.]+", t):
                    raise Unreadable("two numbers side by side")
                node = ("*", node, self.power())
            else:
                return node

    @staticmethod
    def _begins(t: str) -> bool:
        """Whether a factor can begin with t; a bar cannot, as it may also close one."""
        return bool(t) and (t[0].isalnum() or t[0] == "." or t in ("(", "{", "\\frac", "\\sqrt", "\\pi", "\\infty", "\\binom") or t.lstrip("\\") in _FUNCTIONS)

    def signed(self) -> tuple:
        if self.peek() in ("+", "-") and self.peek():
            self.depth += 1
            if self.depth > 60:
                raise Unreadable("too deep")
            sign, node = self.take(), self.signed()
            self.depth -= 1
            return ("-", ("number", Fraction(0)), node) if sign == "-" else node
        return self.power()

    def power(self) -> tuple:
        node = self.atom()
        while self.peek() == "!":
            self.take()
            node = ("!", node)
        if self.peek() == "^":
            self.take()
            node = ("^", node, self.argument())
        return node

    def argument(self) -> tuple:
        """{...}, or one token as LaTeX reads it: \\frac12 is a half; -1 counts as one as well."""
        t = self.peek()
        if t == "{":
            return self.atom()
        if t in ("-", "+"):
            return self.signed()
        if re.fullmatch(r"\d{2,}", t) and self.at and self.tokens[self.at - 1] in ("\\frac", "\\sqrt"):
            self.tokens[self.at : self.at + 1] = list(t)
        return self.atom()

    def atom(self) -> tuple:
        t = self.take()
        if re.fullmatch(r"\d+(?:\.\d+)?|\.\d+", t):
            whole = ("number", Fraction(t))
            if t.isdigit() and self.peek() == "\\frac":  # 2\frac{1}{3} is a mixed number if its parts are whole
                start = self.at
                part = self.atom()
                if part[1][0] == part[2][0] == "number" and part[1][1].denominator == part[2][1].denominator == 1 and 0 < part[1][1] < part[2][1]:
                    return ("+", whole, part)
                self.at = start
            return whole
        if t in ("(", "{"):
            node = self.sum()
            self.take(")" if t == "(" else "}")
            return node
        if t == "|":
            node = ("abs", self.sum())
            self.take("|")
            return node
        if t == "\\frac":
            above = self.argument()
            if re.fullmatch(r"\d{2,}", self.peek()):
                self.tokens[self.at : self.at + 1] = list(self.peek())
            return ("/", above, self.argument())
        if t == "\\binom":
            return ("binom", self.argument(), self.argument())
        if t == "\\sqrt":
            degree = ("number", Fraction(2))
            if self.peek() == "[":
                self.take()
                degree = self.sum()
                self.take("]")
            return ("^", self.argument(), ("/", ("number", Fraction(1)), degree))
        if t in ("\\pi", "\\infty"):
            return ("constant", t[1:])
        if t.lstrip("\\") in _FUNCTIONS:
            name, power = t.lstrip("\\"), None
            if self.peek() == "^":
                self.take()
                power = self.argument()
            node = ("call", name, self.power())
            return ("^", node, power) if power else node
        if len(t) == 1 and t.isalpha() or re.fullmatch(r"\\(?:alpha|beta|gamma|delta|theta|lambda|mu|phi|omega|sigma|rho|tau)", t):
            if self.peek() == "_":
                self.take()
                start = self.at
                self.argument()
                t += "_" + "".join(self.tokens[start : self.at]).strip("{}")
            return ("constant", t) if t in ("e", "i") else ("name", t)
        raise Unreadable(t)


# --- values


def _constant(node: tuple) -> bool:
    return node[0] != "name" and node != ("constant", "i") and all(_constant(x) for x in node[1:] if isinstance(x, tuple))


def _rational(node: tuple) -> Fraction | None:
    """The exact value of a small rational constant."""
    kind = node[0]
    if kind == "number":
        return node[1]
    if kind in ("+", "-", "*", "/"):
        a, b = _rational(node[1]), _rational(node[2])
        if a is None or b is None or kind == "/" and not b:
            return None
        return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b
    return None


_REAL = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh}
_PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459")


def _whole(x: Decimal | Fraction) -> int:
    if x != int(x) or abs(x) > MOST_POWER:
        raise Unreadable("a large or broken number")
    return int(x)


def real(node: tuple) -> Decimal:
    """The value of a real constant to about 50 digits (15 through trigonometric functions)."""
    kind = node[0]
    if kind == "number":
        return Decimal(node[1].numerator) / Decimal(node[1].denominator)
    if kind == "constant":
        return {"pi": _PI, "e": Decimal(1).exp(), "infty": Decimal("Infinity")}[node[1]]
    if kind == "^":
        base, power = real(node[1]), _rational(node[2])
        if power is not None and power.denominator == 1:
            return base ** _whole(power)
        if base < 0 and power is not None and power.denominator % 2:  # the real root
            return -((-base) ** (Decimal(power.numerator) / power.denominator)) if power.numerator % 2 else (-base) ** (Decimal(power.numerator) / power.denominator)
        if base < 0:
            raise Unreadable("no real number")
        return base.sqrt() if power == Fraction(1, 2) else base ** real(node[2])
    if kind == "abs":
        return abs(real(node[1]))
    if kind == "!":
        return Decimal(math.factorial(_whole(real(node[1]))))
    if kind == "binom":
        return Decimal(math.comb(_whole(real(node[1])), _whole(real(node[2]))))
    if kind == "call":
        x = real(node[2])
        if node[1] in ("ln", "log"):
            return x.ln()
        if node[1] == "exp":
            return x.exp()
        if node[1] in ("cot", "sec", "csc"):
            return Decimal(1 / {"cot": math.tan, "sec": math.cos, "csc": math.sin}[node[1]](float(x)))
        return Decimal(_REAL[node[1]](float(x)))
    a, b = real(node[1]), real(node[2])
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b


Element = tuple[int, int]  # a + b sqrt(-1) over the integers modulo P


def _times(x: Element, y: Element) -> Element:
    return (x[0] * y[0] - x[1] * y[1]) % P, (x[0] * y[1] + x[1] * y[0]) % P


def _inverse(x: Element) -> Element:
    size = (x[0] * x[0] + x[1] * x[1]) % P
    if not size:
        raise Unreadable("division by zero")
    k = pow(size, -1, P)
    return x[0] * k % P, -x[1] * k % P


def _raised(x: Element, n: int) -> Element:
    if n < 0:
        x, n = _inverse(x), -n
    out = (1, 0)
    while n:
        if n & 1:
            out = _times(out, x)
        x, n = _times(x, x), n >> 1
    return out


def _point(*what: object) -> Element:
    """A fixed pseudo-random element for a name, or for a function of elements."""
    return int.from_bytes(hashlib.sha256(repr(what).encode()).digest()) % P, 0


def _square_root(x: int) -> Element:
    """A square root, multiplicative in x but for the sign."""
    x %= P
    if pow(x, (P - 1) // 2, P) in (0, 1):
        return pow(x, (P + 1) // 4, P), 0
    return 0, pow(-x % P, (P + 1) // 4, P)


def _root_of_rational(x: Fraction) -> Element:
    """The square root of a rational number, as the product of those of its prime factors: a homomorphism."""
    n = abs(x.numerator) * x.denominator
    out, q = pow(x.denominator, -1, P), 2
    root = (1, 0)
    while q * q <= n and q < 5_000:
        while n % (q * q) == 0:
            n, out = n // (q * q), out * q % P
        if n % q == 0:
            n, root = n // q, _times(root, _square_root(q))
        q += 1
    whole = math.isqrt(n)
    root = _times(root, (whole % P, 0) if whole * whole == n else _square_root(n))
    root = _times(root, (out, 0))
    return _times(root, (0, 1)) if x < 0 else root


def _factored(node: tuple) -> tuple[Fraction, tuple | None]:
    """A product as its rational factor and what is left."""
    value = _rational(node)
    if value is not None:
        return value, None
    if node[0] in ("*", "/"):
        (a, x), (b, y) = _factored(node[1]), _factored(node[2])
        if node[0] == "/" and not b:
            raise Unreadable("division by zero")
        rest = x if y is None else (node[0], x or ("number", Fraction(1)), y)
        return (a * b if node[0] == "*" else a / b), rest
    return Fraction(1), node


def _root(node: tuple, degree: int) -> Element:
    factor, rest = _factored(node)
    if degree % 2:
        if degree < 3 or math.gcd(degree, P - 1) > 1:
            raise Unreadable("a root of that degree")
        x = value(node)
        return (pow(x[0], pow(degree, -1, P - 1), P), 0) if not x[1] else _point("root", degree, x)
    if degree != 2:
        return _point("root", degree, value(node))
    if factor < 0:  # the sign stays with the rest, so that roots of x and -x have one form
        factor, rest = -factor, ("-", ("number", Fraction(0)), rest or ("number", Fraction(1)))
        if _rational(rest) is not None:
            return _root_of_rational(-factor)
    out = _root_of_rational(factor)
    if rest is None:
        return out
    x = value(rest)
    return _times(out, _point("root", 2, x) if x[1] else _square_root(x[0]))


def value(node: tuple) -> Element:
    """The value of an expression at the fixed points."""
    kind = node[0]
    if kind == "number":
        return node[1].numerator * pow(node[1].denominator, -1, P) % P, 0
    if kind == "name" or kind == "constant":
        return (0, 1) if node == ("constant", "i") else _point(*node)
    if kind == "^":
        power = _rational(node[2])
        if power is None:
            return _point("power", value(node[1]), value(node[2]))
        if abs(power.numerator) > MOST_POWER or power.denominator > MOST_POWER:
            raise Unreadable("a large power")
        base = value(node[1]) if power.denominator == 1 else _root(node[1], power.denominator)
        return _raised(base, power.numerator)
    if kind in ("abs", "!", "call", "binom"):
        return _point(kind, *(value(x) if isinstance(x, tuple) else x for x in node[1:]))
    a, b = value(node[1]), value(node[2])
    if kind in ("*", "/"):
        return _times(a, b if kind == "*" else _inverse(b))
    sign = 1 if kind == "+" else -1
    return (a[0] + sign * b[0]) % P, (a[1] + sign * b[1]) % P


# --- keys


def _rounded(x: Fraction) -> str:
    scaled = round(x * 10**DIGITS)
    sign, whole, part = "-" if scaled < 0 else "", *divmod(abs(scaled), 10**DIGITS)
    return f"n:{sign}{whole}" + f".{part:0{DIGITS}d}".rstrip("0").rstrip(".")


def _key_of_node(node: tuple) -> str:
    if _constant(node):
        try:
            with localcontext(Context(prec=60, Emax=5_000, Emin=-5_000)):
                found = real(node)
                if found.is_nan():
                    raise Unreadable("no number")
                return _rounded(Fraction(found)) if found.is_finite() else f"n:{'-' if found < 0 else ''}inf"
        except (Unreadable, ArithmeticError, ValueError, KeyError):
            pass  # no real number: a root of a negative one, say
    return "x:{:x},{:x}".format(*value(node))


_OPEN, _CLOSE = {"(": ")", "[": "]", "\\{": "\\}"}, {")", "]", "\\}"}


def _parts(tokens: list[str], between: str) -> list[list[str]]:
    """tokens cut at `between` outside brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in _OPEN or t == "{") - (t in _CLOSE or t == "}")
        if t == between and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _key_of_tokens(tokens: list[str]) -> str:
    united = _parts(tokens, "\\cup")
    if len(united) > 1:
        return "u:" + "|".join(sorted({_key_of_tokens(x) for x in united}))
    listed = _parts(tokens, ",")
    if len(listed) > 1:  # a list of answers without brackets
        return "l:" + "|".join(sorted(_key_of_tokens(x) for x in listed))
    if len(tokens) > 1 and tokens[0] in _OPEN and tokens[-1] in _CLOSE:
        inside = _parts(tokens[1:-1], ",")
        if tokens[0] == "\\{":
            return "{" + "|".join(sorted({_key_of_tokens(x) for x in inside})) + "}"
        if len(inside) > 1 or tokens[0] == "[":
            return f"{tokens[0]}{'|'.join(_key_of_tokens(x) for x in inside)}{tokens[-1]}"
    reader = _Reader("")
    reader.tokens = list(tokens)
    node = reader.sum()
    if reader.peek():
        raise Unreadable(reader.peek())
    return _key_of_node(node)


def answer_key(form: str | None) -> str:
    """The key of a compared form; '' for an empty one. Never fails: what is no expression is keyed by its text."""
    if not form:
        return ""
    number = number_of(form)
    if number is not None:
        return _rounded(number)
    if len(form) <= MOST_CHARACTERS:
        try:
            return _key_of_tokens(_Reader(form).tokens)
        except (Unreadable, ArithmeticError, ValueError, RecursionError, IndexError):
            pass
    return "s:" + form


#: Forms with a digit or a sign of an expression, or of one or two letters; other texts are words, and words are not
#: multiplied out.
_EXPRESSION = r"[0-9+\-*/^\\=(\[|!√π]|^.{1,2}$"
_PLAIN = r"^-?[0-9]{1,15}(?:\.[0-9]{1,15})?$"
#: Plain decimals of up to DIGITS decimals, but for zeros at the end: they need no rounding.
_SHORT = r"^(?!-0(?:\.0+)?\z)(-?(?:0|[1-9][0-9]{0,14}))(?:\.0{1,15}|(\.[0-9]{0,%d}[1-9])0{0,%d})?\z" % (DIGITS - 1, 15 - DIGITS)


def _keys(forms: pd.Series) -> pd.Series:
    if not forms.notna().any():
        return forms
    codes, different = pd.factorize(forms)
    found = np.array([*map(answer_key, different), None], dtype=object)  # -1, of a null, is the last
    return pd.Series(found[codes], dtype=object)


def short_key(form: Column) -> Column:
    """The key of a plain decimal that needs no rounding; any other form as it is."""
    return F.regexp_replace(form, _SHORT, "n:$1$2")


def native_key(form: Column, short: Column | None = None) -> Column:
    """answer_key() of plain decimals and words, without Python; null for other forms. short is short_key(form)."""
    short = short_key(form) if short is None else short
    digits = F.bround(form.try_cast("decimal(38,15)"), DIGITS).cast("string")
    number = F.regexp_replace(F.regexp_replace(digits, r"(?<=\.[0-9]{0,15})0+$", ""), r"\.$", "")
    number = F.when(number.isin("0", "-0"), F.lit("0")).otherwise(number)
    plain = F.when(form.rlike(_PLAIN), F.concat(F.lit("n:"), number))
    word = F.when(form == "", F.lit("")).when(~form.rlike(_EXPRESSION), F.concat(F.lit("s:"), form))
    return F.when(short != form, short).otherwise(F.coalesce(plain, word))


def key(form: Column, native: Column | None = None) -> Column:
    """answer_key() of a column. Plain decimals and words are keyed without Python; native is native_key(form)."""
    known = native_key(form) if native is None else native
    return F.coalesce(known, F.pandas_udf(_keys, "string")(F.when(known.isNull(), form)))


def with_keys(rows: DataFrame, forms: dict[str, str]) -> DataFrame:
    """rows with key() of the columns `forms` by name, stage by stage."""
    kept, native = ({name: f"__{name}_{k}" for name in forms} for k in ("short", "native"))
    rows = rows.withColumns({kept[n]: short_key(F.col(c)) for n, c in forms.items()})
    rows = once(rows, {native[n]: native_key(F.col(c), F.col(kept[n])) for n, c in forms.items()}).drop(*kept.values())
    return once(rows, {n: key(F.col(c), F.col(native[n])) for n, c in forms.items()}).drop(*native.values())
