"""Quality rules with host-level verdicts.

Every document is measured; the rules that it breaks are summed by host, each rate is shrunk towards the
rate of all hosts by a beta prior whose strength comes from how much hosts differ, and a host with a
shrunk rate over the limit is rejected with all its documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import map_texts, release_worker, stored

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: Per cent of a host's documents (shrunk) that may break a rule.
HOST_LIMIT = 50
#: Bounds of the prior's strength in documents.
WEAKEST, STRONGEST = 1.0, 1e6

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Rule -> condition on the measures, the same in Spark and DuckDB.
RULES = {
    "base": f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)",
    "symbols": "(100 * n_symbols > 10 * word_chars)",
    "dup_lines": "(20 * n_dup_lines > n_words)",
}


def repeated_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that stand in the text twice or more."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    mixed = np.zeros(len(ids) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - WINDOW + 1 + k].astype(np.uint64) + np.uint64(1)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    head = order[np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))]
    beside = np.concatenate((same, [False])) | np.concatenate(([False], same))
    at, head = order[beside], head[beside]
    if all((ids[at + k] == ids[head + k]).all() for k in range(WINDOW)):  # equal hashes are compared word by word
        at = np.sort(at)
    else:  # different windows of one hash
        _, which, times = np.unique(ids[at[:, None] + np.arange(WINDOW)], axis=0, return_inverse=True, return_counts=True)
        at = at[times[which.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    raw = (text or "").encode("utf-8")
    words = WORD.findall(raw)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    return len(words), len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, measures) of every row. A null text has no words."""

    def make():
        release_worker()

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([measures(t) for t in piece.column(2).to_pylist()], dtype=np.int64).reshape(-1, 5)
            return pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *map(pa.array, found.T)], names=["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("t"))
    return map_texts(rows, make, f"id {docs.schema[id_col].dataType.simpleString()}, host string, {MEASURES}", "t")


def shrunk_rates(broken: DataFrame) -> DataFrame:
    """(host, n, rule...) counts of broken rules -> (host, rate of each rule in per cent, shrunk by an empirical beta prior).

    The prior's mean is the rate of all documents; its strength is what leaves the variance between hosts,
    weighted by their documents, that sampling does not explain. The prior is a row of numbers.
    """
    names = list(RULES)
    total = broken.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in names]).first()
    if not total["n"]:
        return broken.select("host", *[F.lit(0.0).alias(r) for r in names])
    means = {r: total[r] / total["n"] for r in names}
    spread = broken.agg(*[(F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(means[r]), F.lit(2.0))) / total["n"]).alias(r) for r in names]).first()
    rates = []
    for r in names:
        noise = means[r] * (1 - means[r])
        between = spread[r] - noise * total["hosts"] / total["n"]
        strength = STRONGEST if between <= 0 else min(max(noise / between - 1, WEAKEST), STRONGEST)
        rates.append((100 * (F.col(r) + F.lit(means[r] * strength)) / (F.col("n") + F.lit(strength))).alias(r))
    return broken.select("host", *rates)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: id, measures, base_failed, kept, and the host's shrunk rates in per cent.

    kept is false if base_failed or the host is rejected: a rule's shrunk rate exceeds HOST_LIMIT. A null
    host is a host of its own. Ids may repeat or be null; other columns are ignored, whatever their names.
    """
    found = stored(document_measures(docs, id_col, text_col, host_col), "measures")
    marked = found.select("*", *[F.expr(c).alias(r) for r, c in RULES.items()])
    hosts = marked.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(r).alias(r) for r in RULES])
    hosts = stored(hosts, "hosts")
    rates = shrunk_rates(hosts).select(F.col("host").alias("of"), *[F.col(r).alias(f"host_{r}_rate") for r in RULES])
    # Rates are unique by host; a host with a large share of the documents is a skewed key that adaptive execution splits.
    joined = marked.join(rates, F.col("host").eqNullSafe(F.col("of")), "left")
    good = F.greatest(*[F.col(f"host_{r}_rate") for r in RULES]) <= HOST_LIMIT
    names = [m.split()[0] for m in MEASURES.split(", ")]
    return joined.select(F.col("id").alias(id_col), *names, F.col("base").alias("base_failed"), (~F.col("base") & good).alias("kept"), *[F.round(f"host_{r}_rate", 6).alias(f"host_{r}_rate") for r in RULES])


_COUNTS = ", ".join(f"count(*) FILTER (WHERE {r}) AS {r}" for r in RULES)
_PRIORS = ", ".join(f"sum({r}) / sum(n)::DOUBLE AS m_{r}" for r in RULES)
_SPREADS = ", ".join(f"sum(h.n * pow(h.{r} / h.n::DOUBLE - m_{r}, 2)) / any_value(a.n) AS v_{r}" for r in RULES)
_STRENGTHS = ", ".join(
    f"CASE WHEN v_{r} - m_{r} * (1 - m_{r}) * hosts / n <= 0 THEN {STRONGEST} ELSE "
    f"least(greatest(m_{r} * (1 - m_{r}) / (v_{r} - m_{r} * (1 - m_{r}) * hosts / n) - 1, {WEAKEST}), {STRONGEST}) END AS s_{r}" for r in RULES
)
_RATES = ", ".join(f"100 * (h.{r} + m_{r} * s_{r}) / (h.n + s_{r}) AS {r}" for r in RULES)
#: The same in DuckDB over the table documents.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT k, i, list_slice(ws, i, i + {WINDOW - 1}) AS win FROM (SELECT k, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, win) > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r, range({WINDOW}) AS x(j) GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
m AS (SELECT k, doc_id, host, len(ws) AS n_words, length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (k) LEFT JOIN c USING (k) LEFT JOIN l USING (k)),
f AS (SELECT *, {", ".join(f"{c} AS {r}" for r, c in RULES.items())} FROM m),
h AS (SELECT host, count(*) AS n, {_COUNTS} FROM f GROUP BY host),
a AS (SELECT count(*) AS hosts, sum(n) AS n, {_PRIORS} FROM h),
v AS (SELECT {_SPREADS} FROM h, a),
s AS (SELECT a.*, {_STRENGTHS} FROM a, v),
rates AS (SELECT h.host AS of, {_RATES} FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f.base AS base_failed,
  NOT f.base AND greatest({", ".join(f"rates.{r}" for r in RULES)}) <= {HOST_LIMIT} AS kept,
  {", ".join(f"round(rates.{r}, 6) AS host_{r}_rate" for r in RULES)}
FROM f JOIN rates ON f.host IS NOT DISTINCT FROM rates.of
"""
