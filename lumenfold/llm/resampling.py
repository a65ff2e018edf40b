"""Target-distribution importance resampling over hashed word features, in two Arrow passes.

The first pass counts each task's features with np.bincount into one vector of buckets, and treeReduce
merges the tasks' vectors. The second pass looks up the buckets' gains, which are broadcast, sums them by
document with bincount's weights, and adds Gumbel noise that a hash of the id gives. The documents of the
highest sums are a weighted sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh, stored, text_chunks
from lumenfold.llm.decontaminate import WORDS

BUCKETS = 10_000
#: Bytes of one text whose words are Python objects at a time.
SLICE_BYTES = 4 << 20
#: Levels of the tree that merges the vectors: the driver gets the cube root of the tasks' number of them.
DEPTH = 3


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time."""
    raw = (text or "").encode("utf-8").translate(WORDS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES) if len(raw) - at > SLICE_BYTES else len(raw)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def buckets_of(text: str | None, runs: int, buckets: int) -> tuple[np.ndarray, int]:
    """Buckets of all runs of 1 to `runs` consecutive words, and the number of words."""
    found, n_words, tail = [np.empty(0, np.int64)], 0, []
    for words in word_slices(text):
        for n in range(1, runs + 1):
            row = tail[max(0, len(tail) - n + 1) :] + words if n > 1 else words
            features = words if n == 1 else [b" ".join(row[i : i + n]) for i in range(len(row) - n + 1)]
            found.append(np.fromiter(map(crc32, features), np.int64, len(features)) % buckets)
        n_words += len(words)
        tail = (tail + words)[-(runs - 1) :] if runs > 1 else []
    return np.concatenate(found), n_words


def bucket_counts(rows: DataFrame, runs: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all rows. Null and empty texts have none; an empty table gives zeros."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in text_chunks(batch, text_col):
                for text in piece.column(0):
                    total += np.bincount(buckets_of(text.as_py(), runs, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = rows.select(text_col).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add, DEPTH) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share of the target and of the corpus, rounded down."""
    ours, theirs = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * ours / ((s + 1.0) * theirs))) for s, t in pairs], np.int64)


def noise(seed: int, doc_id: object) -> int:
    """Thousandths of a standard Gumbel variable, rounded down, from the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, runs: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # as many numbers as buckets

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.astype(np.float64)
        for batch in batches:
            for piece in text_chunks(batch, text_col):
                found = [buckets_of(t.as_py(), runs, len(table)) for t in piece.column(1)]
                n = np.array([len(b) for b, _ in found], np.int64)
                of = np.repeat(np.arange(len(n)), n)
                total = np.bincount(of, weights=table[np.concatenate([b for b, _ in found])], minlength=len(n)).astype(np.int64)
                weight = total // np.maximum(n, 1)
                draw = np.array([noise(seed, i) for i in piece.column(0).to_pylist()], np.int64)
                words = np.array([w for _, w in found], np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, (words, n, weight, weight + draw))], names=[id_col, *_SCORED])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in _SCORED))


_SCORED = ("n_words", "n_features", "weight", "score")


def _numbered(rows: DataFrame, by: list, rank: str) -> DataFrame:
    """rows with their place, from 1, in the order `by`: sorted ranges are written, and the rows before each range added."""
    at, part = fresh(rows.columns, "at"), fresh(rows.columns, "part")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    placed = stored(placed, "ranked").withColumn(part, F.shiftright(at, 33))
    before, starts = 0, []
    for r in placed.groupBy(part).count().orderBy(part).collect():  # a row for each range
        starts.append((r[part], before))
        before += r["count"]
    start = rows.sparkSession.createDataFrame(starts, f"{part} long, {rank} long")
    joined = placed.join(F.broadcast(start), part)
    return joined.withColumn(rank, F.col(rank) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, rank)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = BUCKETS, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; rank is null where the row is not drawn.

    Features are runs of 1 to `runs` words, hashed into buckets; a weight is the mean gain of a row's features, 0 if
    it has none. Of the N rows of `least_words` words or more, floor(percent * N / 100) are drawn: highest score
    first, ties by smaller id, then by weight and n_features; a null id comes first and hashes as an empty one. Null
    and empty texts have no features, on either side. Rows and ids may repeat: each row is ranked for itself. An
    empty table gives an empty result, an empty target weighs by rarity. Other columns are ignored, whatever their names.
    """
    gains = gains_of(bucket_counts(docs, runs, buckets, text_col), bucket_counts(target, runs, buckets, target_text))
    names = ["__id", *_SCORED]
    scored = stored(scores(docs, gains, runs, seed, id_col, text_col).toDF(*names), "scored")
    able = F.col("n_words") >= least_words
    # Weights lie between the least and the greatest gain and noise within -3.2 and 22.9 thousand, so these are some
    # ten thousand rows at most, however many documents there are.
    counts = sorted(((r["score"], r["count"]) for r in scored.filter(able).groupBy("score").count().collect()), reverse=True)
    wanted, seen, least = percent * sum(n for _, n in counts) // 100, 0, None
    for score, n in counts:
        if seen >= wanted:
            break
        seen, least = seen + n, score
    nothing = F.lit(None).cast("long").alias("rank")
    drawn = able & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    out = scored.filter(~drawn).select("*", nothing)
    if least is not None:
        order = [F.col("score").desc(), F.col("__id").asc(), F.col("weight").desc(), F.col("n_features").desc()]
        placed = _numbered(scored.filter(drawn), order, "rank")
        out = out.unionByName(placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))))
    return out.select(F.col("__id").alias(id_col), "n_features", "weight", "score", "rank")


_FEATURES = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: WITH clauses that give the table crc_table (tab: a list of 256 numbers); see crc_sql.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    """DuckDB's expression for the unsigned crc32 of the UTF-8 bytes of the expression `text`, where crc_table is joined."""
    hexes = f"hex(encode({text}))"
    numbers = f"list_transform(range(length({hexes}) // 2), lambda i: ('0x' || substr({hexes}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({numbers}, lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295)"


#: The contract's columns in DuckDB over the tables documents and benchmark.
SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS k, doc_id, {_FEATURES} AS ws FROM documents),
dw AS (SELECT k, unnest(ws) AS w FROM d), bw AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
v AS (SELECT w, {crc_sql("w")} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN v USING (w) GROUP BY ALL), t AS (SELECT bucket, count(*) AS n FROM bw JOIN v USING (w) GROUP BY ALL),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM range({BUCKETS}) AS r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
m AS (SELECT k, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY k),
x AS (SELECT k, doc_id, len(ws) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (k)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id, weight DESC, n_features DESC) AS place, count(*) OVER () AS able FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
FROM y LEFT JOIN z USING (k)
"""
