"""Language-model scores of texts by a weighted backoff automaton over the corpus's own n-grams.

Documents are dealt into batches of bounded text. A batch asks the shards that count n-grams (by the range of an
n-gram's 64-bit hash, so a frequent word is spread) for those it holds, once each, and tells how often its training
texts hold them. A shard adds up and answers every batch. From its answers a batch builds the automaton of its own
n-grams: a state is a known history, an arc a known n-gram, and a failure arc leads to the history without its first
word. One left-to-right traversal of a text carries the state and adds the log-probabilities of arcs and failures.

Smoothing: p(w|h) = (c(hw) + T(h) p(w|h')) / (c(h) + T(h)) with T(h) = K c(h)^GROWTH, the number of different words
expected after a history of that count; K makes these sum to the corpus's number of different n-grams. Single
words: c / (N + V + 1), and (V + 1) / (N + V + 1) for any unknown word. These sum to one after every history.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import crc_fold
from lumenfold.llm.resampling import CRC_TABLE, crc_sql

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACES = b" \t\n\x0b\x0c\r"
BEGIN, END = 0, 1
ORDER = 2
#: Different words after a history grow as this power of its count.
GROWTH = 0.75
#: Text bytes of a batch, on average; a document of more is a batch's whole text.
BATCH_BYTES = 4 << 20
#: Text bytes for each shard of n-gram counts.
SHARD_BYTES = 16 << 20
#: Bytes of one text whose words are Python objects at a time.
SLICE_BYTES = 4 << 20
#: Weights are multiples of these, so that their sums are exact in any order of adding.
WEIGHT, BASE = 2.0**-20, 2.0**-30


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lower case, a bounded part of it at a time."""
    raw = (text or "").encode("utf-8").translate(LOWER)
    at = 0
    while at < len(raw):
        end = at + SLICE_BYTES
        while end < len(raw) and raw[end] not in SPACES:
            end += 1
        yield raw[at:end].split()
        at = end


class Batch:
    """The numbered words of a batch's texts, and its different n-grams of each order in the order of their keys."""

    def __init__(self, texts: list[str | None], order: int):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        assert (number[b" begin"], number[b" end"]) == (BEGIN, END)  # no words, as they hold a space
        parts, sizes = [], []
        for text in texts:
            own = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in word_slices(text)]
            parts += [np.array([BEGIN]), *own, np.array([END])]
            sizes.append(sum(map(len, own)) + 2)
        self.words = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.n_words = len(number)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, self.n_words)
        place = np.arange(len(self.words)) - np.repeat(self.starts, self.sizes)
        #: By order: the places where an n-gram ends, its number there, and by number: prefix, word, suffix, key.
        self.at, self.gram, self.prefix, self.word, self.suffix, self.keys, self.sorted = [], [], [], [], [], [], []
        held = np.unique(self.words[place > 0])
        full = self.words.copy()
        keys = hashes
        for k in range(1, order + 1):
            at = np.flatnonzero(place >= max(1, k - 1))
            if k == 1:
                gram, word, prefix, suffix = self.words[at], np.arange(self.n_words), np.zeros(self.n_words, np.int64), np.zeros(self.n_words, np.int64)
            else:
                code, first, gram = np.unique(full[at - 1] * self.n_words + self.words[at], return_index=True, return_inverse=True)
                prefix, word, suffix = code // self.n_words, code % self.n_words, full[at[first]]
                keys = _mixed(keys[prefix], hashes[word], k)
                full = np.full(len(self.words), -1)
                full[at] = gram
            marked = keys & ~np.uint64(1) | (word == END).astype(np.uint64)  # odd: never a history
            self.at.append(at)
            self.gram.append(gram)
            self.prefix.append(prefix)
            self.word.append(word)
            self.suffix.append(suffix)
            self.keys.append(marked)
            wanted = held if k == 1 else np.arange(len(marked))
            self.sorted.append(wanted[np.argsort(marked[wanted], kind="stable")])

    def counts(self, train: np.ndarray, k: int) -> np.ndarray:
        """How often the texts marked in train hold each n-gram of order k."""
        taken = np.repeat(train, self.sizes)[self.at[k - 1]]
        return np.bincount(self.gram[k - 1][taken], minlength=len(self.keys[k - 1]))


def _mixed(prefix: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """A hash of two hashes in their order."""
    x = prefix * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and gaps of as many bytes as the widest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    gaps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    wide = np.zeros((len(gaps) + 1, 8), np.uint8)
    wide[1:, : data[0]] = gaps
    wide[0] = np.frombuffer(data, np.uint8, 8, offset=1)
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, and eight more for those of 255 and over."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, offset=n)
    return counts


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


ASKED = "__shard long, __batch long, __keys array<binary>, __counts array<binary>"
TOLD = "__shard long, __batch long, __counts array<binary>, __stats binary"


def _ask(order: int, shards: int):
    """What a batch asks: a row for each shard, with the batch's n-grams there and their counts in training texts."""

    def ask(table: pa.Table) -> pa.Table:
        batch = Batch(table.column("__text").to_pylist(), order)
        train = np.array(table.column("__train").to_pylist(), bool)
        keys, counts = [], []
        for k in range(1, order + 1):
            wanted = batch.sorted[k - 1]
            ordered, n = batch.keys[k - 1][wanted], batch.counts(train, k)[wanted]
            cuts = np.searchsorted(shard_of(ordered, shards), np.arange(1, shards))
            keys.append([pack_keys(x) for x in np.split(ordered, cuts)])
            counts.append([pack_counts(x) for x in np.split(n, cuts)])
        columns = [pa.array(range(shards), pa.int64()), pa.array([table.column("__batch")[0].as_py()] * shards, pa.int64())]
        columns += [pa.array(list(zip(*x)), pa.list_(pa.binary())) for x in (keys, counts)]
        return pa.Table.from_arrays(columns, names=["__shard", "__batch", "__keys", "__counts"])

    return ask


def _tell(order: int):
    """What a shard answers: to each batch the corpus's counts of its n-grams, and the shard's sums by order."""

    def tell(table: pa.Table) -> pa.Table:
        asked = list(zip(table.column("__keys").to_pylist(), table.column("__counts").to_pylist()))
        answers: list[list[bytes]] = [[] for _ in asked]
        stats = np.zeros((order, 3))
        for k in range(order):
            keys = [unpack_keys(x[k]) for x, _ in asked]
            ends = np.cumsum([len(x) for x in keys])
            own = np.concatenate([unpack_counts(c[k], len(x)) for x, (_, c) in zip(keys, asked)])
            different, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, weights=own, minlength=len(different)).astype(np.int64)
            history = total[(total > 0) & (different & np.uint64(1) == 0)]
            stats[k] = total.sum(), (total > 0).sum(), (history.astype(float) ** GROWTH).sum()
            for answer, part in zip(answers, np.split(total[which], ends[:-1])):
                answer.append(pack_counts(part))
        told = [table.column("__shard"), table.column("__batch"), pa.array(answers, pa.list_(pa.binary())), pa.array([stats.tobytes()] * len(asked), pa.binary())]
        return pa.Table.from_arrays(told, names=["__shard", "__batch", "__counts", "__stats"])

    return tell


def _logs(x: np.ndarray, step: float) -> np.ndarray:
    """log10, rounded to multiples of step."""
    return np.floor(np.fromiter(map(math.log10, x.tolist()), float, len(x)) / step + 0.5) * step


class Automaton:
    """States are known histories, the n-grams before a place; arcs are known n-grams, and failures lead to the history
    without its first word. All n-grams of the batch have numbers, so the arcs and failures that a text can meet lie in
    the order of its words: at a place a state is the length of its history."""

    def __init__(self, batch: Batch, counts: list[np.ndarray], stats: np.ndarray):
        order = len(counts)
        tokens, vocabulary = stats[0, 0], stats[0, 1]
        begun = counts[0][END]  # as many texts begin as end
        histories = [np.concatenate([[begun], counts[0][1:]]), *counts[1:]]
        p = np.where(counts[0] > 0, counts[0], vocabulary + 1) / (tokens + vocabulary + 1)
        #: By length of the history, at each place: the weight of the arc by the word there (NaN: none), and of the failure
        #: of the history that ends there.
        self.arcs, self.back = [_logs(p, WEIGHT)[batch.words].tolist()], [[]]
        #: The state after an arc of a single word, and after one of more.
        self.known = ((counts[0] > 0) & (order > 1)).astype(int)[batch.words].tolist()
        self.longest = order - 1
        for k in range(2, order + 1):
            c, h = counts[k - 1], histories[k - 2]
            sums = stats[k - 2, 2] + (float(begun) ** GROWTH if k == 2 else 0.0)
            strength = math.floor(stats[k - 1, 1] / sums / WEIGHT + 0.5) * WEIGHT if sums else 1.0
            seen = strength * h.astype(float) ** GROWTH
            was = batch.prefix[k - 1]
            p = np.where(c > 0, (c + seen[was] * p[batch.suffix[k - 1]]) / np.maximum(h[was] + seen[was], 1e-300), 0.0)
            weights, failures = np.full(len(c), np.nan), np.zeros(len(h))
            weights[c > 0], failures[h > 0] = _logs(p[c > 0], WEIGHT), _logs(seen[h > 0] / (h[h > 0] + seen[h > 0]), WEIGHT)
            arcs, back = np.full(len(batch.words), np.nan), np.zeros(len(batch.words))
            arcs[batch.at[k - 1]] = weights[batch.gram[k - 1]]
            if k == 2:
                back[:] = failures[batch.words]
            else:
                back[batch.at[k - 2]] = failures[batch.gram[k - 2]]
            self.arcs.append(arcs.tolist())
            self.back.append(back.tolist())
        self.begin = 1 if order > 1 and begun else 0

    def score(self, start: int, end: int) -> float:
        """log10 probability of the words and the end that follow the begin at `start`, up to `end`."""
        arcs, back, known, longest = self.arcs, self.back, self.known, self.longest
        total, state = 0.0, self.begin
        for place in range(start + 1, end):
            weight = arcs[state][place]
            while weight != weight:
                total += back[state][place - 1]
                state -= 1
                weight = arcs[state][place]
            total += weight
            state = min(state + 1, longest) if state else known[place]
        return total


SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _score(order: int, shards: int, names: list[str]):
    def score(docs: pa.Table, told: pa.Table) -> pa.Table:
        texts = docs.column("__text").to_pylist()
        batch = Batch(texts, order)
        rows = sorted(zip(told.column("__shard").to_pylist(), told.column("__counts").to_pylist(), told.column("__stats").to_pylist()))
        counts = []
        for k in range(order):
            wanted = batch.sorted[k]
            sizes = np.bincount(shard_of(batch.keys[k][wanted], shards).astype(np.int64), minlength=shards)
            if texts and [r[0] for r in rows] != list(range(shards)):
                raise RuntimeError("a shard's answer is missing")
            full = np.zeros(len(batch.keys[k]), np.int64)
            full[wanted] = np.concatenate([unpack_counts(r[1][k], m) for r, m in zip(rows, sizes)]) if texts else []
            counts.append(full)
        stats = sum((np.frombuffer(r[2]).reshape(order, 3) for r in rows), np.zeros((order, 3)))
        tokens, vocabulary = stats[0, 0], stats[0, 1]
        base = _logs((counts[0] + 0.1) / (tokens + 0.1 * (vocabulary + 1)), BASE)
        model = Automaton(batch, counts, stats)
        found: list[list] = [[] for _ in SCORES]
        for start, size in zip(batch.starts.tolist(), batch.sizes.tolist()):
            own = batch.words[start + 1 : start + size]
            row = (size - 1, int((counts[0][own] > 0).sum()), int(tokens), float(base[own].sum()), model.score(start, start + size))
            for column, value in zip(found, row):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        kept = [docs.column("__id"), docs.column("__train")]
        return pa.Table.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(found, kinds))], names=names)

    return score


def language_model_scores(
    docs: DataFrame, train: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row; n-grams of up to `order` words
    are learned from the rows where `train` (of docs' columns) is true and not null.

    A null or empty text is its end token alone. Rows and ids may repeat or be null, and count as often as they stand.
    An empty table gives an empty result; without training rows every token has probability 1. Other columns are
    ignored, whatever their names. n-grams count as equal if their 64-bit hashes are (63 bits and the end mark).
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches, shards = max(least, -(-total // batch_bytes)), max(least, -(-total // shard_bytes))
    # Rows are dealt by their place in the input, not by id, as ids may repeat.
    batch = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(train, F.lit(False)).alias("__train"), F.col(text_col).alias("__text"), batch.alias("__batch"))
    rows = rows.repartition(F.col("__batch"))  # read twice below: one exchange serves both
    asked = rows.groupBy("__batch").applyInArrow(_ask(order, shards), ASKED)
    told = asked.groupBy("__shard").applyInArrow(_tell(order), TOLD)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"__id {kind}, __train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = ["__id", "__train", *SCORES]
    found = rows.groupBy("__batch").cogroup(told.groupBy("__batch")).applyInArrow(_score(order, shards, names), schema)
    return found.select(F.col("__id").alias(id_col), F.col("__train").alias("trained"), *SCORES)


def language_model(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those whose crc32(doc_id) mod 10 is not 0. A null id is not held out."""
    fold = F.coalesce(crc_fold(F.col("doc_id"), 10), F.lit(1))
    return language_model_scores(docs, fold != 0).withColumn("held_out", ~F.col("trained")).drop("trained")


_TOKENS = (
    "list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x20\x09-\x0D]+'), ' end')"
)
#: The same in DuckDB over the table documents, for ORDER = 2.
SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS k, doc_id, doc_id IS NOT NULL AND {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 10 = 0 AS held_out, {_TOKENS} AS ws FROM documents, crc_table),
w AS (SELECT k, held_out, ws[i] AS w, CASE WHEN i = 1 THEN ' begin' ELSE ws[i - 1] END AS h FROM (SELECT k, held_out, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
u AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
b AS (SELECT h, w, count(*) AS c FROM w WHERE NOT held_out GROUP BY h, w),
n AS (SELECT coalesce(sum(c), 0)::DOUBLE AS n, count(*)::DOUBLE AS v FROM u),
hist AS (SELECT CASE WHEN w = ' end' THEN ' begin' ELSE w END AS h, c, pow(c::DOUBLE, {GROWTH}) AS grown FROM u),
s AS (SELECT floor((SELECT count(*) FROM b) / (SELECT sum(grown) FROM hist) / {WEIGHT!r}::DOUBLE + 0.5) * {WEIGHT!r}::DOUBLE AS strength),
one AS (SELECT w, u.c, CASE WHEN u.c IS NULL THEN v + 1 ELSE u.c END / (n + v + 1) AS p,
    floor(log10((coalesce(u.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1))) / {BASE!r}::DOUBLE + 0.5) * {BASE!r}::DOUBLE AS base
  FROM (SELECT DISTINCT w FROM w) LEFT JOIN u USING (w), n),
t AS (SELECT k, one.c IS NOT NULL AS known, base,
    CASE WHEN b.c IS NOT NULL THEN floor(log10((b.c + strength * grown * p) / (hist.c + strength * grown)) / {WEIGHT!r}::DOUBLE + 0.5) * {WEIGHT!r}::DOUBLE
      ELSE floor(log10(p) / {WEIGHT!r}::DOUBLE + 0.5) * {WEIGHT!r}::DOUBLE
        + CASE WHEN hist.c IS NULL THEN 0 ELSE floor(log10(strength * grown / (hist.c + strength * grown)) / {WEIGHT!r}::DOUBLE + 0.5) * {WEIGHT!r}::DOUBLE END END AS x
  FROM w JOIN one USING (w) LEFT JOIN hist ON hist.h = w.h LEFT JOIN b ON b.h = w.h AND b.w = w.w, s),
z AS (SELECT k, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, sum(base) AS base_score, sum(x) AS score FROM t GROUP BY k)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n.n AS BIGINT) AS train_tokens, base_score, score FROM d JOIN z USING (k), n
"""
