"""Ranked lexical search over a clustered index whose documents recursive graph bisection has reordered.

Documents are read into rows of their query terms. Runs of such rows become shards: within a shard recursive
bisection of the graph of documents and terms brings documents with the same terms next to each other, and every
CLUSTER documents in that order are a cluster, which keeps each term's postings and greatest impact. A query's
bound of a cluster is the sum of its terms' weighted greatest impacts. Queries visit clusters by falling bound and
stop when no bound reaches what they have: first the best cluster of each shard, which gives every query a score that
ten documents reach, then all clusters whose bound reaches that score. Postings lead back to document ids, so
equal scores are ordered by id, whatever the order of the index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, fresh, stored, text_chunks
from lumenfold.llm.resampling import word_slices

TOP = 10
#: Documents of a shard and of a cluster, and the most postings that a shard takes on before it is closed.
SHARD, CLUSTER, POSTINGS = 8192, 128, 4_000_000
#: Rounds of swaps at each bisection.
SWAPS = 8
#: Query text that is broadcast at a time; more of it takes another pass over the documents for each block.
BLOCK_BYTES = 2 << 20
#: Stands for a null document id in the index.
NO_ID = (1 << 63) - 1


class Queries:
    """A block of queries: their ids, and their different terms by number with how often each query has them."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        for _, text in items:
            held = Counter(self.vocabulary.setdefault(w, len(self.vocabulary)) for ws in word_slices(text) for w in ws)
            self.terms.append(np.fromiter(held, np.int64, len(held)))
            self.times.append(np.fromiter(held.values(), np.int64, len(held)))


def forward_rows(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every row: its number of terms, and those of the queries with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            for piece in text_chunks(batch, "text"):
                sizes, terms, tfs = [], [], []
                for text in piece.column(1):
                    n, found = 0, [np.empty(0, np.int64)]
                    for words in word_slices(text.as_py()):
                        n += len(words)
                        found.append(np.fromiter((number[w] for w in words if w in number), np.int64))
                    held, times = np.unique(np.concatenate(found), return_counts=True)
                    sizes.append(n)
                    terms.append(held.astype(np.int32))
                    tfs.append(times.astype(np.int32))
                columns = [piece.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def bisected(doc: np.ndarray, term: np.ndarray, n: int, leaf: int) -> np.ndarray:
    """An order of n documents in which those with the same terms are near; postings are (doc, term), by doc.

    Each half takes the documents whose terms it holds more of: per round the documents of most gain in the cost of
    coding the gaps of postings are swapped, in pairs, while a pair gains. The left half is a multiple of leaf.
    """
    starts = np.searchsorted(doc, np.arange(n + 1))

    def split(docs: np.ndarray) -> list[np.ndarray]:
        if len(docs) <= leaf:
            return [docs]
        sizes = starts[docs + 1] - starts[docs]
        owner = np.repeat(np.arange(len(docs)), sizes)
        at = np.repeat(starts[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        different, terms = np.unique(term[at], return_inverse=True)
        n_left = leaf * -(-len(docs) // leaf // 2) or leaf
        right = np.arange(len(docs)) >= n_left
        for _ in range(SWAPS):
            held_right = np.bincount(terms[right[owner]], minlength=len(different))
            held = np.bincount(terms, minlength=len(different)) - held_right, held_right
            n_of = n_left, len(docs) - n_left

            def cost(change: int) -> np.ndarray:
                counts = np.maximum(held[0] - change, 0), np.maximum(held[1] + change, 0)
                return sum(c * np.log2(m / (c + 1)) for c, m in zip(counts, n_of))

            now = cost(0)
            gain = np.bincount(owner, weights=np.where(right[owner], (now - cost(-1))[terms], (now - cost(1))[terms]), minlength=len(docs))
            left_docs, right_docs = np.flatnonzero(~right), np.flatnonzero(right)
            out, back = left_docs[np.argsort(-gain[left_docs], kind="stable")], right_docs[np.argsort(-gain[right_docs], kind="stable")]
            m = min(len(out), len(back))
            swaps = int(np.argmin(np.append(gain[out[:m]] + gain[back[:m]] > 1e-9, False)))
            if not swaps:
                break
            right[out[:swaps]], right[back[:swaps]] = True, False
        return split(docs[~right]) + split(docs[right])

    return np.concatenate(split(np.arange(n)))


INDEX = "ids binary, places binary, impacts binary, run_cluster binary, run_term binary, run_size binary, run_most binary"


def shard_row(ids: list, sizes: list[int], terms: list, tfs: list, n_docs: int, n_terms: int) -> list[bytes]:
    """The columns of INDEX: postings by (cluster, term, place), and a run of them for each cluster and term."""
    lengths = np.fromiter(map(len, terms), np.int64, len(terms))
    doc, term, tf = np.repeat(np.arange(len(ids)), lengths), np.concatenate(terms).astype(np.int64), np.concatenate(tfs).astype(np.int64)
    order = bisected(doc, term, len(ids), CLUSTER)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    m = 25 + (75 * np.array(sizes, np.int64) * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    at = place[doc]
    by = np.lexsort((at, term, at // CLUSTER))
    at, term, impact = at[by], term[by], impact[by]
    first = np.flatnonzero(np.diff(at // CLUSTER, prepend=-1).astype(bool) | np.diff(term, prepend=-1).astype(bool))
    named = np.array([NO_ID if i is None else i for i in ids], np.int64)[order]
    columns = named, at.astype(np.int32), impact.astype(np.int32), (at[first] // CLUSTER).astype(np.int32), term[first].astype(np.int32)
    columns += np.diff(first, append=len(at)).astype(np.int32), np.maximum.reduceat(impact, first).astype(np.int32)
    return [c.tobytes() for c in columns]


def build_index(forward: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row of INDEX for each shard: a run of rows of forward as they stand."""
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        postings = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:2]), *(map(lambda x: x.values.to_numpy(), c) for c in batch.columns[2:])):
                held.append(row)
                postings += len(row[2])
                if len(held) >= SHARD or postings >= POSTINGS:
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in shard_row(*map(list, zip(*held)), n_docs, n_terms)], names=names)
                    held, postings = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in shard_row(*map(list, zip(*held)), n_docs, n_terms)], names=names)

    return forward.filter(F.size("terms") > 0).select("id", "n", "terms", "tfs").mapInArrow(run, INDEX)


class Shard:
    """A row of INDEX, searched."""

    def __init__(self, row: dict[str, bytes]):
        kinds = {"ids": np.int64}
        self.__dict__ |= {k: np.frombuffer(v, kinds.get(k, np.int32)) for k, v in row.items()}
        self.starts = np.cumsum(self.run_size) - self.run_size
        self.terms, column = np.unique(self.run_term, return_inverse=True)
        n = -(-len(self.ids) // CLUSTER)
        #: By cluster and term (the last column: a term that is not here) its run, or that of no postings, and greatest impact.
        self.run = np.full((n, len(self.terms) + 1), len(self.run_size))
        self.run[self.run_cluster, column] = np.arange(len(self.run_size))
        self.most = np.append(self.run_most, 0).astype(np.int64)[self.run]
        self.sizes, self.first = np.append(self.run_size, 0), np.append(self.starts, 0)

    def columns(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, terms)
        return np.where((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms), at, len(self.terms))

    def visit(self, cluster: int, columns: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the documents of a cluster that have one of the terms."""
        runs = self.run[cluster, columns]
        sizes = self.sizes[runs].astype(np.int64)
        at = np.repeat(self.first[runs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        place = self.places[at] - cluster * CLUSTER
        # Sums of whole numbers below 2^53 are exact in doubles.
        score = np.bincount(place, weights=self.impacts[at] * np.repeat(factors, sizes), minlength=CLUSTER).astype(np.int64)
        found = np.flatnonzero(score > 0)
        return self.ids[cluster * CLUSTER + found], score[found]


class Best:
    """The best documents that a task has found for each query: ids and scores, highest score first, ties by smaller id."""

    def __init__(self, n: int, top: int):
        self.top = top
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = (np.concatenate(x) for x in zip(self.found[q], (ids, scores)))
        by = np.lexsort((ids, -scores))[: self.top]
        self.found[q] = ids[by], scores[by]

    def floor(self, q: int) -> int:
        """The least score that could still come in, or tie."""
        scores = self.found[q][1]
        return int(scores[-1]) if len(scores) == self.top else 1


def search_pass(index: DataFrame, queries: Queries, weights: np.ndarray, top: int, floors: np.ndarray | None) -> DataFrame:
    """(q, id, score, visits) of each task's best documents. Without floors only the cluster of the greatest bound is
    visited in each shard; with them all whose bound reaches the floor and the task's own best. visits counts the task's."""
    factors = [weights[t] * n for t, n in zip(queries.terms, queries.times)]
    shared = index.sparkSession.sparkContext.broadcast((queries.terms, factors, floors))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, factors, floors = shared.value
        best, visits = Best(len(terms), top), np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({name: batch.column(i)[row].as_buffer().to_pybytes() for i, name in enumerate(batch.schema.names)})
                for q, (own, factor) in enumerate(zip(terms, factors)):
                    columns = shard.columns(own)
                    bounds = shard.most[:, columns] @ factor
                    order = np.argsort(-bounds, kind="stable")
                    for cluster in order[:1] if floors is None else order:
                        if bounds[cluster] < max(best.floor(q), 1 if floors is None else floors[q]):
                            break
                        visits[q] += 1
                        best.add(q, *shard.visit(cluster, columns, factor))
        ids, scores = zip(*best.found) if best.found else ([], [])
        of = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        if len(of):
            columns = of, np.concatenate(ids), np.concatenate(scores), visits[of]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "id", "score", "visits"])

    return index.mapInArrow(run, "q long, id long, score long, visits long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """found with its place among the rows of q, up to top."""
    by = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item id, rank, doc id, score): the `top` documents of highest score above 0 for each row of items.

    Ids of documents are whole numbers. A null text has no terms; a null document id stands after all others among
    equal scores and stays null. Rows that repeat are documents, and items, of their own, whatever their ids. An
    empty table on either side gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, out = -(-total // block_bytes) or 1, None
    name = fresh(["rank", id_col, "score"], item_col)
    for k in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        queries = Queries([(r.i, r.t) for r in part.collect()])
        forward = stored(forward_rows(docs, queries, id_col, text_col), "forward")
        n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = np.zeros(len(queries.vocabulary), np.int64)
        for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each query term
            held[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
        index = stored(build_index(forward, n_docs, n_terms), "index")
        discard(forward)
        floors = np.ones(len(queries.ids), np.int64)
        first = ranked(search_pass(index, queries, weights, top, None), top)
        for r in first.filter(F.col("rank") == top).select("q", "score").collect():  # a row for each query
            floors[r["q"]] = r["score"]
        found = stored(ranked(search_pass(index, queries, weights, top, floors), top), "found")
        discard(index)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"q long, i {kind}")
        rows = found.join(F.broadcast(names), "q").select(
            F.col("i").alias(name), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "score"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: The contract's columns in DuckDB over the tables documents and benchmark.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ws FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ws FROM benchmark),
n AS (SELECT count(*) FILTER (len(ws) > 0) AS n, CAST(coalesce(sum(len(ws)), 0) AS BIGINT) AS l FROM d),
qt AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(ws) AS t FROM q) GROUP BY ALL),
tf AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ws) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), n),
m AS (SELECT k, doc_id, 100 - 75 + (75 * len(ws) * n) // l AS m FROM d, n WHERE len(ws) > 0),
s AS (SELECT q, k, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM qt JOIN tf USING (t) JOIN w USING (t) JOIN m USING (k) GROUP BY ALL),
r AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (k) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r JOIN q USING (q) WHERE rank <= {TOP}
"""
