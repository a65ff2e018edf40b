"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is a bounded run of documents. Its words become numbers (one per benchmark word, -1 for any
other), and the suffixes that could begin a benchmark window are sorted by their words: a suffix array
without the suffixes that cannot match. The window that begins each suffix of the benchmark is
binary-searched in it, equal windows once; the entries that begin with it are its occurrences, so a
place has an occurrence for each window length at most, however often texts repeat themselves. At each
place the longest verbatim match is that with one of its two neighbours among the sorted benchmark
suffixes. The covered words are hit, and documents with a hit are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh, release_worker, stored, text_chunks

#: Each byte as decontamination reads it: A-Z in lower case, 0-9, a-z and bytes of non-ASCII letters, else a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOW = 10
#: Stands after the words of an item.
END = -2
#: Benchmark text that is broadcast at a time; a larger benchmark takes a pass over the documents for each block. Its
#: suffixes and windows are some 18 times as large in each worker.
BLOCK_BYTES = 3 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(WORDS).split()


class Suffixes:
    """The suffixes of a block of benchmark items that are as long as their item's window at least, and their windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        flat: list[int] = []
        starts, need, depth, item = [], [], [], []
        names = sorted({i for i, _ in items})
        place = {name: k for k, name in enumerate(names)}
        for name, text in items:
            ws = words(text)
            size = min(window, len(ws))
            for at in range(len(ws) - size + 1 if ws else 0):
                starts.append(len(flat) + at)
                need.append(size)
                depth.append(len(ws) - at)
                item.append(place[name])
            flat += [number(w, len(self.vocabulary)) for w in ws]
            flat.append(END)
        self.names = np.array(names, dtype=object)
        self.flat = np.array(flat + [END] * window, dtype=np.int32)
        starts, need, depth, item = (np.array(x, dtype=np.int64) for x in (starts, need, depth, item))
        heads = self.flat[starts[:, None] + np.arange(window)].astype(np.int32)
        heads[np.arange(window) >= need[:, None]] = END
        keyed = np.hstack([heads, need[:, None].astype(np.int32)])
        self.heads, of = np.unique(keyed, axis=0, return_inverse=True) if len(keyed) else (keyed, np.zeros(0, np.int64))
        self.heads, self.need = self.heads[:, :window], self.heads[:, window].astype(np.int64)
        pairs = np.unique(np.stack([of.ravel(), item], axis=1), axis=0)
        self.item, self.item_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.heads) + 1))
        least = np.full(len(self.vocabulary) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, self.heads[:, 0], self.need)
        self.least = least  # by first word, the words of its shortest window; the last entry is for unknown words
        long = self.need > 1
        self.seconds = np.unique(_pair(self.heads[long, 0], self.heads[long, 1])) if long.any() else np.zeros(0, np.int64)
        order = np.argsort(_suffix_ranks(self.flat, int(depth.max()) if len(depth) else 0)[starts], kind="stable")
        self.starts, self.depth, self.owner = starts[order], depth[order], item[order]
        self.sums, self.powers = _prefix_sums(self.flat)

    def longest(self, shard: np.ndarray, places: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the text from each place the words that match a benchmark suffix, the longest match, and that suffix.

        Suffixes are in order, so the longest match is with the one before or after the place's text. Lengths of
        matches are found by halving, over 64-bit sums of the words.
        """
        sums, powers = _prefix_sums(shard)

        def common(suffix: np.ndarray) -> np.ndarray:
            at = self.starts[suffix]
            low, high = np.zeros(len(places), np.int64), np.minimum(most, self.depth[suffix])
            while (low < high).any():
                mid = (low + high + 1) // 2
                here = (sums[places + mid] - sums[places]) * self.powers[at]
                there = (self.sums[at + mid] - self.sums[at]) * powers[places]
                same = here == there
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            return low

        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.starts), np.int64)
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(self.starts) - 1)
            n = common(mid)
            before = (self.flat[self.starts[mid] + n] < shard[places + n]) & (low < high)
            low, high = np.where(before, mid + 1, low), np.where(before | (low >= high), high, mid)
        below, above = np.maximum(low - 1, 0), np.minimum(low, len(self.starts) - 1)
        first, second = common(below), common(above)
        return np.maximum(first, second), np.where(first >= second, below, above)

    def candidates(self, shard: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Places where known words go on for as long as the shortest window that begins with that word, and the
        second word follows the first in some window."""
        at = np.nonzero(run >= self.least[shard])[0]
        if len(at) and len(self.seconds):
            keys = _pair(shard[at], shard[at + 1])
            near = np.minimum(np.searchsorted(self.seconds, keys), len(self.seconds) - 1)
            at = at[(self.seconds[near] == keys) | (self.least[shard[at]] == 1)]
        return at


def _suffix_ranks(flat: np.ndarray, longest: int) -> np.ndarray:
    """The rank of the suffix at each place by prefix doubling, up to `longest` words."""
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < longest:
        after = np.concatenate((rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64)))
        rank = np.unique(rank << 32 | after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def _prefix_sums(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums, modulo 2^64, of mixed words times powers of an odd number up to each place, and those powers."""
    x = (numbers.astype(np.int64) + 3).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(x), 0xD1342543DE82EF95, np.uint64))), dtype=np.uint64)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers[:-1], dtype=np.uint64))), powers


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)


def _sign(rows: np.ndarray, heads: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of the first difference between rows and heads within their first `need` words."""
    differ = np.sign(rows.astype(np.int64) - heads) * (np.arange(heads.shape[1]) < need[:, None])
    return differ[np.arange(len(differ)), (differ != 0).argmax(axis=1)]


def search(grid: np.ndarray, heads: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each head the range of sorted suffixes (rows of grid) that begin with its first `need` words."""
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(heads), np.int64), np.full(len(heads), len(grid), np.int64)
        while len(go := np.nonzero(low < high)[0]):
            mid = (low[go] + high[go]) // 2
            sign = _sign(grid[mid], heads[go], need[go])
            right = sign <= 0 if upper else sign < 0
            low[go[right]] = mid[right] + 1
            high[go[~right]] = mid[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


def match_shard(texts: list[str | None], block: Suffixes) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Words of each text; of every occurrence of a window its text, first word and window; and of every longest
    verbatim match that is not part of the one a word before its text, first word, length and suffix."""
    found = [words(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    none = np.zeros(0, np.int64)
    get = block.vocabulary.get
    # Each text ends with a word of its own, so no suffix goes on into the next text.
    shard = np.fromiter((n for ws in found for n in (*map(get, ws, repeat(-1)), -1)), np.int32, int(sizes.sum()) + len(sizes))
    nothing = sizes, (none,) * 3, (none,) * 4
    if not len(block.heads) or not len(shard):
        return nothing
    unknown = np.where(shard < 0, np.arange(len(shard)), len(shard))
    run = np.minimum.accumulate(unknown[::-1])[::-1] - np.arange(len(shard))
    places = block.candidates(shard, run)
    if not len(places):
        return nothing
    padded = np.concatenate((shard, np.full(block.window, -1, np.int32)))
    grid = padded[places[:, None] + np.arange(block.window)]
    order = np.lexsort(grid.T[::-1])
    grid, places = grid[order], places[order]
    low, high = search(grid, block.heads, block.need)
    counts = high - low
    if not counts.any():
        return nothing
    head = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(head)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = places[np.repeat(low, counts) + nth]
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.searchsorted(begins, place, side="right") - 1
    at = np.unique(place)
    matched, suffix = block.longest(padded, at, run[at])
    part = np.concatenate(([False], (at[1:] == at[:-1] + 1) & (matched[1:] == matched[:-1] - 1)))
    at, matched, suffix = at[~part], matched[~part], suffix[~part]
    of = np.searchsorted(begins, at, side="right") - 1
    return sizes, (text, place - begins[text], head), (of, at - begins[of], matched, suffix)


SPAN = pa.struct([("first", pa.int64()), ("length", pa.int64()), ("item", pa.string())])
SPANS = "array<struct<first: bigint, length: bigint, item: string>>"


class Names:
    """Names of added columns that no column of the documents has."""

    def __init__(self, taken: list[str]):
        self.words, self.hits, self.items, self.spans = (fresh(taken, n) for n in ("__n_words", "__hits", "__items", "__spans"))
        self.n_hit, self.n_items, self.sha = (fresh(taken, n) for n in ("__n_hit", "__n_items", "__items_sha256"))

    def state(self) -> str:
        return f"`{self.words}` long, `{self.spans}` {SPANS}, `{self.hits}` binary, `{self.items}` array<string>"

    def result(self) -> str:
        return f"`{self.words}` long, `{self.spans}` {SPANS}, `{self.n_hit}` long, `{self.n_items}` long, `{self.sha}` string"


def _groups(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its entries) of the entries' texts."""
    order = np.argsort(of, kind="stable")
    for part in np.split(order, np.nonzero(np.diff(of[order]))[0] + 1) if len(order) else []:
        yield int(of[part[0]]), part


def _pass(block: Suffixes, text_col: str, names: Names, final: bool):
    """For mapInArrow: adds a block's hits (one bit for each word), items and longest matches to the state columns.

    The last pass gives the counts and the digest in place of hits and items, so that a task has one Python worker.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in batches:
            for piece in text_chunks(batch, text_col):
                column = {f.name: piece.column(i) for i, f in enumerate(piece.schema)}
                sizes, (text, first, head), (of, start, length, suffix) = match_shard(column[text_col].to_pylist(), block)
                bits, items, spans = (column.pop(c).to_pylist() for c in (names.hits, names.items, names.spans))
                for t, part in _groups(text):
                    edge = np.zeros(int(sizes[t]) + 1, np.int64)
                    np.add.at(edge, first[part], 1)
                    np.add.at(edge, first[part] + block.need[head[part]], -1)
                    hit = np.cumsum(edge[:-1]) > 0
                    if bits[t]:
                        hit |= np.unpackbits(np.frombuffer(bits[t], np.uint8), count=len(hit)).astype(bool)
                    bits[t] = np.packbits(hit).tobytes()
                    there = {i for h in np.unique(head[part]).tolist() for i in block.item[block.item_from[h] : block.item_from[h + 1]].tolist()}
                    items[t] = sorted({*(items[t] or []), *(block.names[i] for i in there)})
                for t, part in _groups(of):
                    owners = block.names[block.owner[suffix[part]]].tolist()
                    found = [{"first": a, "length": n, "item": i} for a, n, i in zip(start[part].tolist(), length[part].tolist(), owners)]
                    spans[t] = [*(spans[t] or []), *found]
                column |= {names.words: pa.array(sizes), names.spans: pa.array(spans, pa.list_(SPAN))}
                if final:
                    column[names.n_hit] = pa.array([int(np.bitwise_count(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in bits], pa.int64())
                    column[names.n_items] = pa.array([len(i or []) for i in items], pa.int64())
                    column[names.sha] = pa.array([hashlib.sha256(",".join(i or []).encode()).hexdigest() for i in items])
                else:
                    column |= {names.hits: pa.array(bits, pa.binary()), names.items: pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    return run


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, Names]:
    """docs with the columns of Names: words, hit words, items, their digest, and spans (first word, length, item) of the
    longest verbatim matches that begin with a window. The benchmark is broadcast in blocks of bounded size."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    before, names = _columns(docs), Names(docs.columns)
    empty = {names.words: "bigint", names.spans: SPANS, names.hits: "binary", names.items: "array<string>"}
    out = docs.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        block = Suffixes([(r.i, r.t) for r in part.collect()], window)
        final = k == blocks - 1
        out = out.mapInArrow(_pass(block, text_col, names, final), f"{before}, {names.result() if final else names.state()}")
        if not final:
            out = stored(out, "marked")
    return out, names


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, matches.

    A window is `window` words of an item in a row; an item of fewer words is one window, one of none has
    none. Null and empty texts have no words on either side. Items that share an id are one item; a null id
    reads "null". Ids of documents may repeat or be null. Other columns are ignored, whatever their names.
    matches has first word, length in words and an item of each longest verbatim match (null: none).
    """
    marked, n = mark(docs.select(id_col, text_col), benchmark, window, text_col, item_col, item_text)
    return marked.selectExpr(
        f"`{id_col}`", f"{n.words} as n_words", f"{n.n_hit} as n_hit", f"{n.n_items} as n_items", f"{n.sha} as items_sha256", f"{n.n_hit} > 0 as contaminated",
        f"cast(coalesce(array_max({n.spans}.length), 0) as int) as longest_match", f"{n.spans} as matches",
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: The contract's columns in DuckDB over the tables documents and benchmark.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS ws FROM benchmark),
s AS (SELECT item, ws, least({WINDOW}, len(ws)) AS size FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, size, list_slice(ws, i, i + size - 1) AS win FROM (SELECT item, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM s)),
dw AS (SELECT k, size, i, list_slice(ws, i, i + size - 1) AS win
       FROM (SELECT k, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM w) WHERE len(ws) >= size)),
m AS (SELECT k, dw.size, i, item FROM dw JOIN w ON dw.size = w.size AND dw.win = w.win),
h AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT k, size, i FROM m), range({WINDOW}) AS r(j) WHERE j < size GROUP BY k),
wl AS (SELECT r, size, j, list_slice(ws, j, j + size - 1) AS win FROM (SELECT r, size, ws, unnest(range(1, len(ws) - size + 2)) AS j FROM (SELECT row_number() OVER () AS r, * FROM s))),
p AS (SELECT k, r, dw.size, i, i - j AS d FROM dw JOIN wl ON dw.size = wl.size AND dw.win = wl.win),
x AS (SELECT k, max(n) AS longest FROM (SELECT k, count(*) + size - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY k, r, size, d ORDER BY i) AS g FROM p) GROUP BY k, r, size, d, g) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT k, item FROM m) GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS INTEGER) AS longest_match
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k) LEFT JOIN x USING (k)
"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a hit word; columns and names stay, whatever they are."""
    marked, n = mark(docs, benchmark, window, text_col, item_col, item_text)
    return marked.filter(F.col(n.n_hit) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
