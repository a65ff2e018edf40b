"""SimHash near-duplicates: fingerprints, an inverted index over combinations of byte positions, components.

Two 64-bit fingerprints that differ in d bits or fewer differ in d of their eight bytes at most, so
they agree in 8 - d positions. The index has a posting for every set of 8 - d positions with the bytes
there. These keys stand for a tally of equal bytes: a pair meets just when 8 - d positions agree. No code
counts them; single-byte postings, which a tally needs, would each hold about a 256th of all fingerprints.
Met pairs are verified by their differing bits. A posting yields a
tree over its linked members, not their pairs. Postings beyond a size are handled exactly by centres
instead (see _centre_links).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import map_texts, release_worker, stored
from lumenfold.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Members of a posting up to which its pairs are compared directly.
POSTING = 4096
#: Fingerprints whose postings a task makes.
EXPLODE_ROWS = 16_384
#: Linked roots up to which their components' ids are broadcast.
BROADCAST_ROWS = 200_000
#: Ids of rows to drop, in bytes, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """Majority bits of the XXH64 values of all shingles, repeats included; 0 without a word."""
    found = WORD.findall((text or "").encode("utf-8").translate(LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, at = np.zeros(64, np.int64), 0
    while at < n:
        part = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])]
        octets = np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
        at += BLOCK
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row. Null and wordless texts have fingerprint 0."""

    def make():
        release_worker()

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            values = np.array([fingerprint(t, words) for t in piece.column(1).to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([piece.column(0), pa.array(values.view(np.int64))], names=[id_col, "fp"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, fp long", text_col)


def _posting_key(fp: Column, which: int, positions: tuple[int, ...]) -> Column:
    """The number of the position set above the bytes there (up to seven of them)."""
    key = F.lit(which).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
    return key


def _tree(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (member, least member reached) over the members of a posting within `distance` bits."""
    root = np.arange(len(fps))
    step = max(1, (1 << 21) // len(fps))
    while True:
        before = root.copy()
        for at in range(0, len(fps), step):
            near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= distance
            low = np.where(near, root[None, :], len(fps)).min(axis=1)
            root[at : at + step] = np.minimum(root[at : at + step], low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.nonzero(root != np.arange(len(fps)))[0]
    return list(zip(fps[moved].tolist(), fps[root[moved]].tolist()))


def _posting_links(distance: int, limit: int):
    """For mapInArrow over rows (key, fp) sorted by key: links of each posting, or its members marked as crowded."""

    def out(links: list[tuple[int, int]], crowded: np.ndarray) -> pa.RecordBatch:
        u = np.array([x[0] for x in links] + crowded.tolist(), dtype=np.uint64).view(np.int64)
        v = np.array([x[1] for x in links], dtype=np.uint64).view(np.int64)
        v = pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(len(crowded), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept, over = None, np.zeros(0, np.uint64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            links, crowded = [], [np.zeros(0, np.uint64)]
            cuts = np.nonzero(keys[1:] != keys[:-1])[0] + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(keys)]))
            if kept_key is not None and keys[0] != kept_key:
                if not over and len(kept) > 1:
                    links += _tree(kept, distance)
                kept, over = np.zeros(0, np.uint64), False
            # The first run may go on from the last batch, the last run may go on in the next.
            first = np.concatenate((kept, fps[: ends[0]]))
            if over or len(first) > limit:
                crowded.append(fps[: ends[0]] if over else first)
                first, over = first[:0], True
            if len(starts) > 1:
                if not over and len(first) > 1:
                    links += _tree(first, distance)
                over = False
                sizes = ends - starts
                pair = np.nonzero(sizes[1:-1] == 2)[0] + 1
                a, b = fps[starts[pair]], fps[starts[pair] + 1]
                near = np.bitwise_count(a ^ b) <= distance
                links += list(zip(a[near].tolist(), b[near].tolist()))
                for i in (np.nonzero(sizes[1:-1] > 2)[0] + 1).tolist():
                    run_fps = fps[starts[i] : ends[i]]
                    if len(run_fps) > limit:
                        crowded.append(run_fps)
                    else:
                        links += _tree(run_fps, distance)
                first = fps[starts[-1] :]
                if len(first) > limit:
                    crowded.append(first)
                    first, over = first[:0], True
            kept_key, kept = keys[-1], first
            more = np.concatenate(crowded)
            if links or len(more):
                yield out(links, more)
        if not over and len(kept) > 1 and (links := _tree(kept, distance)):
            yield out(links, kept[:0])

    return run


def _centres(fp: Column, radius: int) -> Column:
    """All values within `radius` bits of fp, with their distance."""
    masks = [(sum(1 << b for b in bits), r) for r in range(radius + 1) for bits in combinations(range(64), r)]
    signed = [(m - (1 << 64) if m >> 63 else m, r) for m, r in masks]
    table = F.array(*[F.lit(m) for m, _ in signed]), F.array(*[F.lit(r) for _, r in signed])
    return F.transform(F.arrays_zip(table[0].alias("m"), table[1].alias("r")), lambda x: F.struct(fp.bitwiseXOR(x["m"]).alias("centre"), x["r"].alias("r")))


def _centre_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links of crowded fingerprints, in rows linear in their number.

    Two values differ in d bits or fewer just when a centre lies within floor(d/2) of one and ceil(d/2)
    of the other. All members of a centre link with its least inner member; a centre without one links none.
    """
    inner = distance // 2
    rows = fps.select("fp", F.explode(_centres(F.col("fp"), distance - inner)).alias("c"))
    rows = rows.select(F.col("c.centre").alias("key"), (F.col("c.r") > inner).cast("int").alias("outer"), "fp")
    rows = rows.repartition("key").sortWithinPartitions("key", "outer", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, outer, fp = (batch.column(i).to_numpy() for i in range(3))
            begins = np.concatenate(([True], keys[1:] != keys[:-1]))
            begins[0] = key is None or keys[0] != key
            at = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
            hubs, ok = fp[np.maximum(at, 0)], outer[np.maximum(at, 0)] == 0
            if not begins[0]:
                hubs[at < 0], ok[at < 0] = (0, False) if hub is None else (hub, True)
            key, hub = keys[-1], (hubs[-1] if ok[-1] else None)
            use = ok & (fp != hubs)
            yield pa.RecordBatch.from_arrays([pa.array(fp[use]), pa.array(hubs[use])], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def fingerprint_links(fps: DataFrame, distance: int = 4, posting: int = POSTING) -> DataFrame:
    """Distinct fingerprints (column fp) -> links (u, v) whose components are those of all pairs within `distance` bits."""
    if not 0 <= distance <= 6:
        raise ValueError("distance must be from 0 to 6, so that two byte positions at least agree")
    if distance == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    keys = [_posting_key(F.col("fp"), i, c) for i, c in enumerate(combinations(range(8), 8 - distance))]
    spread = fps.repartition(max(1, -(-fps.count() // EXPLODE_ROWS)))  # fingerprints are few bytes and would be one task
    rows = spread.select(F.explode(F.array(*keys)).alias("key"), "fp")
    rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    found = stored(rows.mapInArrow(_posting_links(distance, posting), "u long, v long").distinct(), "posting-links")
    crowded = found.filter("v is null").select(F.col("u").alias("fp"))
    links = found.filter("v is not null")
    if crowded.isEmpty():
        return links
    return links.unionByName(_centre_links(crowded, distance))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, posting: int = POSTING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id reachable over links).

    Null texts and texts without a word have fingerprint zero and link like others. Exact copies share a
    fingerprint, so a group of copies of any size is one entry of the index. Repeated ids give repeated
    rows. A null id keeps its row; it is never a component_id unless its component has no other id. An
    empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    prints = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    found = connected_components(fingerprint_links(distinct.select("fp"), distance, posting))
    rooted = stored(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left"), "rooted")
    linked = rooted.filter("root is not null")
    of_root = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    if of_root.count() <= BROADCAST_ROWS:
        of_root = F.broadcast(of_root)
    classes = rooted.join(of_root, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp", "left").select(id_col, text.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the least id. Columns and names stay.

    Of rows that repeat that id one stays. Rows without an id cannot be told apart and stay. The ids that go, not
    those that stay, are joined with docs: they are broadcast up to `broadcast_bytes`, so that texts are not shuffled;
    beyond that both sides are shuffled by the id.
    """
    of_id = near_duplicates(docs, words, distance, id_col=id_col, text_col=text_col).filter(F.col(id_col).isNotNull())
    of_id = of_id.groupBy(id_col).agg(F.max(F.col(id_col) == F.col("component_id")).alias("__stays"), (F.count("*") > 1).alias("__repeats"))
    other = stored(of_id.filter("__repeats or not __stays"), "not-once")
    size = other.agg(F.sum(F.octet_length(F.col(id_col).cast("string")) + 8), F.max(F.col("__stays"))).first()
    ids = other.select(id_col)
    out = docs.join(F.broadcast(ids) if (size[0] or 0) <= broadcast_bytes else ids, id_col, "left_anti")
    if size[1]:
        out = out.unionByName(docs.join(other.filter("__stays").select(id_col), id_col, "left_semi").dropDuplicates([id_col]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


# The primes of XXH64.
_PRIMES = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _xxh64_sql(names: str, source: str, text: str, seed: int) -> str:
    """CTEs that give the table `names` of (text, h): XXH64 of each different text of `source`, in 128-bit whole numbers."""
    word = "18446744073709551616::UHUGEINT"
    one, two, three, four, five = (f"{p}::UHUGEINT" for p in _PRIMES)
    low = lambda x: f"(({x}) % {word})"
    let = lambda x, body: f"list_transform([{x}], lambda y: {body})[1]"
    turned = lambda x, r: let(x, f"{low(f'y * {1 << r}::UHUGEINT')} + y // {1 << (64 - r)}::UHUGEINT")
    mixed = lambda state, lane: low(f"{turned(low(f'{state} + {low(f'{lane} * {two}')}'), 31)} * {one}")
    lane = lambda at, n: " + ".join(f"b[{at} + {j + 1}] * {256**j}::UHUGEINT" for j in range(n))
    start = ", ".join(f"{x % (1 << 64)}::UHUGEINT" for x in (seed + _PRIMES[0] + _PRIMES[1], seed + _PRIMES[1], seed, seed - _PRIMES[0]))
    stripes = f"list_transform(range(n // 32), lambda k: [{', '.join(lane(f'(32 * k + {8 * j})', 8) for j in range(4))}])"
    striped = f"list_reduce({stripes}, lambda s, e: [{', '.join(mixed(f's[{j}]', f'e[{j}]') for j in range(1, 5))}], [{start}])"
    joined = " + ".join(turned(f"v[{j}]", r) for j, r in zip(range(1, 5), (1, 7, 12, 18)))
    merged = f"list_reduce(v, lambda h, x: {low(f'xor(h, {mixed("0::UHUGEINT", "x")}) * {one} + {four}')}, {low(joined)})"
    eights = f"list_transform(range(n % 32 // 8), lambda k: {lane('(n - n % 32 + 8 * k)', 8)})"
    by_eight = f"list_reduce({eights}, lambda h, x: {low(f'{turned(f"xor(h, {mixed("0::UHUGEINT", "x")})", 27)} * {one} + {four}')}, h)"
    by_four = f"CASE WHEN n % 8 >= 4 THEN {low(f'{turned(f"xor(h, {low(f"({lane("(n - n % 8)", 4)}) * {one}")})", 23)} * {two} + {three}')} ELSE h END"
    ends = "list_transform(range(n % 4), lambda k: b[n - n % 4 + k + 1])"
    by_one = f"list_reduce({ends}, lambda h, x: {low(f'{turned(f"xor(h, {low(f"x * {five}")})", 11)} * {one}')}, h)"
    last = "h"
    for shift, prime in ((33, two), (29, three), (32, None)):
        last = let(last, f"xor(y, y // {1 << shift}::UHUGEINT)")
        last = low(f"{last} * {prime}") if prime else last
    return f"""{names}_b AS (SELECT t, length(x) // 2 AS n, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UHUGEINT) AS b
  FROM (SELECT t, hex(encode(t)) AS x FROM (SELECT DISTINCT {text} AS t FROM {source}))),
{names}_v AS (SELECT t, n, b, CASE WHEN n >= 32 THEN {striped} END AS v FROM {names}_b),
{names}_h AS (SELECT t, n, b, {low(f"CASE WHEN n >= 32 THEN {merged} ELSE {seed}::UHUGEINT + {five} END + n::UHUGEINT")} AS h FROM {names}_v),
{names}_8 AS (SELECT t, n, b, {by_eight} AS h FROM {names}_h), {names}_4 AS (SELECT t, n, b, {by_four} AS h FROM {names}_8), {names}_1 AS (SELECT t, {by_one} AS h FROM {names}_4),
{names} AS (SELECT t, ({last})::UBIGINT AS h FROM {names}_1)"""


def _sql(words: int = 4, distance: int = 4, seed: int = 42) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = " + ".join(f"(2 * sum((h >> {b}) & 1) > count(*))::INTEGER::UHUGEINT * {1 << b}::UHUGEINT" for b in range(64))
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT k, array_to_string(list_slice(ws, i, i + {words - 1}), ' ') AS shingle FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
{_xxh64_sql("x", "s", "shingle", seed)},
f AS (SELECT k, {bits} AS fp FROM s JOIN x ON x.t = s.shingle GROUP BY k),
p AS (SELECT k, doc_id, coalesce(fp, 0::UHUGEINT) AS fp FROM d LEFT JOIN f USING (k)),
u AS (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
e AS (SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::HUGEINT) <= {distance}),
r AS (SELECT fp, fp AS other FROM u UNION SELECT r.fp, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT r.fp, min(least) AS component_id FROM r JOIN u ON u.fp = r.other GROUP BY r.fp)
SELECT doc_id, lower(lpad(hex(fp::UBIGINT), 16, '0')) AS fingerprint, component_id FROM p JOIN c USING (fp)
"""


#: The same in DuckDB over the table documents, comparing all pairs of different fingerprints.
SQL = _sql()
