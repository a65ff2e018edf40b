"""Best-fit packing of token sequences by bin completion with branch and bound.

Lengths are whole numbers up to the capacity, so however many documents there are the problem is a
histogram with `capacity` entries at most. The plan is made on that histogram: around the largest
remaining length, undominated fillings of the rest of its sequence are enumerated lazily, the fullest first;
a filling is applied as often as the counts allow. Depth-first search over the fillings prunes a branch
whose waste so far leaves no fewer sequences than the incumbent, which is at first the best-fit plan.
The plan, not the documents, is what the driver holds; pieces find their places by their rank among
the pieces of their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import kept_in_worker, map_texts, stored
from lumenfold.llm.merges import LONG, PairMerges, byte_letters

CAPACITY = 4096
#: Steps of the search: lengths tried in fillings, and NODE steps for each node; a plan that meets the lower bound ends it sooner.
STEPS, NODE = 2_000_000, 100
#: Rows of one rank window.
RANK_ROWS = 4_000
#: Words that a worker remembers, at most.
REMEMBERED = 500_000


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by total, and by large lengths that cannot share one (for every cut)."""
    tokens = counts * np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(tokens)
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    above = number[-1] - number[capacity - k]  # beside these nothing of length k or more fits
    middle = number[capacity - k] - number[half]
    room = middle * capacity - (total[capacity - k] - total[half])
    small = total[half] - total[np.maximum(k, 1) - 1]
    cuts = above + middle + np.maximum(0, -(-(small - room) // capacity))
    return max(int(-(-total[-1] // capacity)), int(cuts.max()))


def _upto(bits: int, most: int) -> int:
    """The largest set bit of `bits` that is no larger than `most`; -1 without one."""
    return (bits & ((2 << most) - 1)).bit_length() - 1


def _smeared(bits: int, n: int) -> int:
    """Every bit together with the n bits above it."""
    done = 0
    while done < n:
        step = min(done + 1, n - done)
        bits |= bits << step
        done += step
    return bits


class Spent(Exception):
    """The steps of a search are used up."""


class Fillings:
    """The undominated sets of lengths for a room, lazily, the fullest first.

    A set is dominated if a length left out could stand for one smaller member or for several members and
    still fit, or be added: a packing that uses the other set instead is no worse. Sets are built from
    the largest member down, so whatever dominates a beginning dominates all that go on from it, and they
    are cut there.
    """

    def __init__(self, counts: np.ndarray, room: int):
        self.room = room
        self.counts = counts
        self.present = int.from_bytes(np.packbits(counts[: room + 1] > 0, bitorder="little").tobytes(), "little") & ~1
        self.sums = self._sums()

    def _sums(self) -> int:
        """The sums, up to the room, that available lengths add up to, as bits."""
        full, sums, rest = (2 << self.room) - 1, 1, self.present
        while rest and sums != full:
            low = rest & -rest
            size, rest = low.bit_length() - 1, rest ^ low
            n, k = min(int(self.counts[size]), self.room // size), 1
            while n > 0:
                sums |= sums << size * min(k, n) & full
                n, k = n - k, 2 * k
        return sums

    def each(self, spend) -> Iterator[tuple[int, ...]]:
        """The sets; spend() is called at each length tried."""
        total = self.room
        while (total := _upto(self.sums, total)) >= 0:
            yield from self._of_total(total, spend)
            total -= 1
            if total < 0:
                return

    def _of_total(self, total: int, spend) -> Iterator[tuple[int, ...]]:
        spare = self.room - total
        members: list[int] = []
        # What is to be filled, the largest length to try next, the sums of one and of several members, lengths with a copy left.
        frames = [(total, total, 0, 0, self.present)]
        while frames:
            rest, top, ones, several, left = frames[-1]
            size = _upto(left, min(top, rest)) if rest else 0
            if not rest and not left & ((2 << spare) - 1):
                yield tuple(members)
            if size <= 0:
                frames.pop()
                if members:
                    members.pop()
                continue
            spend()
            frames[-1] = (rest, size - 1, ones, several, left)
            if not self.sums >> (rest - size) & 1:
                continue
            if members.count(size) + 1 == self.counts[size]:
                left &= ~(1 << size)
            several |= several << size | ones << size
            ones |= 1 << size
            if _smeared(several, spare) & left or spare and _smeared(ones << 1, spare - 1) & left:
                continue
            members.append(size)
            frames.append((rest - size, size, ones, several, left))


Step = tuple[tuple[int, ...], int]


def best_fit(counts: np.ndarray, capacity: int) -> list[Step]:
    """The first incumbent: each sequence begins with the largest length and takes the largest that fits, again and again."""
    left, steps = counts.astype(np.int64).copy(), []
    present = int.from_bytes(np.packbits(left > 0, bitorder="little").tobytes(), "little") & ~1
    while present:
        members: list[int] = []
        taken: Counter = Counter()
        room, open_ = capacity, present
        while (size := _upto(open_, room)) > 0:
            members.append(size)
            taken[size] += 1
            room -= size
            if taken[size] == left[size]:
                open_ &= ~(1 << size)
        times = min(int(left[m]) // n for m, n in taken.items())
        for m, n in taken.items():
            left[m] -= n * times
            if not left[m]:
                present &= ~(1 << m)
        steps.append((tuple(members), times))
    return steps


def plan(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[Step], int]:
    """[(lengths of a sequence, how many such sequences)] and the lower bound, for counts[length].

    A plan as small as the bound, or one found when the search ends by itself, is optimal; otherwise it is the
    best of the plans met in `steps` steps, the best-fit plan among them.
    """
    need = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(times for _, times in best)
    left = counts.astype(np.int64).copy()
    spent = 0

    def spend(n: int = 1) -> None:
        nonlocal spent
        spent += n
        if spent > steps:
            raise Spent

    def choices() -> Iterator[tuple[Counter, int]]:
        """Fillings around the largest length left, each as often as the counts allow, then once.

        A filling once leaves all other ways of filling further sequences open, so no plan is passed over.
        """
        top = int(np.nonzero(left)[0][-1])
        left[top] -= 1
        found = Fillings(left, capacity - top)
        found.counts = left.copy()
        left[top] += 1
        for rest in found.each(spend):
            members = Counter((top, *rest))
            times = min(int(left[m]) // n for m, n in members.items())
            yield members, times
            if times > 1:
                yield members, 1

    path: list[tuple[Counter, int]] = []
    open_nodes: list[Iterator[tuple[Counter, int]]] = []
    used = 0
    try:
        while fewest > need:
            spend(NODE)
            if left.any():
                deeper = used + lower_bound(left, capacity) < fewest
            else:
                deeper = False
                if used < fewest:
                    fewest, best = used, [(tuple(sorted(m.elements(), reverse=True)), times) for m, times in path]
            if deeper:
                open_nodes.append(choices())
            elif path:
                used -= _apply(left, path.pop(), -1)
            while open_nodes and (found := next(open_nodes[-1], None)) is None:
                open_nodes.pop()
                if path:
                    used -= _apply(left, path.pop(), -1)
            if not open_nodes:
                break
            path.append(found)
            used += _apply(left, found, 1)
    except Spent:
        pass
    return best, need


def _apply(left: np.ndarray, step: tuple[Counter, int], sign: int) -> int:
    members, times = step
    for m, n in members.items():
        left[m] -= sign * n * times
    return times


class PieceMaker:
    """Token ids of texts by a lower-casing word-level BPE tokenizer file, remembered by word as little-endian bytes.

    Words of lower-case Latin letters are merged in batches by the file's ranks; all else goes to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))).search if specials else None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = PairMerges(model)
        ends = model.get("end_of_word_suffix") or ""
        self.inner, self.last = (np.array([model["vocab"][c + e] for c in byte_letters()], dtype=np.int64) for e in ("", ends))
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merge_long(self, word: bytes) -> bytes:
        symbols = self.inner[np.frombuffer(word, np.uint8)]
        symbols[-1] = self.last[word[-1]]
        return self.merges.merge_long(symbols).astype("<u4").tobytes()

    def _merge(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        symbols, row = self.merges.merge(symbols, np.repeat(np.arange(len(words)), sizes))
        cuts = (4 * np.cumsum(np.bincount(row, minlength=len(words)))).tolist()
        ids = symbols.astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, wanted: set[bytes]) -> None:
        """Makes all wanted words known. Words of the memory before the last are taken over when they are met again."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {b"": b""}
        known, older = self.known, self.older
        new = wanted.difference(known)
        met = [w for w in new if w in older]
        known.update((w, older[w]) for w in met)
        new.difference_update(met)
        plain = [w for w in new if PLAIN(w)]
        odd = new.difference(plain)
        ends = {w: m.groups() for w in odd if (m := TAIL(w))}
        parts = {part for pair in ends.values() for part in pair}.difference(known, plain)
        plain += [w for w in parts if PLAIN(w)]
        rest = list(odd.difference(ends).union(parts).difference(plain))
        known.update((w, self._merge_long(w)) for w in plain if len(w) > LONG)
        plain = [w for w in plain if len(w) <= LONG]
        if plain:
            known.update(zip(plain, self._merge(plain)))
        known.update(zip(rest, self._encode([w.decode("utf-8") for w in rest])))
        known.update((w, known[stem] + known[tail]) for w, (stem, tail) in ends.items())

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """No token spans a space or line end, so texts are cut there, A-Z lowered first as the tokenizer does;
        a text with a special string is encoded whole."""
        parts = [(t or "").encode("utf-8").translate(FOLD).split(b" ") for t in texts]
        self._learn(set().union(*parts))
        known = self.known.__getitem__
        return [self._encode([t])[0] if t and self.special and self.special(t) else b"".join(map(known, p)) for t, p in zip(texts, parts)]


#: A-Z in lower case, line ends as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))
#: A word of lower-case letters that no normal form changes: a to z and those of Latin-1 with two bytes.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: A word that ends in ASCII punctuation after a letter or digit (no apostrophe): two tokens' texts at least.
TAIL = re.compile(rb"([^']*[a-z0-9])([!-&(-/:-@\[-`{-~]+)").fullmatch


def token_pieces(docs: DataFrame, vocab: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document: its ids and end_id, cut only where longer than capacity."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        maker = kept_in_worker(("pieces", vocab), lambda: PieceMaker(vocab))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, ids in enumerate(maker.ids(batch.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            of, piece, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
            columns = [batch.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long", text_col)


def _ranked(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """pieces with their rank (from 0) among those of equal length, any order; no task gets a whole length that is common."""
    rows = pieces.count()
    parts = max(1, rows // RANK_ROWS)
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64(*keys, "piece", "length"), F.lit(parts)))
    within = Window.partitionBy("length", "__part").orderBy("piece", *keys)
    sizes = dealt.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1).join(offsets, ["length", "__part"])
    return ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__part", "__before")


def _places(steps: list[Step]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of the length in a sequence, offset in it), sorted."""
    rows, taken, sequence = [], Counter(), 0
    for members, times in steps:
        offset = 0
        for length, n in Counter(members).items():
            rows.append((length, taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, steps: int = STEPS, keys: list[str] | None = None) -> DataFrame:
    """pieces (length from 1 to capacity, piece, keys) with sequence_id and offset, in as few sequences as the plan finds.

    Offsets of a sequence are gapless from 0. Pieces that are alike in every column get different places.
    An empty table gives an empty one.
    """
    keys = keys or ["doc_id"]
    histogram = pieces.groupBy("length").count().collect()  # `capacity` rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    planned, _ = plan(counts, capacity, steps)
    places = pieces.sparkSession.sparkContext.broadcast(_places(planned))  # bounded by the histogram, not by the pieces
    ranked = _ranked(pieces, keys)
    names = [c for c in ranked.columns if c != "__rank"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        order = table[:, 0] << 44 | table[:, 1] if len(table) else np.zeros(0, np.int64)
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            at = np.searchsorted(order, length << 44 | rank, side="right") - 1
            _, first, sequence, n, offset = table[at].T
            nth = rank - first
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array(sequence + nth // n), pa.array(offset + nth % n * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str, end_id: int = 1, capacity: int = CAPACITY, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Only documents longer than the capacity are cut. Ids may be
    null or repeat: every row is a document of its own. Other columns are ignored, whatever their names.
    """
    return pack(stored(token_pieces(docs, vocab, end_id, capacity, id_col, text_col), "pieces"), capacity, steps, [id_col])
