"""Rank-synchronous pair merging over ragged numpy arrays, which token counts and token ids share.

A batch of pre-tokens is one flat symbol array with the row of each symbol. Each round looks up the rank
of every adjacent pair, takes each row's lowest, applies that pair at all its places in the row at once
(left to right where places overlap), and squeezes the array. Rows without a ranked pair leave; their
surviving symbols are their tokens. This gives the tokens of pairwise merging by rank, as a merge only
makes pairs of later rank. A very long pre-token takes a round for each rank that it has, so it is merged alone,
by lists of the places of each rank, and each round touches only its own places.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

#: Symbols from which on a row is merged alone.
LONG = 4096
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return letters


class PairMerges:
    """Pairs of symbols by rank, and what each becomes: of a tokenizer file's model of kind BPE."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._hash_pairs(np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """An open-addressing table of the pairs, eight slots a pair, so that few lookups go on to a next slot."""
        self.shift = np.uint64(64 - max(3, int(len(keys)).bit_length() + 3))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.slot_ranks = np.full(len(self.slots), NONE, np.int32)
        rest = np.arange(len(keys))
        at = self._slot(keys)
        while len(rest):
            free = self.slots[at[rest]] < 0
            won = rest[free][np.unique(at[rest[free]], return_index=True)[1]]
            self.slots[at[won]], self.slot_ranks[at[won]] = keys[won], won
            rest = rest[self.slots[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        at = self._slot(keys)
        there = self.slots[at]
        ranks = np.where(there == keys, self.slot_ranks[at], NONE)
        rest = np.nonzero((there != keys) & (there >= 0))[0]
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)
            there = self.slots[at[rest]]
            ranks[rest] = np.where(there == keys[rest], self.slot_ranks[at[rest]], NONE)
            rest = rest[(there != keys[rest]) & (there >= 0)]
        return ranks

    def merge(self, symbols: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols and their rows, which are in order and side by side on both sides."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NONE, np.int32)
        pair = np.nonzero(row[1:] == row[:-1])[0]
        rank[pair] = self._rank(symbols[pair], symbols[pair + 1])
        while len(symbols):
            starts = np.concatenate(([0], np.nonzero(row[1:] != row[:-1])[0] + 1))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.concatenate((starts, [len(symbols)])))
            alive = np.repeat(lowest < NONE, lengths)
            done.append((symbols[~alive], row[~alive]))
            # Of adjoining places (a pair of equal symbols) every other one is applied.
            at = np.nonzero((rank == np.repeat(lowest, lengths)) & alive)[0]
            if not len(at):
                break
            begins = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            alive[at + 1] = False
            now = (np.cumsum(alive) - 1)[at]
            symbols, row, rank = symbols[alive], row[alive], rank[alive]
            # Only pairs beside a new symbol have a new rank.
            for pair in (now, now[now > 0] - 1):
                rank[pair] = NONE
                pair = pair[pair + 1 < len(symbols)]
                pair = pair[row[pair] == row[pair + 1]]
                rank[pair] = self._rank(symbols[pair], symbols[pair + 1])
        if not done:
            return symbols, row
        symbols, row = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(row, kind="stable")
        return symbols[order], row[order]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The surviving symbols of one row, with the same rounds as merge() over linked places."""
        n = len(symbols)
        symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, NONE, np.int32)  # of the pair that begins at a place; the last one is past the end
        rank[: n - 1] = self._rank(symbols[:-1], symbols[1:])
        alive = np.ones(n, bool)
        places: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        waiting: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                if len(part) and (r := int(rank[part[0]])) < NONE:
                    if not places[r]:
                        heapq.heappush(waiting, r)
                    places[r].append(part)

        wait(np.arange(n - 1))
        while waiting:
            lowest = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(lowest)))
            at = at[rank[at] == lowest]
            if not len(at):
                continue
            begins = np.concatenate(([True], after[at[:-1]] != at[1:]))
            run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            symbols[at] = self.made[lowest]
            rank[gone], alive[gone] = NONE, False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            changed = np.concatenate((at, before[at][before[at] >= 0]))
            rank[changed] = NONE
            changed = np.unique(changed[after[changed] < n])
            if len(changed):
                rank[changed] = self._rank(symbols[changed], symbols[after[changed]])
                wait(changed)
        return symbols[alive]
