"""Token counts of a byte-level BPE tokenizer by rank-synchronous merging over ragged numpy arrays.

Texts are cut into pre-tokens, those not met before are merged in one batch (see merges.py), and a text's
count is the sum of its pre-tokens' surviving symbols.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lumenfold.llm.common import kept_in_worker, map_texts
from lumenfold.llm.merges import LONG, PairMerges, byte_letters

#: Fixed value: the byte-level pre-token pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each memory of counts in a worker; a full one is emptied.
REMEMBERED = 400_000


class ByteMerger:
    """Counts tokens of pre-tokens, texts and batches of texts as the tokenizer file defines them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        self.merges = PairMerges(spec["model"])
        self.pretokens = regex.compile(PATTERN).findall
        self.split_specials = re.compile("|".join(map(re.escape, self.specials))).split if self.specials else None
        self.of_pretoken: dict[str, int] = {}
        self.of_chunk: dict[str, int] = {}

    def merged_lengths(self, tokens: list[str]) -> np.ndarray:
        """How many symbols survive in each pre-token."""
        raw = [t.encode("utf-8") for t in tokens]
        alone = {i: t for i, t in enumerate(raw) if len(t) > LONG}
        raw = [b"" if i in alone else t for i, t in enumerate(raw)] if alone else raw
        row = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
        _, left = self.merges.merge(self.first[np.frombuffer(b"".join(raw), np.uint8)], row)
        survived = np.bincount(left, minlength=len(raw))
        for i, t in alone.items():
            survived[i] = len(self.merges.merge_long(self.first[np.frombuffer(t, np.uint8)]))
        return survived

    def _learn_pretokens(self, wanted: set[str]) -> None:
        new = [t for t in wanted if t not in self.of_pretoken]
        if len(self.of_pretoken) + len(new) > REMEMBERED:
            self.of_pretoken.clear()
            new = list(wanted)
        self.of_pretoken.update(zip(new, self.merged_lengths(new).tolist()))

    def _chunks(self, text: str) -> list[str]:
        """Parts between single spaces that a character other than white space follows: no pre-token spans such a
        place, and the space goes to what follows it."""
        return text.split(" ") if SPACED(text) is None else CUT(text)

    def counts(self, texts: list[str | None]) -> list[int]:
        total = [0] * len(texts)
        parts: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = [text]
            if self.split_specials and any(s in text for s in self.specials):
                pieces = self.split_specials(text)
                total[i] = len(pieces) - 1
            parts += [(i, self._chunks(p)) for p in pieces if p]
        wanted = set().union(*(p[1:] for _, p in parts))
        new = {c for c in wanted if c not in self.of_chunk}
        if len(self.of_chunk) + len(new) > REMEMBERED:
            self.of_chunk.clear()
            new = wanted
        split = {c: self.pretokens(" " + c) for c in new}
        heads = {p[0]: self.pretokens(p[0]) for _, p in parts}
        self._learn_pretokens({t for found in (split, heads) for ts in found.values() for t in ts})
        known = self.of_pretoken.__getitem__
        self.of_chunk.update((c, sum(map(known, ts))) for c, ts in split.items())
        of_head = {h: sum(map(known, ts)) for h, ts in heads.items()}
        for i, p in parts:
            total[i] += of_head[p[0]] + sum(map(self.of_chunk.__getitem__, p[1:]))
        return total


SPACED = re.compile(r" (?:\s|$)").search
CUT = re.compile(r" (?=\S)").split


def count_tokens(docs: DataFrame, vocab: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row by the byte-level BPE file `vocab`.

    Null and empty texts have 0 bytes and tokens. A special token's string inside a text is that one
    token. Rows and ids may repeat or be null; other columns are ignored, whatever their names.
    """

    def make():
        merger = kept_in_worker(("merger", vocab), lambda: ByteMerger(vocab))

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(piece.column(1)), 0), pa.int64())
            n_tokens = pa.array(merger.counts(piece.column(1).to_pylist()), pa.int64())
            return pa.RecordBatch.from_arrays([piece.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", text_col)
