import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import packing

VOCAB = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, piece string, length double"


def fewest(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[j] += items[i]
            place(i + 1, bins)
            bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_plans_are_optimal_on_small_cases():
    rng = np.random.default_rng(5)
    for _ in range(150):
        capacity = int(rng.integers(8, 50))
        items = rng.integers(1, capacity + 1, int(rng.integers(0, 11))).tolist()
        steps, need = packing.plan(np.bincount(items, minlength=capacity + 1), capacity)
        used = sorted(m for members, times in steps for m in members * times)
        assert used == sorted(items) and all(sum(m) <= capacity for m, _ in steps)
        n = sum(times for _, times in steps)
        assert n == fewest(items, capacity) >= need


@pytest.mark.parametrize("capacity,sequences,parts", [(100, 30, 3), (50, 400, 4), (4096, 60, 4), (4096, 200, 3)])
def test_whole_sequences_cut_at_random_are_put_together(capacity, sequences, parts):
    rng = np.random.default_rng(sequences)
    cuts = np.sort(rng.integers(1, capacity, (sequences, parts - 1)), axis=1)
    items = np.diff(np.hstack([np.zeros((sequences, 1), int), cuts, np.full((sequences, 1), capacity)]), axis=1).ravel()
    steps, need = packing.plan(np.bincount(items[items > 0], minlength=capacity + 1), capacity)
    assert need == sequences <= sum(times for _, times in steps) <= sequences + 1


@pytest.mark.parametrize("capacity,counts,optimum", [
    (4096, {2049: 500, 1365: 1000, 683: 400}, 734), (100, {34: 300, 33: 300, 26: 100, 40: 90}, 270), (10, {6: 700, 4: 300, 3: 500, 1: 90}, 734),
])
def test_few_hot_lengths(capacity, counts, optimum):
    """Far more pieces than any branch could try one by one; best fit alone needs more sequences in the first two."""
    c = np.zeros(capacity + 1, np.int64)
    c[list(counts)] = list(counts.values())
    steps, _ = packing.plan(c, capacity, 200_000)
    assert sum(times for _, times in steps) == optimum
    used = np.zeros_like(c)
    for members, times in steps:
        np.add.at(used, list(members), times)
    assert (used == c).all()


def undominated(items, room):
    """By definition: no length left out stands for a smaller member, or for several, and none can be added."""
    sets = {tuple(sorted(s, reverse=True)) for n in range(len(items) + 1) for s in combinations(items, n) if sum(s) <= room}
    out = []
    for s in sets:
        left = Counter(items) - Counter(s)
        spare = room - sum(s)
        parts = [p for n in range(len(s) + 1) for p in combinations(s, n)]
        if not any(x <= sum(p) + spare and (x > sum(p) or x == sum(p) and len(p) > 1) for x in left for p in parts):
            out.append(s)
    return sorted(out)


def test_fillings_are_all_undominated_sets():
    rng = np.random.default_rng(8)
    for _ in range(150):
        room = int(rng.integers(3, 30))
        items = rng.integers(1, room + 3, int(rng.integers(0, 9))).tolist()
        found = list(packing.Fillings(np.bincount(items, minlength=room + 4), room).each(lambda: None))
        assert sorted(found) == undominated(items, room)
        assert [sum(s) for s in found] == sorted((sum(s) for s in found), reverse=True)


def test_large_plans_meet_the_bound():
    rng = np.random.default_rng(6)
    items = np.minimum(rng.lognormal(6, 1.2, 50_000).astype(int) + 1, 4096)
    steps, need = packing.plan(np.bincount(items, minlength=4097))
    assert need <= sum(t for _, t in steps) <= need * 1.001 + 1


@pytest.mark.parametrize("texts", [["Hello, World!", "", None, "a\nb  c", "It's <|endoftext|> x", "é\x85İ中 !!.,", "don't. stop-now (ok)", "straße naïve ÀÉ×÷ße\u0301 e\u0301é ÿĀ ½ a1b"]])
def test_ids_are_the_tokenizers(texts):
    want = [np.array(Tokenizer.from_file(VOCAB).encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.PieceMaker(VOCAB).ids(texts) == want


def test_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    maker, library = packing.PieceMaker(VOCAB), Tokenizer.from_file(VOCAB)
    for k in range(12):
        texts = [" ".join(f"wörd{'abcdefgh'[(i * k) % 8]}{'xyz'[i % 3]}," for i in range(30 + k)), "the end."]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert maker.ids(texts) == want


def check(found, texts, capacity):
    tokenizer = Tokenizer.from_file(VOCAB)
    lengths = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    by_doc, by_seq = {}, {}
    for r in found:
        by_doc.setdefault((r.doc_id, r.start == 0 and id(r)), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in found) == sum(lengths)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for r in found:
        text = next(t for i, t in texts if i == r.doc_id)
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert r.start == r.piece * capacity and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_pieces_and_places(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    texts = [(1, "one two three " * 30), (2, ""), (3, None), (4, "word " * 15), (None, "x"), (6, "word " * 15), (7, "short"), (2, "")]
    docs = spark.createDataFrame([(i, t, "p", 1.0) for i, t in texts], DOCS)
    found = packing.pack_documents(docs, VOCAB, capacity=16).collect()
    check(found, texts, 16)
    assert len(found) == 6 + 1 + 1 + 1 + 1 + 1 + 1 + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), VOCAB).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = packing.pack_documents(docs, VOCAB).collect()
    check(found, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    total = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= -(-total // 4096) + 1
