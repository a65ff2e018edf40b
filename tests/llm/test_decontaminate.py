import hashlib
import re
import time

import numpy as np

from lumenfold.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, n_hit string", "item_id long, text string"


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plainly(text, items, window):
    words, hit, found = split(text), set(), set()
    for item, item_text in items:
        ws = split(item_text)
        size = min(window, len(ws))
        wins = {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if ws else set()
        for at in range(len(words) - size + 1):
            if tuple(words[at : at + size]) in wins:
                hit |= set(range(at, at + size))
                found.add("null" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def both(spark, docs, items, window):
    found = decontaminate.contamination(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS), spark.createDataFrame(items, ITEMS), window)
    got = sorted(map(str, [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found.collect()]))
    want = sorted(map(str, [(i, *plainly(t, items, window)) for i, t in docs]))
    assert got == want


def test_random_texts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    letters = ["a", "b", "c", "D", "é", "7"]
    text = lambda alphabet, most: " ".join(rng.choice(alphabet, rng.integers(0, most)))
    docs = [(i, text(letters, 60)) for i in range(60)] + [(None, "a b c d"), (7, None), (7, ""), (8, "-- !!")]
    items = [(i, text(letters[:5], 9)) for i in range(9)] + [(3, "a b c"), (None, "b b c a"), (11, None), (12, "...")]
    both(spark, docs, items, 4)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)  # several passes
    both(spark, docs, items, 4)


def test_one_word_item_and_no_items(spark):
    docs = [(1, "x y X z"), (2, "y")]
    both(spark, docs, [(1, "x")], 10)
    both(spark, docs, [], 10)
    both(spark, [], [(1, "x")], 10)


def test_longest_match_and_removal(spark):
    docs = spark.createDataFrame([(1, "p q a b c d e r", "k"), (2, "a b x c", "k"), (3, None, None)], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    found = {r.doc_id: r.longest_match for r in decontaminate.contamination(docs, items, 3).collect()}
    assert found == {1: 5, 2: 0, 3: 0}
    kept = decontaminate.drop_contaminated(docs, items, 3)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def longest_at(text, items, window):
    """[(first word, length)] of the longest matches that are not part of the one a word before."""
    ws, best = split(text), {}
    for _, item_text in items:
        its = split(item_text)
        size = min(window, len(its))
        for a in range(len(ws)):
            for b in range(len(its)):
                n = 0
                while a + n < len(ws) and b + n < len(its) and ws[a + n] == its[b + n]:
                    n += 1
                if size and n >= size:
                    best[a] = max(best.get(a, 0), n)
    return sorted((a, n) for a, n in best.items() if best.get(a - 1, 0) != n + 1)


def test_longest_matches_against_brute_force(spark):
    rng = np.random.default_rng(11)
    text = lambda most: " ".join(rng.choice(["a", "b", "c", "zz"], rng.integers(0, most)))
    docs, items = [(i, text(40)) for i in range(40)], [(i, text(14)) for i in range(8)] + [(9, "a a a a a a a")]
    found = decontaminate.contamination(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS), spark.createDataFrame(items, ITEMS), 3).collect()
    for r in found:
        want = longest_at(dict(docs)[r.doc_id], items, 3)
        assert sorted((m["first"], m["length"]) for m in r.matches or []) == want
        assert r.longest_match == max((n for _, n in want), default=0)


def test_repeated_words_are_linear():
    began = time.time()
    block = decontaminate.Suffixes([("1", "a " * 5000), ("2", "b")], 10)
    sizes, (text, first, head), (_, start, length, _) = decontaminate.match_shard(["a " * 100_000, None, "b a b"], block)
    assert sizes.tolist() == [100_000, 0, 3] and len(text) == 100_000 - 9 + 2 and length.max() == 5000 and len(start) < 100_000
    assert time.time() - began < 10


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "p a b c", 4, "x", "y"), (2, "none", 5, None, "z")], "doc_id long, text string, __n_hit long, __Hits string, __spans string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "a b c")], ITEMS), 3)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "none", 5, None, "z")]


def test_whole_table(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    found = decontaminate.contamination(read("documents"), read("benchmark")).collect()
    assert len(found) == len(texts) and any(r.contaminated for r in found)
    for r in found:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plainly(texts[r.doc_id], items, 10)
