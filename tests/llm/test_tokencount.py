import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenfold.llm import packing, queries, tokencount
from lumenfold.llm.tokencount import ByteMerger

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, MERGER = Tokenizer.from_file(VOCAB), tokencount.ByteMerger(VOCAB)
PARTS = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "é", "1", "²", "Ⅷ", "\x1c", "\x85", "\xa0", "中", "aaaa", "the", "<|endoftext|>", "!", "__", "́", "İ", "'ll", "\x0b", "👍", "٣"]


def counted(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    assert MERGER.counts(texts) == counted(texts)


def test_mixed_parts_and_long_runs(monkeypatch):
    source = random.Random(1)
    texts = ["".join(source.choices(PARTS, k=source.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, " " * 3000, "", "ab" * 4000]
    assert MERGER.counts(texts) == counted(texts)
    monkeypatch.setattr(tokencount, "REMEMBERED", 50)
    small = tokencount.ByteMerger(VOCAB)
    assert [n for at in range(0, 600, 100) for n in small.counts(texts[at : at + 100])] == counted(texts[:600])


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, "y"), (3, "", None), (4, "a " * 600, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted(map(str, [tuple(r) for r in tokencount.count_tokens(docs, VOCAB).collect()]))
    assert found == sorted(map(str, [(1, 11, 2, False), (1, 11, 2, False), (None, 0, 0, False), (3, 0, 0, False), (4, 1200, 601, True)]))
    assert tokencount.count_tokens(docs.limit(0), VOCAB).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokencount.count_tokens(docs, VOCAB).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), counted([texts[r.doc_id]])[0])


@pytest.mark.parametrize("letters,n", [("a", 9_000), ("ab", 9_001), ("abcdefghij", 30_000), ("etaoinshrdlu", 60_000), ("äöß漢字ab", 9_000)])
def test_long_words_are_merged_as_the_library_does(letters, n):
    source = random.Random(n)
    text = "".join(source.choice(letters) for _ in range(n))
    path = queries.tokenizer_file("byte_bpe_50k.json")
    assert ByteMerger(path).counts([f"x {text} y"]) == [len(Tokenizer.from_file(path).encode(f"x {text} y", add_special_tokens=False).ids)]
    path = queries.tokenizer_file("word_bpe_49k.json")
    ids = np.frombuffer(packing.PieceMaker(path).ids([f"x {text} y"])[0], "<u4").tolist()
    assert ids == Tokenizer.from_file(path).encode(f"x {text} y", add_special_tokens=False).ids
