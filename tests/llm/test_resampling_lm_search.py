"""Importance resampling, language-model scoring and lexical search against brute force, and their odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ngram_lm, resampling, search

ODD = [None, "", " \t\n", "!!!", "É é\x0b x", "A-Z a_z 0-9", "a" * 5000, "\x00a\x7fb"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def word_runs(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def texts_of(seed, n, words=60):
    source = random.Random(seed)
    known = [f"w{int(source.paretovariate(0.7))}" for _ in range(400)]
    found = [" ".join(source.choice(known) for _ in range(source.randint(1, words))) for _ in range(n)]
    return found + ODD + found[: n // 10]


# --- importance resampling


def resampled(docs, target, percent, least, runs, buckets=10_000):
    def features(text):
        ws = word_runs(text)
        return [" ".join(ws[i : i + n]) for n in range(1, runs + 1) for i in range(len(ws) - n + 1)], len(ws)

    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[0]), Counter(bucket(f) for x in target for f in features(x)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        fs, n = features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[2], -r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    drawn = {id(r) for r in able[: percent * len(able) // 100]}
    return sorted((tuple(r[:4]) + (r[4] if id(r) in drawn else None,) for r in rows), key=repr)


@pytest.mark.parametrize("runs,percent", [(1, 10), (2, 35), (3, 100)])
def test_resampling_equals_brute_force(spark, runs, percent):
    docs = [(i if i % 17 else None, t) for i, t in enumerate(texts_of(runs, 150))]
    docs += docs[:20]
    target = texts_of(9, 10)
    frame = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in docs], "doc_id long, text string, rank int, score int, `__id` string, at string").repartition(3)
    found = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent, 5, runs)
    assert sorted(map(tuple, found.collect()), key=repr) == resampled(docs, target, percent, 5, runs)


def test_resampling_without_rows(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert {r.doc_id: (r.n_features, r.weight <= 0, r["rank"]) for r in resampling.resample(some, none, percent=100).collect()} == {1: (30, True, 1), 2: (0, True, None)}


def test_one_draw_for_equal_scores_goes_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(7, "a b")] * 12, "doc_id long, text string").repartition(4)
    assert sorted(r["rank"] or 99 for r in resampling.resample(rows, rows, 50, 2).collect()) == [1, 2, 3, 4, 5, 6] + [99] * 6


def test_texts_in_slices(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)) + " " + "z" * 900 + " end"
    whole = [resampling.buckets_of(text, n, 1000) for n in (1, 3)]
    words = [w for ws in ngram_lm.word_slices(text) for w in ws]
    monkeypatch.setattr(resampling, "SLICE_BYTES", 100)
    monkeypatch.setattr(ngram_lm, "SLICE_BYTES", 100)
    for n, (found, n_words) in zip((1, 3), whole):
        again, same = resampling.buckets_of(text, n, 1000)
        assert same == n_words == 3002 and Counter(again.tolist()) == Counter(found.tolist())
    assert [w for ws in ngram_lm.word_slices(text) for w in ws] == words == text.encode().split()


# --- language-model scoring


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [" end"]


def scored(docs, order):
    """docs: (text, train). (n_tokens, n_known, train_tokens, base_score, score) by the formulas, without an automaton."""
    grams = [Counter() for _ in range(order + 1)]
    for text, train in docs:
        row = [" begin", *tokens(text)]
        for k in range(1, order + 1):
            for i in range(1 if k == 1 else k - 1, len(row)):
                grams[k][tuple(row[i - k + 1 : i + 1])] += train
    grams = [Counter({g: c for g, c in x.items() if c}) for x in grams]
    n, v = grams[1].total(), len(grams[1])
    begun = sum(train for _, train in docs)
    history = [None, Counter({g: c for g, c in grams[1].items() if g[-1] != " end"}) + Counter({(" begin",): begun}), *(Counter({g: c for g, c in x.items() if g[-1] != " end"}) for x in grams[2:])]
    round20 = lambda x: math.floor(x * 2**20 + 0.5) / 2**20
    strength = [None, *(round20(len(grams[k]) / s) if (s := sum(c**ngram_lm.GROWTH for c in history[k - 1].values())) else 1.0 for k in range(2, order + 1))]

    def p(h, w):
        if not h:
            return (grams[1][(w,)] or v + 1) / (n + v + 1)
        c = history[len(h)][h]
        t = strength[len(h)] * c**ngram_lm.GROWTH
        return (grams[len(h) + 1][(*h, w)] + t * p(h[1:], w)) / (c + t) if c else p(h[1:], w)

    out = []
    for text, _ in docs:
        row, ws = [" begin", *tokens(text)], tokens(text)
        base = sum(math.log10((grams[1][(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((len(ws), sum(grams[1][(w,)] > 0 for w in ws), n, base, sum(math.log10(p(tuple(row[max(0, i - order + 1) : i]), row[i])) for i in range(1, len(row)))))
    return out, p, grams


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_the_formulas(spark, order):
    docs = [(t, i % 4 != 0) for i, t in enumerate(texts_of(order, 60, 25))]
    rows = spark.createDataFrame([(i if i % 9 else None, t, k, 1, "x", i) for i, (t, k) in enumerate(docs)], "doc_id long, text string, train boolean, score int, `__batch` string, at long")
    found = ngram_lm.language_model_scores(rows.repartition(3), F.col("train"), order, id_col="at", batch_bytes=2000, shard_bytes=3000).collect()
    want, _, _ = scored(docs, order)
    assert len(found) == len(docs)
    for r in found:
        n_tokens, n_known, train_tokens, base, score = want[r["at"]]
        assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (docs[r["at"]][1], n_tokens, n_known, train_tokens)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-5 * n_tokens)


def test_probabilities_sum_to_one():
    _, p, grams = scored([("a b a c", True), ("b a b", True), ("a", True), ("d d", False)], 3)
    for h in [(), ("a",), (" begin",), ("b", "a"), (" begin", "b")]:
        assert sum(p(h, w) for (w,) in grams[1]) + p(h, "unknown") == pytest.approx(1)


def test_language_model_odd_tables(spark):
    assert ngram_lm.language_model(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(None, None), (None, ""), (5, "x Y")], "doc_id long, text string")
    found = {(r.n_tokens, r.n_known): r for r in ngram_lm.language_model_scores(rows, F.lit(False)).collect()}
    assert set(found) == {(1, 0), (3, 0)} and all(r.base_score == r.score == 0.0 and r.train_tokens == 0 for r in found.values())
    assert [r.held_out for r in ngram_lm.language_model(rows.filter("doc_id is null")).collect()] == [False, False]
    assert all(r.n_known == r.n_tokens == 1 for r in ngram_lm.language_model(rows.filter("doc_id is null")).collect())


def test_scores_do_not_depend_on_batches(spark):
    rows = spark.createDataFrame(list(enumerate(texts_of(3, 80))), "doc_id long, text string")
    found = [sorted(map(tuple, ngram_lm.language_model_scores(rows.repartition(n), F.col("doc_id") % 3 > 0, batch_bytes=size).collect())) for n, size in ((1, 1 << 20), (4, 500))]
    assert found[0] == found[1]


def test_packed_keys_and_counts():
    source = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.sort(source.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(source.integers(0, 2)))
        counts = source.integers(0, 300, n)
        assert (ngram_lm.unpack_keys(ngram_lm.pack_keys(keys)) == keys).all() and (ngram_lm.unpack_counts(ngram_lm.pack_counts(counts), n) == counts).all()


def test_held_out_texts_are_likelier_than_under_single_words(spark):
    rows = ngram_lm.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > 0.9 * rows[1]


# --- lexical search


def searched(docs, items, top):
    rows = [(i, Counter(word_runs(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in rows:
            m = 25 + (75 * c.total() * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in word_runs(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts,block", [(1, 1 << 20), (5, 300)])
def test_search_equals_brute_force(spark, parts, block):
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts_of(parts, 600, 40))]
    docs += [(9, "w1 w2 w3")] * 40 + [(10_000 - i, "w5 w1") for i in range(300)]
    items = [(i, t) for i, t in enumerate([*texts_of(7, 25, 12), "w5 w5 w1", "unheard of"])] + [(3, "w2"), (None, "w3 w1")]
    rows = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, rank int, item_id string, `__id` int").repartition(parts)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int")
    found = search.search(rows, asked, 7, block_bytes=block).collect()
    assert sorted(map(tuple, found), key=repr) == searched(docs, items, 7)


def test_search_odd_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert search.search(none, items).collect() == [] == search.search(some, items.limit(0)).collect()
    assert search.search(some.filter("text is null"), items).collect() == []
    assert [tuple(r) for r in search.search(some, items).collect()] == [(1, 1, 1, 2 * (math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100))))]


def topics(seed=2):
    source = random.Random(seed)
    return [[source.randrange(40 * (k % 16), 40 * (k % 16) + 40) for _ in range(30)] for k in range(2048)]


def test_bisection_brings_like_documents_together():
    rows = [np.unique(x) for x in topics()]
    doc, term = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    order = search.bisected(doc, term, len(rows), 128)
    assert sorted(order.tolist()) == list(range(len(rows)))
    pure = [Counter((order[k : k + 128] % 16).tolist()).most_common(1)[0][1] for k in range(0, len(rows), 128)]
    assert sum(pure) > 0.9 * len(rows)


def test_most_clusters_are_not_visited(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{t}" for t in ts)) for i, ts in enumerate(topics())], "doc_id long, text string").repartition(1)
    queries = search.Queries([(k, " ".join(f"t{40 * k + j}" for j in range(5))) for k in range(16)])
    forward = search.forward_rows(docs, queries, "doc_id", "text")
    index = search.build_index(forward, 2048, 2048 * 30).cache()
    weights = np.full(len(queries.vocabulary), 1000)
    found = search.search_pass(index, queries, weights, 10, np.ones(16, np.int64))
    visits = found.groupBy("q").agg(F.max("visits").alias("v")).agg(F.sum("v")).first()[0]
    index.unpersist()
    assert visits <= 3 * 16  # of 16 * 16
