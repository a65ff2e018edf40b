"""Language, quality and toxicity: held-out accuracy, and rows that have nothing to say."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import langid, quality_crf, samples, toxicity
from lumenfold.llm.samples import bounded_sample, different_texts

DOCS = "doc_id long, text string, lang string, source string, score string"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def tables(spark):
    """The next larger tables, for enough labels to learn from."""
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_language(spark, tables):
    docs, _ = tables
    found = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_quality(spark, tables):
    docs, labels = tables
    found = quality_crf.quality(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.97
    assert ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_toxicity(spark, tables):
    docs, labels = tables
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.95
    assert (held[(held.toxic == 1) & (held.lang == "en")].predicted == 1).mean() > 0.7


ROWS = [(i, t, lang, "s", "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
ODD = [(100, None, "en", None, None), (101, "", None, "s", None), (102, "123 !!", "en", "s", None), (None, "the dog", "en", "s", None), (100, None, "en", None, None), (103, "x" * 200_000, "en", "s", None)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS + ODD, DOCS)
    labels = spark.createDataFrame([(i, i % 2, i % 2, "t") for i in range(60)] + [(None, 1, 1, "t"), (100, None, None, "t")], LABELS)
    lang = langid.languages(docs).collect()
    assert sorted(r.doc_id for r in lang if r.lang_pred == "und" and r.doc_id is not None) == [100, 100, 101, 102]
    assert all(r.score == 0 for r in lang if r.lang_pred == "und") and not any(r.held_out for r in lang if r.doc_id is None)
    for found in (quality_crf.quality(docs, labels), toxicity.toxicity(docs, labels)):
        rows = found.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (t, _) in enumerate([("the cat and the dog", 1), ("der hund", 0)] * 6)], "doc_id long, text string, __Score string, score int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 12
    assert toxicity.toxicity(docs, labels).count() == 12


def test_scores_of_rows_are_those_of_the_model(spark, tables):
    """The distributed scores against the fitted model, text by text."""
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    gains = toxicity.Gains(model.ordinary, model.toxic)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.toxicity(docs, labels).collect():
        assert r.score == pytest.approx(model.score(gains, texts[r.doc_id])) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_gain_is_the_difference_of_two_lengths():
    gains = toxicity.Gains(b" Plain  Words  Here ", b" Zzzzword  Qqqqword ")
    assert gains.of([b"zzzzword", b"plain"]).tolist() == [max(0, len(gains.plain(w)) - len(gains.both(w))) for w in (b"<@[0123456789]= Zzzzword =[9876543210]@>", b"<@[0123456789]= Plain =[9876543210]@>")]
    assert gains.of([b"zzzzword"])[0] > 2 > gains.of([b"xzzzzwor"])[0] + 1 or gains.of([b"zzzzword"])[0] > gains.of([b"other"])[0]


def test_language_of_a_text_by_hand():
    model = langid.LanguageModel.fit([("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de")] * 20)
    text = "the dog"
    buckets = langid.subwords(text)
    z = (model.table[buckets].mean(axis=0) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    lang, score, _ = model.predict(text)
    assert lang == model.languages[int(p.argmax())] == "en" and score == pytest.approx(p.max(), rel=1e-4)


def test_an_id_that_repeats_does_not_flood_the_driver(spark):
    rows = spark.createDataFrame([(1, f"text {i}", 1) for i in range(500)] + [(2, "same", 0)] * 500, "id long, t string, y int")
    found = samples.different_texts(rows, "t", "y", 10)
    assert Counter(y for _, y in found) == {1: 80, 0: 1} and found == sorted(found) and len(samples.different_texts(rows.filter("y = 0"), "t", "y", 10)) == 1


@pytest.mark.parametrize("marks", [[], [(1, 1, 1, "t")], [(1, 0, 0, "t")]])
def test_without_labels_of_both_classes(spark, marks):
    docs, labels = spark.createDataFrame(ROWS[:4], DOCS), spark.createDataFrame(marks, LABELS)
    assert quality_crf.quality(docs, labels).count() == 4 == toxicity.toxicity(docs, labels).count()


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert langid.languages(docs).count() == quality_crf.quality(docs, labels).count() == toxicity.toxicity(docs, labels).count() == 0


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 4])
    scores, transitions = rng.normal(size=8), rng.normal(size=(2, 2))
    got, expected = quality_crf.Chains(sizes).marginals(scores, transitions)
    want, pairs, at = np.zeros(8), np.zeros((2, 2)), 0
    for n in sizes:
        total, bad, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in range(2**n):
            y = [bits >> i & 1 for i in range(n)]
            weight = np.exp(sum(scores[at + i] * y[i] for i in range(n)) + sum(transitions[a, b] for a, b in zip(y, y[1:])))
            total += weight
            bad += weight * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += weight
        want[at : at + n], pairs, at = bad / total, pairs + two / total, at + n
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_samples_are_bounded_by_label_and_bytes(spark):
    rows = spark.range(24_000).selectExpr("id", "concat('text ', id) as t", "concat('l', id % 12) as lang").unionByName(spark.range(3000).selectExpr("7L as id", "concat('again ', id) as t", "'l7' as lang"))
    found = Counter(lang for _, lang in different_texts(bounded_sample(rows, "id", "lang", 600), "t", "lang", 600))
    assert len(found) == 12 and all(500 < n < 700 for lang, n in found.items() if lang != "l7") and found["l7"] <= 4800
    few = different_texts(rows.filter("id < 100"), "t", "lang", 600, sample_bytes=1200)
    by = Counter()
    for text, lang in few:
        by[lang] += len(text)
    assert len(by) == 12 and max(by.values()) <= 100


def test_toxicity_folds_are_trained_alike_in_tasks_and_alone(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = samples.labelled_texts(docs, labels, "toxic", F.lit(True), 1500)
    alone, tasks = toxicity.ToxicityModel.fit(texts), toxicity.ToxicityModel.fit(texts, spark)
    assert (alone.weights == tasks.weights).all() and alone.threshold == tasks.threshold and (alone.ordinary, alone.toxic) == (tasks.ordinary, tasks.toxic)
    few = [("good words here", 0), ("bad words there", 1)]
    assert (toxicity.ToxicityModel.fit(few).weights == toxicity.ToxicityModel.fit(few, spark).weights).all()


def test_steps_of_few_texts_are_as_those_of_many(monkeypatch):
    source = np.random.default_rng(5)
    for sizes in ([1], [7], [3, 1, 9], [40, 2, 2, 2, 2, 30, 1], [5] * 6, [1, 1, 1, 1], [60, 60, 60, 60, 1]):
        scores, transitions = source.normal(0, 3, sum(sizes)), source.normal(0, 1, (2, 2))
        found = []
        for few in (0, 3, 100):
            monkeypatch.setattr(quality_crf, "FEW", few)
            found.append(quality_crf.Chains(np.array(sizes)).marginals(scores, transitions))
        for bad, expected in found[1:]:
            assert np.allclose(bad, found[0][0], atol=1e-12) and np.allclose(expected, found[0][1], atol=1e-9)


def test_a_text_of_very_many_lines_takes_bounded_time():
    began = time.time()
    bad, expected = quality_crf.Chains(np.array([200_000, 3])).marginals(np.random.default_rng(1).normal(0, 2, 200_003), np.zeros((2, 2)))
    assert time.time() - began < 5 and ((bad >= 0) & (bad <= 1)).all() and abs(expected.sum() - 200_001) < 1e-3
