import numpy as np
import pytest

from lumenfold.llm import simhash
from lumenfold.llm.components import connected_components

DOCS = "doc_id long, text string, fp string, root int"


def least_reachable(fps, ids, distance):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    label = ids.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return label
        label = new


def plain_fingerprint(text, words):
    import re

    import xxhash

    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, " \n\t", "one", "One two", "a b c d e A B c d", "é " * 9, "x y\x0bz\xa0w " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == plain_fingerprint(text, 4)


def test_long_text_is_counted_whole(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000))
    want = plain_fingerprint(text, 4)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text, 4) == want


@pytest.mark.parametrize("distance,posting", [(3, 2), (4, 2), (4, 7), (4, 4096)])
def test_links_against_brute_force(spark, distance, posting):
    rng = np.random.default_rng(distance)
    flips = [[np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)] for _ in range(500)]
    bases = rng.integers(0, 2**63, 25, dtype=np.uint64)
    fps = np.unique(np.array([bases[i % 25] ^ np.bitwise_xor.reduce(np.array([*f, 0], np.uint64)) for i, f in enumerate(flips)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df, distance, posting)).collect()}
    want = least_reachable(fps, fps.view(np.int64), distance)
    assert [got.get(int(x), int(x)) for x in fps.view(np.int64)] == want.tolist()
    assert len(set(want.tolist())) < len(fps)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = np.array([plain_fingerprint(texts[i], 4) for i in got.doc_id], np.uint64)
    assert [f"{x:016x}" for x in fps.tolist()] == got.fingerprint.tolist()
    assert least_reachable(fps, got.doc_id.to_numpy(), 4).tolist() == got.component_id.tolist()


def test_nulls_ties_and_clashing_names(spark):
    text = "some words that are long enough to make shingles of"
    rows = [(5, text, "a", 1), (5, text, "b", 2), (3, text, "c", 3), (7, None, "d", 4), (8, " ", None, None), (None, text, "e", 5), (9, "another text of quite different words here", "f", 6)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [("3", 3), ("5", 3), ("5", 3), ("7", 7), ("8", 7), ("9", 9), ("None", 3)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]
    twice = spark.createDataFrame([(1, text, "a", 1), (1, text, "b", 2)], DOCS)
    assert simhash.drop_near_duplicates(twice).count() == 1
    shuffled = simhash.drop_near_duplicates(docs, broadcast_bytes=-1)
    assert sorted(str(r.doc_id) for r in shuffled.collect()) == ["3", "7", "9", "None"]
    assert "Broadcast" in kept._jdf.queryExecution().executedPlan().toString()
    apart = spark.createDataFrame([(1, text, "a", 1), (2, text, "b", 2), (2, "quite another text of its own", "c", 3)], DOCS)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(apart).collect()) == [1, 2]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0
