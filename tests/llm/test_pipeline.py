import pathlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_decontaminate import plainly
from test_simhash import least_reachable, plain_fingerprint
from tokenizers import Tokenizer

from lumenfold.llm import decontaminate, linededup, toxicity


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and (now == ids) == (i == 1)
        ids = now
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contamination(docs, benchmark).filter("contaminated").count() == 0
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def without_common_lines(docs):
    """docs (id, source, text) by the definition: lines on a share of a source's documents or of its different texts."""
    pages, texts, holders = Counter(s for _, s, _ in docs), defaultdict(set), defaultdict(list)
    for _, s, t in docs:
        texts[s].add(t)
        for line in {x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")}:
            holders[s, line].append(t)
    gone = set()
    for (s, line), found in holders.items():
        many = len(set(found))
        often = many >= linededup.COMMON_TEXTS and many > linededup.COMMON * len(texts[s])
        if pages[s] >= linededup.MIN_PAGES and (len(found) > linededup.RATIO * pages[s] or often):
            gone.add((s, line))
    return [(i, s, "\n".join(x for x in t.split("\n") if (s, x) not in gone)) for i, s, t in docs]


def test_rows_are_those_of_a_plain_chain(spark, sf_dir):
    """Every stage by its definition, on one machine: only the fitted toxicity model is shared."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    model = toxicity.fit_toxicity(table, labels, toxicity.crc_fold(F.col("doc_id"), 4) != 2)
    gains = toxicity.Gains(model.ordinary, model.toxic)
    docs = [(r.doc_id, r.source, r.text) for r in table.collect() if model.score(gains, r.text) < toxicity.THRESHOLD]
    docs = without_common_lines(docs)
    ids = np.array([i for i, _, _ in docs])
    least = least_reachable(np.array([plain_fingerprint(t, 4) for _, _, t in docs], np.uint64), ids, 4)
    docs = [d for d, m in zip(docs, least.tolist()) if d[0] == m]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    docs = [d for d in docs if plainly(d[2], items, 10)[1] == 0]
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, _, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    total = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= -(-total // 4096) + 1


def test_odd_tables(spark, tmp_path):
    """Null and empty texts, null and repeated ids, names that operators use, and no documents at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, fp string, __id string, hits string, root string"
    rows = [(i, t, "en", None if i % 3 else "s", 1, 0.5, "w", "f", "x", "h", "r") for i, t in enumerate(["", None, "one two three four five", " \n", "another text of some words", None])]
    rows += [(None, "without an id", None, None, None, None, None, None, None, None, None), (2, "one two three four five six", "en", "s", 1, 0.5, "w", "f", "x", "h", "r")]
    for name, documents in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(documents, kind).coalesce(1).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(4, 1, 0), (2, 1, 1)] if documents else [], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([("a", "another text")] if documents else [], "item_id string, text string").coalesce(1).write.parquet(str(folder / "benchmark.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(folder))
            assert docs.columns == [c.split(" ")[0] for c in kind.split(", ")]
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert len(found) == docs.count() and all(r.piece == 0 for r in found)
        if documents:
            kept = {r.doc_id for r in found}
            assert 4 not in kept and {0, None} <= kept and len(found) <= 5  # contaminated, of the empty ones the first, without an id
        else:
            assert found == []


def test_tables_of_earlier_stages_go(spark, sf_dir):
    from lumenfold.llm.common import shared_dir

    path = pathlib.Path(shared_dir(spark).removeprefix("file://")) / "lumenfold"
    before = set(path.glob("*"))
    corpus_pipeline.run(spark, sf_dir).count()
    left = {p.name.rsplit("-", 1)[0] for p in set(path.glob("*")) - before if any(p.glob("*.parquet"))}
    assert not left & {"toxicity", "line_dedup", "simhash_near_dedup"} and "benchmark_decontamination" in left
