"""Quality rules, line dedup and archives: against SQL, brute force and exact round trips."""

import gzip
import hashlib
import os
import random
import time

import corpus_pipeline
import duckdb
import pytest

from lumenfold.llm import linededup, queries, rules, warc


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = c.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[x]) for x in columns) for r in found.collect()) == sorted(tuple(plain(r[names.index(x)]) for x in columns) for r in want.fetchall())


def repeated(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)})


def test_repeated_words():
    source = random.Random(4)
    for _ in range(60):
        words = [source.choice([b"a", b"b", b"c"]) for _ in range(source.randint(0, 60))]
        assert rules.repeated_words(words) == repeated(words)


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    assert rules.measures(text)[0] == 60_000 == rules.measures(text)[4]
    docs = spark.createDataFrame([(i, f"{text}\nfoot\n{i}", "s", 1, None, None) for i in range(12)], DOCS)
    assert sorted(r.text for r in linededup.drop_boilerplate(docs).collect()) == sorted(str(i) for i in range(12))


def test_two_million_words_in_bounded_time():
    words = [b"w%d" % (i % 977) for i in range(2_000_000)]
    began = time.time()
    assert rules.repeated_words(words) == 2_000_000 and time.time() - began < 8


def test_measures():
    assert rules.measures("a é\x0bb#\n\nx\nx\n x") == (6, 7, 1, 1, 0)
    assert rules.measures(None) == (0, 0, 0, 0, 0) == rules.measures(" \t\n")


DOCS = "doc_id long, text string, source string, n_chars long, host string, digest string"


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "# " * 30
    rows = [(i, good, "fine", 1, "h", "d") for i in range(40)] + [(100 + i, bad, "spam", 1, "h", "d") for i in range(40)] + [(200, good, "spam", 1, None, None), (201, None, None, None, None, None), (None, good, "new", 1, "h", "d"), (201, good, None, None, None, None)]
    found = rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert len(found) == len(rows) and set(range(40)) <= kept and None in kept and not kept & {200, *range(100, 140)}
    assert rules.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_boilerplate(spark, monkeypatch):
    foot = "All rights reserved"
    rows = [(i, f"line {i}\n{foot}\n\n{foot}\r" if i % 2 else f"line {i}\n{foot}", "a", 9, "h", "d") for i in range(12)]
    rows += [(50, foot, "b", 9, "h", "d"), (51, foot, "a", 9, None, None), (52, None, "a", 9, None, None), (53, "", "a", 0, None, None), (None, f"x\n{foot}", None, 1, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for limit in (32 << 20, 0):
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", limit)
        found = linededup.drop_boilerplate(docs, length_col="n_chars")
        text = {r.doc_id: r.text for r in found.collect()}
        assert found.columns == docs.columns and found.count() == len(rows)
        assert (text[0], text[1], text[50], text[51], text[52], text[53], text[None]) == ("line 0", f"line 1\n", foot, "", None, "", f"x\n{foot}")
    assert linededup.drop_boilerplate(docs.limit(0)).count() == 0


def test_pipeline_drops_common_lines(spark, sf_dir):
    foot, long, short = "shared foot", " ".join(f"p{i}" for i in range(60)), "short"
    rows = [(i, "\n".join([f"line {i}", *[foot] * (i < 7), *[long] * (10 <= i < 18), *[short] * (20 <= i < 24)]), "a", 9, "h", "d") for i in range(90)]
    rows += [(100 + i, "whole copy\nof a page", "a", 9, "h", "d") for i in range(9)]
    text = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()}
    assert len(text) == len(rows) and not any(foot in t.split("\n") or long in t.split("\n") for t in text.values())
    assert all(text[i] == f"line {i}" for i in range(7)) and [i for i, t in text.items() if short in t.split("\n")] == [20, 21, 22, 23]
    assert all(text[100 + i] == "whole copy\nof a page" for i in range(9))  # 8 % of the pages, but one text


def test_boilerplate_with_clashing_names(spark, monkeypatch):
    rows = [(i, f"line {i}\nfoot", "a", "x", 1, "y", None, 2) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __host string, __Drop int, __new string, __at string, __salt int")
    for limit in (32 << 20, 0):
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", limit)
        found = linededup.drop_boilerplate(docs)
        assert found.columns == docs.columns and sorted(map(tuple, found.collect())) == [(i, f"line {i}", *r[2:]) for i, r in enumerate(rows)]


def test_boilerplate_runs_no_python(spark, sf_dir):
    plan = queries.op5_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


PAGES = "page_id long, url string, html string, timestamp string, run string"


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example.com/{i % 5}?q", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\n", "t", "r") for i in range(60)]
    rows += [(70, None, None, None, None), (71, "http://x/\r\nA: b", "", None, None), (None, "http://h0.example.com/", "<p>1</p>\r\n\r\nWARC/1.1\r\n", None, None), (72, "http://[bad", "é", None, None), (72, "http://[bad", "é", None, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    found = warc.capture_index(pages, str(tmp_path / "a"), archive_bytes=2000, rows_per_task=9).collect()
    payload = {}
    for i, _, html, *_ in rows:
        payload.setdefault(html or "", []).append(i)
    want = []
    for i, _, html, *_ in rows:
        data, group = (html or "").encode(), payload[html or ""]
        last = max(x for x in group if x is not None)
        again = i != last
        want.append((i, len(data), warc.payload_digest(data), "revisit" if again else "response", last if again else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found)
    order = sorted(found, key=lambda r: (r.url_key, r.capture_no))
    for a, b in zip(order, order[1:]):
        if a.url_key == b.url_key:
            assert b.capture_no == a.capture_no + 1 and a.timestamp <= b.timestamp
        else:
            assert b.capture_no == 1
    names = sorted(p for p in os.listdir(tmp_path / "a") if p.endswith(".warc.gz"))
    assert len(names) > 3
    text = gzip.decompress((tmp_path / "a" / names[0]).read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa", None, None), (2, "u", "aa", None, None), (3, "u", "long text", None, None), (4, "u", "long text", None, None)], PAGES)
    found = {r.page_id: r.record_type for r in warc.capture_index(pages, str(tmp_path / "b"), min_bytes=5).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.capture_index(pages.limit(0), str(tmp_path / "c")).count() == 0


def test_broken_archive_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text", None, None)], PAGES)
    runs = warc.write_archives(warc.prepare(pages), str(tmp_path / "d"))
    name = next(p for p in os.listdir(tmp_path / "d") if p.endswith(".gz") and not p.startswith("."))
    record = gzip.decompress((tmp_path / "d" / name).read_bytes()).replace(b"text\r", b"tixt\r")
    (tmp_path / "d" / name).write_bytes(gzip.compress(record))
    for crc in (tmp_path / "d").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="not that of its header"):
        warc.read_archives(spark, str(tmp_path / "d"), runs).collect()


def test_loser_tree():
    source = random.Random(2)
    for k in range(12):
        runs = [sorted((source.randint(0, 9), i) for i in range(source.randint(0, 7))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("rows_per_task", [40, 100_000])
def test_runs_are_merged_in_the_order_they_were_written(spark, tmp_path, rows_per_task, monkeypatch):
    source = random.Random(8)
    rows = []
    for name in "abcde":
        captures = sorted((f"k{source.randint(0, 9) if source.random() < 0.5 else 3}", f"{source.randint(0, 20):014d}", f"{name}{i}") for i in range(source.randint(1, 90)))
        rows += [(name, i, 7, *c) for i, c in enumerate(captures)]
    kind = "run string, offset long, length long, url_key string, timestamp string, record_id string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    found = warc.merge_runs(runs, rows_per_task)
    got = [(r.url_key, r.timestamp, r.record_id, r.run, r.offset) for r in sorted(found.collect(), key=lambda r: (r.part, r.seq))]
    assert got == sorted((k, t, i, n, o) for n, o, _, k, t, i in rows)
    assert found.select("part").distinct().count() == (1 if rows_per_task > 1000 else len(warc.cut_points(runs, -(-len(rows) // rows_per_task))) + 1)
    assert warc.merge_runs(runs.filter("false")).count() == 0



def test_url_keys():
    assert warc.url_key("http://www.A.Example.com:80/P?q=1") == "com,example,a)/p?q=1"
    assert warc.url_key("https://b.org:8080") == "org,b:8080)/"
    assert warc.url_key(None) == "-" == warc.url_key("")
    assert hashlib.sha1(b"").digest() and warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
