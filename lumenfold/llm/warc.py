"""WARC archives of pages, and one ordered capture index over them by an external merge of sorted runs.

Writing: the payload digest decides which records are responses and which revisit one. Each task writes
its archives, a gzip member for each record, under names of its partition, first as temporary files, so
a repeated attempt replaces them; and with each archive a run: its captures sorted by URL key and
timestamp. Payloads are not shuffled unless the digests with several pages are too many to broadcast. Merging:
the runs are read in their order and cut at keys of a sample, and each range is merged from its pieces of the runs by
a loser tree, which gives a globally ordered index and each capture's place in the history of its URL.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import chain, count
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import new_path, stored

#: Bytes at which an archive is closed; a record is never cut.
ARCHIVE_BYTES = 64 << 20
#: Digests with several pages up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Captures that a merge task holds.
MERGE_ROWS = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
LEVEL = 4
CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels from the right, then path and query, in lower case; '-' without a URL."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    port_text = "" if port in (None, 80, 443) else f":{port}"
    return f"{labels}{port_text}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_time(page_id: int | None) -> str:
    """Pages have no capture times; a page's is its id in seconds after EPOCH (of 100 years)."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 3_155_760_000)).strftime("%Y%m%d%H%M%S")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _clean(value: object) -> str:
    """Header values have one line each."""
    return " ".join(str(value).split())


def record(page: dict, payload: bytes) -> bytes:
    """A WARC/1.1 record. A revisit has no payload of its own; the length and digest of the full one stand in its header."""
    when = datetime.strptime(page["timestamp"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    body = payload if page["record_type"] == "response" else b""
    head = [f"WARC-Type: {page['record_type']}", f"WARC-Record-ID: <urn:uuid:{page['record_id']}>", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{page['digest']}", f"X-Payload-Length: {len(payload)}"]
    if page["url"]:
        head.insert(1, f"WARC-Target-URI: {_clean(page['url'])}")
    if page["page_id"] is not None:
        head.append(f"X-Page-ID: {page['page_id']}")
    if page["refers_to"] is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {page['refers_to']}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + CRLF.join(h.encode() for h in head) + 2 * CRLF + body + 2 * CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and body of a record; ValueError where it is not whole."""
    head, found, rest = data.partition(2 * CRLF)
    lines = head.split(CRLF)
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != 2 * CRLF:
        raise ValueError("record does not end where its length says")
    return fields, rest[:n]


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member of a stream, one in memory at a time."""
    import zlib

    offset, buffer = 0, b""
    while buffer or (buffer := stream.read(1 << 20)):
        machine, out, used = zlib.decompressobj(31), [], 0
        while True:
            out.append(machine.decompress(buffer))
            used += len(buffer)
            if machine.eof:
                break
            buffer = stream.read(1 << 20)
            if not buffer:
                raise ValueError("archive ends inside a record")
        buffer = machine.unused_data
        used -= len(buffer)
        yield offset, used, b"".join(out)
        offset += used


RUN = "run string, offset long, length long, url_key string, timestamp string, record_id string"


def prepare(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to of every page.

    Of pages with equal payloads of min_bytes or more, those with the largest id are responses, the others
    revisit it; a null id is smaller than all others, and pages without a larger one are all responses.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = rows.filter(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1 and last is not null").select("key", "last"), "copied-digests")
    # One row a digest on the right; where they are many, a digest with very many pages is a skewed key that
    # adaptive execution splits.
    small = groups.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(groups) if small else groups, "key", "left")
    if not small:  # archives are written from rows in a fixed order, also by a task that runs again
        joined = stored(joined, "judged-pages")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"))


def write_archives(prepared: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes prepare()'s rows as .warc.gz files into folder; returns the runs, one row a record, each archive's in order."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["run", "offset", "length", "url_key", "timestamp", "record_id"]

    def archive(pages: Iterator[dict], fs: pafs.FileSystem, base: str, name: str, attempt: int) -> pa.RecordBatch | None:
        """Writes pages to one archive until it is full; its run, or None if there was no page."""
        hidden, rows, at = f"{base}/.{name}.{attempt}", [], 0
        first = next(pages, None)
        if first is None:
            return None
        with fs.open_output_stream(hidden, compression=None) as out:
            for page in chain([first], pages):
                payload = page["html"].encode("utf-8")
                page["digest"] = payload_digest(payload)
                page["timestamp"] = capture_time(page["page_id"])
                page["record_id"] = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{len(rows)}"))
                data = gzip.compress(record(page, payload), LEVEL, mtime=0)
                out.write(data)
                rows.append((name, at, len(data), url_key(page["url"]), page["timestamp"], page["record_id"]))
                at += len(data)
                if at >= archive_bytes:
                    break
        fs.move(hidden, f"{base}/{name}")
        rows.sort(key=lambda r: r[3:])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        pages = (page for batch in batches for at in range(0, batch.num_rows, 256) for page in batch.slice(at, 256).to_pylist())
        for k in count():
            found = archive(pages, fs, base, f"captures-{task.partitionId():06d}-{k:04d}.warc.gz", task.taskAttemptId())
            if found is None:
                return
            yield found

    return stored(prepared.mapInArrow(run, RUN), "runs")


class LoserTree:
    """Merges sorted sequences: each inner node holds the loser of its match, so the next item costs log k comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _head(self, i: int) -> tuple | None:
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, i: int) -> None:
        """Sends run i up from its leaf; at first a run waits at the first free node."""
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while (item := self._head(winner := self.losers[0])) is not None:
            yield item
            self.at[winner] += 1
            self._play(winner)


ORDER = ("url_key", "timestamp", "record_id")


def cut_points(runs: DataFrame, parts: int, per_part: int = 32, most: int = 1_000_000) -> list[tuple]:
    """Keys that cut the captures into `parts` ranges of about equal size, from a sample by hash of bounded size."""
    if parts < 2:
        return []
    grain = max(1, runs.count() // min(per_part * parts, most))
    keys = sorted(tuple(r) for r in runs.filter(F.pmod(F.xxhash64("record_id"), F.lit(grain)) == 0).select(*ORDER).collect())
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def _cut_runs(cuts: list[tuple]):
    """For mapInArrow over stored runs: a row (part, piece) for each part of each run, its captures in the run's order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("run")).to_pylist()
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ORDER)))
            begins = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1] or keys[i] < keys[i - 1]]
            parts, pieces = [], []
            for start, end in zip(begins, [*begins[1:], len(names)]):
                while start < end:
                    part = bisect_right(cuts, keys[start])
                    stop = bisect_left(keys, cuts[part], start, end) if part < len(cuts) else end
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.slice(start, stop - start))
                    parts.append(part)
                    pieces.append(sink.getvalue().to_pybytes())
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(pieces, pa.binary())], names=["part", "piece"])

    return run


def merge_runs(runs: DataFrame, rows_per_task: int = MERGE_ROWS) -> DataFrame:
    """The runs as one index ordered by (url_key, timestamp, record_id), with part (of the order) and seq (in the part).

    Runs are read as they were written, in order, and each is cut at the same keys; the pieces of a part, whose
    captures keep their order, meet in one task, which merges them without sorting. Parts are cut by the whole key, so
    a URL with very many captures spans several; only a part is in memory.
    """
    cuts = cut_points(runs, max(1, -(-runs.count() // rows_per_task)))
    pieces = runs.mapInArrow(_cut_runs(cuts), "part int, piece binary")

    def merge(table: pa.Table) -> pa.Table:
        slices = []
        for piece in table.column("piece").to_pylist():
            held = pa.ipc.open_stream(piece).read_all().to_pydict()
            slices.append(list(zip(*(held[c] for c in (*ORDER, "run", "offset", "length")))))
        merged = list(LoserTree(sorted(slices, key=lambda x: (x[0][3], x[0]))))
        key, when, record_id, name, offset, length = (list(c) for c in zip(*merged))
        n = len(key)
        arrays = [pa.array(name), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(key), pa.array(when), pa.array(record_id), pa.array(np.full(n, table.column("part")[0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int64))]
        return pa.Table.from_arrays(arrays, names=["run", "offset", "length", "url_key", "timestamp", "record_id", "part", "seq"])

    return pieces.groupBy("part").applyInArrow(merge, f"{RUN}, part int, seq long")


def histories(index: DataFrame) -> DataFrame:
    """index with capture_no, the number (from 1) of a capture among those of its URL key, in the index's order.

    A URL's captures in a part are numbered by the window of that URL and part, and follow those of earlier parts.
    """
    sizes = index.groupBy("url_key", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.expr("sum(n) over (partition by url_key order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    starts = sizes.select("url_key", "part", (before - F.col("first")).alias("shift"))
    return index.join(starts, ["url_key", "part"]).withColumn("capture_no", F.col("seq") + F.col("shift") + 1).drop("shift")


def read_archives(spark, folder: str, names: DataFrame) -> DataFrame:
    """Every record of the named archives (column run): run, offset, page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are taken from its payload and must be those of its header.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        schema = pa.schema([("run", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        number = lambda v: None if v is None else int(v)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, _, data in members(stream):
                        fields, body = parse(data)
                        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                        if fields["warc-type"] == "response" and (digest, size) != (payload_digest(body), len(body)):
                            raise ValueError(f"{name} at {offset}: the payload is not that of its header")
                        rows.append((name, offset, number(fields.get("x-page-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], number(fields.get("x-refers-to-page-id"))))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    schema = "run string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    listed = stored(names.select("run").distinct(), "archives")
    # A row is a whole archive, which row counts and sizes do not show: the number of tasks is given.
    return listed.repartition(max(1, listed.count()), "run").mapInArrow(run, schema)


def capture_index(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, rows_per_task: int = MERGE_ROWS) -> DataFrame:
    """Archives pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url_key, timestamp, capture_no.

    One row per row of pages. Null html is an empty payload; a null url sorts as '-'. Repeated rows are
    records of their own. Other columns are ignored, whatever their names. An empty table gives none.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    runs = write_archives(prepare(pages, min_bytes), folder, archive_bytes)
    index = histories(stored(merge_runs(runs, rows_per_task), "capture-index"))
    records = stored(read_archives(spark, folder, runs), "records")  # so that the join knows its size
    joined = records.join(index.select("run", "offset", "url_key", "timestamp", "capture_no"), ["run", "offset"], "left")
    lost = F.raise_error(F.concat(F.lit("no capture in the index for the record at "), F.col("offset").cast("string"), F.lit(" of "), F.col("run")))
    found = F.when(F.col("capture_no").isNotNull(), F.col("capture_no")).otherwise(lost.cast("long"))
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", found.alias("capture_no"))


#: The same in DuckDB over the table pages (the base32 digest is built from the hex one; page ids make capture times differ).
SQL = r"""
WITH u AS (SELECT page_id, lower(trim(url)) AS url, regexp_extract(lower(trim(url)), '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages),
k AS (SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN '-' ELSE
    array_to_string(list_reverse(string_split(regexp_replace(host, '^www\.', ''), '.')), ',') || ')'
    || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/')
    || coalesce('?' || nullif(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '') END AS url_key FROM u),
c AS (SELECT page_id, url_key, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS timestamp,
    row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture_no FROM k),
p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last, count(*) AS n FROM p GROUP BY h),
b AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 5 * i + 1, 5)::BIT::INTEGER AS INTEGER), 1)), '') AS digest
      FROM (SELECT h, array_to_string(list_transform(range(1, 41), lambda i:
              lpad(bin(CAST('0x' || substr(h, i, 1) AS INTEGER)), 4, '0')), '') AS bits FROM g))
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n > 1 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id < last THEN last END AS refers_to, url_key, timestamp, capture_no
FROM p JOIN g USING (h) JOIN b USING (h) JOIN c USING (page_id)
"""
