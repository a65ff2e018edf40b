"""Site-relative line frequency: lines that stand on a large share of a host's pages are boilerplate and are dropped.

DataFrame functions only. A page counts once for a line however often the line repeats in it. Counting
shuffles 16-byte digests that are summed in parts before they are sent, so a line or host that holds a
third of all rows costs no task more than others. At most 1/ratio times a page's lines can exceed the
ratio on a host, so the digests that are dropped are few; they go back to the pages as one array for a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh, stored

#: A line on more than this share of its host's pages is boilerplate.
RATIO = 0.1
#: Pages of a host below which nothing is known of it.
MIN_PAGES = 10
#: Of a host's different texts, the share above which and the number from which a line is common on it.
COMMON, COMMON_TEXTS = 0.06, 6
#: Bytes of the hosts' arrays up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Parts that each host is dealt out to where the arrays are too large to broadcast.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _line_digests(rows: DataFrame, *keep: str) -> DataFrame:
    """(host, digest, *keep) of each different line with a word of a page."""
    found = rows.select("host", *keep, F.explode(F.array_distinct(_lines(F.col("t")))).alias("line"))
    return found.filter(_has_word(F.col("line"))).select("host", *keep, _digest(F.col("line")).alias("digest"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", common: float | None = None) -> DataFrame:
    """(host, digest, pages, host_pages) of each line over the ratio on a host with min_pages pages at least.

    A null host is a host. Lines without a word are never boilerplate. Null texts count as pages.
    With common, lines on more than this share of the host's different texts, and on COMMON_TEXTS of them at
    least, go too. Pages with the same text count once there, or copies of a document would lose their lines.
    """
    rows = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("t"))
    totals = rows.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") >= min_pages)
    over = F.col("pages") > ratio * F.col("host_pages")
    if common is None:
        found = _line_digests(rows)
        counted = found.groupBy("host", "digest").agg(F.count("*").alias("pages"))
        # A line of one page alone exceeds no ratio of min_pages pages or more unless 1 / min_pages does.
        counted = counted.filter(F.col("pages") > ratio * min_pages)
    else:
        rows = rows.withColumn("of", _digest(F.col("t")))
        copies = rows.groupBy("host", "of").agg(F.count("*").alias("n"))
        totals = copies.groupBy("host").agg(F.sum("n").alias("host_pages"), F.count("of").alias("host_texts")).filter(F.col("host_pages") >= min_pages)
        found = _line_digests(rows, "of").groupBy("host", "digest", "of").agg(F.count("*").alias("n"))
        counted = found.groupBy("host", "digest").agg(F.sum("n").alias("pages"), F.count("*").alias("texts"))
        counted = counted.filter((F.col("pages") > ratio * min_pages) | (F.col("texts") >= COMMON_TEXTS))
        over = over | ((F.col("texts") >= COMMON_TEXTS) & (F.col("texts") > common * F.col("host_texts")))
    joined = counted.alias("c").join(totals.alias("t"), F.expr("c.host <=> t.host"))
    return joined.filter(over).select("c.host", "digest", "pages", "host_pages")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", length_col: str | None = None, common: float | None = None) -> DataFrame:
    """pages with boilerplate lines taken out of the text; columns, names and rows stay.

    A text without a line left is empty; a null text stays null. Texts are otherwise byte for byte what
    they were, line ends included. length_col, if given, is set to the characters of the new text.
    """
    host, drop, salt, at, changed = (fresh(pages.columns, n) for n in ("__host", "__drop", "__salt", "__at", "__new"))
    hosts = boilerplate(pages, ratio, min_pages, host_col, text_col, common).groupBy("host").agg(F.collect_set("digest").alias(drop))
    hosts = stored(hosts.withColumnRenamed("host", host), "boilerplate")  # counted once, for the size and for the join
    size = hosts.agg(F.sum(F.size(drop) * 40 + F.coalesce(F.octet_length(host), F.lit(0)) + 64)).first()[0] or 0
    same = F.col(f"`{host_col}`").eqNullSafe(F.col(host))
    if size <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(hosts), same, "left")
    else:
        hosts = hosts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = pages.withColumn(at, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]), F.lit(SALTS)).cast("int"))
        joined = salted.join(hosts, same & (F.col(at) == F.col(salt)), "left")
    text = F.col(f"`{text_col}`")
    kept = F.array_join(F.filter(_lines(text), lambda x: ~F.array_contains(F.col(drop), _digest(x))), "\n")
    new = F.when(F.col(drop).isNull() | text.isNull(), text).otherwise(kept)
    out = joined.withColumn(changed, new)
    columns = {text_col: F.col(changed)}
    if length_col:
        columns[length_col] = F.length(changed).cast(pages.schema[length_col].dataType)
    return out.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in pages.columns])


#: The same in DuckDB over the table documents.
SQL = f"""
WITH pages AS (SELECT doc_id, source, text, n_chars FROM documents),
totals AS (SELECT source, count(*) AS host_pages, count(DISTINCT text) AS host_texts FROM pages GROUP BY source),
lines AS (SELECT source, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
counted AS (
  SELECT source, line, count(*) AS n, count(DISTINCT text) AS texts FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
dropped AS (
  SELECT c.source, list(c.line) AS gone FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE t.host_pages >= {MIN_PAGES} AND (c.n > {RATIO} * t.host_pages
    OR (c.texts >= {COMMON_TEXTS} AND c.texts > {COMMON} * t.host_texts)) GROUP BY c.source)
SELECT p.doc_id, p.source,
  CASE WHEN d.gone IS NULL OR p.text IS NULL THEN p.text
       ELSE array_to_string(list_filter(string_split(p.text, chr(10)), lambda x: NOT list_contains(d.gone, x)), chr(10)) END AS text
FROM pages p LEFT JOIN dropped d ON p.source IS NOT DISTINCT FROM d.source
"""


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text) of documents without boilerplate lines; the host is the source."""
    return drop_boilerplate(docs.select("doc_id", "source", "text"), common=COMMON)
