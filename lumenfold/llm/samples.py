"""Bounded samples of labelled rows, which classifiers are fitted on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAIN = 1 << 24
#: Text bytes that may reach the driver, for all labels together; each label has an equal share.
SAMPLE_BYTES = 96 << 20


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label, chosen by a hash of the key: all rows of a label that has no more.

    Labels are few (a handful of classes); their counts are all that is gathered.
    """
    counts = {r[label]: r["count"] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    at = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(GRAIN))
    taken: list[Column] = [(F.col(label) == F.lit(v)) & (at < F.lit(int(GRAIN * min(1.0, per_label / n)))) for v, n in sorted(counts.items())]
    return rows.filter(reduce(lambda a, b: a | b, taken, F.lit(False)))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of the labelled rows where `train` (of the id) holds; each text once, in order of text.

    Null labels, ids and texts are left out.
    """
    wanted = labels.select(id_col, F.col(label).alias("__label")).filter(train & F.col(id_col).isNotNull())
    wanted = bounded_sample(wanted, id_col, "__label", per_label)
    ids = wanted.select(F.col(id_col).alias("__id"), "__label").distinct()
    found = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())
    joined = found.join(F.broadcast(ids), F.col("__of") == F.col("__id"))  # bounded by the sample
    return different_texts(joined, "__text", "__label", per_label)


def different_texts(rows: DataFrame, text: str, label: str, per_label: int, sample_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """Different (text, label) in order of text: of each label the least by a hash of the text, 8 * per_label at most, and
    as many as its share of the bytes holds. So an id that stands in very many rows brings no more of them to the
    driver, and neither do many labels or long texts; texts are whole."""
    pairs = rows.select(F.col(text).alias("t"), F.col(label).alias("l")).filter(F.col("l").isNotNull()).distinct()
    by = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    ranked = pairs.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= 8 * per_label)
    sized = ranked.withColumn("bytes", F.sum(F.octet_length("t")).over(by))
    labels = F.broadcast(sized.agg(F.count_distinct("l").alias("labels")))  # one row
    kept = sized.join(labels).filter(F.col("bytes") <= F.lit(sample_bytes) / F.col("labels"))
    return sorted((r["t"], r["l"]) for r in kept.select("t", "l").collect())
