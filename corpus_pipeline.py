"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import decontaminate, linededup, packing, simhash, toxicity
from lumenfold.llm.common import discard, stored
from lumenfold.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not reject; it learns from the labelled ones among docs. Null texts
    hold no evidence and stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are common on their source's documents or different texts; n_chars follows the text."""
    return linededup.drop_boilerplate(docs, length_col="n_chars", common=linededup.COMMON)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near-duplicates. Null texts and those without words are copies
    of one another; rows without an id stay."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window; null texts have no words and stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null text is an empty one."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are a table before the next one reads them, and that of the
    stage before goes then. Null and empty texts, repeated ids and further columns go through as the stages say; an
    empty table gives an empty one."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs


#: Classifiers, suffix arrays and packing are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
