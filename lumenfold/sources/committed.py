"""Tables and manifests that are replaced in one step.

A committed table is a folder of versions and one small file that names the version that holds. A new version is
written whole, then the file is renamed over: readers find the old or the new version at any moment, whatever
step a crash comes after, and versions that nothing names are removed by the next commit.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import strip
from lumenfold.operators.requests import number_rows
from lumenfold.sources.jsonl import _hadoop, write_text_atomically

POINTER = "CURRENT.json"


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a committed table says: version, format and further facts; None where nothing is committed."""
    fs, place = _hadoop(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        text = bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
    found = json.loads(text)
    if not isinstance(found, dict) or not isinstance(found.get("version"), str) or not isinstance(found.get("format"), str):
        raise ValueError(f"{path} has a broken {POINTER}")
    return found


def commit(rows: DataFrame, path: str, kind: str = "parquet", check: Callable[[str], None] | None = None, **facts: object) -> str:
    """Writes rows as the version that holds from now on, with facts beside it in the pointer; its folder.

    check gets the folder before the pointer names it; what it raises ends the commit, and the version goes.
    """
    spark, base = rows.sparkSession, path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    rows.write.format(kind).option("ignoreNullFields", "false").save(f"{base}/{version}")
    if check:
        try:
            check(f"{base}/{version}")
        except Exception:
            fs, place = _hadoop(spark, f"{base}/{version}")
            fs.delete(place, True)
            raise
    return _hold(spark, path, version, kind, facts)


def _hold(spark: SparkSession, path: str, version: str, kind: str, facts: dict) -> str:
    """Lets the pointer name a version that is whole, and removes those before the last one."""
    base, before = path.rstrip("/"), current(spark, path)
    write_text_atomically(spark, f"{base}/{POINTER}", json.dumps({"version": version, "format": kind, **facts}, ensure_ascii=False, allow_nan=False) + "\n")
    fs, place = _hadoop(spark, base)
    # Readers that still hold the version before keep their files until the next commit.
    keep = {version, before["version"] if before else version}
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in keep:
            fs.delete(status.getPath(), True)
    return f"{base}/{version}"


def commit_tables(tables: dict[str, DataFrame], path: str, **facts: object) -> str:
    """Writes several tables, and facts beside them, as one version: all of them hold from the same moment on."""
    first = next(iter(tables.values()))
    version = f"v-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{path.rstrip('/')}/{version}/{name}")
    return _hold(first.sparkSession, path, version, "parquet", facts)


def folder(spark: SparkSession, path: str, table: str | None = None) -> str:
    """The folder of the version that holds, or of one of its tables."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"nothing is committed in {path}")
    return f"{path.rstrip('/')}/{found['version']}" + (f"/{table}" if table else "")


def read(spark: SparkSession, path: str, schema: str | None = None, table: str | None = None) -> DataFrame:
    found = current(spark, path)
    reader = spark.read.format((found or {}).get("format", "parquet"))
    return (reader.schema(schema) if schema else reader).load(folder(spark, path, table))


def _fault(ids: DataFrame) -> str | None:
    """What is wrong with a manifest's (place, doc_id) rows."""
    blank = F.coalesce(strip(F.col("doc_id")), F.lit("")) == ""
    found = ids.agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"), F.count_distinct("doc_id").alias("ids"), F.min("place").alias("least"), F.max("place").alias("most"), F.count_distinct("place").alias("places")).first()
    if found["blank"]:
        return f"{found['blank']} ids are missing or blank"
    if found["ids"] < found["n"]:
        return "ids are repeated"
    if found["n"] and (found["least"], found["most"], found["places"]) != (0, found["n"] - 1, found["n"]):
        return "its places have gaps"
    return None


def _in_order(questions: DataFrame) -> DataFrame:
    """(place, doc_id): places from 0 in the order of a column `ordinal`, or else of the rows as they are read."""
    order = F.col("ordinal") if "ordinal" in questions.columns else F.monotonically_increasing_id()
    keyed = questions.select(F.col("doc_id").cast("string").alias("doc_id"), order.alias("at"))
    return number_rows(keyed, F.col("at"), "place").select("place", "doc_id")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((place, doc_id), n_samples) of a run; fails where the manifest cannot be: ids blank or repeated, no places from 0
    without gaps, a number of samples that is not whole and positive."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"no manifest in {path}")
    ids = read(spark, path)
    n = found.get("n_samples")
    if type(n) is not int or n < 1:
        raise ValueError(f"manifest {path}: n_samples is {n!r}")
    if set(ids.columns) != {"place", "doc_id"} or dict(ids.dtypes)["doc_id"] != "string":
        raise ValueError(f"manifest {path} has other columns: {ids.columns}")
    if fault := _fault(ids):
        raise ValueError(f"manifest {path}: {fault}")
    return ids, n


def write_manifest(questions: DataFrame, path: str, n_samples: int, output: str | None = None) -> bool:
    """Commits the ids of a run in their order, or checks them against the manifest that is there; whether one holds now.

    Ids must be there, not blank and different. A manifest of other ids, another order or depth is an error. An
    output that was begun without a manifest goes on without one, with a warning.
    """
    if type(n_samples) is not int or n_samples < 1:
        raise ValueError(f"n_samples must be positive: {n_samples!r}")
    spark = questions.sparkSession
    mine = _in_order(questions)
    if fault := _fault(mine):
        raise ValueError(f"questions of {path}: {fault}")
    if current(spark, path) is not None:
        there, n = read_manifest(spark, path)
        if n != n_samples or not there.exceptAll(mine).isEmpty() or not mine.exceptAll(there).isEmpty():
            raise ValueError(f"{path} is the manifest of another run; use a new output")
        return True
    if output is not None and _begun(spark, output):
        logging.getLogger(__name__).warning("%s was begun without a manifest and goes on without one", output)
        return False
    commit(mine, path, n_samples=n_samples)
    return True


def _begun(spark: SparkSession, output: str) -> bool:
    fs, place = _hadoop(spark, output)
    return fs.exists(place) and fs.getContentSummary(place).getLength() > 0
