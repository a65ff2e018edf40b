"""Strict JSON-lines tables, run manifests and result files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.text import has_chat_template, strip
from lumenfold.operators.requests import number_rows


def _lines(spark: SparkSession, path: str, ends: str | None = None) -> DataFrame:
    """(value, file, block, ordinal, raw variant, fault) of every line, blank ones too.

    Spark's text source keeps a line's bytes as they are, so they are checked before anything decodes them. Ordinals
    tell lines apart and follow each other in a block of a file, which is where a split of it begins. A repeated key
    of an object keeps its last value; the session's spark.sql.variant.allowDuplicateKeys is set for that.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    reader = spark.read if ends is None else spark.read.option("lineSep", ends)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = reader.text(path).select("value", *place, F.monotonically_increasing_id().alias("ordinal"))
    sound = F.is_valid_utf8("value")
    raw = F.when(sound, F.try_parse_json("value"))
    blank = sound & (F.regexp_replace("value", r"(?U)\s+", "") == "")
    parsed = lines.withColumns({"raw": raw, "sound": sound, "blank": blank})
    fault = F.when(~F.col("sound"), "invalid UTF-8").when(F.col("blank"), None).when(F.col("raw").isNull(), "invalid JSON")
    fault = fault.when(~F.schema_of_variant("raw").startswith("OBJECT"), "not a JSON object")
    return parsed.withColumn("fault", fault).drop("sound")


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(raw variant, file, block, ordinal) of each line that is not blank. In strict reading a line that is not valid
    UTF-8 or not a JSON object (or holds NaN or Infinity) fails the job; else it is left out. line_faults() tells
    the numbers of such lines."""
    lines = _lines(spark, path).filter(~F.col("blank"))
    if not strict:
        return lines.filter("fault is null").select("raw", "file", "block", "ordinal")
    told = F.concat(F.col("fault"), F.lit(" in "), F.col("file"), F.lit(": "), F.substring(F.make_valid_utf8("value"), 1, 200))
    checked = F.when(F.col("fault").isNull(), F.col("raw")).otherwise(F.raise_error(told).cast("variant"))
    return lines.select(checked.alias("raw"), "file", "block", "ordinal")


def line_faults(spark: SparkSession, path: str, ends: str | None = None) -> DataFrame:
    """(file, line, fault, text) of the lines that strict reading refuses; lines are numbered from 1 in their file, blank
    ones too, from the number of lines in the blocks before: two passes that move a row for each block."""
    lines = _lines(spark, path, ends)
    return _placed(lines, lines.filter("fault is not null"))


def _placed(lines: DataFrame, found: DataFrame) -> DataFrame:
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))  # a row for each split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return found.join(starts, ["file", "block"]).select("file", (F.col("ordinal") + F.col("shift")).alias("line"), "fault", F.make_valid_utf8(F.substring("value", 1, 200)).alias("text"))


def in_file_order(lines: DataFrame) -> DataFrame:
    """read_jsonl() rows whose ordinal is their place (from 0) by file name and line, without gaps."""
    return number_rows(lines, F.struct("file", "block", "ordinal"), "__place").drop("ordinal", "block").withColumnRenamed("__place", "ordinal")


def field(raw: Column, name: str, kind: str = "string") -> Column:
    """A key of a JSON object; of the wrong type, null. Whole numbers are strict: true, 1.0 and "1" are not numbers."""
    if kind in ("int", "bigint", "long"):
        typed = F.schema_of_variant(F.try_variant_get(raw, f"$.{name}", "variant")) == "BIGINT"
        return F.when(typed, F.try_variant_get(raw, f"$.{name}", kind))
    if kind == "string":
        typed = F.schema_of_variant(F.try_variant_get(raw, f"$.{name}", "variant")) == "STRING"
        return F.when(typed, F.try_variant_get(raw, f"$.{name}", "string"))
    return F.try_variant_get(raw, f"$.{name}", kind)


def single_generation(raw: Column, name: str = "gen") -> Column:
    """A generation that is a string, [] (an empty text) or [string]; null for anything else."""
    value = F.try_variant_get(raw, f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(raw, f"$.{name}", "array<variant>")
    first = F.try_variant_get(raw, f"$.{name}[0]", "string")
    of_one = F.when(F.size(items) == 0, F.lit("")).when((F.size(items) == 1) & (F.schema_of_variant(F.try_element_at(items, F.lit(1))) == "STRING"), first)
    return F.when(kind == "STRING", F.try_variant_get(raw, f"$.{name}", "string")).when(kind.startswith("ARRAY"), of_one)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends rows as new part files; a file that was cut short stays as it is and does not join a new line."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_resumable(spark: SparkSession, path: str, repair: bool = False) -> DataFrame:
    """(raw, file, ordinal) of a possibly interrupted output: of each file a broken last line without a line end is left
    out; any other broken line (invalid UTF-8, invalid JSON, no object) fails with its file and number.

    With repair, files that end without a line end are put right first: a broken last line goes, a sound one gets
    its line end. A file that cannot be written is left as it is.
    """
    lines = _lines(spark, path, "\n")
    last = lines.groupBy("file").agg(F.max(F.struct("block", "ordinal")).alias("last"))
    broken = lines.filter("fault is not null").join(last, "file").withColumn("at_end", F.struct("block", "ordinal") == F.col("last"))
    ends = broken.filter(F.col("at_end") & (F.col("fault") != "not a JSON object")).select("file").distinct()
    cut = [r["file"] for r in ends.toLocalIterator() if not _ends_line(spark, unquote(r["file"]))]  # a few files at most
    wrong = broken.filter(~(F.col("at_end") & F.col("file").isin(cut)))
    if wrong.head(1):
        r = _placed(lines, wrong).orderBy("file", "line").first()
        raise ValueError(f"{r['fault']} in {r['file']} at line {r['line']}: {r['text']}")
    if repair and [f for f in _files(spark, path) if repair_tail(spark, f, f in map(unquote, cut))]:
        lines = _lines(spark, path, "\n")
    return lines.filter("fault is null and not blank").select("raw", "file", "ordinal")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that Spark reads under path, named as rows name theirs."""
    return [_hadoop(spark, unquote(f))[1].toString() for f in spark.read.text(path).inputFiles()]


def _ends_line(spark: SparkSession, path: str) -> bool:
    """Whether the last byte of a file is a line end, or there is none."""
    fs, place = _hadoop(spark, path)
    length = fs.getFileStatus(place).getLen()
    if not length:
        return True
    stream = fs.open(place)
    try:
        stream.seek(length - 1)
        return stream.read() == 10
    finally:
        stream.close()


def _last_line_start(fs, place, step: int = 1 << 16) -> int:
    """Where the last line of a file begins: after its last line end, looked for from the end backwards."""
    stream, end = fs.open(place), fs.getFileStatus(place).getLen()
    try:
        while end:
            size = min(step, end)
            stream.seek(end - size)
            at = bytes(stream.readNBytes(size)).rfind(b"\n")
            if at >= 0:
                return end - size + at + 1
            end -= size
        return 0
    finally:
        stream.close()


def repair_tail(spark: SparkSession, path: str, broken: bool) -> bool:
    """Puts the end of a file right that has none: cuts its broken last line, or ends its sound one; whether it did.

    The file is copied beside itself, in streams, and renamed over, so a crash leaves the old or the new one.
    """
    if _ends_line(spark, path):
        return False
    fs, place = _hadoop(spark, path)
    keep = _last_line_start(fs, place) if broken else fs.getFileStatus(place).getLen()

    def fill(out) -> None:
        source = fs.open(place)
        try:
            left = keep
            while left:
                part = source.readNBytes(min(left, 1 << 20))
                out.write(part)
                left -= len(part)
        finally:
            source.close()
        if not broken:
            out.write(bytearray(b"\n"))

    try:
        replace_file(spark, path, fill)
    except Exception as e:  # a place that is only read
        if not any(x in str(e) for x in ("ermission", "Read-only", "read-only")):
            raise
        return False
    return True


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def replace_file(spark: SparkSession, path: str, fill: Callable) -> None:
    """Fills a temporary file beside path and renames it over path: at any moment the old or the new file stands there.
    fill gets the stream to write to."""
    fs, place = _hadoop(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    try:
        out = fs.create(hidden, True)
        try:
            fill(out)
        finally:
            out.close()
        rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
        files.rename(files.makeQualified(hidden), files.makeQualified(place), how)
    finally:
        fs.delete(hidden, False)  # gone where it was renamed


def write_text_atomically(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on any Hadoop file system: the old or the new one at any moment."""
    replace_file(spark, path, lambda out: out.write(bytearray(text.encode("utf-8"))))


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """A result file; NaN and Infinity are errors."""
    write_text_atomically(spark, path, json.dumps(summary, ensure_ascii=False, indent=2, allow_nan=False) + "\n")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, modificationTime) of files that match a glob, without their content."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")


def load_questions(spark: SparkSession, path: str, name: str, choices: bool = False) -> DataFrame:
    """(doc_id, prompt, answer, ordinal) of question files, with choices also (choices, choice_tokens, gold); rows without an
    id are named by `name` and their place (from 0, by file name and line)."""
    raw = F.col("raw")
    more = [F.try_variant_get(raw, f"$.{c}", "array<string>").alias(c) for c in ("choices", "choice_tokens")] + [field(raw, "gold", "int").alias("gold")] if choices else []
    rows = in_file_order(read_jsonl(spark, path)).select(field(raw, "doc_id").alias("doc_id"), field(raw, "prompt").alias("prompt"), F.try_variant_get(raw, "$.answer", "string").alias("answer"), *more, "ordinal")
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.concat(F.lit(f"{name}:"), F.col("ordinal").cast("string"))))


def load_pool(spark: SparkSession, path: str, shots: int) -> DataFrame:
    """(doc_id, prompt, answer) of a file of demonstrations; fails where there are fewer than `shots`, or one has a blank
    prompt or answer or a prompt with a chat template."""
    raw = F.col("raw")
    pool = read_jsonl(spark, path).select(*[field(raw, c).alias(c) for c in ("doc_id", "prompt", "answer")])
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    seen = pool.agg(F.count("*").alias("n"), F.count_if(blank("prompt")).alias("prompts"), F.count_if(blank("answer")).alias("answers"), F.count_if(has_chat_template(F.col("prompt"))).alias("templates")).first()
    if seen["n"] < shots:
        raise ValueError(f"{path} has {seen['n']} demonstrations, fewer than {shots}")
    for fault in ("prompts", "answers", "templates"):
        if seen[fault]:
            raise ValueError(f"{path}: {seen[fault]} demonstrations with {'a chat template' if fault == 'templates' else 'blank ' + fault}")
    return pool
