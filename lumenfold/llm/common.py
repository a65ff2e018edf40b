"""Helpers that the corpus operators share: shared storage, Arrow batches, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker turns into Python objects at a time.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    conf = conf or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lumenfold/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores added until no column is called so (names do not tell upper from lower case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def release_worker() -> None:
    """Lets go what another operator kept in this Python worker."""
    _KEPT[:] = [None, None]


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow in bounded pieces. make() runs once in each task and returns the function of a piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in text_chunks(batch, text):
                yield work(piece)

    return df.mapInArrow(run, schema)


def crc_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


_KEPT: list = [None, None]


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What make() gives, kept by a Python worker from task to task until it is asked for something else.

    Workers outlive tasks and operators, so only the last operator's state stays in their memory.
    """
    if _KEPT[0] != key:
        release_worker()
        _KEPT[:] = [key, make()]
    return _KEPT[1]
