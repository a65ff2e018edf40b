"""Generation outputs as a stream: appended once for each sample, counted as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_outputs(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Output files of a run as a stream; files_per_trigger bounds what a batch takes on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_of_each_sample(outputs: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Drops repeats of (doc_id, sample_index); with an event time, state older than the delay is let go."""
    if event_time:
        return outputs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["doc_id", "sample_index"])
    return outputs.dropDuplicates(["doc_id", "sample_index"])


def progress(outputs: DataFrame, event_time: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Outputs and errors in each window of event time."""
    marked = outputs.withWatermark(event_time, delay)
    return marked.groupBy(F.window(event_time, window).alias("window")).agg(F.count("*").alias("outputs"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def append_once(outputs: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Runs what is there through sink, a batch at a time; a failing sink fails the query, and a new start goes on from there."""
    return outputs.writeStream.foreachBatch(lambda batch, _: sink(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
