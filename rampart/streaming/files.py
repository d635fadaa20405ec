"""SRC5 on a stream: whole files as records, merged by their first timestamp.

A folder is watched with the streaming binary file source, which keeps the
files it has taken in its checkpoint; each file becomes one record keyed by
the first timestamp in it.  A micro-batch writes its records under its own
number, so one that is replayed writes them once, and files added between
two runs are taken by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.sinks import write_batch

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_binary(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """One row a file (path, content) as files appear."""
    r = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path).select("path", "content")


def timed_files(files: DataFrame) -> DataFrame:
    """Files with ``ts``, the first timestamp in each; files without one drop (O2)."""
    timed = files.withColumn("ts", X.embedded_time(F.col("content").cast("string")))
    return timed.where(F.col("ts").isNotNull())


def start_merge_files(spark: SparkSession, path: str, out: str, checkpoint: str, max_files: int | None = None,
                      available_now: bool = False, trigger_seconds: float = 1.0):
    """Add each new file's record to the table ``out``; returns the ``StreamingQuery``."""
    w = (timed_files(stream_binary(spark, path, max_files)).writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, i: write_batch(df, out, i)))
    if available_now:
        return w.trigger(availableNow=True).start()
    return w.trigger(processingTime=f"{trigger_seconds} seconds").start()


def merged_files(spark: SparkSession, out: str) -> DataFrame:
    """The records so far in merged order (time, then path)."""
    return spark.read.parquet(out).select("path", "content", "ts").orderBy("ts", "path")
