"""B2 on a stream: the batch rate ban's answer, whatever order rows come in.

Failures are counted per (address, second), as in batch, and those counts are
the state: a table partitioned by spans of findtime buckets, to which each
micro-batch adds its own counts.  A second is banned if the failures in
``[t - findtime, t]`` reach ``maxretry``; that window lies in two buckets, so
a micro-batch reads only the buckets next to its own, of the addresses it
touches, and runs the batch window over them.  It emits the first banned second
it finds for an address; the ban is the least emitted one, so a late row can
move it back.  Counts go in and out by partition folders, never by rewriting
a group, and all of it runs in Spark's own operators.

Rows more than ``lateness`` behind the latest time seen before their
micro-batch are dropped, and spans that no row can reach any more are
deleted.  Everything micro-batch n writes lies under n, so a replayed
micro-batch replaces its own counts and events.  Every ``MERGE`` micro-batches
the counts so far become one table, so that files stay few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.operators.blocking import ADDR, FINDTIME_SEC, MAXRETRY, ban_times, failures_per_second, first_bans
from rampart.session import delete_path, file_names, get_text, put_text
from rampart.sinks import write_batch

SPAN = 16                   # buckets of one partition folder
MERGE = 32                  # micro-batches whose counts are merged into one table
TASK_ROWS = 100_000         # counts that one task holds, about

__all__ = ["RateBans", "ban_times", "start_rate_ban"]


class RateBans:
    """The counts of a stream's failures, kept under ``state``."""

    def __init__(self, spark: SparkSession, out: str, state: str, failure: Column | None = None, findtime: int = FINDTIME_SEC,
                 maxretry: int = MAXRETRY, lateness: int = 3600, ts: str = "TimeLocal", col: str = ADDR):
        self.spark, self.out, self.state = spark, out, state.rstrip("/")
        self.failure, self.findtime, self.maxretry, self.lateness, self.ts, self.col = failure, findtime, maxretry, lateness, ts, col
        self.schema = f"`{col}` STRING, sec BIGINT, n BIGINT, bucket BIGINT, span BIGINT"

    def _bucket(self, counts: DataFrame) -> DataFrame:
        return counts.withColumn("bucket", F.floor(F.col("sec") / self.findtime).cast("bigint"))

    def _write(self, counts: DataFrame, path: str) -> None:
        counts.withColumn("span", F.floor(F.col("bucket") / SPAN)).write.mode("overwrite").partitionBy("span").parquet(path)

    def _counts(self, batch_id: int, low: int, high: int) -> DataFrame:
        """Counts of the buckets low .. high: the last merged table and every micro-batch since."""
        merged = batch_id // MERGE * MERGE
        paths = [p for p in [f"{self.state}/merged/{merged}", *(f"{self.state}/counts/{i}" for i in range(merged, batch_id + 1))]
                 if file_names(self.spark, p)]
        parts = [self.spark.read.schema(self.schema).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(F.col("span").between(low // SPAN, high // SPAN) & F.col("bucket").between(low, high)).drop("span")

    def _merge(self, batch_id: int, low: int) -> None:
        """Counts before ``batch_id`` as one table; what the merge before that one replaced goes."""
        done = batch_id - MERGE
        got = self._counts(batch_id - 1, low, 1 << 62).groupBy(self.col, "sec", "bucket").agg(F.sum("n").alias("n"))
        self._write(got, f"{self.state}/merged/{batch_id}")
        delete_path(self.spark, f"{self.state}/merged/{done}")
        for i in range(done - MERGE, done):
            delete_path(self.spark, f"{self.state}/counts/{i}")

    def take(self, rows: DataFrame, batch_id: int) -> None:
        """One micro-batch: add its counts, emit the bans of the addresses it touches."""
        latest = get_text(self.spark, f"{self.state}/latest/{batch_id - 1}")
        floor = None if not latest else int(latest) - self.lateness
        if batch_id and batch_id % MERGE == 0:
            self._merge(batch_id, -(1 << 62) if floor is None else floor // self.findtime - 1)
        here = f"{self.state}/counts/{batch_id}"
        new = failures_per_second(rows, self.failure, self.ts, self.col)
        self._write(self._bucket(new if floor is None else new.where(F.col("sec") >= floor)), here)
        delta = self.spark.read.schema(self.schema).parquet(here)
        seen = delta.agg(F.min("sec").alias("low"), F.max("sec").alias("high")).first()
        if seen["low"] is not None:
            low, high = (int(seen[k]) // self.findtime for k in ("low", "high"))
            near = self._counts(batch_id, low - 1, high + 1)
            # dealt by (address, bucket), to as many tasks as the counts need:
            # the join deals by address, which would hold all its buckets
            parts = 1 + near.count() // TASK_ROWS
            near = near.join(delta.select(self.col).distinct(), self.col, "left_semi").repartition(parts, self.col, "bucket")
            per_sec = near.groupBy(self.col, "bucket", "sec").agg(F.sum("n").alias("n"))
            write_batch(first_bans(per_sec, self.findtime, self.maxretry, self.col, parts), self.out, batch_id)
        now = [int(x) for x in (latest, seen["high"]) if x is not None and x != ""]
        put_text(self.spark, f"{self.state}/latest/{batch_id}", str(max(now)) if now else "")
        delete_path(self.spark, f"{self.state}/latest/{batch_id - 2}")
        if floor is not None:
            self._drop_old(batch_id, floor // self.findtime - 1)

    def _drop_old(self, batch_id: int, low: int) -> None:
        """Delete spans below bucket ``low``: a row from now on needs its bucket and the one before."""
        merged = batch_id // MERGE * MERGE
        for path in [f"{self.state}/merged/{merged}", *(f"{self.state}/counts/{i}" for i in range(merged, batch_id))]:
            for folder in file_names(self.spark, path):
                name = folder.rsplit("/", 1)[1]
                if name.startswith("span=") and int(name[5:]) < low // SPAN:
                    delete_path(self.spark, folder)


def start_rate_ban(rows: DataFrame, out: str, state: str, checkpoint: str, failure: Column | None = None,
                   findtime: int = FINDTIME_SEC, maxretry: int = MAXRETRY, lateness: int = 3600, ts: str = "TimeLocal",
                   col: str = ADDR, available_now: bool = False, trigger_seconds: float = 1.0):
    """Bans of a stream of requests, written to ``out`` as ``(address, ban_sec,
    batch_id)``; ``ban_times`` reduces them to one ban an address.

    ``lateness`` is in seconds; the state under ``state`` (shared storage)
    belongs to the checkpoint.  Returns the ``StreamingQuery``.
    """
    bans = RateBans(rows.sparkSession, out, state, failure, findtime, maxretry, lateness, ts, col)
    w = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(bans.take)
    if available_now:
        return w.trigger(availableNow=True).start()
    return w.trigger(processingTime=f"{trigger_seconds} seconds").start()
