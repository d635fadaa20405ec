"""Live detection (E1): tail → parse → per micro-batch {score, cut, classify}.

The parse is part of the streaming plan; everything that needs a static
frame (per-batch statistics, the forest, joins with saved dictionaries) runs
in ``foreachBatch``.  Every write of a micro-batch replaces partition
``batch_id=<n>`` of its table, so a batch replayed after a failure (the
checkpoint makes Spark replay the last uncommitted batch) overwrites its own
output instead of appending it twice: effectively-once output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart import sinks
from rampart.operators import classify as C
from rampart.operators import parse as P
from rampart.operators import threshold as TH
from rampart.operators.numbering import mark_lines, number_lines
from rampart.plans import detect as DT
from rampart.schemas import NORMALIZED_COLUMNS
from rampart.session import delete_path, get_text, put_text
from rampart.sources.files import path_exists
from rampart.sources.tail import tail

# Lines of one batch of the adaptive cut (the reference's buffer).
LINE_BATCH = 5


@dataclass
class LiveOutputs:
    normalized: str
    rejects: str
    scores: str
    anomalies: str
    classified: str


def outputs_under(base: str) -> LiveOutputs:
    b = base.rstrip("/")
    return LiveOutputs(b + "/normalized", b + "/rejects", b + "/scores", b + "/anomalies", b + "/classified")


def parsed_stream(lines: DataFrame) -> DataFrame:
    """P1–P8 on a stream of ``(value, epoch, offset)`` lines.

    ``id`` is the byte offset of the line in its file plus one (a line
    counter cannot survive restarts; this can); with the file's ``epoch``,
    kept beside it, it is unique and ordered.
    """
    with_id = lines.select((F.col("offset") + 1).alias("id"), "value", "epoch")
    return P.parse_marker(with_id, keep=("epoch",))


def process_batch(batch: DataFrame, batch_id: int, model: DT.Model | None, out: LiveOutputs,
                  line_batch: str | None = None) -> None:
    """One micro-batch through score → cut → classify → writes.

    The adaptive cut runs per engine micro-batch, or per value of the column
    ``line_batch`` (batches by line number) if the rows carry one.
    """
    keep = [c for c in ("epoch", line_batch) if c and c in batch.columns]
    batch = batch.persist()
    try:
        good, bad = P.split(batch, [*NORMALIZED_COLUMNS, *keep])
        sinks.write_batch(bad, out.rejects, batch_id)
        sinks.write_batch(good, out.normalized, batch_id)
        if model is None:
            flagged = good.withColumn("anomaly", F.lit(None).cast("int")) \
                .withColumn("anomaly_score", F.lit(None).cast("double"))
            sinks.write_batch(C.classify(flagged), out.classified, batch_id)
            return
        sinks.write_batch(DT.score(good, model, small_input=True), out.scores, batch_id)
        # the batch's scores, read back from what was just written; without
        # a good row there is nothing to cut
        written = f"{out.scores}/batch_id={int(batch_id)}"
        if not path_exists(good.sparkSession, written):
            return
        scored = good.sparkSession.read.parquet(written)
        by = line_batch or "_all"
        cut = TH.adaptive_filter(scored.withColumn("_all", F.lit(0)), "anomaly_score", by).drop("_all").persist()
        try:
            sinks.write_batch(cut, out.anomalies, batch_id)
            sinks.write_batch(C.classify(cut), out.classified, batch_id)
        finally:
            cut.unpersist()
    finally:
        batch.unpersist()


class LineBatches:
    """S3 / S5 on a stream of lines: running line numbers, and batches of
    ``size`` lines, however the engine cuts micro-batches.

    Lines are numbered on from the lines before, in the order of their file
    (or of the tailed log's epoch) and place.  A micro-batch's lines are
    written once, so a source is read once, and are numbered from their
    counts a range; those of an unfinished batch wait for the next
    micro-batch.  What micro-batch b leaves (its waiting lines, and the number
    of lines so far) is written under b and read by b + 1, so a replayed
    micro-batch, or a restarted stream, starts from the same state; older
    state is dropped.  ``flush`` takes the last, shorter batch.
    """

    def __init__(self, spark: SparkSession, size: int, state: str):
        self.spark, self.size, self.state = spark, size, state.rstrip("/")

    def _before(self, batch_id: int) -> tuple[DataFrame | None, int]:
        path = f"{self.state}/{batch_id - 1}"
        done = get_text(self.spark, path + "/count")
        if done is None:
            return None, 0
        return (self.spark.read.parquet(path + "/waiting") if int(done) % self.size else None), int(done)

    def _batched(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("line_batch", F.floor((F.col("id") - 1) / self.size).cast("bigint"))

    def take(self, lines: DataFrame, batch_id: int) -> DataFrame | None:
        """Whole batches of (id, value, line_batch) from the waiting and the
        new lines (value, file_path, block_start); None if there is none."""
        waiting, done = self._before(batch_id)
        here = f"{self.state}/{batch_id}"
        mark_lines(lines.select("value", "file_path", "block_start")).write.mode("overwrite").parquet(here + "/lines")
        new = self.spark.read.parquet(here + "/lines")
        total = done + new.count()
        every = number_lines(new, base=done + 1).select("id", "value")
        every = self._batched(every if waiting is None else waiting.unionByName(every))
        whole = F.col("line_batch") < total // self.size
        if total % self.size:
            every.where(~whole).drop("line_batch").write.mode("overwrite").parquet(here + "/waiting")
        put_text(self.spark, here + "/count", str(total))
        delete_path(self.spark, f"{self.state}/{batch_id - 2}")
        return every.where(whole) if total // self.size > done // self.size else None

    def flush(self, last_batch: int) -> DataFrame | None:
        waiting, _ = self._before(last_batch + 1)
        return None if waiting is None else self._batched(waiting)

    def run(self, lines: DataFrame, batch_id: int, model: DT.Model | None, out: LiveOutputs) -> None:
        """Take one micro-batch's whole batches through ``process_batch``."""
        rows = self.take(lines, batch_id)
        if rows is not None:
            process_batch(P.parse_marker(rows, keep=("line_batch",)), batch_id, model, out, "line_batch")


def start_live(spark: SparkSession, log_path: str, out_dir: str, checkpoint: str,
               model_path: str | None = None, encoding: str = "utf-16le",
               starting: str = "latest", trigger_seconds: float = 1.0, available_now: bool = False):
    """Start the live query; returns the ``StreamingQuery``.

    ``starting='latest'`` skips what the log already holds (S1); the
    trigger polls the file every ``trigger_seconds`` (S2).  Here a micro-batch
    of the engine is a batch, so that no line waits, and ``id`` is a byte
    offset; ``start_tail`` has batches of a fixed number of lines instead.
    """
    model = DT.load_model(spark, model_path) if model_path else None
    out = outputs_under(out_dir)
    stream = parsed_stream(tail(spark, log_path, encoding, starting))
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: process_batch(df, bid, model, out)))
    return _triggered(w, trigger_seconds, available_now)


def _triggered(writer, trigger_seconds: float, available_now: bool):
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{trigger_seconds} seconds").start()


def start_tail(spark: SparkSession, log_path: str, out_dir: str, checkpoint: str, model: DT.Model | None = None,
               encoding: str = "utf-16le", starting: str = "latest", batch_lines: int = LINE_BATCH,
               trigger_seconds: float = 1.0, available_now: bool = False):
    """S1–S6 in batches of ``batch_lines`` lines of the tailed log.

    ``id`` is the number of the line among all lines delivered, rejected ones
    included, without gaps over restarts and rotations; a batch is scored,
    cut and written when its last line is there, whatever micro-batches or
    restarts cut it.
    """
    out = outputs_under(out_dir)
    batches = LineBatches(spark, batch_lines, out_dir.rstrip("/") + "/lines")
    lines = tail(spark, log_path, encoding, starting).select(
        "value", F.lpad(F.col("epoch").cast("string"), 20, "0").alias("file_path"), F.col("range_start").alias("block_start"))
    w = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: batches.run(df, bid, model, out))
    return _triggered(w, trigger_seconds, available_now)


def start_file_stream(spark: SparkSession, lines_dir: str, out_dir: str, checkpoint: str,
                      model: DT.Model | None = None, max_files: int | None = None, batch_lines: int = LINE_BATCH):
    """The same pipeline over a folder of rotated log files (each new file is
    new data), with Spark's own file source, run to completion.

    Files come in the order they were written.  ``id`` is the line's number
    over all files, and the adaptive cut runs on batches of ``batch_lines``
    lines (S3), so results do not depend on files or micro-batches.
    """
    reader = spark.readStream.schema("value STRING")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(lines_dir).select("value", F.col("_metadata.file_path").alias("file_path"),
                                          F.col("_metadata.file_block_start").alias("block_start"))
    out = outputs_under(out_dir)
    batches = LineBatches(spark, batch_lines, out_dir.rstrip("/") + "/lines")
    last = [-1]

    def one(df: DataFrame, batch_id: int) -> None:
        batches.run(df, batch_id, model, out)
        last[0] = batch_id

    q = (lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rest = batches.flush(last[0]) if last[0] >= 0 else None
    if rest is not None:
        process_batch(P.parse_marker(rest, keep=("line_batch",)), last[0] + 1, model, out, "line_batch")
    return q
