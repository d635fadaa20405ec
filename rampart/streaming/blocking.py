"""J1 / B1 on a stream: a block list that grows as classified rows arrive.

An address is new if the block list, as it stood when the stream was first
started, lacks it (a stream-static anti join) and the stream has not emitted
it before (streaming de-duplication, whose state outlives restarts in the
checkpoint).  Its state is the set of addresses this stream has added, which
is what the block list must hold anyway.  Each micro-batch writes its
addresses under its own number, so one that is replayed writes them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart import sinks
from rampart.operators.blocking import ADDR, outside_whitelist
from rampart.session import write_table
from rampart.sources.files import read_blocklist


def stream_new_addresses(rows: DataFrame, blocked: DataFrame, whitelist: DataFrame | None = None,
                         critical_only: bool = False, col: str = ADDR) -> DataFrame:
    """New addresses of a stream of classified rows, each once (append mode)."""
    if critical_only:
        rows = rows.where(F.col("critical_alert"))
    cand = rows.select(col).where(F.col(col).isNotNull())
    if whitelist is not None:
        cand = outside_whitelist(cand, whitelist, col)
    return cand.join(blocked.select(col), on=col, how="left_anti").dropDuplicates([col])


def start_block_stream(rows: DataFrame, blocklist_path: str, checkpoint: str, whitelist: DataFrame | None = None,
                       critical_only: bool = False, available_now: bool = False, trigger_seconds: float = 1.0):
    """Append a stream's new addresses to a block list (a folder of text files,
    one address a line); returns the ``StreamingQuery``.

    What the list holds at the start is read once; lines that this stream
    added before a restart are in its state as well, so they are never added
    again.  Micro-batch n writes the folder ``batch_id=n``, which a replay replaces.
    """
    spark = rows.sparkSession
    blocked = write_table(read_blocklist(spark, blocklist_path), "blocked")
    new = stream_new_addresses(rows, blocked, whitelist, critical_only)
    w = (new.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, i: sinks.overwrite(df.select(ADDR), f"{blocklist_path.rstrip('/')}/batch_id={i}", "text")))
    if available_now:
        return w.trigger(availableNow=True).start()
    return w.trigger(processingTime=f"{trigger_seconds} seconds").start()
