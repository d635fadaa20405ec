"""Batch file sources: text logs, UTF-16 logs, CSV tables, lists, binary files.

Every CSV read has an explicit schema (no inference pass over the data); tables
with a header are read by column name.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart import schemas as SC
from rampart.functions import text as X
from rampart.operators.numbering import number_lines, parse_bytes


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def any_path(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether something matches the path, or one of the paths (they may hold wildcards)."""
    jvm = spark._jvm
    for one in path if isinstance(path, list) else [path]:
        p = jvm.org.apache.hadoop.fs.Path(one)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
            return True
    return False


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "utf-8",
               numbered: bool = False) -> DataFrame:
    """SRC1 / SRC3 / SRC4: one row per line, with its file and split.

    UTF-8 goes through Spark's text source.  Other encodings (the live log
    is UTF-16LE) go through the ``logfiles`` source, which reads aligned
    byte ranges of each file on the executors and decodes whole lines.
    With ``numbered`` the lines get 1-based ``id`` in file order (P7).
    """
    paths = path if isinstance(path, list) else [path]
    if encoding.lower().replace("-", "").replace("_", "") == "utf8":
        df = spark.read.text(paths).select(
            F.col("value"), F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"))
    else:
        from rampart.sources.tail import read_files
        chunk = parse_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
        df = read_files(spark, paths, encoding, chunk).select("value", "file_path", "block_start")
    return number_lines(df) if numbered else df


HEADER_STEP = 1 << 16          # bytes read at once while a header record goes on
HEADER_LIMIT = 16 << 20        # a file without a newline up to here has no header that can be read


def _read_header(path: str) -> list[str] | None:
    """Field names of a CSV file's first record; None if it cannot be read as text."""
    from rampart.sources.tail import _fs
    try:
        fs, p = _fs(path)
        with fs.open_input_stream(p) as f:               # .gz and the like are unpacked
            raw = b""
            while True:
                more = f.read(HEADER_STEP)
                raw += more
                # the record ends at the first newline outside quotes
                quotes = np.cumsum(np.frombuffer(raw, np.uint8) == 0x22) % 2
                ends = np.flatnonzero((np.frombuffer(raw, np.uint8) == 0x0A) & (quotes == 0))
                if len(ends) or not more:
                    break
                if len(raw) > HEADER_LIMIT:
                    return None
        head = raw[:int(ends[0])] if len(ends) else raw
        rows = list(csv.reader(io.StringIO(head.decode("utf-8-sig"), newline="")))
        return [x.strip() for x in rows[0]] if rows else []
    except (OSError, UnicodeDecodeError, csv.Error):
        return None


def csv_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, names): the header of every CSV file, read on the executors.

    Only the first bytes of a file are read; the listing is the binary file
    source without its content.  Empty files have no names, unreadable ones null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), pa.array([_read_header(p) for p in paths], pa.list_(pa.string()))], ["path", "names"])

    files = spark.read.format("binaryFile").load(path if isinstance(path, list) else [path]).select("path")
    return files.mapInArrow(run, "path string, names array<string>")


def column_places(names: list[str], wanted: list[str], aliases: dict[str, str]) -> dict[str, int]:
    """Where each wanted column stands in a header: under its name or its alias,
    exactly or but for letter case; the first of several."""
    found = {}
    for w in wanted:
        for like in (w, aliases.get(w, w)):
            at = [i for i, n in enumerate(names) if n == like] or [i for i, n in enumerate(names) if n.lower() == like.lower()]
            if at:
                found[w] = at[0]
                break
    return found


def read_named_csv(spark: SparkSession, path: str | list[str], want: T.StructType, required: Iterable[str] = (),
                   aliases: dict[str, str] | None = None, tolerant: bool = False) -> DataFrame:
    """Columns of header CSV files by name, wherever each file has them.

    Files are grouped by header; each group is read once with a schema of its
    own, so only the wanted columns are parsed, and the groups are united.  A
    column that a file lacks is null, unless it is ``required``.  A missing
    path, an unreadable file or a file without a required column is an error;
    with ``tolerant`` such a path or file gives no rows.  There is one plan a
    header, not one a file.
    """
    if tolerant and not any_path(spark, path):
        return empty(spark, want)
    kinds = csv_headers(spark, path).groupBy("names").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    parts = []
    for r in kinds.orderBy(F.col("paths")[0]).collect():
        names, paths = r["names"], r["paths"]
        if names is not None and not names:              # empty files
            continue
        place = column_places(names or [], want.names, aliases or {})
        lost = [c for c in required if c not in place]
        if names is None or lost:
            if tolerant:
                continue
            raise ValueError(f"{paths[0]} " + (f"has no column {lost[0]}" if lost and names else "has no header that can be read"))
        back = {i: c for c, i in place.items()}
        schema = T.StructType([T.StructField(back.get(i, f"_unused_{i}"), want[back[i]].dataType if i in back else T.StringType())
                               for i in range(len(names))])
        reader = (spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", True)
                  .option("mode", "PERMISSIVE"))
        if tolerant:
            reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        parts.append(reader.csv(paths).select(*[F.col(f.name) if f.name in place else F.lit(None).cast(f.dataType).alias(f.name)
                                                for f in want.fields]))
    if not parts:
        return empty(spark, want)
    return reduce(DataFrame.unionByName, parts)


def read_normalized_csv(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """SRC6 / SRC7: the normalized table from header CSV files, columns by name.

    ``TimeLocal`` is read as text and parsed with ``yyyy-MM-dd HH:mm:ss``
    (FT3).  Doubled quotes inside quoted fields are unescaped.  Columns may
    stand in any order and other columns are ignored; one that a file lacks is
    null.  With ``tolerant`` what cannot be loaded gives no rows, and a time
    that does not parse becomes null instead of an error.
    """
    return _read_csv(spark, path, SC.NORMALIZED, tolerant)


def read_classified_csv(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """SRC7: the exported classified table by column name; its critical flag
    is read back from the export's words (anything else is null)."""
    df = _read_csv(spark, path, SC.CLASSIFIED, tolerant, texts=("critical_alert",))
    if isinstance(df.schema["critical_alert"].dataType, T.BooleanType):
        return df
    flag = F.col("critical_alert")
    return df.withColumn("critical_alert", F.when(flag == SC.CRITICAL_YES, True).when(flag == SC.CRITICAL_NO, False))


def _read_csv(spark: SparkSession, path: str, want: T.StructType, tolerant: bool, texts: tuple = ()) -> DataFrame:
    plain = {"TimeLocal", *texts}
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in plain else f.dataType)
                           for f in want.fields])
    if tolerant and not any_path(spark, path):
        return empty(spark, want)
    df = read_named_csv(spark, path, schema, aliases=SC.EXPORT_NAMES, tolerant=tolerant)
    fmt = F.lit("yyyy-MM-dd HH:mm:ss")
    time = F.try_to_timestamp("TimeLocal", fmt).cast("timestamp_ntz") if tolerant else F.to_timestamp_ntz("TimeLocal", fmt)
    return df.withColumn("TimeLocal", time)


def read_positional_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """SRC8: CSV whose rows are read by position into ``schema``; rows that do
    not fit keep the fields they have, and the raw row in ``_corrupt_record``."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(full).option("header", header).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("enforceSchema", True).csv(path))


def read_addresses_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: only the column named ``RemoteAddress`` of header CSV files; a
    file without it is an error."""
    return read_named_csv(spark, path, SC.BLOCKED, required=("RemoteAddress",))


def read_list(spark: SparkSession, path: str, col: str) -> DataFrame:
    """SRC10 / SRC11: stripped, distinct, non-empty lines; empty if absent."""
    if not path_exists(spark, path):
        return empty(spark, T.StructType([T.StructField(col, T.StringType())]))
    # the list may be a file, or a folder that jobs and streams append to
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return (lines.select(X.btrim_ws("value").alias(col))
            .where(F.col(col) != "").distinct())


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path, "RemoteAddress")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path, "entry")


def read_binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC5: one record per file (``path``, ``content``)."""
    paths = path if isinstance(path, list) else [path]
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table (the default storage of every rampart output)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)
