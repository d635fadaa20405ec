"""``logtail``: line sources over byte ranges of log files, any encoding.

Streaming — following one growing file.  Spark's file stream source only
notices *new files*; a web server appends to one file.  This source keeps a
byte offset instead:

* the offset is ``{"epoch": e, "pos": p, "head": h, "crc": c}``: ``p`` is the
  byte after the last complete line delivered; ``c`` is the checksum of the
  file's first ``h`` bytes, which tells a replaced file from a grown one; ``e``
  counts replacements, after which the rest of the old file, and every whole
  file rotated away since, are read from ``rotatedPath`` (default: the path
  with ``.1``, ``.2``, ..., newest first) if they are there, and the new file
  from byte 0;
* ``latestOffset`` ends at the last complete line, so a line the writer is
  still writing waits for the next micro-batch;
* ``partitions`` cuts the new byte range into chunks that executors read;
  each chunk owns the lines that *start* inside it (as Hadoop's line reader
  does), so nothing is read twice and nothing goes through the driver; rows
  carry their chunk's start, from which ``live.LineBatches`` numbers lines;
* ``startingPosition`` is ``latest`` (skip what is there, as a live tail
  does) or ``earliest``.

Batch — whole files in ``encoding`` (the live log is UTF-16LE), split into
byte ranges per file; rows carry ``file_path`` and ``block_start`` so that
``numbering.number_lines`` can number them in file order.  Newlines are
matched at code-unit boundaries, so a two-byte newline is never found
astride two characters, and no separator or quote character can cut a line.

Files are opened through ``pyarrow.fs``: local paths, or shared storage
(HDFS, S3, ...) that every executor can reach.

Options: ``path`` (batch: several paths joined by newlines; folders are
listed), ``encoding`` (``utf-8`` or ``utf-16le``), ``startingPosition``,
``maxBytesPerPartition``, ``rotatedPath``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

STREAM_SCHEMA = StructType([StructField("value", StringType()), StructField("epoch", LongType()),
                            StructField("offset", LongType()), StructField("range_start", LongType())])
BATCH_SCHEMA = StructType([StructField("value", StringType()), StructField("file_path", StringType()),
                           StructField("block_start", LongType()), StructField("offset", LongType())])

DEFAULT_CHUNK = 128 << 20
HEAD_BYTES = 1024               # bytes that identify a file


def _codec(encoding: str) -> str:
    e = encoding.lower().replace("_", "-")
    return "utf-16-le" if e in ("utf-16le", "utf-16-le", "utf16le") else e


def _newline(encoding: str) -> bytes:
    return "\n".encode(_codec(encoding))


def _fs(path: str):
    """Filesystem and path for a plain path or a URI (``file:`` included)."""
    from pyarrow import fs
    if path.startswith("file:"):
        p = path[5:]
        while p.startswith("//"):
            p = p[1:]
        return fs.LocalFileSystem(), p
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _size(path: str) -> int:
    from pyarrow import fs
    filesystem, p = _fs(path)
    info = filesystem.get_file_info(p)
    return info.size if info.type == fs.FileType.File else 0


def _open(path: str):
    filesystem, p = _fs(path)
    return filesystem.open_input_file(p)


def _last_line_end(path: str, size: int, nl: bytes, floor: int) -> int:
    """Byte just after the last newline before ``size`` (at least ``floor``)."""
    step = 1 << 16
    width = len(nl)
    with _open(path) as f:
        end = size
        while end > floor:
            start = max(floor, end - step)
            start -= (start - floor) % width
            f.seek(start)
            buf = f.read(end - start)
            i = len(buf) - width
            i -= i % width
            while i >= 0:
                if buf[i:i + width] == nl:
                    return start + i + width
                i -= width
            end = start
    return floor


BLOCK = 8 << 20


def _newlines(buf: bytes, width: int) -> np.ndarray:
    """Byte positions of the newlines of an aligned buffer."""
    n = len(buf) - len(buf) % width
    units = np.frombuffer(buf[:n], np.uint8 if width == 1 else "<u2")
    return np.flatnonzero(units == 10) * width


def _decode_lines(buf: bytes, ends: np.ndarray, width: int, codec: str) -> list[str]:
    """Lines of ``buf`` that end at the given newlines, decoded in one go."""
    text = buf[:int(ends[-1])].decode(codec, errors="replace").split("\n")
    if len(text) != len(ends):               # damaged bytes swallowed a newline: line by line
        starts = np.r_[0, ends[:-1] + width]
        text = [buf[i:j].decode(codec, errors="replace") for i, j in zip(starts, ends)]
    return [t[:-1] if t.endswith("\r") else t for t in text]


def read_range(path: str, start: int, end: int, first: bool, encoding: str, final: bool):
    """Yield ``(lines, line starts)`` for the lines that start in
    ``[start, end)``, a block at a time.  Unless ``first``, the line already
    running at ``start`` belongs to the previous range; with ``final`` an
    unterminated last line is emitted too."""
    width = len(_newline(encoding))
    codec = _codec(encoding)
    skip = not first
    pos = start - width if skip else start    # the newline just before the range may end that line
    with _open(path) as f:
        f.seek(pos)
        parts: list[bytes] = []               # an unfinished line, gathered without copying it again
        while pos < end or parts:
            piece = f.read(BLOCK)
            if not piece:
                tail = b"".join(parts)
                if final and tail and not skip and pos < end:
                    yield _decode_lines(tail, np.array([len(tail)]), width, codec), np.array([pos])
                return
            parts.append(piece)
            if not len(_newlines(piece, width)):
                continue
            buf = b"".join(parts)
            ends = _newlines(buf, width)
            if skip:
                cut = int(ends[0]) + width
                buf, pos, ends, skip = buf[cut:], pos + cut, ends[1:] - cut, False
            if len(ends):
                starts = np.r_[0, ends[:-1] + width] + pos
                own = int(np.searchsorted(starts, end))
                if own:
                    yield _decode_lines(buf, ends[:own], width, codec), starts[:own]
                done = int(ends[-1]) + width
                buf, pos = buf[done:], pos + done
            if pos >= end:
                return
            parts = [buf] if buf else []


class _Range(InputPartition):
    def __init__(self, path, epoch, start, end, first, encoding, final=False):
        self.path, self.epoch, self.start, self.end = path, epoch, start, end
        self.first, self.encoding, self.final = first, encoding, final


def _chunks(path: str, s: int, e: int, chunk: int, width: int, epoch: int, encoding: str,
            final: bool) -> list:
    out = []
    pos = s
    while pos < e:
        nxt = min(e, pos + chunk)
        nxt -= (nxt - s) % width
        if nxt <= pos:
            nxt = e
        out.append(_Range(path, epoch, pos, nxt, pos == s, encoding, final and nxt == e))
        pos = nxt
    return out


class LogTailStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.encoding = options.get("encoding", "utf-8")
        self.nl = _newline(self.encoding)
        self.starting = options.get("startingPosition", "latest").lower()
        self.rotated = options.get("rotatedPath", self.path.replace("{", "{{").replace("}", "}}") + ".{n}")
        self.chunk = int(options.get("maxBytesPerPartition", 64 << 20))
        self._last = None

    def _mark(self, path: str, upto: int) -> dict:
        """Identity of a file: length and checksum of its first bytes."""
        size = min(upto, HEAD_BYTES)
        if not size:
            return {"head": 0, "crc": 0}
        with _open(path) as f:
            return {"head": size, "crc": zlib.crc32(f.read(size))}

    def _same_file(self, path: str, size: int, mark: dict) -> bool:
        """Whether ``path`` still begins with the bytes already delivered."""
        if size < mark.get("pos", 0):
            return False
        head = mark.get("head", 0)
        return not head or self._mark(path, head)["crc"] == mark["crc"]

    def initialOffset(self) -> dict:
        pos = 0 if self.starting == "earliest" else _last_line_end(self.path, _size(self.path), self.nl, 0)
        return {"epoch": 0, "pos": pos, **self._mark(self.path, pos)}

    def latestOffset(self) -> dict:
        size = _size(self.path)
        last = self._last or {"epoch": 0, "pos": 0, "head": 0, "crc": 0}
        epoch, floor = last["epoch"], last["pos"]
        if not self._same_file(self.path, size, last):       # truncated or replaced: start over
            epoch, floor = epoch + 1, 0
        pos = max(_last_line_end(self.path, size, self.nl, floor), floor)
        self._last = {"epoch": epoch, "pos": pos, **self._mark(self.path, pos)}
        return self._last

    def partitions(self, start: dict, end: dict):
        # The file is another one if its first bytes are not those of the
        # committed start, or it ends before it.  Comparing bytes (not the
        # epoch counter) also works after a restart, when this reader's
        # counter began again while ``start`` comes from the checkpoint; the
        # epoch used beside the ids is resynchronised here.
        rotated = end["pos"] < start["pos"] or not self._same_file(self.path, max(end["pos"], start["pos"]), start)
        epoch = max(start["epoch"], end["epoch"])
        if rotated and end["epoch"] <= start["epoch"]:
            epoch += 1
        if self._last is not None and self._last["epoch"] < epoch:
            self._last = {**self._last, "epoch": epoch}
        width = len(self.nl)
        if not rotated:
            return _chunks(self.path, start["pos"], end["pos"], self.chunk, width, epoch, self.encoding, final=False)
        old = self._rotated_files(start)
        out = []
        for i, (path, pos) in enumerate(old):
            out += _chunks(path, pos, _size(path), self.chunk, width, start["epoch"] + i, self.encoding, final=True)
        epoch = max(epoch, start["epoch"] + len(old))
        if self._last is not None and self._last["epoch"] < epoch:
            self._last = {**self._last, "epoch": epoch}
        return out + _chunks(self.path, 0, end["pos"], self.chunk, width, epoch, self.encoding, final=False)

    def _rotated_files(self, start: dict) -> list[tuple[str, int]]:
        """The rotated files not yet delivered, oldest first: the rest of the
        one that the committed start lies in, and whole ones since.  Without
        that one nothing says which of the others are new, so there are none.
        """
        newer: list[tuple[str, int]] = []
        path = self.rotated.format(n=1)
        while start.get("head") and (size := _size(path)):
            if size >= start["pos"] and self._same_file(path, size, start):
                return [(path, start["pos"]), *reversed(newer)]
            newer.append((path, 0))
            after = self.rotated.format(n=len(newer) + 1)
            if after == path:
                break
            path = after
        return []

    def read(self, part: _Range):
        for lines, at in read_range(part.path, part.start, part.end, part.first, part.encoding, part.final):
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines, pa.string()), pa.array(np.full(len(at), part.epoch, np.int64)), pa.array(at, pa.int64()),
                 pa.array(np.full(len(at), part.start, np.int64))], ["value", "epoch", "offset", "range_start"])

    def commit(self, end: dict) -> None:
        pass


def _list_files(paths: list[str]) -> list[str]:
    from pyarrow import fs
    out = []
    for path in paths:
        filesystem, p = _fs(path)
        info = filesystem.get_file_info(p)
        if info.type == fs.FileType.Directory:
            sel = fs.FileSelector(p, recursive=True)
            for f in filesystem.get_file_info(sel):
                name = f.base_name
                if f.type == fs.FileType.File and not name.startswith((".", "_")):
                    out.append(path.rstrip("/") + f.path[len(p.rstrip("/")):] if "://" in path else f.path)
        elif info.type == fs.FileType.File:
            out.append(path)
    return sorted(out)


class LogFileBatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split("\n") if p]
        self.encoding = options.get("encoding", "utf-8")
        self.chunk = int(options.get("maxBytesPerPartition", DEFAULT_CHUNK))

    def partitions(self):
        width = len(_newline(self.encoding))
        out = []
        for path in _list_files(self.paths):
            out += _chunks(path, 0, _size(path), self.chunk, width, 0, self.encoding, final=True)
        return out or [_Range("", 0, 0, 0, True, self.encoding, True)]

    def read(self, part: _Range):
        if not part.path:
            return
        for lines, at in read_range(part.path, part.start, part.end, part.first, part.encoding, part.final):
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines, pa.string()), pa.array([part.path] * n, pa.string()),
                 pa.array(np.full(n, part.start, np.int64)), pa.array(at, pa.int64())],
                ["value", "file_path", "block_start", "offset"])


class LogTailDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self):
        return STREAM_SCHEMA

    def streamReader(self, schema):
        return LogTailStreamReader(self.options)


class LogFilesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logfiles"

    def schema(self):
        return BATCH_SCHEMA

    def reader(self, schema):
        return LogFileBatchReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LogTailDataSource)
    spark.dataSource.register(LogFilesDataSource)


def tail(spark, path: str, encoding: str = "utf-8", starting: str = "latest"):
    """``readStream`` over one growing file."""
    register(spark)
    return (spark.readStream.format("logtail").option("path", path).option("encoding", encoding)
            .option("startingPosition", starting).load())


def read_files(spark, paths: list[str], encoding: str, chunk_bytes: int | None = None):
    """Batch lines of whole files in any encoding, with file and block."""
    register(spark)
    r = spark.read.format("logfiles").option("path", "\n".join(paths)).option("encoding", encoding)
    if chunk_bytes:
        r = r.option("maxBytesPerPartition", str(chunk_bytes))
    return r.load()
