import os
import time

from pyspark.sql import functions as F

from rampart.plans import detect as DT
from rampart.sources.tail import LogTailStreamReader, tail
from rampart.streaming.live import outputs_under, start_live

BASE = ('Oct 10 host: RemoteAddress=10.0.0.{ip} - TimeLocal=10/Oct/2024:13:{mm:02d}:36 +0200 GET {url} '
        'HTTP/1.1 200 655 "-" "Mozilla/5.0 (X11)" a b c d e tok{ip}')


def _line(i):
    url = ["/view?k=1", "/q?id=1%27%20OR%201=1--", "/etc/passwd", "/x?a=1&b=2"][i % 4]
    return BASE.format(ip=i % 7, mm=i % 60, url=url)


def _append(path, lines, partial=""):
    with open(path, "ab") as f:
        f.write(("".join(s + "\n" for s in lines) + partial).encode("utf-16-le"))


def _rows(reader, start, end):
    """(value, epoch, offset) of what the reader delivers between two offsets."""
    return [tuple(r.values()) for part in reader.partitions(start, end) for b in reader.read(part) for r in b.to_pylist()]


def test_tail_reader_holds_partial_line_and_splits_chunks(tmpdir_path):
    p = os.path.join(tmpdir_path, "a.log")
    _append(p, ["old 1", "old 2"])
    r = LogTailStreamReader({"path": p, "encoding": "utf-16le", "startingPosition": "latest",
                             "maxBytesPerPartition": "10"})
    start = r.initialOffset()
    _append(p, ["new 1", "new 2 longer line", "new 3"], partial="half")
    end = r.latestOffset()
    lines = [row[0] for row in _rows(r, start, end)]
    assert lines == ["new 1", "new 2 longer line", "new 3"]
    _append(p, [], partial=" done\n")
    end2 = r.latestOffset()
    assert [row[0] for row in _rows(r, end, end2)] == ["half done"]
    with open(p, "wb") as f:                         # rotation: file starts over
        f.write("fresh\n".encode("utf-16-le"))
    end3 = r.latestOffset()
    assert end3["epoch"] == end2["epoch"] + 1
    assert [row[0] for row in _rows(r, end2, end3)] == ["fresh"]


def test_tail_stream_in_spark(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "s.log")
    _append(p, ["skipped"])
    q = (tail(spark, p, "utf-16le", "latest").writeStream.format("memory").queryName("tail_t")
         .option("checkpointLocation", tmpdir_path + "/ck").start())
    try:
        q.processAllAvailable()
        _append(p, ["one", "two"])
        time.sleep(0.5)
        q.processAllAvailable()
        got = sorted(r["value"] for r in spark.sql("SELECT value FROM tail_t").collect())
    finally:
        q.stop()
    assert got == ["one", "two"]


def test_live_pipeline_restart_is_effectively_once(spark, tmpdir_path):
    # a model trained on a batch of the same kind of lines
    from rampart.operators import parse as P
    train_lines = spark.createDataFrame([(i + 1, _line(i)) for i in range(400)], "id BIGINT, value STRING")
    model, _ = DT.train(spark, P.normalize(train_lines), n_trees=20, psi=64)
    mdir = tmpdir_path + "/model"
    DT.save_model(spark, model, mdir)

    log = os.path.join(tmpdir_path, "live.log")
    _append(log, [_line(i) for i in range(50)])
    out, ck = tmpdir_path + "/out", tmpdir_path + "/ck"
    q = start_live(spark, log, out, ck, mdir, starting="earliest", available_now=True)
    q.awaitTermination()
    _append(log, [_line(i) for i in range(50, 80)] + ["garbage line"])
    q = start_live(spark, log, out, ck, mdir, starting="earliest", available_now=True)
    q.awaitTermination()
    o = outputs_under(out)
    norm = spark.read.parquet(o.normalized)
    assert norm.count() == 80 and norm.select("id").distinct().count() == 80
    assert spark.read.parquet(o.rejects).where(F.col("reason") == "no_marker").count() == 1
    scores = spark.read.parquet(o.scores)
    assert scores.count() == 80
    # replaying a batch rewrites its partition instead of appending
    from rampart.sinks import write_batch
    again = scores.where(F.col("batch_id") == 0).drop("batch_id")
    write_batch(again, o.scores, 0)
    assert spark.read.parquet(o.scores).count() == 80
    cls = spark.read.parquet(o.classified)
    assert set(cls.columns) >= {"attack_types", "critical_alert", "anomaly_score"}


def test_watermarked_buckets_equal_batch(spark, tmpdir_path):
    from datetime import datetime, timedelta

    from rampart.operators import dashboard as D
    from rampart.streaming.windows import logs_over_time
    t0 = datetime(2024, 1, 1)
    rows = [(i, "1.1.1.1", t0 + timedelta(minutes=7 * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id BIGINT, RemoteAddress STRING, TimeLocal TIMESTAMP_NTZ")
    path = tmpdir_path + "/in"
    df.coalesce(3).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = (logs_over_time(stream, "1 hour", "0 seconds").writeStream.format("memory").queryName("v4_t")
         .outputMode("append").option("checkpointLocation", tmpdir_path + "/ck").start())
    q.processAllAvailable()
    q.stop()
    got = {(r[0], r[1]) for r in spark.sql("SELECT * FROM v4_t").collect()}
    want = {(r[0], r[1]) for r in D.logs_over_time(df).collect()}
    # the last bucket stays open (no later event moves the watermark past it)
    assert got <= want and len(want - got) <= 1


def test_tail_reader_restart_after_rotation(tmpdir_path):
    p = os.path.join(tmpdir_path, "r.log")
    _append(p, ["a1", "a2", "a3"])
    r = LogTailStreamReader({"path": p, "encoding": "utf-16le", "startingPosition": "earliest"})
    start = r.initialOffset()
    end = r.latestOffset()
    assert [x[0] for x in _rows(r, start, end)] == ["a1", "a2", "a3"]
    with open(p, "wb") as f:                          # rotated while the query was down
        f.write("b1\n".encode("utf-16-le"))
    fresh = LogTailStreamReader({"path": p, "encoding": "utf-16le"})   # restart: counter at 0
    end2 = fresh.latestOffset()
    rows = _rows(fresh, end, end2)
    assert [x[0] for x in rows] == ["b1"] and rows[0][1] == end["epoch"] + 1
    _append(p, ["b2"])
    end3 = fresh.latestOffset()
    rows = _rows(fresh, end2, end3)
    assert [x[0] for x in rows] == ["b2"] and rows[0][1] == end["epoch"] + 1


def test_tail_reader_utf8_chunks(tmpdir_path):
    p = os.path.join(tmpdir_path, "u8.log")
    lines = [f"ligne {i} é中 " + "x" * (i % 9) for i in range(200)]
    with open(p, "wb") as f:
        f.write(("\n".join(lines) + "\npartial").encode("utf-8"))
    r = LogTailStreamReader({"path": p, "encoding": "utf-8", "startingPosition": "earliest",
                             "maxBytesPerPartition": "7"})
    start, end = r.initialOffset(), r.latestOffset()
    got = [x[0] for x in _rows(r, start, end)]
    assert got == lines


def test_tail_rotation_to_a_longer_file(spark, tmpdir_path):
    """A log replaced by one that is already longer: the old file's rest and
    the whole new file are delivered."""
    import os

    from rampart.sources.tail import LogTailStreamReader

    log = os.path.join(tmpdir_path, "access.log")

    def write(path, lines, mode="w"):
        with open(path, mode) as f:
            f.write("".join(x + "\n" for x in lines))

    def read(reader, a, b):
        return [x[0] for x in _rows(reader, a, b)]

    r = LogTailStreamReader({"path": log, "startingPosition": "earliest"})
    write(log, ["a1", "a2"])
    start = r.latestOffset()
    write(log, ["a3"], "a")
    os.rename(log, log + ".1")
    write(log, ["b1", "b2", "b3", "b4"])
    end = r.latestOffset()
    assert read(r, start, end) == ["a3", "b1", "b2", "b3", "b4"]
    write(log, ["b5"], "a")
    assert read(r, end, r.latestOffset()) == ["b5"]


def test_line_batches_do_not_depend_on_files(spark, tmpdir_path):
    """The adaptive cut sees the same batches of lines for 1 and 6 files."""
    from conftest import SF_SMALL
    from rampart.plans import detect as DT
    from rampart.plans.registry import _write_log_files, access
    from rampart.streaming.live import outputs_under, start_file_stream
    model, _ = DT.train(spark, access(spark, SF_SMALL), n_trees=20, psi=64)
    got = []
    for n in (1, 6):
        logs, _ = _write_log_files(spark, SF_SMALL, n_files=n)
        out = f"{tmpdir_path}/out{n}"
        start_file_stream(spark, logs, out, f"{tmpdir_path}/ck{n}", model=model, max_files=2, batch_lines=7)
        got.append(sorted((r["id"], round(r["anomaly_score"], 9), r["line_batch"])
                          for r in spark.read.parquet(outputs_under(out).anomalies).collect()))
    assert got[0] and got[0] == got[1]


def _tail_run(spark, log, out, ck, model, size):
    from rampart.streaming.live import start_tail
    start_tail(spark, log, out, ck, model, starting="earliest", batch_lines=size, available_now=True).awaitTermination()


def test_tail_batches_survive_restarts_and_rotation(spark, tmpdir_path):
    """Lines fed in pieces, the stream stopped and started inside batches, the
    log rotated: ids 1..n without gaps and the batches of the batch replay."""
    from rampart.operators import parse as P
    from rampart.operators import threshold as TH
    lines = [_line(i) if i % 11 else f"garbage {i}" for i in range(64)]
    numbered = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines)], "id BIGINT, value STRING")
    model, _ = DT.train(spark, P.normalize(numbered), n_trees=20, psi=32)
    log, out, ck = (os.path.join(tmpdir_path, x) for x in ("live.log", "out", "ck"))
    at = 0
    for step, n in enumerate((3, 1, 5, 7, 0, 13, 2, 20, 13)):
        if step == 5:
            os.rename(log, log + ".1")                       # rotated between two runs
        _append(log, lines[at:at + n], partial="half" if step == 2 else "")
        at += n
        _tail_run(spark, log, out, ck, model, 5)
        if step == 2:                                        # the half line ends before the next run
            with open(log, "rb+") as f:
                f.seek(-len("half".encode("utf-16-le")), os.SEEK_END)
                f.truncate()
    assert at == len(lines)
    o = outputs_under(out)
    whole = len(lines) // 5 * 5
    good = P.normalize(numbered).where(F.col("id") <= whole)
    norm = sorted((r["id"], r["line_batch"], r["URL"]) for r in spark.read.parquet(o.normalized).collect())
    assert norm == sorted((r["id"], (r["id"] - 1) // 5, r["URL"]) for r in good.collect())
    bad = sorted(r["id"] for r in spark.read.parquet(o.rejects).collect())
    assert sorted([r[0] for r in norm] + bad) == list(range(1, whole + 1))
    key = lambda r: (r["id"], round(r["anomaly_score"], 9))
    batch = TH.adaptive_filter(DT.score(TH.with_batches(good, 5), model), "anomaly_score", "batch_id")
    assert sorted(map(key, spark.read.parquet(o.anomalies).collect())) == sorted(map(key, batch.collect()))


def test_line_batches_replay(spark, tmpdir_path):
    """A micro-batch taken twice gives the same rows and leaves the same state."""
    from rampart.streaming.live import LineBatches
    b = LineBatches(spark, 4, tmpdir_path + "/state")
    df = lambda vals, name: spark.createDataFrame([(v, name, 0) for v in vals], "value STRING, file_path STRING, block_start BIGINT").coalesce(1)
    rows = lambda got: [] if got is None else sorted((r["id"], r["value"], r["line_batch"]) for r in got.collect())
    assert rows(b.take(df("ab", "0"), 0)) == []
    first = rows(b.take(df("cde", "1"), 1))
    assert first == rows(b.take(df("cde", "1"), 1)) == [(1, "a", 0), (2, "b", 0), (3, "c", 0), (4, "d", 0)]
    assert rows(b.take(df("", "2"), 2)) == []
    assert rows(b.take(df("fghijkl", "3"), 3)) == [(i + 1, v, i // 4) for i, v in enumerate("abcdefghijkl") if i >= 4]
    assert b.flush(3) is None
    assert rows(b.take(df("m", "4"), 4)) == [] and rows(b.flush(4)) == [(13, "m", 3)]


def test_tail_reader_several_rotations_between_polls(tmpdir_path):
    p = os.path.join(tmpdir_path, "log{x}")

    def write(path, *lines):
        with open(path, "w") as f:
            f.write("".join(x + "\n" for x in lines))

    r = LogTailStreamReader({"path": p, "startingPosition": "earliest"})
    write(p, "a1", "a2")
    start = r.latestOffset()
    write(p + ".5", "too old")
    write(p + ".3", "a1", "a2", "a3")                # the committed file, rotated three times
    write(p + ".2", "b1")
    write(p + ".1", "c1", "c2")
    write(p, "d1")
    end = r.latestOffset()
    rows = _rows(r, start, end)
    assert [x[0] for x in rows] == ["a3", "b1", "c1", "c2", "d1"]
    assert [x[1] for x in rows] == [0, 1, 2, 2, 3]
    with open(p, "a") as f:
        f.write("d2\n")
    assert [x[:2] for x in _rows(r, end, r.latestOffset())] == [("d2", 3)]
    fresh = LogTailStreamReader({"path": p})
    write(p, "e1")                                   # replaced; the file before it is gone
    assert [x[0] for x in _rows(fresh, end, fresh.latestOffset())] == ["e1"]
