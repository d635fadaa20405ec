import ipaddress
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rampart.operators import blocking as B


def test_rate_ban_matches_brute_force(spark):
    rnd = random.Random(5)
    t0 = datetime(2024, 1, 1)
    rows = []
    for ip in [f"1.1.1.{i}" for i in range(12)]:
        t = t0
        for _ in range(rnd.randint(3, 60)):
            t += timedelta(seconds=rnd.choice([0, 1, 30, 120, 400, 900]))
            rows.append((ip, t, rnd.choice(["200", "404", "500"])))
    # a hot address with many events per second
    rows += [("9.9.9.9", t0 + timedelta(seconds=s // 7), "500") for s in range(3000)]
    df = spark.createDataFrame(rows, "RemoteAddress STRING, TimeLocal TIMESTAMP_NTZ, Status STRING")
    got = {r[0]: r[1] for r in B.rate_ban(df, B.failed_request(), 600, 5).collect()}
    want = {}
    for ip in {r[0] for r in rows}:
        ts = sorted(r[1] for r in rows if r[0] == ip and r[2][0] in "45")
        for t in ts:
            n = sum(1 for u in ts if t - timedelta(seconds=600) <= u <= t)
            if n >= 5:
                want[ip] = t
                break
    assert got == want


def test_whitelist_cidr(spark):
    wl = ["10.0.0.0/26", "192.168.1.7", "172.16.0.0/12", "bogus", "::1"]
    addrs = ["10.0.0.1", "10.0.0.63", "10.0.0.64", "192.168.1.7", "192.168.1.8", "172.20.3.4",
             "172.32.0.1", "::1", "x.y", None]
    df = spark.createDataFrame([(a,) for a in addrs], "RemoteAddress STRING")
    wdf = spark.createDataFrame([(e,) for e in wl], "entry STRING")
    got = {r[0] for r in B.whitelisted(df, wdf).collect()}
    nets = [ipaddress.ip_network(e) for e in wl if "/" in e]
    want = set()
    for a in addrs:
        if a is None:
            continue
        if a in wl:
            want.add(a)
            continue
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            continue
        if any(ip in n for n in nets if n.version == ip.version):
            want.add(a)
    assert got == want


def test_new_addresses_once_and_not_blocked(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", True), (None, True)],
                                 "RemoteAddress STRING, critical_alert BOOLEAN")
    blocked = spark.createDataFrame([("c",)], "RemoteAddress STRING")
    assert sorted(r[0] for r in B.new_addresses(rows, blocked).collect()) == ["a", "b"]
    assert sorted(r[0] for r in B.new_addresses(rows, blocked, critical_only=True).collect()) == ["a"]


def _stream_bans(spark, schema, path, where, findtime=600, maxretry=5, lateness=10 * 86400):
    from rampart.streaming.rateban import ban_times, start_rate_ban
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    start_rate_ban(stream, where + "/out", where + "/state", where + "/ck", None, findtime, maxretry, lateness,
                   available_now=True).awaitTermination()
    return {r[0]: r[1] for r in ban_times(spark.read.parquet(where + "/out")).collect()}


def test_stream_rate_ban_equals_batch_over_shuffled_files(spark, tmpdir_path):
    rnd = random.Random(9)
    t0 = datetime(2024, 1, 1)
    rows = [(f"ip{rnd.randint(0, 5)}", t0 + timedelta(seconds=rnd.randint(0, 4000))) for _ in range(400)]
    df = spark.createDataFrame(rows, "RemoteAddress STRING, TimeLocal TIMESTAMP_NTZ")
    path = tmpdir_path + "/in"
    df.repartition(4).write.parquet(path)
    got = _stream_bans(spark, df.schema, path, tmpdir_path)
    assert got == {r[0]: r[1] for r in B.rate_ban(df, None, 600, 5).collect()}


def test_stream_rate_ban_counts_only_its_window(spark, tmpdir_path):
    """A row from long before later failures bans nobody; one that completes
    an earlier window moves the ban back."""
    t0 = datetime(2024, 1, 1)
    first = [("a", t0 + timedelta(seconds=100000 + i)) for i in range(4)]
    first += [("b", t0 + timedelta(seconds=s)) for s in (1000, 1001, 1002, 1003, 1300)]
    late = [("a", t0), ("b", t0 + timedelta(seconds=1002))]
    schema = "RemoteAddress STRING, TimeLocal TIMESTAMP_NTZ"
    path = tmpdir_path + "/in"
    for rows in (first, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    got = _stream_bans(spark, df.schema, path, tmpdir_path)
    assert got == {"b": t0 + timedelta(seconds=1003)}
    assert got == {r[0]: r[1] for r in B.rate_ban(df, None, 600, 5).collect()}


def _failures(rnd, n, t0, span):
    return [(f"ip{rnd.randint(0, 7)}", t0 + timedelta(seconds=rnd.randint(0, span))) for _ in range(n)]


def test_rate_ban_state_is_merged_dropped_and_replayed(spark, tmpdir_path, monkeypatch):
    """Many micro-batches in time order: same bans as batch, old buckets gone, a replay changes nothing."""
    from rampart.session import file_names
    from rampart.streaming import rateban
    monkeypatch.setattr(rateban, "MERGE", 3)
    monkeypatch.setattr(rateban, "SPAN", 2)
    rnd = random.Random(4)
    t0 = datetime(2024, 1, 1)
    schema = "RemoteAddress STRING, TimeLocal TIMESTAMP_NTZ"
    steps = [_failures(rnd, 12, t0 + timedelta(seconds=700 * i), 900) for i in range(11)]
    bans = rateban.RateBans(spark, tmpdir_path + "/out", tmpdir_path + "/state", None, 600, 4, lateness=1800)
    for i, rows in enumerate(steps):
        df = spark.createDataFrame(rows, schema)
        bans.take(df, i)
        if i in (3, 5, 6):
            bans.take(df, i)                                  # replayed after a failure
    every = spark.createDataFrame([r for s in steps for r in s], schema)
    got = {r[0]: r[1] for r in rateban.ban_times(spark.read.parquet(tmpdir_path + "/out")).collect()}
    assert got and got == {r[0]: r[1] for r in B.rate_ban(every, None, 600, 4).collect()}
    kept = [f for d in ("merged", "counts") for b in file_names(spark, f"{tmpdir_path}/state/{d}") for f in file_names(spark, b)]
    spans = [int(f.rsplit("=", 1)[1]) for f in kept if "span=" in f]
    last = max(int(r[1].timestamp()) for r in steps[9]) - 1800
    assert min(spans) >= (last // 600 - 3) // 2 and len(file_names(spark, tmpdir_path + "/state/merged")) <= 2


def test_rate_ban_drops_rows_that_are_too_late(spark, tmpdir_path):
    from rampart.streaming.rateban import RateBans, ban_times
    t0 = datetime(2024, 1, 1)
    schema = "RemoteAddress STRING, TimeLocal TIMESTAMP_NTZ"
    bans = RateBans(spark, tmpdir_path + "/out", tmpdir_path + "/state", None, 600, 2, lateness=3600)
    at = lambda a, s: (a, t0 + timedelta(seconds=s))
    for i, rows in enumerate([[at("a", 0), at("b", 9000)], [], [at("a", 1), at("b", 5400), at("c", 5400)], [at("c", 5401), (None, t0), ("d", None)]]):
        bans.take(spark.createDataFrame(rows, schema), i)
    got = {r[0]: r[1] for r in ban_times(spark.read.parquet(tmpdir_path + "/out")).collect()}
    assert got == {"c": t0 + timedelta(seconds=5401)}         # a's second row came behind the watermark


def test_block_stream_adds_each_address_once(spark, tmpdir_path):
    """Several micro-batches, a restart, repeated rows, null addresses, a whitelist with networks."""
    from rampart.sources.files import read_blocklist
    from rampart.streaming.blocking import start_block_stream
    lst, src, ck = (f"{tmpdir_path}/{x}" for x in ("list", "rows", "ck"))
    spark.createDataFrame([("10.0.0.1",)], "value STRING").write.text(lst)
    wl = spark.createDataFrame([("10.1.0.0/16",), ("10.0.0.9",), ("name",)], "entry STRING")
    schema = "RemoteAddress STRING, critical_alert BOOLEAN"
    runs = [[["10.0.0.1", "10.0.0.2", "10.0.0.2", None], ["10.0.0.2", "10.0.0.9", "10.1.3.4", "name"]],
            [["10.0.0.2", "10.0.0.3"], ["10.0.0.3", "10.0.0.1", "10.2.0.1", "x"]]]
    for files in runs:
        for rows in files:
            spark.createDataFrame([(a, True) for a in rows], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        start_block_stream(stream, lst, ck, wl, available_now=True).awaitTermination()
    lines = sorted(r[0] for r in spark.read.option("recursiveFileLookup", True).text(lst).collect())
    assert lines == ["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.2.0.1", "x"]
    assert sorted(r[0] for r in read_blocklist(spark, lst).collect()) == lines
    batch = B.refresh_blocklist(spark.read.parquet(src), spark.createDataFrame([("10.0.0.1",)], "RemoteAddress STRING"), wl)
    assert sorted(r[0] for r in batch.collect()) == lines[1:]


def test_outside_whitelist_equals_batch(spark):
    rnd = random.Random(2)
    rows = [(f"10.{rnd.randint(0, 3)}.{rnd.randint(0, 3)}.{rnd.randint(0, 255)}",) for _ in range(500)] + [("name",), ("::1",), ("10.0.0",)]
    df = spark.createDataFrame(rows, "RemoteAddress STRING")
    wl = spark.createDataFrame([("10.0.0.0/14",), ("10.2.1.0/24",), ("10.3.3.128/25",), ("::1",), ("10.3.0.7",), ("bad/99",)], "entry STRING")
    got = sorted(r[0] for r in B.outside_whitelist(df, wl).collect())
    assert got == sorted(r[0] for r in B.exclude_whitelisted(df, wl).collect()) and got


def test_rate_ban_windows_are_dealt_by_bucket(spark, tmpdir_path, monkeypatch):
    """Counts that come dealt by address do not keep all buckets of an address
    in one task, and the stream deals its counts to as many tasks as they need."""
    from rampart.streaming import rateban
    per_sec = spark.range(0, 4000, 10).select(F.lit("hot").alias("RemoteAddress"), F.col("id").alias("sec"), F.lit(1).alias("n"))
    bans = B.first_bans(per_sec.repartition(3, "RemoteAddress"), 60, 5, parts=7)
    assert [tuple(r) for r in bans.collect()] == [("hot", 40)]
    assert "REPARTITION_BY_NUM" in bans._jdf.queryExecution().executedPlan().toString().split("Window")[-1]
    dealt = []
    first = rateban.first_bans
    monkeypatch.setattr(rateban, "TASK_ROWS", 50)
    monkeypatch.setattr(rateban, "first_bans", lambda *a: dealt.append(a[4]) or first(*a))
    rows = spark.createDataFrame(_failures(random.Random(2), 400, datetime(2024, 1, 1), 4000), "RemoteAddress STRING, TimeLocal TIMESTAMP_NTZ")
    rows.repartition(2).write.parquet(tmpdir_path + "/in")
    got = _stream_bans(spark, rows.schema, tmpdir_path + "/in", tmpdir_path)
    assert got == {r[0]: r[1] for r in B.rate_ban(rows, None, 600, 5).collect()}
    assert len(dealt) == 2 and dealt[0] >= 4 and dealt[1] > dealt[0]
