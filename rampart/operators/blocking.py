"""Block list maintenance: new addresses, whitelist, rate bans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDR = "RemoteAddress"

# Rate-ban defaults of the ban configuration.
FINDTIME_SEC = 600
MAXRETRY = 5


def new_addresses(rows: DataFrame, blocked: DataFrame, col: str = ADDR,
                  critical_only: bool = False) -> DataFrame:
    """Addresses of ``rows`` that the block list lacks, each once.

    ``distinct`` pre-aggregates per task; the anti join is left to the
    planner (AQE broadcasts the block list while it is small, and falls back
    to a shuffle join when it is not).
    """
    if critical_only:
        rows = rows.where(F.col("critical_alert"))
    cand = rows.select(col).where(F.col(col).isNotNull()).distinct()
    return cand.join(blocked.select(col), on=col, how="left_anti")


def ipv4_to_long(c: Column) -> Column:
    """Dotted IPv4 text → integer; null when it is not four octets."""
    parts = F.split(c, r"\.")
    octets = [F.get(parts, i).try_cast("int") for i in range(4)]
    ok = (F.size(parts) == 4) & c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for o in octets:
        ok = ok & o.between(0, 255)
    val = ((octets[0].cast("bigint") * 16777216) + (octets[1].cast("bigint") * 65536)
           + (octets[2].cast("bigint") * 256) + octets[3].cast("bigint"))
    return F.when(ok, val)


def whitelist_networks(whitelist: DataFrame, col: str = "entry") -> DataFrame:
    """Whitelist entries as ``(plen, net)`` (IPv4, exact = /32) or ``exact``
    text for anything else."""
    e = F.col(col)
    addr = F.split(e, "/").getItem(0)
    plen = F.when(e.contains("/"), F.split(e, "/").getItem(1).try_cast("int")).otherwise(F.lit(32))
    ip = ipv4_to_long(addr)
    shift = (F.lit(32) - plen).cast("int")
    return whitelist.select(
        e.alias("entry"),
        F.when(ip.isNotNull() & plen.between(0, 32), plen).alias("plen"),
        # Division by a power of two is exact in double for 32-bit values.
        F.when(ip.isNotNull() & plen.between(0, 32),
               F.floor(ip / F.pow(F.lit(2.0), shift)).cast("bigint")).alias("net"))


def whitelisted(addresses: DataFrame, whitelist: DataFrame, col: str = ADDR,
                entry_col: str = "entry") -> DataFrame:
    """Distinct addresses covered by the whitelist (exact text or CIDR).

    A CIDR test is a range test; it becomes an equi-join by cutting each
    address to every prefix length the whitelist uses.  Those lengths are at
    most 33 values (/0../32), the only thing collected to the driver.
    """
    nets = whitelist_networks(whitelist, entry_col)
    lengths = sorted(r[0] for r in nets.where(F.col("plen").isNotNull()).select("plen").distinct().collect())
    addrs = addresses.select(col).where(F.col(col).isNotNull()).distinct()
    exact = addrs.join(nets.select(F.col("entry").alias(col)), on=col, how="left_semi")
    if not lengths:
        return exact
    ip = ipv4_to_long(F.col(col))
    cands = F.array(*[F.struct(F.lit(n).alias("plen"), F.shiftrightunsigned(ip, 32 - n).alias("net"))
                      for n in lengths])
    keyed = addrs.where(ip.isNotNull()).select(col, F.inline(cands))
    by_net = keyed.join(nets.where(F.col("plen").isNotNull()).select("plen", "net").distinct(),
                        on=["plen", "net"], how="left_semi").select(col)
    return exact.unionByName(by_net).distinct()


def _distinct_addresses(rows: DataFrame, col: str) -> DataFrame:
    """Distinct non-null addresses, written once to the shared folder.

    The set is read three times (exact match, CIDR match, anti join); each
    branch gets different pushed-down filters, so Spark would not share one
    exchange and would run the rows' whole pipeline once per branch.
    """
    from rampart.session import write_table
    return write_table(rows.select(col).where(F.col(col).isNotNull()).distinct(), "addresses")


def exclude_whitelisted(rows: DataFrame, whitelist: DataFrame, col: str = ADDR) -> DataFrame:
    """Drop rows whose address is whitelisted (two passes over the rows:
    their distinct addresses, then the anti join).  The whitelisted set is
    written out so that the join sees a plain shuffle on both sides and AQE
    can split a hot address's rows, or broadcast the set."""
    from rampart.session import write_table
    hits = write_table(whitelisted(_distinct_addresses(rows, col), whitelist, col), "whitelisted")
    return rows.join(hits, on=col, how="left_anti")


def outside_whitelist(rows: DataFrame, whitelist: DataFrame, col: str = ADDR, entry_col: str = "entry") -> DataFrame:
    """J3 row by row, for streams: an anti join with the exact entries and one
    with the networks of each prefix length in use (at most 33, collected)."""
    nets = whitelist_networks(whitelist, entry_col)
    lengths = sorted(r[0] for r in nets.where(F.col("plen").isNotNull()).select("plen").distinct().collect())
    out = rows.join(nets.select(F.col("entry").alias(col)).distinct(), on=col, how="left_anti")
    for n in lengths:
        own = F.shiftrightunsigned(ipv4_to_long(F.col(col)), 32 - n)
        of_length = nets.where(F.col("plen") == n).select(F.col("net").alias("_net")).distinct()
        out = out.withColumn("_net", own).join(of_length, on="_net", how="left_anti").drop("_net")
    return out


def refresh_blocklist(classified: DataFrame, blocked: DataFrame, whitelist: DataFrame | None = None,
                      critical_only: bool = False, col: str = ADDR) -> DataFrame:
    """B1: addresses to append to the block list this round.

    The rows are reduced to their distinct addresses first; the whitelist
    and the block list then only touch that small set.
    """
    rows = classified.where(F.col("critical_alert")) if critical_only else classified
    cand = _distinct_addresses(rows, col)
    if whitelist is not None:
        cand = cand.join(whitelisted(cand, whitelist, col), on=col, how="left_anti")
    return cand.join(blocked.select(col), on=col, how="left_anti")


def rate_ban(rows: DataFrame, failure: Column | None = None, findtime: int = FINDTIME_SEC,
             maxretry: int = MAXRETRY, ts: str = "TimeLocal", col: str = ADDR) -> DataFrame:
    """B2: addresses with ``maxretry`` failures within ``findtime`` seconds.

    Returns ``(RemoteAddress, ban_time)`` with the first moment the count of
    failures in ``[t - findtime, t]`` reaches ``maxretry``; the ban never
    expires.  Failures are first counted per (address, second) with a
    partial aggregate, so a hot address is at most one row per second.  The
    sliding count then runs per (address, findtime bucket), with the previous
    bucket's rows copied in as context: no window partition spans more than
    two buckets, however long a hot address stays active.
    """
    bans = first_bans(failures_per_second(rows, failure, ts, col), findtime, maxretry, col)
    return bans.select(col, F.timestamp_seconds("ban_sec").cast("timestamp_ntz").alias("ban_time"))


def failures_per_second(rows: DataFrame, failure: Column | None, ts: str = "TimeLocal", col: str = ADDR) -> DataFrame:
    """``(address, sec, n)``: failures of each address in each second."""
    f = rows if failure is None else rows.where(failure)
    sec = F.unix_timestamp(F.col(ts).cast("timestamp"))
    return (f.where(F.col(col).isNotNull() & F.col(ts).isNotNull())
            .groupBy(col, sec.alias("sec")).agg(F.count(F.lit(1)).alias("n")))


def first_bans(per_sec: DataFrame, findtime: int, maxretry: int, col: str = ADDR, parts: int | None = None) -> DataFrame:
    """``(address, ban_sec)``: the first second whose window of ``findtime``
    holds ``maxretry`` of the counted failures.

    ``parts`` is the number of tasks that share the (address, bucket) windows;
    without it the planner takes one.  An input dealt by address would
    otherwise keep all buckets of its addresses in their tasks.
    """
    b = F.floor(F.col("sec") / findtime)
    # each per-second row goes to its own bucket and, as context, to the next
    copies = F.array(F.struct(b.alias("b"), F.lit(True).alias("own")),
                     F.struct((b + 1).alias("b"), F.lit(False).alias("own")))
    both = per_sec.select(col, "sec", "n", F.inline(copies))
    if parts:
        both = both.repartition(parts, col, "b")
    w = Window.partitionBy(col, "b").orderBy("sec").rangeBetween(-findtime, 0)
    counted = both.withColumn("cnt", F.sum("n").over(w))
    return counted.where(F.col("own") & (F.col("cnt") >= maxretry)).groupBy(col).agg(F.min("sec").alias("ban_sec"))


def ban_times(bans: DataFrame, col: str = ADDR) -> DataFrame:
    """``(address, ban_time)``: the least ``ban_sec`` of each address."""
    return bans.groupBy(col).agg(F.timestamp_seconds(F.min("ban_sec")).cast("timestamp_ntz").alias("ban_time"))


def failed_request(status: str = "Status") -> Column:
    """A request answered with a 4xx or 5xx status."""
    return F.col(status).rlike("^[45]")
