"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every rampart job relies on.  The time zone is pinned because the
# log times are wall-clock times without a zone (TIMESTAMP_NTZ); parsing them
# through a zoned type in UTC never shifts them across a DST gap.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of data no longer referenced are removed by Spark
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rampart", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with rampart's settings.

    On a cluster ``master`` stays ``None`` so that spark-submit decides; the
    shuffle partition count should then be sized to the input (roughly input
    bytes / 128 MB), and AQE coalesces what turns out to be small.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    # Session-level settings also apply when the session already existed.
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.execution.arrow.pyspark.enabled"):
        spark.conf.set(k, conf[k])
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir).  Only a local session without one gets a private folder
    under the system temp dir, as tests do; a cluster without the setting is
    an error, because a machine-local folder would not survive the loss of
    that machine.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="rampart-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/rampart-{sc.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(drop_scratch, spark)
    return f"{root}/{name or 'work'}-{uuid.uuid4().hex[:12]}"


_SCRATCH: set = set()


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables and folders that this application's operators wrote
    under the shared folder; frames that still read them end here.

    Called when the driver's Python ends, and by a long-running application
    between jobs.  A driver that is killed leaves its ``rampart-<application
    id>`` folder behind, which names what to delete.
    """
    sc = spark.sparkContext
    if sc._jsc is None:                  # the context has stopped
        return
    for root in list(_SCRATCH):
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _SCRATCH.discard(root)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``df.checkpoint()`` has a reliable folder; return it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared_dir(spark)
    return sc.getCheckpointDir()


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme so that local tests can use ``os`` calls."""
    if uri.startswith("file:"):
        uri = uri[5:]
        while uri.startswith("//"):
            uri = uri[1:]
    return os.path.abspath(uri)


def checkpoint(df):
    """Eager reliable checkpoint into the shared folder.

    The result's lineage starts at the written files, so a lost executor
    re-reads them instead of recomputing the plan.  (Spark writes an eager
    checkpoint in a single job; no extra persist is needed.)
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rampart`` importable in Python workers (pandas UDFs, grouped
    maps, data sources), once per context.

    The package is zipped and handed to ``addPyFile``, which distributes it
    through Spark's own file server and puts it on every worker's path; the
    zip on the driver is only the source of that copy.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="rampart-pkg-"), "rampart.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def write_table(df, name: str = "table"):
    """Materialize ``df`` as parquet in the shared folder and read it back.

    Like ``checkpoint`` it cuts lineage onto reliable storage, and the
    re-read table has its true file size as statistics, so AQE and size
    checks see the real size (a checkpoint keeps the estimate of the plan
    it came from).  Use ``checkpoint`` where partition order must survive.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a few characters of bookkeeping (a count, a position) to a file of shared storage."""
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """What ``put_text`` wrote, None if there is no such file."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    f = fs.open(p)
    try:
        return bytes(f.readAllBytes()).decode()
    finally:
        f.close()


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def rename_path(spark: SparkSession, old: str, new: str) -> bool:
    """Move a file; false if it is not there."""
    fs, p = _hadoop(spark, old)
    return bool(fs.exists(p) and fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)))


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Paths directly under a folder in name order, without hidden ones; empty if it is absent."""
    fs, p = _hadoop(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(names) if not n.startswith(("_", "."))]
