"""Spark session and shared-storage helpers.

The library never creates machine-local scratch space on a cluster: lineage is
cut by writing to the folder named by ``spark.checkpoint.dir``. Only when that
setting is absent and Spark runs in one process (tests) is a fresh ``/tmp`` folder set.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "retrieva", extra: dict | None = None) -> SparkSession:
    """Session with AQE (runtime re-planning and skew-join splitting) on."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    Set a private ``/tmp`` folder only when the session names none and driver and
    executors are one process (tests); a cluster without the setting is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="retrieva-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back (cuts lineage, survives
    executor loss: the re-read table does not depend on lost shuffle files)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


MAX_SENT_ROWS = 200_000  # rows that a join sends to all tasks, counted first


def sent_if_small(df: DataFrame, name: str, rows: int = MAX_SENT_ROWS) -> tuple[DataFrame, bool]:
    """``df`` written, and whether it has at most ``rows`` rows, so that a join may send it to all tasks."""
    df = materialize(df, name)
    return df, df.limit(rows + 1).count() <= rows


def shared_fs(path: str):
    """(Arrow file system, path in it) of a path or URI, for tasks that write single files to shared storage."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = path[len("file:"):]
        path = "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (tokenising, scoring) all task slots.

    A large input arrives in many file splits and is left alone. An input with
    fewer splits than the cluster has cores is spread round-robin first, and so is one
    of few files, whose splits may hold no row group of their own."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits < target or (splits < 4 * target and len(df.inputFiles()) < target):
        return df.repartition(target)
    return df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in executor Python workers (pandas UDFs
    pickle functions by module reference): zip it once per SparkContext and
    register it with ``addPyFile``, Spark's own distribution mechanism."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="retrieva-pyfiles-"), "retrieva.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    atexit.register(shutil.rmtree, os.path.dirname(zpath), ignore_errors=True)  # Spark serves it till the end
    _SHIPPED.add(sc.applicationId)
