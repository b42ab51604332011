"""Session construction and the shared folder used for checkpoints / versions."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

# Settings that every job here relies on.  Shuffle partition count is a
# starting point only: AQE coalesces small partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "inboxlake",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (DFS / object store)
    folder and is used as is.  Only when it is unset (local runs, tests) do we
    create a private folder and register it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="inboxlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for stream checkpoints, versioned tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts) if "://" not in base else "/".join([base.rstrip("/"), *parts])


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs.

    It does so once the driver's garbage collector has found their plans, which may be half an hour later; until then
    a run of many jobs keeps every shuffle it made.
    """
    gc.collect()  # what Python still refers to
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``inboxlake`` importable on executors (Arrow UDF bodies live in it).

    Zips the package once per driver process and registers it with
    ``addPyFile``; Spark distributes it to every executor.
    """
    sc = spark.sparkContext
    key = id(sc._jsc) if getattr(sc, "_jsc", None) is not None else id(sc)
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="inboxlake-pkg-")
    archive = shutil.make_archive(os.path.join(out, "inboxlake"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="inboxlake")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
