"""Spark session construction and cluster-safe helpers.

Everything the library needs from the session lives here: the builder used by
tests and the bench, the checkpoint folder lookup (read from the session, set
only when the session has none), and a parallelism guard for tiny inputs.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows in the corpus are whole files (up to 1 MB); keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # local runs only: the driver JVM is the whole cluster (ignored once a JVM exists)
    "spark.driver.memory": "8g",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "riskloom",
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only a local session (tests) without one gets a folder under /tmp; a
    cluster session without one is an error, because a driver-local folder
    would be invisible to the executors.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    The plan runs once, with the partitions it has: the write itself is the
    only job of an eager checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_plans(spark: SparkSession) -> None:
    """Have the driver's JVM collect plans that are no longer held, and Spark what it kept for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Repartition to the caller's ``partitions``; None leaves the input's splits."""
    return df if partitions is None else df.repartition(partitions)


# Rows handed to a Python worker at once by mapInArrow: rows are whole files
# (up to 1 MB after eligibility), so a batch stays well under a gigabyte.
MAX_ARROW_FILES_PER_BATCH = 256


def bound_arrow_batches(spark: SparkSession, limit: int = MAX_ARROW_FILES_PER_BATCH) -> None:
    """Lower ``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``limit`` if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        current = int(spark.conf.get(key, "10000"))
    except (TypeError, ValueError):
        current = 10000
    if current <= 0 or current > limit:
        spark.conf.set(key, str(limit))


def ship_package_code() -> None:
    """Make functions of this package travel with the tasks that run them.

    The two Python jobs (``mapInArrow``) execute package functions on the
    executors; pickling the package by value means executors need no
    installed copy (the same effect as ``--py-files`` with a zip).
    """
    import sys as _sys

    from pyspark import cloudpickle

    pkg = _sys.modules[__name__.split(".")[0]]
    try:
        cloudpickle.register_pickle_by_value(pkg)
    except ValueError:  # already registered
        pass
