"""SparkSession construction and cluster-wide settings.

On a cluster the session already exists and its configuration comes from the
deployment; ``get_spark`` only fills in settings that are unset, so local
tests get sane defaults without overriding a production conf.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults applied only where the running session has no value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one for tests if needed."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_defaults(active)
        return active
    builder = (
        SparkSession.builder.master(master or os.environ.get("VIGIL_MASTER", "local[8]"))
        .appName("vigil")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        # local runs only: a cluster names its own shared folder
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vigil-ckpt-", dir="/tmp"))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    # Event-time arithmetic (epoch micros of naive timestamps, day buckets,
    # rendered ISO times) is defined in UTC; the session zone always has a
    # value (the JVM default), so it is pinned explicitly.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    find_package(spark)


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Workers that have it installed, or get it with ``--py-files``, need no such path.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to shared storage, and it is an error if
    it has not; a local session (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder for intermediate tables")
        # unset in a local session, as in tests: take a fresh scratch folder
        current = tempfile.mkdtemp(prefix="vigil-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current
