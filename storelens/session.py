"""Session construction and the few session settings the operators rely on."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every operator assumes.  They are runtime SQL confs, so they can be
# applied to a session somebody else built (the driver, a notebook, a job).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SESSION_CONF`` to an existing session (idempotent)."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_spark(master: str | None = None, app: str = "storelens",
              shuffle_partitions: int | None = None,
              extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster ``master`` stays None so spark-submit decides.  The shuffle
    partition count defaults to Spark's own; AQE coalesces small partitions
    at runtime, so a large static value is safe at scale.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if driver_memory:
        # Only meaningful for local mode, where the driver JVM runs the tasks.
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@contextmanager
def set_for(spark: SparkSession, key: str, value):
    """A session setting for the statements of a ``with`` block only."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and streaming state.

    The cluster names it in ``spark.checkpoint.dir``; we only pick our own
    folder when the setting is absent *and* the master is local (tests).
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            # executors on other machines could not see a local folder
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="storelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint dir for one written table/stream."""
    import uuid
    base = checkpoint_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"



def materialize(df, name: str, compression: str | None = None):
    """Write ``df`` under the shared checkpoint dir and read it back.

    Cuts the lineage (a lost executor recomputes from the written files, not
    from the sources) and lets several outputs share one computation.
    Uses the cluster's ``spark.checkpoint.dir``; never a machine-local folder
    unless the session has none (tests).  ``compression``: a Parquet codec
    instead of the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)
