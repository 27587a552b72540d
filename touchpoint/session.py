"""Spark session settings the operators assume.

* ``spark.sql.session.timeZone=UTC``: lead and event instants are stored as UTC
  wall-clock values; local (e.g. Jakarta) times are derived explicitly.
* AQE on, with skew-join splitting and runtime broadcast conversion: a side is only
  broadcast when its *measured* shuffle size is under the threshold.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python call-site capture on every DataFrame/Column call (for error context)
    # costs about a third of plan-building time on the driver; jobs do not need it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(
    master: str | None = None,
    app_name: str = "touchpoint",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``master`` is only set when given, so a cluster launcher's choice wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    ``fallback`` is applied only when the setting is unset (tests pass a fresh
    scratch folder); on a cluster the configured shared folder is always used.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if fallback:
        spark.conf.set("spark.checkpoint.dir", fallback)
        spark.sparkContext.setCheckpointDir(fallback)
        return fallback
    return None


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that a job writes and reads again: what the cluster names in
    ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir`` was given. Without
    either, a local session (a test) gets a new scratch folder; on a cluster executors
    would write to disks of their own, so that is an error."""
    folder = checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("no shared folder: set spark.checkpoint.dir")
        folder = checkpoint_dir(spark, tempfile.mkdtemp(prefix="run-ckpt-"))
    return folder.rstrip("/")
