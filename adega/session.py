"""Session construction and the shared scratch location.

Library functions never create a session; callers pass one in.  ``build_session``
is a convenience for scripts, tests and the benchmark: it turns on adaptive query
execution (runtime partition coalescing, skew-join splitting, runtime broadcast
conversion behind Spark's measured-size threshold) and keeps the web UI off.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole web pages travel to Python in Arrow batches: cut a batch at 64 MB as
    # well as at the default 10,000 rows, so large pages do not build huge batches
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def build_session(master: str | None = None, app_name: str = "adega",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the library is tuned for.

    ``master`` is left unset on a cluster, where spark-submit provides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    On a cluster this must name storage every executor can reach, so it is read
    from the session.  Only a local master without one (tests) gets a folder of its
    own, registered as the checkpoint directory; any other master is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    try:
        sc = spark.sparkContext
    except Exception as no_context:  # Spark Connect: nothing says which folder is shared
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from no_context
    if not sc.getCheckpointDir():
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="adega-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def application_id(spark: SparkSession) -> str:
    """Identifies this session: application id plus the session's own id, so two
    sessions of one application (``newSession()``) never share DataFrames."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:
        app = spark.conf.get("spark.app.id", "app")
    try:
        return f"{app}/{spark._jsparkSession.sessionUUID()}"
    except Exception:
        return f"{app}/{id(spark)}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
