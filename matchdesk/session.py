"""Session helpers: a local session for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings this library relies on. On a cluster these come from the
# cluster's own configuration; `local_session` sets them for tests.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
}


def local_session(master: str = "local[8]", app: str = "matchdesk", **conf) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """Shared folder for written tables: the cluster's checkpoint folder.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only when
    neither is set -- local tests -- a fresh scratch folder is created and
    installed as the checkpoint dir so that ``checkpoint()`` works too.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir().rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="matchdesk-", dir=os.environ.get("MATCHDESK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """The configured shared folder itself (``spark.checkpoint.dir``), for
    tables reused across applications; the per-application work folder when
    nothing is configured (local tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return configured.rstrip("/") if configured else work_root(spark)
