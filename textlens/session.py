"""Session construction and the shared scratch location.

Library code never creates a session on its own; callers pass one in.
``get_session`` is a convenience for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "textlens", **conf) -> SparkSession:
    """Local session with settings sized for ``local[N]`` runs."""
    master = master or os.environ.get("TEXTLENS_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**_LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed)
    folder and is used as is.  A fresh local folder is created only when
    neither it nor a context checkpoint folder is set and the master is a
    single local JVM (tests, local runs); on any other master its absence is
    an error, because executors would write to disks of their own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="textlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used for small aggregated tables that several branches of a plan read,
    so the expensive input is not recomputed per branch; a reliable
    checkpoint survives executor loss (unlike a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    # A reliable checkpoint writes in a second job; persisting first keeps
    # that job from recomputing the plan.  Disk only: the copy can be large
    # and is dropped right after the checkpoint is written.
    cached = df.persist(StorageLevel.DISK_ONLY)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/textlens-{name}-{uuid.uuid4().hex}"
