"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "palaver", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on.

    Adaptive execution sizes shuffle partitions at run time, turns a join whose
    build side proves small into a broadcast, and splits oversized join
    partitions.  Nothing here fixes a partition count or a machine path: those
    belong to the cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # First-n-per-key is cut before the shuffle for n up to this.
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
        .config("spark.sql.session.timeZone", "UTC")
        # Without call-site capture, building an expression takes one call instead of several.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  A session that names none gets one
    below its warehouse, which driver and executors share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
