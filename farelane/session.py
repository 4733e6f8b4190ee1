"""Session settings that the plans assume."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "farelane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; conf overrides and adds. The cluster sets master, memory and shuffle partitions."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); on a local master where that is unset, in a temp folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="farelane-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
