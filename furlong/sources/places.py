"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared folder of the session. Where that is unset, one below the warehouse, but only for a local
    session, whose tasks run in the driver's process."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/furlong-{uuid.uuid4().hex}"
