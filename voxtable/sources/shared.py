"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without one the warehouse, or on a single machine a new temporary folder."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    key = spark.sparkContext.applicationId
    if key not in _local:
        _local[key] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local[key]


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared one that is not there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
