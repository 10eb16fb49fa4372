"""The folder that driver and executors share, for files that a job leaves for another."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own below ``spark.checkpoint.dir``; where that is unset, a session of one process uses its
    warehouse, and on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/raster-work"
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """A path of new_path() as processes open it; only of folders that are mounted, so file: or no scheme."""
    bare = re.sub(r"^file:/*", "/", path)
    if re.match(r"^[a-z0-9+.-]+:", bare):
        raise ValueError(f"{path} is not a mounted folder")
    return bare
