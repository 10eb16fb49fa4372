"""What the operators of this subpackage share: paths, sizes, written tables."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define a word: ``[^\x20\x09-\x0D]+``.
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a session of one process uses a folder below its warehouse; on a cluster
    that is an error, as a folder that executors don't share would lose files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/llm-work"
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def work_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, group_bytes: int | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again.

    Cuts the lineage in a form that outlives any executor; columns that are not
    needed later are pruned when it is read. group_bytes: the size of row groups, for
    wide rows, of which a task that writes or reads holds a group.
    """
    spark = df.sparkSession
    path = work_path(spark, what)
    schema = df.schema
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return spark.read.schema(schema).parquet(path)


def tidy() -> None:
    """Called at the end of a task in a Python worker: hands memory that is no longer used back,
    as workers outlive their tasks and stand beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def plan_bytes(df: DataFrame, column: str) -> float:
    """About the bytes of df as Parquet: for a plain scan the size of its files, without a job;
    else, where Catalyst only multiplies bounds, from one aggregation of the column's lengths."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if plan.collectLeaves().size() == 1 and size < 1 << 50:
        return size
    return 0.6 * (df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def shards_for(df: DataFrame, megabytes: float, column: str = "text") -> int:
    """So many partitions that each holds about so many MB of df as Parquet."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return max(least, math.ceil(plan_bytes(df, column) / (megabytes * 1e6)))


def words(text: Column) -> Column:
    """Words of a text (null: none) as an array, by JVM operations only."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def unlike(names: list[str], start: str = "own") -> str:
    """A column name that none of names is, in whatever case."""
    taken = {n.lower() for n in names}
    while start in taken:
        start += "_"
    return start


def prefer_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_hash() -> Column:
    """64 bits of a text; null and empty are alike."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
