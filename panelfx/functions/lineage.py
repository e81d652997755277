"""Cutting lineage on the folder that driver and executors share; a session whose shuffles follow the size of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_folder(spark, label: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or the warehouse where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder of spark.checkpoint.dir; below the warehouse where that is unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint(eager=True)


def parquet_copy(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder: later scans read the columns they use."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of Parquet files for one shuffle partition: as rows in the memory of a window they are many times as many, and a
#: task has some windows and joins in a row. Small, so that a task has as much at all sizes from some 100 MB on.
SHARE = 2 << 20
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def file_bytes(spark, *paths: str) -> int:
    """The size of the files at these paths; what doesn't exist counts 0."""
    total = 0
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        total += fs.getContentSummary(where).getLength() if fs.exists(where) else 0
    return total


def sized_session(spark, size: int):
    """A session whose shuffles have a partition for each SHARE bytes of an input of `size`, so that a task's rows don't
    grow with it: spark itself where its shuffles have as many, else one with its settings and that number. The caller's
    session stays as it is."""
    parts = -(-size // SHARE)
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return spark
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.shuffle.partitions", str(parts))
    if ADVISED not in spark.conf.getAll:  # what adaptive execution may put together for one task
        own.conf.set(ADVISED, "8m")
    return own
