"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all tasks run
    on this machine (local tests), a temporary folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = getattr(_base, "_own", None) or tempfile.mkdtemp(prefix="vellumgrid-")
        _base._own = base
    return base.rstrip("/")


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: columns, compressed."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a few large files dealt to all cores; a table of many files as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
