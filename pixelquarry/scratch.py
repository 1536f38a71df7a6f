"""Folders that every executor sees, tables that cut lineage there, and positions of sorted rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``).  Where that is unset, a temporary one serves a local
    session; a cluster session must set it, as its executors do not see the driver's disk."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs start from the files.  The tables of an
    application are in one folder of its name, to be removed when its results are no longer read."""
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """``ordered`` (a sorted frame) with each row's position from 0.  Spark sorts by ranges; rows are counted within their
    range, and the sizes of the ranges (one number a task) add up on the driver, so no task sees all rows."""
    placed = stored(ordered.withColumn("_id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_id", 33).alias("_part")
    sizes = dict(placed.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    begins = ordered.sparkSession.createDataFrame(starts, "_part long, _begin long")
    out = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return out.withColumn(name, F.col("_begin") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_begin")
