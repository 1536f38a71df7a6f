"""Scratch tables and the given tables, as the operators of this package read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir, stored

__all__ = ["ARROW_ROWS", "documents", "numbered", "parts", "renamed", "shared_dir", "stored"]

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A given table.  Rows of long texts go to Python 2,000 at a time, unless the session says otherwise."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(docs: DataFrame, *without: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns called c0, c1, ..., so that no name of an operator's own clashes with one, and the names.
    Columns named like one in ``without`` are left out."""
    names = [c for c in docs.columns if c.lower() not in without]
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))), names


def renamed(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns of ``numbered`` under their names again, and ``more``."""
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *more)


def parts(spark: SparkSession, factor: int = 1) -> int:
    """Shuffle partitions as the session has them, times ``factor``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor
