"""Revisions of the index: a folder for each, a manifest that names them, and walks that stay on the one they began with.

A revision of a data set is written to a folder of its own and only then named by one row of the manifest, one file that
appears at once: a reader sees the old revision or the new one, whole.  Nothing is overwritten, so a walk that was
opened before goes on in its folder; it is stale from then on.  Old folders go when no reader has said to be in them.
One writer at a time writes a data set; of two that give a revision the same number the later one counts."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import keyset_page

MANIFEST = "dataset_id string, revision long, folder string, items long, event string, at timestamp"


class Snapshot(NamedTuple):
    """One revision of a data set: what a walk is bound to."""

    dataset_id: str
    revision: int
    folder: str


def create(spark: SparkSession, root: str) -> None:
    """An index without data sets."""
    spark.createDataFrame([], MANIFEST).write.parquet(f"{root}/manifest")


def _log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _note(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    noted = spark.createDataFrame(rows, "dataset_id string, revision long, folder string, items long, event string")
    noted.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def revisions(spark: SparkSession, root: str) -> DataFrame:
    """The revisions that are there: dataset_id, revision, folder, items, at."""
    log = _log(spark, root)
    written = log.where("event = 'written'").drop("event")
    return written.join(log.where("event = 'removed'").select("folder"), "folder", "left_anti")


def current(spark: SparkSession, root: str, dataset_id: str) -> Snapshot | None:
    """The newest revision of a data set; None if there is none, or if it was unregistered."""
    log = _log(spark, root).where(F.col("dataset_id") == dataset_id).where("event IN ('written', 'unregistered')")
    row = log.agg(F.max_by(F.struct("revision", "folder", "event"), F.struct("revision", "at")).alias("r")).first()["r"]
    return Snapshot(dataset_id, row["revision"], row["folder"]) if row and row["event"] == "written" else None


def write(assets: DataFrame, root: str, dataset_id: str) -> Snapshot:
    """``assets`` as the next revision of a data set; ``assets`` may come from an older one."""
    spark = assets.sparkSession
    last = _log(spark, root).where(F.col("dataset_id") == dataset_id).agg(F.max("revision")).first()[0]
    revision = (last or 0) + 1
    folder = f"revisions/{uuid.uuid4().hex}"
    assets.withColumn("index_revision", F.lit(revision).cast("long")).write.parquet(f"{root}/{folder}")
    items = spark.read.parquet(f"{root}/{folder}").count()  # Parquet footers only
    _note(spark, root, [(dataset_id, revision, folder, items, "written")])
    return Snapshot(dataset_id, revision, folder)


def unregister(spark: SparkSession, root: str, dataset_id: str) -> None:
    """The data set has no revision any more; walks that are open go on, source files stay."""
    at = current(spark, root, dataset_id)
    if at:
        _note(spark, root, [(dataset_id, at.revision + 1, None, 0, "unregistered")])


def read(spark: SparkSession, root: str, at: Snapshot) -> DataFrame:
    """The assets of one revision, whatever was written since."""
    return spark.read.parquet(f"{root}/{at.folder}")


def is_stale(spark: SparkSession, root: str, at: Snapshot) -> bool:
    """Whether the data set has a newer revision, or is gone."""
    return current(spark, root, at.dataset_id) != at


def page(spark: SparkSession, root: str, at: Snapshot, limit: int, last: tuple[bool, str, str] | None = None, total: int | None = None, where: Column | None = None) -> DataFrame:
    """A keyset page of a walk, from the revision it is bound to, with whether that one is ``stale`` by now."""
    rows = read(spark, root, at)
    found = keyset_page(rows if where is None else rows.where(where), limit, last, total)
    return found.withColumn("stale", F.lit(is_stale(spark, root, at)))


def enter(spark: SparkSession, root: str, at: Snapshot, reader: str) -> None:
    """A reader is in a revision: its folder stays until all readers have left it."""
    _note(spark, root, [(at.dataset_id, at.revision, at.folder, None, f"entered by {reader}")])


def leave(spark: SparkSession, root: str, at: Snapshot, reader: str) -> None:
    _note(spark, root, [(at.dataset_id, at.revision, at.folder, None, f"left by {reader}")])


def remove_unread(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove the folders of all but the ``keep`` newest revisions of each data set (all of one that was unregistered) that no
    reader is in, and name them.  The manifest has each as removed before its files go."""
    log = _log(spark, root)
    readers = log.where("event LIKE 'entered by %' OR event LIKE 'left by %'").select("folder", F.when(F.col("event").startswith("entered"), 1).otherwise(-1).alias("n"))
    read_now = readers.groupBy("folder").agg(F.sum("n").alias("n")).where("n > 0").select("folder")
    gone = log.where("event = 'unregistered'").groupBy("dataset_id").agg(F.max("revision").alias("gone"))
    newer = revisions(spark, root).alias("a").join(revisions(spark, root).select("dataset_id", F.col("revision").alias("other")).distinct(), "dataset_id").where("other >= revision")
    ranked = newer.groupBy("dataset_id", "revision", "folder").agg(F.count("*").alias("rank")).join(gone, "dataset_id", "left")
    old = ranked.where((F.col("rank") > keep) | (F.col("revision") < F.col("gone"))).join(read_now, "folder", "left_anti")
    rows = [(r["dataset_id"], r["revision"], r["folder"], None, "removed") for r in old.select("dataset_id", "revision", "folder").collect()]  # one each revision
    if rows:
        _note(spark, root, rows)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for _, _, folder, _, _ in rows:
        path = hadoop.Path(f"{root}/{folder}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return [r[2] for r in rows]
