"""Connected parts of masks given as runs, band by band.

A band is ``BAND`` rows of an image and the first row of the band below it.  Within a band runs are joined in one pass over
sorted rows: of the runs that come in, only those of one band are held.  A row that two bands share has a label in each;
those pairs are the only edges that leave a band, so the components that are sought across the table are those of the
seams, a few for each band, and not of all runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import positions, stored
from .components import components

BAND = 64
_LABELS = pa.schema([("image", pa.string()), *((c, pa.int64()) for c in ("run", "y", "x0", "x1", "label")), ("own", pa.bool_()), ("seam", pa.bool_())])
_AT_ONCE = 1 << 15


def join_rows(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For runs sorted by (y, x0, x1): the first run of the part that each is in; runs of neighbouring rows that share a column
    are of one part."""
    n = len(y)
    begin = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if n else np.empty(0, np.int64)
    end = np.append(begin[1:], n)
    from_, to = [], []
    for a, b, c, d in zip(begin[:-1], end[:-1], begin[1:], end[1:], strict=True):
        if y[c] != y[a] + 1:
            continue
        lo = np.searchsorted(np.maximum.accumulate(x1[c:d]), x0[a:b], "left")  # the first that may reach this far
        count = np.maximum(0, np.searchsorted(x0[c:d], x1[a:b], "right") - lo)
        i = np.repeat(np.arange(a, b), count)
        j = c + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        meet = x1[j] >= x0[i]
        from_.append(i[meet])
        to.append(j[meet])
    label = np.arange(n)
    if from_:
        u, v = np.concatenate(from_), np.concatenate(to)
        while len(u):
            a, b = label[u], label[v]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots hook to smaller ones
            while not np.array_equal(label, label[label]):
                label = label[label]
            left = label[u] != label[v]
            u, v = u[left], v[left]
    return label


def labelled(runs: DataFrame, band: int) -> DataFrame:
    """``runs`` (image, run, y, x0, x1) with their label in each band they are in: the least run of their part there.  ``own``
    tells the band that a run counts for, ``seam`` the rows that two bands share.  Small bands leave in common batches."""
    own = F.floor(F.col("y") / band)
    shared = F.pmod(F.col("y"), F.lit(band)) == 0
    bands = F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))).alias("band")
    rows = runs.select(F.col("image").cast("string").alias("image"), "run", "y", "x0", "x1", bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        ready: list[tuple[str, tuple[np.ndarray, ...]]] = []
        waiting = 0

        def done() -> tuple[np.ndarray, ...]:
            t = pa.Table.from_batches(held)
            y, x0, x1, ids = (t.column(c).to_numpy() for c in ("y", "x0", "x1", "run"))
            return ids, y, x0, x1, ids[join_rows(y, x0, x1)], y // band == key[1], y % band == 0

        def sent() -> pa.RecordBatch:
            names = pa.array([k for k, _ in ready], pa.string()).take(pa.array(np.repeat(np.arange(len(ready)), [len(c[0]) for _, c in ready])))
            batch = pa.RecordBatch.from_arrays([names, *(pa.array(np.concatenate(c)) for c in zip(*(c for _, c in ready), strict=True))], schema=_LABELS)
            ready.clear()
            return batch

        for batch in batches:
            image, at = batch.column("image").to_numpy(zero_copy_only=False), batch.column("band").to_numpy()
            if not len(at):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (at[1:] != at[:-1]), [True]]))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if key != (image[lo], at[lo]):
                    if held:
                        ready.append((key[0], done()))
                        waiting += len(ready[-1][1][0])
                    if waiting >= _AT_ONCE:
                        yield sent()
                        waiting = 0
                    held, key = [], (image[lo], at[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            ready.append((key[0], done()))
        if ready:
            yield sent()

    return rows.repartition("image", "band").sortWithinPartitions("image", "band", "y", "x0", "x1").mapInArrow(run, "image string, run long, y long, x0 long, x1 long, label long, own boolean, seam boolean")


def mask_components(runs: DataFrame, least_area: int = 1, band: int = BAND) -> DataFrame:
    """Connected parts of masks given as runs (image, y, x0, x1; ends included): image, component, area and bounds.

    A component is named by its first run's number in its image, in the order of rows.  Runs with a null are left out."""
    kind = runs.schema["image"].dataType
    whole = runs.select("image", *(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1"))).where("image IS NOT NULL AND y IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL")
    placed = positions(whole.orderBy("image", "y", "x0", "x1"), "run")
    found = stored(labelled(placed, band), "bands")
    edges = found.where("seam").groupBy("run").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("a", "b").distinct()
    joined = components(edges)
    sized = found.where("own").groupBy("image", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.min("run").alias("first"))
    named = sized.join(joined, sized["label"] == joined["node"], "left").withColumn("component", F.coalesce("component", "label"))
    parts = named.groupBy("image", "component").agg(F.sum("area").alias("area"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("first").alias("first"))
    first = F.min("first").over(Window.partitionBy("image"))
    numbered = parts.withColumn("component", F.col("component") - first + 1)
    return numbered.select(F.col("image").cast(kind).alias("image"), "component", "area", "x0", "y0", "x1", "y1").where(F.col("area") >= least_area)
