"""Hits of points among the shapes of their images: dealt once, and the same below and above the size of a dense image."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelquarry.functions import geometry as g
from pixelquarry.operators import annotations as an
from pixelquarry.registry import queries

SF = "/root/testdata/sf0.001"


def drawn(spark):
    """Upright boxes, turned ones, triangles, boxes without a side or an area, points in any order, none; two images of many
    shapes, one that has no name."""
    rng, rows = random.Random(5), []
    for image, n in (("a", 3), ("b", 40), ("c", 1), ("d", 25), (None, 4)):
        for k in range(n):
            x, y, w, h = rng.randrange(200), rng.randrange(200), rng.randrange(0, 160, 8), rng.randrange(0, 160, 8)
            box = [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
            shapes = [box, box, box[::-1], [[x, y], [x + w, y + h], [x - h, y + w]], [[x, y], [x + 30, y + 20], [x + 10, y + 50], [x - 20, y + 30]], None]
            points = shapes[k % 6] and [[float(v) for v in p] for p in shapes[k % 6]]
            rows.append((image, k, points, float(x + rng.randrange(-8, 60)), float(y + rng.randrange(-8, 60))))
    return spark.createDataFrame(rows, "image string, idx long, points array<array<double>>, x double, y double")


def plainly(rows):
    """Every point with every shape of its image."""
    points = rows.select("image", F.col("idx").alias("point_id"), "x", "y")
    met = points.join(rows.where("points IS NOT NULL").select("image", "idx", "points"), "image")
    p, x, y = F.col("points"), F.col("x"), F.col("y")
    met = met.withColumn("distance", g.edge_distance(p, x, y)).withColumn("on_edge", F.col("distance") <= 4).withColumn("area", g.area(p))
    met = met.where(F.col("on_edge") | g.in_polygon(p, x, y))
    order = Window.partitionBy("image", "point_id").orderBy(F.desc("on_edge"), F.when(F.col("on_edge"), F.col("distance")), "area", "distance", F.desc("idx"))
    return met.withColumn("rank", F.row_number().over(order))


def sorted_rows(found):
    columns = ("image", "point_id", "idx", "on_edge", "distance", "area", "rank")
    return sorted([v if not isinstance(v, float) else round(v, 6) for v in r] for r in found.select(*columns).collect())


@pytest.mark.parametrize("dense", [0, 10, 1000])
def test_hits_below_and_above_dense(spark, dense):
    rows = drawn(spark)
    want = sorted_rows(plainly(rows))
    assert len(want) > 100 and sorted_rows(an.hits_among(rows, dense=dense)) == want
    points = rows.select("image", F.col("idx").alias("point_id"), "x", "y")
    assert sorted_rows(an.hits(points, rows.select("image", "idx", "points"))) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_line_items_are_dealt_once(spark):
    plan = queries()["j17_hits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
