import math

import pytest
from pyspark.sql import functions as F

from pixelquarry.functions import geometry as g
from pixelquarry.operators import annotations as an
from pixelquarry.operators import predictions as pr

SHAPE = "image string, idx long, label string, shape_type string, points array<array<double>>"


def rect(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]


def shapes(spark, *rows):
    return spark.createDataFrame([("i", k, "a", t, [list(map(float, p)) for p in pts]) for k, (t, pts) in enumerate(rows)], SHAPE)


def points_of(df):
    return [(r["shape_type"], [[round(v, 6) for v in p] for p in r["points"]]) for r in df.orderBy("idx").collect()]


def test_crop_resize_flip_and_affine(spark):
    df = shapes(spark, ("rectangle", rect(20, 10, 40, 20)))
    cropped = an.clip(df, F.lit(10), F.lit(5), F.lit(80), F.lit(40))
    kind, points = g.resize_shape(F.col("shape_type"), F.col("points"), F.lit(0.5), F.lit(0.5))
    small = cropped.withColumn("points", points).withColumn("points", g.flip(F.col("points"), F.lit(40), F.lit(20), True))
    assert points_of(small) == [("rectangle", [[35, 2.5], [25, 2.5], [25, 7.5], [35, 7.5]])]
    m = g.compose(g.compose(g.affine(1, 0, 0, 1, -10, -5), g.affine(0.5, 0, 0, 0.5, 0, 0)), g.affine(-1, 0, 0, 1, 40, 0))
    row = df.select(m.alias("m")).select("m", g.inverse(F.col("m")).alias("n"), g.inverse(g.affine(1, 2, 2, 4, 0, 0)).alias("flat")).first()
    assert tuple(row["m"]) == (-0.5, 0, 0, 0.5, 45, -2.5) and [v + 0 for v in row["n"]] == [-2, 0, 0, 2, 90, 5] and row["flat"] is None


def test_clip(spark):
    df = shapes(spark, ("rectangle", rect(5, 15, 30, 35)), ("rectangle", rect(0, 0, 5, 5)), ("line", [[0, 25], [50, 25]]), ("point", [[9, 9]]), ("circle", [[20, 20], [60, 20]]))
    got = points_of(an.clip(df, F.lit(10), F.lit(10), F.lit(40), F.lit(30)))
    assert got[0][0] == "polygon" and sorted(got[0][1]) == sorted([[0, 5], [20, 5], [20, 25], [0, 25]])
    assert got[1:] == [("line", [[0, 15], [40, 15]])]


def test_clip_strip(spark):
    df = shapes(spark, ("linestrip", [[-10, 10], [10, 10], [30, 10], [50, 10]]), ("linestrip", [[5, 5], [5, 50], [15, 50], [15, 5]]))
    got = points_of(an.clip(df, F.lit(0), F.lit(0), F.lit(40), F.lit(30)))
    assert got[0] == ("linestrip", [[0, 10], [10, 10], [30, 10], [40, 10]])
    assert sorted(got[1:]) == [("linestrip", [[5, 5], [5, 30]]), ("linestrip", [[15, 30], [15, 5]])]


def test_resize_promotes(spark):
    df = shapes(spark, ("circle", [[50, 50], [60, 50]]), ("rotation", rect(10, 10, 30, 20)))
    kind, points = g.resize_shape(F.col("shape_type"), F.col("points"), F.lit(2.0), F.lit(0.5))
    got = points_of(df.select("image", "idx", "label", kind.alias("shape_type"), points.alias("points")))
    assert got[0][0] == "polygon" and len(got[0][1]) == 32
    assert got[1] == ("polygon", [[20, 5], [60, 5], [60, 10], [20, 10]])


@pytest.mark.parametrize("degrees,want", [(0, [20, 10]), (90, [40, 20]), (180, [80, 40]), (270, [10, 80])])
def test_turn(spark, degrees, want):
    df = shapes(spark, ("point", [[20, 10]]))
    assert df.select(g.turn(F.col("points"), F.lit(100), F.lit(50), degrees)[0]).first()[0] == want


def test_tiles(spark):
    images = spark.createDataFrame([("i", 100, 60)], "image string, width int, height int")
    windows = an.tiles(images, 64, 40, 16, 10)
    assert sorted(tuple(r) for r in windows.select("x", "y", "w", "h").collect()) == [(0, 0, 64, 40), (0, 30, 64, 30), (48, 0, 52, 40), (48, 30, 52, 30)]
    df = shapes(spark, ("rectangle", rect(40, 10, 80, 30)), ("rectangle", rect(90, 45, 99, 59)), ("point", [[95, 55]]))
    got = an.tile_shapes(windows, df).collect()
    first = [r for r in got if (r["x"], r["y"]) == (0, 0)]
    assert [(min(p[0] for p in r["points"]), max(p[0] for p in r["points"])) for r in first] == [(40, 64)]
    assert [r["points"] for r in got if r["shape_type"] == "point" and r["x"] == 48] == [[[47, 25]]]


def test_quality(spark):
    df = shapes(spark, ("rectangle", rect(1, 1, 10, 10)), ("rectangle", rect(1, 1, 10, 10)), ("rectangle", rect(60, 40, 80, 60)), ("polygon", [[1, 1], [2, 2], [3, 3]])).withColumn("width", F.lit(64)).withColumn("height", F.lit(48))
    images = spark.createDataFrame([("i",), ("empty",)], "image string")
    assert {r["issue"]: r["count"] for r in an.quality_counts(an.quality(df), images).collect()} == {"out_of_bounds": 1, "degenerate": 1, "duplicate": 1, "empty_annotation": 1}


def test_pyramid(spark):
    images = spark.createDataFrame([("i", 600, 350), ("one", 1, 1)], "image string, width int, height int")
    got = {(r["image"], r["level"], r["column"], r["row"]): (r["out_w"], r["out_h"]) for r in an.pyramid(images).collect()}
    assert got["i", 10, 2, 1] == (88, 94) and got["i", 9, 1, 0] == (44, 175) and got["i", 0, 0, 0] == (1, 1)
    assert max(k[1] for k in got if k[0] == "i") == 10 and [k for k in got if k[0] == "one"] == [("one", 0, 0, 0)]


def test_suppression_and_letterbox(spark):
    raw = spark.createDataFrame([("i", 0, 320.0, 320.0, 200.0, 100.0, [0.9, 0.1]), ("i", 1, 322.0, 320.0, 200.0, 100.0, [0.8, 0.2]), ("i", 2, 100.0, 100.0, 50.0, 60.0, [0.05, 0.92])], "image string, idx long, cx double, cy double, w double, h double, class_scores array<double>")
    boxes = pr.decode(raw).withColumn("label", F.col("class_index").cast("string")).select("image", "label", "idx", "score", "x0", "y0", "x1", "y1")
    kept = pr.suppress(boxes).withColumns({"s": F.lit(0.5), "px": F.lit(0.0), "py": F.lit(160.0), "ow": F.lit(1280), "oh": F.lit(640)})
    rows = pr.letterbox_restore(kept, "s", "px", "py", "ow", "oh").orderBy("idx").collect()
    assert [r["idx"] for r in rows] == [0, 2] and (rows[0]["x0"], rows[0]["y0"]) == (440, 220)


def test_rotated_suppression(spark):
    rows = [("i", "a", 0, 0.9, 50.0, 50.0, 80.0, 8.0, math.pi / 4), ("i", "a", 1, 0.8, 50.0, 50.0, 80.0, 8.0, -math.pi / 4), ("i", "a", 2, 0.7, 51.0, 51.0, 80.0, 8.0, math.pi / 4)]
    df = spark.createDataFrame(rows, "image string, label string, idx long, score double, cx double, cy double, w double, h double, angle double")
    assert sorted(r["idx"] for r in pr.suppress_rotated(df).collect()) == [0, 1]
    two = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 2.0, 0.0)], "ax double, ay double, bx double, by double, s double, t double")
    two = two.select(pr.corners("ax", "ay", "s", "s", "t").alias("a"), pr.corners("bx", "by", "s", "s", "t").alias("b")).withColumn("both", pr.convex_intersection("a", "b"))
    assert abs(two.select(pr.polygon_area("both")).first()[0] - 2) < 1e-9


def test_mask_parts(spark):
    art = ["##..#", ".#..#", ".###.", ".....", "#.#.#"]
    runs = [("m", y, x, x) for y, line in enumerate(art) for x, c in enumerate(line) if c == "#"]
    df = spark.createDataFrame(runs, "image string, y long, x0 long, x1 long")
    joined = df.selectExpr("image", "y", "x0", "x1")
    got = sorted(r["area"] for r in pr.mask_components(joined).collect())
    assert sum(got) == len(runs)
    solid = spark.createDataFrame([("m", 0, 0, 1), ("m", 0, 4, 4), ("m", 1, 1, 1), ("m", 1, 4, 4), ("m", 2, 1, 3), ("m", 4, 0, 0)], "image string, y long, x0 long, x1 long")
    parts = pr.largest(pr.mask_components(solid), 2).orderBy("rank").collect()
    assert [(r["area"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in parts] == [(6, 0, 0, 3, 2), (2, 4, 0, 4, 1)]
