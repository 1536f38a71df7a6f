import random

from pyspark.sql import functions as F

from pixelquarry.operators import annotations as an
from pixelquarry.operators import grid
from pixelquarry.operators import predictions as pr

BOXES = "image string, idx long, x0 double, y0 double, x1 double, y1 double"


def made_up(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        size = 2.0 ** r.randrange(-6, 9)
        x, y = (r.choice([r.uniform(-300, 300), float(r.randrange(-5, 5) * 64)]) for _ in range(2))
        rows.append((r.choice(["i", "j", None]), i, x, y, x + size * r.choice([0, r.random(), 1]), y + size * r.random()))
    return [*rows, ("i", n, float("nan"), 0.0, 1.0, 1.0), ("i", n + 1, None, 0.0, 1.0, 1.0), ("j", n + 2, -1e9, -1e9, 1e9, 1e9)]


def touch(a, b):
    return a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]


def good(rows):
    return [r for r in rows if r[2] is not None and r[2] == r[2]]


def test_every_pair_once(spark):
    rows = made_up(1, 250)
    df = spark.createDataFrame(rows, BOXES)
    got = [(p["a"]["idx"], p["b"]["idx"]) for p in grid.touching(df, ["image"], "a.idx < b.idx").collect()]
    assert sorted(got) == sorted((a[1], b[1]) for a in good(rows) for b in good(rows) if a[1] < b[1] and touch(a, b))
    other = made_up(2, 120)
    got = [(p["a"]["idx"], p["b"]["idx"]) for p in grid.meeting(df, spark.createDataFrame(other, BOXES), ["image"]).collect()]
    assert sorted(got) == sorted((a[1], b[1]) for a in good(rows) for b in good(other) if touch(a, b))


def test_one_huge_box_does_not_make_cells_larger(spark):
    """50,000 small boxes and one over them all: looked up in a few cells each, never all against all."""
    side = 225
    small = spark.range(side * side).selectExpr("'i' AS image", "'c' AS label", "id AS idx", "0.5D AS score", f"cast(id % {side} AS double) * 2 AS x0", f"cast(id div {side} AS double) * 2 AS y0")
    small = small.selectExpr("*", "x0 + 1.5 AS x1", "y0 + 1.5 AS y1")
    huge = spark.createDataFrame([("i", "c", -1, 0.9, 0.0, 0.0, 2.0 * side, 2.0 * side)], small.schema)
    boxes = small.unionByName(huge)
    placed = grid._placed(boxes.select("image", "idx", "x0", "y0", "x1", "y1"), ["image"], "a")
    looked_up = grid._cells(placed.join(placed.select(F.col("own").alias("level")).distinct(), F.col("level") >= F.col("own")), "a", "level")
    assert looked_up.count() <= 8 * boxes.count()
    assert pr.overlapping_pairs(boxes, 0.0).count() == side * side
    assert pr.suppress(boxes, 0.3).count() == boxes.count() and pr.suppress(boxes, 1e-9).count() == 1


def test_large_groups_agree_with_small_ones(spark):
    r = random.Random(3)
    rows = [(r.choice("ij"), "c", i, r.choice([0.2, 0.5, 0.9]), r.uniform(0, 50), r.uniform(0, 50), r.uniform(0.1, 30), r.uniform(0.1, 30), r.uniform(-3, 3)) for i in range(150)]
    rows += [("i", "c", 200, 0.9, 1.0, 1.0, 0.0, 5.0, 0.0), ("i", "c", 201, 0.9, float("nan"), 1.0, 1.0, 5.0, 0.0)]
    boxes = spark.createDataFrame(rows, "image string, label string, idx long, score double, cx double, cy double, w double, h double, angle double")
    got = [sorted((x["image"], x["idx"]) for x in pr.suppress_rotated(boxes, 0.2, dense=dense).collect()) for dense in (1000, 1)]
    assert got[0] == got[1] and 5 < len(got[0]) < 150
    best = sorted((x["image"], x["idx"]) for x in pr.suppress_rotated(boxes, 0.2, limit=4).collect())
    kept = {(r[0], r[2]): r for r in rows if (r[0], r[2]) in set(got[0])}
    assert best == sorted(k for i in "ij" for k in sorted((k for k in kept if k[0] == i), key=lambda k: (-kept[k][3], k[1]))[:4])


def test_limit_is_per_image_over_all_labels(spark):
    rows = [("i", f"l{i % 3}", i, 1 - i / 10, 100.0 * i, 0.0, 10.0, 10.0, 0.1) for i in range(9)]
    boxes = spark.createDataFrame(rows, "image string, label string, idx long, score double, cx double, cy double, w double, h double, angle double")
    assert sorted(x["idx"] for x in pr.suppress_rotated(boxes, limit=4).collect()) == [0, 1, 2, 3]


def test_tiles_of_an_image_with_many_shapes(spark):
    """Tiles and shapes meet by cell: the plan has no join on the image alone."""
    shapes = spark.range(400).selectExpr("'i' AS image", "id AS idx", "'c' AS label", "'rectangle' AS shape_type", "array(array(id % 20 * 10D, id div 20 * 10D), array(id % 20 * 10D + 8, id div 20 * 10D), array(id % 20 * 10D + 8, id div 20 * 10D + 8), array(id % 20 * 10D, id div 20 * 10D + 8)) AS points")
    windows = an.tiles(spark.createDataFrame([("i", 200, 200)], "image string, width int, height int"), 64, 64)
    out = an.tile_shapes(windows, shapes)
    want = sum(1 for w in windows.collect() for i in range(400) if i % 20 * 10 < w["x"] + w["w"] and i % 20 * 10 + 8 > w["x"] and i // 20 * 10 < w["y"] + w["h"] and i // 20 * 10 + 8 > w["y"])
    assert out.count() == want and out.columns == [*windows.columns, "idx", "label", "shape_type", "points", "tile"]
