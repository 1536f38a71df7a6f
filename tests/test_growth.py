"""Steps whose cost a row must not grow: what is computed once stays so, and clipping boxes gives what clipping polygons does."""

import itertools

from pyspark.sql import functions as F

from pixelquarry.functions import geometry as g
from pixelquarry.functions import text as tx
from pixelquarry.operators import annotations as an
from pixelquarry.operators import masks
from pixelquarry.operators import predictions as pr


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_circles_have_constant_angles(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [4.0, 6.0]],)], g.POINTS.replace("array", "p array", 1)).select(g.circle_polygon(F.col("p")).alias("c"))
    assert "cos(" not in plan_of(df)
    c = df.first()["c"]
    assert len(c) == 32 and c[0] == [6.0, 2.0] and all(abs((x - 1) ** 2 + (y - 2) ** 2 - 25) < 1e-9 for x, y in c)


def test_boxes_are_cut_as_polygons_are(spark):
    spots = [(-5.0, 3.0), (0.0, 10.0), (2.0, 2.0), (4.0, 30.0), (10.0, 12.0), (-3.0, 0.0)]
    rows = [(float(a), float(c), float(b), float(d)) for (a, b), (c, d) in itertools.product(spots, spots)]
    df = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double").withColumn("points", g.rectangle(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
    window = tuple(F.lit(v) for v in (0.0, 1.0, 10.0, 9.0))
    df = df.where("x1 >= 0 AND x0 <= 10 AND y1 >= 1 AND y0 <= 9")
    got = df.select(g.is_upright(F.col("points")).alias("upright"), g.clip_upright(g.bounds(F.col("points")), *window).alias("a"), g.clip_polygon(F.col("points"), *window).alias("b")).collect()
    assert len(got) > 10 and all(r["upright"] and r["a"] == r["b"] for r in got)


def test_pyramids_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(an, "PYRAMIDS", 10)
    images = spark.range(400).selectExpr("id AS image", "300L AS width", "200L AS height").coalesce(1)
    assert an.pyramid(images).rdd.getNumPartitions() >= 40


def test_hash_by_batches(spark):
    texts = ["", "a", "foobar", "é𝄞x", None, "a" * 300]

    def plain(t):
        h, b = 2166136261, t.encode("utf-16-le")
        for i in range(0, len(b), 2):
            h = (h ^ int.from_bytes(b[i : i + 2], "little")) * 16777619 & 0xFFFFFFFF
        return h

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fnv1a(F.col("t")).alias("h"))
    assert [r["h"] for r in df.collect()] == [None if t is None else plain(t) for t in texts]
    assert "lambdafunction" not in plan_of(df)


def test_turned_boxes_are_cut_once(spark, monkeypatch):
    seen = []
    decided = pr._decided
    monkeypatch.setattr(pr, "_decided", lambda ids, pairs: seen.append(plan_of(pairs)) or decided(ids, pairs))
    rows = [("i", "a", k, 1.0 - k / 10, 5.0 + k, 5.0, 10.0, 10.0, 0.3 * k) for k in range(4)]
    kept = pr.suppress_rotated(spark.createDataFrame(rows, "image string, label string, idx long, score double, cx double, cy double, w double, h double, angle double"), 0.3)
    assert [r["idx"] for r in kept.collect()] == [0] and seen[0].count("aggregate(transform(poly_b") == 1


def test_bands_keep_their_runs(spark):
    runs = spark.range(300).selectExpr("id % 100 AS image", "id AS run", "id DIV 100 AS y", "0L AS x0", "3L AS x1")
    assert {"y", "x0", "x1"} <= set(masks.labelled(runs, 64).columns)
