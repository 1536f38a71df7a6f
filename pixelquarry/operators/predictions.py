"""Model outputs as tables: decode, thresholds, suppression, ranks, coordinate restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let, once
from ..scratch import stored
from . import grid
from .masks import mask_components


def sigmoid(x: Column) -> Column:
    """Stable for large values of either sign."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v - top) / temperature))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def probabilities(x: Column) -> Column:
    """Scores that lie in 0..1 and add up to 1 (within 0.001) stay; others go through softmax."""
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.forall(x, lambda v: (v >= 0) & (v <= 1)) & (F.abs(total - 1) <= 1e-3), x).otherwise(softmax(x))


def decode(rows: DataFrame, scores: str = "class_scores", objectness: str | None = None, confidence: float = 0.25) -> DataFrame:
    """Best class (the first of equals) and corners of rows (cx, cy, w, h, class scores) that reach the confidence."""
    best = F.array_max(scores) * (F.col(objectness) if objectness else F.lit(1.0))
    out = rows.withColumn("class_index", (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("int")).withColumn("score", best).where(F.col("score") >= confidence)
    half = lambda c, s, sign: F.col(c) + sign * F.col(s) / 2
    return out.withColumns({"x0": half("cx", "w", -1), "y0": half("cy", "h", -1), "x1": half("cx", "w", 1), "y1": half("cy", "h", 1)})


def letterbox_restore(boxes: DataFrame, scale: str, pad_x: str, pad_y: str, width: str, height: str) -> DataFrame:
    """Corners from the model's padded space to the image, cut at its border."""
    back = lambda v, pad, size: F.least(F.greatest((F.col(v) - F.col(pad)) / F.col(scale), F.lit(0.0)), F.col(size).cast("double"))
    return boxes.withColumns({v: back(v, pad_x if v[0] == "x" else pad_y, width if v[0] == "x" else height) for v in ("x0", "y0", "x1", "y1")})


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes of two aliases."""
    c = lambda t, n: F.col(f"{t}.{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda t: (c(t, "x1") - c(t, "x0")) * (c(t, "y1") - c(t, "y0"))
    return F.coalesce(w * h / F.nullif(area(a) + area(b) - w * h, F.lit(0.0)), F.lit(0.0))


DENSE = 512


def _met(boxes: DataFrame, order: str, dense: int = DENSE) -> DataFrame:
    """Pairs (image, label, a, b: structs) of touching boxes, a before b in ``order``.  Groups up to ``dense`` boxes are
    joined by their keys, larger ones by the grid of sizes."""
    keys = ["image", "label"]
    large = boxes.groupBy(*keys).count().where(F.col("count") > dense).select(*keys)

    def by_keys(rows: DataFrame) -> DataFrame:
        one = rows.select(*keys, F.struct("*").alias("a"))
        touch = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
        return one.join(one.withColumnRenamed("a", "b"), keys).where(f"({order}) AND {touch}")

    if large.isEmpty():
        return by_keys(boxes)
    rest = boxes.join(large, keys, "left_anti")
    return by_keys(rest).unionByName(grid.touching(boxes.join(large, keys, "left_semi"), keys, order).select(*keys, "a", "b"))


def overlapping_pairs(boxes: DataFrame, least: float = 0.0, dense: int = DENSE) -> DataFrame:
    """Pairs of boxes of one image and label that overlap by more than ``least``; bounds are tested before the ratio."""
    met = _met(boxes.select("image", "label", "idx", "x0", "y0", "x1", "y1"), "a.idx < b.idx", dense).withColumn("iou", iou("a", "b")).where(F.col("iou") > least)
    return met.select("image", "label", F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), "iou")


GATHERED = 2048


def _iou_of(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda t: (t["x1"] - t["x0"]) * (t["y1"] - t["y0"])
    return let(w * h, lambda both: F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0.0)), F.lit(0.0)))


def suppress(boxes: DataFrame, most: float = 0.45, gathered: int = GATHERED) -> DataFrame:
    """Class-wise non-maximum suppression: by score, then idx, a box goes if it overlaps a kept one by more than
    ``most``.  A group is one class of one image.  Groups of up to ``gathered`` boxes are lists that are folded; in larger
    ones the overlapping pairs are found by grid cell and decided in rounds, so no group is ever gathered."""
    keys = ["image", "label"]
    large = boxes.groupBy(*keys).count().where(F.col("count") > gathered).select(*keys)
    if large.isEmpty():
        return _folded(boxes, most)
    return _folded(boxes.join(large, keys, "left_anti"), most).unionByName(_in_rounds(boxes.join(large, keys, "left_semi"), most))


def _folded(boxes: DataFrame, most: float) -> DataFrame:
    rest = [c for c in boxes.columns if c not in ("image", "label")]
    box = F.struct((-F.col("score")).alias("_order"), F.col("idx").alias("_idx"), *rest)
    groups = boxes.groupBy("image", "label").agg(F.array_sort(F.collect_list(box)).alias("_b"))
    free = lambda kept, v: ~F.exists(kept, lambda k: _iou_of(k, v) > most)
    fold = F.aggregate(F.slice(F.col("_b"), 2, F.size("_b")), F.slice(F.col("_b"), 1, 1), lambda kept, v: F.when(free(kept, v), F.concat(kept, F.array(v))).otherwise(kept))
    kept = F.when(F.size("_b") == 1, F.col("_b")).otherwise(fold)
    return groups.select("image", "label", F.explode(kept).alias("_k")).select("image", "label", *(F.col(f"_k.{c}").alias(c) for c in rest)).select(*boxes.columns)


BETTER = "a.score > b.score OR a.score = b.score AND (a.idx < b.idx OR a.idx = b.idx AND a._id < b._id)"


def _in_rounds(boxes: DataFrame, most: float) -> DataFrame:
    """The same by pairs: a box is kept once all better ones that overlap it are gone, and goes once one is kept."""
    ids = stored(boxes.withColumn("_id", F.monotonically_increasing_id()), "boxes")
    pairs = grid.touching(ids.select("image", "label", "idx", "score", "x0", "y0", "x1", "y1", "_id"), ["image", "label"], BETTER).where(iou("a", "b") > most)
    return _decided(ids, pairs)


def _decided(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ids`` without those that a kept one of ``pairs`` (a: the better, b) puts out; in rounds over the pairs alone."""
    left = stored(pairs.select(F.col("a._id").alias("a"), F.col("b._id").alias("b")), "pairs")
    gone: DataFrame | None = None
    while not left.isEmpty():  # each round decides at least the best box that is left
        sure = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        fall = stored(left.join(sure, "a").select(F.col("b").alias("_id")).distinct(), "gone")
        gone = fall if gone is None else gone.unionByName(fall)
        down = lambda c: fall.withColumnRenamed("_id", c)  # noqa: B023, E731
        left = stored(left.join(down("a"), "a", "left_anti").join(down("b"), "b", "left_anti"), "pairs")
    kept = ids if gone is None else ids.join(gone, "_id", "left_anti")
    return kept.drop("_id")


def corners(cx: str = "cx", cy: str = "cy", w: str = "w", h: str = "h", angle: str = "angle") -> Column:
    """Corners (x, y) of a box turned about its centre."""
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in _corners(cx, cy, w, h, angle)))


def _corners(cx: str, cy: str, w: str, h: str, angle: str) -> list[tuple[Column, Column]]:
    def corner(dx: int, dy: int) -> tuple[Column, Column]:
        across, down = F.col(w) * (dx / 2), F.col(h) * (dy / 2)
        return F.col(cx) + across * F.cos(angle) - down * F.sin(angle), F.col(cy) + across * F.sin(angle) + down * F.cos(angle)

    return [corner(dx, dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def polygon_area(polygon: str) -> Column:
    """Area of a polygon (array of x, y), whichever way it turns."""
    step = f"transform({polygon}, (p, i) -> p.x * {polygon}[(i + 1) % size({polygon})].y - {polygon}[(i + 1) % size({polygon})].x * p.y)"
    return F.expr(f"abs(aggregate({step}, 0D, (s, v) -> s + v)) / 2")


def convex_intersection(first: str, second: str) -> Column:
    """What two convex polygons share, as a polygon: the first is cut at each edge of the second, a fold over half planes.
    The second has its inside on the left of its edges."""
    edges = f"transform({second}, (p, i) -> named_struct('p', p, 'q', {second}[(i + 1) % size({second})]))"
    side = lambda v: f"(e.q.x - e.p.x) * ({v}.y - e.p.y) - (e.q.y - e.p.y) * ({v}.x - e.p.x)"
    step = f"transform(poly, (p, i) -> named_struct('p', p, 'q', poly[(i + 1) % size(poly)], 's', {side('p')}, 't', {side('poly[(i + 1) % size(poly)]')}))"
    cross = "named_struct('x', r.p.x + r.s / (r.s - r.t) * (r.q.x - r.p.x), 'y', r.p.y + r.s / (r.s - r.t) * (r.q.y - r.p.y))"
    points = f"CASE WHEN r.s >= 0 AND r.s * r.t < 0 THEN array(r.p, {cross}) WHEN r.s >= 0 THEN array(r.p) WHEN r.s * r.t < 0 THEN array({cross}) ELSE filter(array(r.p), z -> false) END"
    return F.expr(f"aggregate({edges}, {first}, (poly, e) -> flatten(transform({step}, r -> {points})))")


def suppress_rotated(boxes: DataFrame, most: float = 0.45, limit: int = 300, dense: int = DENSE) -> DataFrame:
    """The same for turned boxes (cx, cy, w, h, angle), and of what is left the ``limit`` best of each image.

    Bounds first, then the shared area in columns, computed once and only for pairs whose bounds share enough for it;
    pairs beyond ``most`` are decided in rounds.  Boxes without an area or
    with a side that is not finite are left out."""
    finite = " AND ".join(f"abs({c}) < double('Infinity')" for c in ("cx", "cy", "w", "h", "angle", "score"))
    ids = stored(boxes.where(f"{finite} AND w > 0 AND h > 0").withColumn("_id", F.monotonically_increasing_id()), "turned")
    turned = ["cx", "cy", "w", "h", "angle"]
    xs, ys = zip(*_corners(*turned), strict=True)
    ends = {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
    framed = ids.select("image", "label", "idx", "score", "_id", *turned, (F.col("w") * F.col("h")).alias("area"), *(e.alias(n) for n, e in ends.items()))
    met = _met(framed, BETTER, dense)
    room = F.expr("(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))")
    most_shared = F.least(room, F.col("a.area"), F.col("b.area")) * (1 + 1e-6)  # what two polygons share, and room for rounding
    met = met.where(~(most_shared / F.greatest(F.col("a.area") + F.col("b.area") - most_shared, F.lit(1e-12)) <= most))
    for side in "ab":
        met = once(met, f"poly_{side}", corners(*(f"{side}.{c}" for c in turned)))
    met = once(met, "both", convex_intersection("poly_a", "poly_b"))
    shared = F.when(F.size("both") > 2, polygon_area("both")).otherwise(0.0)
    pairs = met.where(let(shared, lambda s: s / F.greatest(F.col("a.area") + F.col("b.area") - s, F.lit(1e-12))) > most)
    kept = _decided(ids, pairs)
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "idx", "label"))
    return kept.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def top_k(rows: DataFrame, k: int, *key: str, least: float | None = None) -> DataFrame:
    """The k best of each key with their rank, score first, then idx."""
    rows = rows.where(F.col("score") >= least) if least is not None else rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "idx"))).where(F.col("rank") <= k)


def top_k_of_classes(rows: DataFrame, scores: str, k: int, *key: str) -> DataFrame:
    """The k best (row, class) of each key; of equal scores the earlier row, then class."""
    flat = rows.select(*key, "idx", F.posexplode(scores).alias("class_index", "score"))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "idx", "class_index")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tags(rows: DataFrame, least: float, deleted: list[str] = (), kept: list[str] | None = None, known: list[str] | None = None) -> DataFrame:
    """Tags that reach the threshold, ranked per image; deny list, then allow list.  Names that are not among the
    model's ``known`` ones are errors."""
    if known is not None and (unknown := sorted({*deleted, *(kept or ())} - set(known))):
        raise ValueError(f"no such tags: {', '.join(unknown)}")
    rows = rows.where(F.col("score") >= least).where(~F.col("label").isin(list(deleted))) if deleted else rows.where(F.col("score") >= least)
    rows = rows.where(F.col("label").isin(list(kept))) if kept is not None else rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "label")))


def without_background(scores: Column, index: int) -> Column:
    """Class scores without the background's."""
    return F.filter(scores, lambda v, i: i != index)


def keypoint_rows(boxes: DataFrame, keypoints: str, names: list[str], least: float) -> DataFrame:
    """Each box, and a point per keypoint (x, y, score) that reaches the threshold, named class:name."""
    named = F.array(*map(F.lit, names))
    points = boxes.select("image", "idx", "label", F.posexplode(keypoints).alias("k", "p")).where(F.col("p")[2] >= least)
    points = points.select("image", "idx", F.concat_ws(":", "label", F.get(named, F.col("k"))).alias("label"), F.lit("point").alias("shape_type"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("score"))
    whole = boxes.select("image", "idx", "label", F.lit("rectangle").alias("shape_type"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "score")
    return whole.unionByName(points)


def best_mask(masks: DataFrame, *key: str) -> DataFrame:
    """The mask with the best predicted overlap."""
    return masks.groupBy(*key).agg(F.max_by("idx", F.struct("score", -F.col("idx"))).alias("idx"), F.max("score").alias("score"))


def ctc_collapse(frames: DataFrame, key: str, time: str, label: str, score: str, blank: int = 0) -> DataFrame:
    """Per sequence the labels without repeats of the frame before and blanks, and their mean score."""
    before = F.lag(label).over(Window.partitionBy(key).orderBy(time))
    kept = frames.withColumn("_before", before).where((F.col(label) != blank) & (F.col("_before").isNull() | (F.col("_before") != F.col(label))))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, label))), lambda s: s[label]).alias("labels"), F.avg(score).alias("confidence"))


def largest(components: DataFrame, n: int) -> DataFrame:
    """The n largest parts of each image, earlier ones first among equals."""
    return components.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("area"), "component"))).where(F.col("rank") <= n)


def reading_order(boxes: DataFrame, n: int) -> DataFrame:
    """Text boxes from top to bottom, then left to right; the first n."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy("y0", "x0", "idx"))).where(F.col("place") <= n)


def text_boxes(boxes: DataFrame, least_score: float = 0.6, unclip: float = 1.5, least_side: float = 3.0) -> DataFrame:
    """``boxes`` (length, breadth between pixel centres, score) that reach the score, each side a pixel longer and at
    least 1, grown by area * unclip / perimeter on every side; those with a side up to ``least_side`` go."""
    side = lambda c: F.greatest(F.col(c) + 1.0, F.lit(1.0))
    grown = boxes.where(F.col("score") >= least_score).withColumns({"length": side("length"), "breadth": side("breadth")})
    grown = grown.withColumn("_by", F.col("length") * F.col("breadth") * unclip / F.greatest(2 * (F.col("length") + F.col("breadth")), F.lit(1e-7)))
    grown = grown.withColumns({"length": F.col("length") + 2 * F.col("_by"), "breadth": F.col("breadth") + 2 * F.col("_by")}).drop("_by")
    return grown.where((F.col("length") > least_side) & (F.col("breadth") > least_side))


def oriented_boxes(pixels: DataFrame, *key: str) -> DataFrame:
    """Per part of pixels (x, y): centre, principal angle from second moments, and extents along and across it."""
    m = pixels.groupBy(*key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"), F.count("*").alias("n"))
    m = m.withColumn("angle", 0.5 * F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")))
    p = pixels.join(m, list(key))
    along = (F.col("x") - F.col("cx")) * F.cos("angle") + (F.col("y") - F.col("cy")) * F.sin("angle")
    across = (F.col("y") - F.col("cy")) * F.cos("angle") - (F.col("x") - F.col("cx")) * F.sin("angle")
    return p.groupBy(*key, "cx", "cy", "angle", "n").agg((F.max(along) - F.min(along)).alias("length"), (F.max(across) - F.min(across)).alias("breadth"))
