"""Annotation shapes as tables: checks, quality flags, clipping, tiling, editing.

Shapes have image, idx, label, shape_type, points (array of [x, y]) and what an operator names beside."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import UNNAMED, category, is_category
from . import grid

#: Number of points of each shape type (least, most; null is any).
POINT_COUNTS = {"point": (1, 1), "line": (2, 2), "circle": (2, 2), "rectangle": (4, 4), "rotation": (4, 4), "polygon": (3, None), "linestrip": (2, None), "points": (1, None), "mask": (2, 2)}


def problems(width: str = "width", height: str = "height") -> Column:
    """Names of the rules that a shape breaks."""
    p, kind = F.col("points"), F.col("shape_type")
    finite = F.forall(p, lambda q: (F.size(q) == 2) & F.forall(q, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    counts = F.lit(False)
    for name, (least, most) in POINT_COUNTS.items():
        bad = (F.size(p) < least) | (F.size(p) > most if most else F.lit(False))
        counts = counts | ((kind == name) & bad)
    rules = {
        "size": ~((F.col(width) > 0) & (F.col(height) > 0)), "label": F.trim(F.coalesce("label", F.lit(""))) == "", "type": ~kind.isin(*POINT_COUNTS),
        "coordinates": ~finite, "point_count": counts, "direction": (kind == "rotation") & g.direction(p).isNull(),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items())))


def quality(shapes: DataFrame, width: str = "width", height: str = "height", digits: int = 3) -> DataFrame:
    """Shapes with flags: invalid_shape (nothing is known of it), invalid_points (none, or some that are no pair of finite
    numbers), and of the others out_of_bounds (where the image has a size), degenerate (a point of several places,
    another type of one, or three points and more without area) and duplicate (all but the first of equal label, type
    and places).  A shape without label is unlabeled, one without type a polygon; places are points rounded to
    ``digits``, in any order, each once."""
    p = F.col("points")
    known = F.col("label").isNotNull() | F.col("shape_type").isNotNull() | p.isNotNull()
    finite = F.forall(p, lambda q: (F.size(q) == 2) & F.forall(q, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    good = F.coalesce((F.size(p) > 0) & finite, F.lit(False))
    places = F.array_sort(F.array_distinct(F.transform(p, lambda q: F.transform(q, lambda v: F.round(v, digits) + 0.0))))
    kind = F.when(F.coalesce("shape_type", F.lit("")) == "", "polygon").otherwise(F.col("shape_type"))
    label = F.when(F.coalesce("label", F.lit("")) == "", "unlabeled").otherwise(F.col("label"))
    out = shapes.withColumns({"label": label, "shape_type": kind, "_known": known, "_good": known & good}).withColumn("_places", F.when(F.col("_good"), places))
    outside = F.exists(p, lambda q: (q[0] < 0) | (q[1] < 0) | (q[0] > F.col(width)) | (q[1] > F.col(height)))
    n = F.size("_places")
    flat = F.when(F.col("shape_type") == "point", n != 1).otherwise(n < 2) | ((F.size(p) >= 3) & (g.area(p) <= 1e-6))
    first = F.row_number().over(Window.partitionBy("image", "label", "shape_type", "_places").orderBy("idx"))
    flags = {
        "invalid_shape": ~F.col("_known"), "invalid_points": F.col("_known") & ~F.col("_good"), "duplicate": F.col("_good") & (first > 1), "degenerate": F.col("_good") & flat,
        "out_of_bounds": F.col("_good") & F.coalesce((F.col(width) > 0) & (F.col(height) > 0), F.lit(False)) & outside,
    }
    return out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("_known", "_good", "_places")


ISSUES = ("invalid_shape", "invalid_points", "out_of_bounds", "degenerate", "duplicate")


def quality_counts(flagged: DataFrame, images: DataFrame) -> DataFrame:
    """How many shapes have each issue, and how many images have no shape."""
    issues = flagged.select(F.explode(F.array_compact(F.array(*(F.when(F.col(n), n) for n in ISSUES)))).alias("issue"))
    empty = images.join(flagged.select("image").distinct(), "image", "left_anti").select(F.lit("empty_annotation").alias("issue"))
    return issues.unionByName(empty).groupBy("issue").count()


def label_counts(flagged: DataFrame) -> DataFrame:
    """Shapes of each label, and how many of them have an issue; shapes of which nothing is known are none."""
    some = F.lit(False)
    for n in ISSUES:
        some = some | F.col(n)
    return flagged.where("NOT invalid_shape").groupBy("label").agg(F.count("*").alias("shapes"), F.count_if(some).alias("with_issue"))


def clip(shapes: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """Shapes within a window, moved to its corner.  Points outside go; lines are cut; polygons and boxes are cut, a cut
    box becomes a polygon, and what has no area goes; line strips are cut into runs (``clip_strips``); other types
    stay only if all their points are inside."""
    p, kind = F.col("points"), F.col("shape_type")
    x1, y1 = x + w, y + h
    inside = F.forall(p, lambda q: (q[0] >= x) & (q[0] <= x1) & (q[1] >= y) & (q[1] <= y1))
    box = F.col("_box")
    met = (box["x1"] >= x) & (box["x0"] <= x1) & (box["y1"] >= y) & (box["y0"] <= y1)
    finite = (box["x0"] > float("-inf")) & (box["y0"] > float("-inf")) & (box["x1"] < float("inf")) & (box["y1"] < float("inf"))
    upright = finite & (w >= 0) & (h >= 0) & g.is_upright(p)
    area = F.when(upright, g.clip_upright(box, x, y, x1, y1)).otherwise(g.clip_polygon(p, x, y, x1, y1))
    cut = F.when(F.col("_whole"), p).when(kind == "line", g.clip_line(p[0], p[1], x, y, x1, y1)).when(kind.isin("rectangle", "rotation", "polygon"), area)
    out = g.once(shapes.where(kind != "linestrip"), "_box", g.bounds(p)).where(met)
    out = g.once(g.once(out, "_whole", inside), "_cut", cut).drop("_box")
    flat = ~F.col("_whole") & kind.isin("rectangle", "rotation", "polygon") & (g.area(F.col("_cut")) <= 1e-6)
    out = out.where(F.col("_cut").isNotNull() & ~flat).withColumn("shape_type", F.when(~F.col("_whole") & kind.isin("rectangle", "rotation"), "polygon").otherwise(kind))
    out = out.withColumn("points", g.shift(F.col("_cut"), -x, -y)).drop("_cut", "_whole")
    return out.unionByName(clip_strips(shapes.where(kind == "linestrip"), x, y, w, h))


def clip_strips(strips: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """Line strips within a window: segments are cut one by one, and runs that stay joined are strips again."""
    keys = [c for c in strips.columns if c != "points"]
    p = F.col("points")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 2, F.lit(0))), lambda i: F.struct(i.alias("i"), p[i].alias("a"), F.get(p, i + 1).alias("b")))
    segments = strips.select(*keys, F.explode(pairs).alias("s")).where("s.b IS NOT NULL")
    cut = segments.withColumn("c", g.clip_line(F.col("s.a"), F.col("s.b"), x, y, x + w, y + h)).where("c IS NOT NULL AND c[0] <> c[1]")
    by = Window.partitionBy(*keys).orderBy("s.i")
    joined = (F.lag(F.col("c")[1]).over(by) == F.col("c")[0]) & (F.lag("s.i").over(by) == F.col("s.i") - 1)
    runs = cut.withColumn("_run", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct("s.i", "c"))).alias("_segments"))
    points = F.concat(F.slice(F.col("_segments")[0]["c"], 1, 1), F.transform("_segments", lambda s: s["c"][1]))
    return whole.withColumn("points", g.shift(points, -x, -y)).select(*strips.columns)


def tiles(images: DataFrame, w: int, h: int, overlap_x: int = 0, overlap_y: int = 0, partial: bool = True) -> DataFrame:
    """Tile windows of ``images`` (image, width, height): column, row, x, y, w, h.  The last tile of a side may be cut
    (``partial``) or must fit."""

    def starts(size: str, tile: int, overlap: int) -> Column:
        stride = tile - overlap
        every = F.sequence(F.lit(0), F.greatest(F.col(size) - 1, F.lit(0)).cast("int"), F.lit(stride))
        keep = (lambda v: (v == 0) | (v - stride + tile < F.col(size))) if partial else (lambda v: v + tile <= F.col(size))
        return F.filter(every, keep)

    out = images.select("*", F.posexplode(starts("width", w, overlap_x)).alias("column", "x")).select("*", F.posexplode(starts("height", h, overlap_y)).alias("row", "y"))
    return out.withColumn("w", F.least(F.lit(w), F.col("width") - F.col("x"))).withColumn("h", F.least(F.lit(h), F.col("height") - F.col("y")))


def tile_shapes(windows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes of each tile, clipped and moved: windows and bounds of shapes meet by the grid of sizes."""
    box = g.bounds(F.col("points"))
    bounded = shapes.select("image", F.struct("idx", "label", "shape_type", "points").alias("shape"), *(box[c].alias(c) for c in ("x0", "y0", "x1", "y1")))
    framed = windows.select("image", F.struct(*(c for c in windows.columns if c != "image")).alias("window"), *(F.expr(e).cast("double").alias(n) for n, e in (("x0", "x"), ("y0", "y"), ("x1", "x + w"), ("y1", "y + h"))))
    met = grid.meeting(framed, bounded, ["image"]).select("image", "a.window.*", "b.shape.*")
    out = clip(met, F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return out.withColumn("tile", F.format_string("%s__tile_r%04d_c%04d", F.col("image").cast("string"), "row", "column"))


def rename_category(shapes: DataFrame, source: str, target: str) -> DataFrame:
    """Shapes of the category (trimmed, in normal form C) get the new name; ``renamed`` tells which change."""
    hit, name = is_category(F.col("label"), source), unicodedata.normalize("NFC", target.strip()) or UNNAMED
    return shapes.withColumn("renamed", hit & (F.col("label") != name)).withColumn("label", F.when(hit, F.lit(name)).otherwise(F.col("label")))


def promote(shapes: DataFrame, predictions: DataFrame, key: str = "prediction_key") -> DataFrame:
    """Predictions not yet among the shapes, appended behind each image's last shape."""
    fresh = predictions.join(shapes.where("source = 'ai_promoted'").select("image", key), ["image", key], "left_anti")
    last = shapes.groupBy("image").agg(F.max("idx").alias("_last"))
    place = F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("image").orderBy("idx"))
    return fresh.join(last, "image", "left").withColumn("idx", place).withColumn("label", category(F.col("label"))).withColumn("source", F.lit("ai_promoted")).drop("_last")


def asset_metadata(shapes: DataFrame) -> DataFrame:
    """Count, sorted labels and types per image."""
    return shapes.groupBy("image").agg(F.count("*").alias("annotation_count"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("shape_type")).alias("shape_types"))


def revalidate(old: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Index rows with what was found anew for some of them: image error, then annotation error, else valid."""
    both = old.alias("o").join(fresh.alias("f"), "asset_id", "left")
    there = F.col("f.image_ok").isNotNull()
    status = F.when(~there, F.col("o.status")).when(~F.col("f.image_ok"), "corrupt_image").when(~F.col("f.annotation_ok"), "corrupt_annotation").otherwise("valid")
    return both.select("asset_id", status.alias("status"), *(F.when(there, F.coalesce(f"f.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns))


def _targets(shapes: DataFrame, *keep: str) -> DataFrame:
    """What hits ask of a shape, made once: bounds, area, and its edges (none of an upright box, which its bounds tell)."""
    p, upright = F.col("points"), F.col("_upright")
    rows = shapes.select("image", "idx", *keep, "points", g.is_upright(F.col("points")).alias("_upright"))
    box = F.when(upright, F.struct(*(F.get(F.get(p, F.lit(i)), F.lit(j)).alias(c) for c, i, j in (("x0", 0, 0), ("y0", 0, 1), ("x1", 2, 0), ("y1", 2, 1))))).otherwise(g.bounds(p))
    rows = rows.select("*", box.alias("_b"))
    area = F.when(upright, (F.col("_b.x1") - F.col("_b.x0")) * (F.col("_b.y1") - F.col("_b.y0"))).otherwise(g.area(p))
    return rows.select("image", "idx", *keep, *(F.col(f"_b.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")), area.alias("area"), F.when(~upright, g.edges(p)).alias("_edges"))


def _struck(met: DataFrame, tolerance: float) -> DataFrame:
    """Of pairs of a point and a target those that hit, ranked per point."""
    x, y, x0, y0, x1, y1, sides = (F.col(c) for c in ("x", "y", "_x0", "_y0", "_x1", "_y1", "_edges"))
    met = met.where((x >= x0 - tolerance) & (x <= x1 + tolerance) & (y >= y0 - tolerance) & (y <= y1 + tolerance))
    away = lambda a, v, b: F.pow(F.greatest(a - v, F.lit(0.0), v - b), F.lit(2.0))
    within = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
    of_box = F.when(within, F.least(x - x0, x1 - x, y - y0, y1 - y)).otherwise(F.sqrt(away(x0, x, x1) + away(y0, y, y1)))
    met = g.once(met, "distance", F.when(sides.isNull(), of_box).otherwise(g.distance_to_edges(sides, x, y))).withColumn("on_edge", F.col("distance") <= tolerance)
    inside = F.when(sides.isNull(), within & (x < x1) & (y < y1)).otherwise(g.inside_edges(sides, x, y))
    met = met.where(F.when(F.col("on_edge"), True).otherwise(inside)).select("image", "point_id", "idx", "distance", "on_edge", "area")
    order = Window.partitionBy("image", "point_id").orderBy(F.desc("on_edge"), F.when(F.col("on_edge"), F.col("distance")), "area", "distance", F.desc("idx"))
    return met.withColumn("rank", F.row_number().over(order)).select("image", "point_id", "idx", "on_edge", "distance", "area", "rank")


def _by_cell(points: DataFrame, targets: DataFrame, tolerance: float, cell: float) -> DataFrame:
    reach = lambda a, b: F.sequence(F.floor((F.col(a) - tolerance) / cell), F.floor((F.col(b) + tolerance) / cell))
    spread = targets.withColumn("_cx", F.explode(reach("_x0", "_x1"))).withColumn("_cy", F.explode(reach("_y0", "_y1")))
    asked = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    return asked.join(spread, ["image", "_cx", "_cy"])


def hits(points: DataFrame, shapes: DataFrame, tolerance: float = 4.0, cell: float = 128.0) -> DataFrame:
    """Shapes under each point (image, point_id, x, y), best first: edges before interiors, then the nearer edge, the
    smaller area, the later shape.  Points and bounds meet by grid cell, so a dense image is many keys."""
    return _struck(_by_cell(points, _targets(shapes), tolerance, cell), tolerance)


def hits_among(shapes: DataFrame, tolerance: float = 4.0, cell: float = 128.0, dense: int = grid.DENSE) -> DataFrame:
    """``hits`` of a point of each shape (columns x, y; its idx is the point_id).  Rows of images up to ``dense`` shapes get
    the list of their image's, so what is dealt by image is not dealt again; those of other images meet by cell."""
    rows, by = shapes.where("image IS NOT NULL"), Window.partitionBy("image")
    crowds = not rows.groupBy("image").count().where(F.col("count") > dense).isEmpty()
    targets = _targets(rows, "x", "y")
    few = sized = targets.withColumn("_n", F.count("*").over(by)) if crowds else targets
    if crowds:
        few = sized.where(F.col("_n") <= dense)
    target = ("idx", "_x0", "_y0", "_x1", "_y1", "area", "_edges")
    listed = few.select("image", F.col("idx").alias("point_id"), "x", "y", F.collect_list(F.struct(*target)).over(by).alias("_all"))
    found = _struck(listed.select("image", "point_id", "x", "y", F.inline("_all")), tolerance)
    if not crowds:
        return found
    many = sized.where(F.col("_n") > dense)
    met = _by_cell(many.select("image", F.col("idx").alias("point_id"), "x", "y"), many.select("image", *target), tolerance, cell)
    return found.unionByName(_struck(met, tolerance))


def dry_run(assets: DataFrame, steps: list[tuple]) -> DataFrame:
    """Sizes after a pipeline and the first reason against it: ("crop", x, y, w, h), ("resize", w, h), ("scale", f),
    ("rotate", degrees), ("flip",)."""
    w, h, reason = F.col("width").cast("double"), F.col("height").cast("double"), F.when(F.col("width").isNull() | F.col("height").isNull(), "no_size")
    for k, (name, *p) in enumerate(steps):
        if name == "crop":
            reason = F.coalesce(reason, F.when((w < p[0] + p[2]) | (h < p[1] + p[3]), F.lit(f"crop_out_of_range_{k}")))
            w, h = F.lit(float(p[2])), F.lit(float(p[3]))
        elif name == "resize":
            w, h = F.lit(float(p[0])), F.lit(float(p[1]))
        elif name == "scale":
            w, h = F.bround(w * p[0]), F.bround(h * p[0])
        elif name == "rotate" and p[0] % 180:
            w, h = h, w
        reason = F.coalesce(reason, F.when(w * h > 64e6, F.lit(f"too_large_{k}")))
    return assets.select("*", w.alias("out_width"), h.alias("out_height"), reason.alias("reason"))


#: Images of a task that cuts pyramids: a small file of images makes very many tiles.
PYRAMIDS = 20_000


def pyramid(images: DataFrame, tile: int = 256) -> DataFrame:
    """Tiles of every level of ``images`` (image, width, height): level, column, row, source box, output size.  Images are
    dealt to as many tasks as their number takes, by image, so what follows per image stays where it is."""
    images = images.select("image", "width", "height").repartition(images.count() // PYRAMIDS + images.sparkSession.sparkContext.defaultParallelism, "image")
    longest = F.greatest("width", "height")
    top = F.when(longest > 1, F.length(F.bin(longest - 1))).otherwise(0).cast("int")
    levels = images.select("image", "width", "height", top.alias("max_level")).select("*", F.explode(F.sequence(F.lit(0), F.col("max_level"))).alias("level"))
    levels = levels.withColumn("factor", F.expr("1L << (max_level - level)")).withColumn("lw", F.ceil(F.col("width") / F.col("factor"))).withColumn("lh", F.ceil(F.col("height") / F.col("factor")))
    across = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / tile) - 1).cast("int"))
    cells = levels.select("*", F.explode(across("lw")).alias("column")).select("*", F.explode(across("lh")).alias("row"))
    side = lambda at, n: F.least(F.lit(tile).cast("long"), F.col(n) - F.col(at) * tile)
    cells = cells.withColumn("out_w", side("column", "lw")).withColumn("out_h", side("row", "lh"))
    return cells.withColumn("x", F.col("column") * tile * F.col("factor")).withColumn("y", F.col("row") * tile * F.col("factor")).drop("lw", "lh")


def import_problems(shapes: DataFrame, least_length: float = 1.0) -> DataFrame:
    """Strict check of imported shapes against their image: bounds, distinct corners, least side."""
    p, kind, box = F.col("points"), F.col("shape_type"), g.bounds(F.col("points"))
    rules = {
        "out_of_bounds": (box["x0"] < 0) | (box["y0"] < 0) | (box["x1"] > F.col("width")) | (box["y1"] > F.col("height")),
        "corners": kind.isin("polygon", "rectangle", "rotation") & (F.size(F.array_distinct(p)) < 3),
        "too_short": kind.isin("line", "linestrip", "rectangle", "rotation") & (F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"]) < least_length),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items())))
    return shapes.withColumn("problems", F.concat(found, problems()))


def mapping_record(rows: DataFrame, m: str, topology_safe: str) -> DataFrame:
    """Kind and id of each row's coordinate map: identity, affine or, without an inverse, unavailable."""
    one = F.struct(*(F.lit(v).cast("double").alias(n) for n, v in zip("abcdef", (1, 0, 0, 1, 0, 0), strict=True)))
    kind = F.when(g.inverse(F.col(m)).isNull(), "unavailable").when(F.col(m) == one, "identity").otherwise("affine")
    return rows.withColumn("kind", kind).withColumn("coordinate_space_id", F.substring(F.sha2(F.to_json(F.struct("kind", F.col(m).alias("forward"), F.col(topology_safe).alias("topology_safe"))), 256), 1, 24))


def derived_conflicts(new: DataFrame, manifest: DataFrame) -> DataFrame:
    """New outputs against the manifest of their root: reuse where the fingerprint is the same, else conflict."""
    return new.join(manifest.select("output_root", F.col("fingerprint").alias("_old")), "output_root").withColumn("action", F.when(F.col("fingerprint") == F.col("_old"), "reuse").otherwise("conflict")).drop("_old")


#: What each kind of image operator does to annotations.
POLICIES = {"crop": "clip_translate", "resize": "scale_xy", "flip": "mirror", "rotate": "rotate", "tile": "tile_clip_translate", "fourier": "suppress", "wavelet": "suppress"}


def policy(kind: str) -> str:
    """What an operator does to annotations; those that leave coordinates alone preserve them."""
    return POLICIES.get(kind, "preserve")


def after_operator(shapes: DataFrame, kind: str, *p: float) -> DataFrame:
    """``shapes`` (with width and height of their image) after an image operator, the sizes after it, and ``mapping``:
    affine, identity, or unavailable where coordinates lose their meaning, which takes all shapes away.

    ("crop", x, y, w, h), ("resize", w, h), ("flip", 1 for left and right), ("rotate", degrees), ("fourier",),
    ("wavelet",), or any operator that keeps coordinates."""
    w, h, points = F.col("width").cast("double"), F.col("height").cast("double"), F.col("points")
    does = policy(kind)
    if does == "suppress":
        return shapes.where(F.lit(False)).withColumn("mapping", F.lit("unavailable"))
    if does == "clip_translate":
        out = clip(shapes, *(F.lit(float(v)) for v in p))
        return out.withColumns({"width": F.lit(float(p[2])), "height": F.lit(float(p[3])), "mapping": F.lit("affine")})
    if does == "scale_xy":
        kind_, moved = g.resize_shape(F.col("shape_type"), points, F.lit(float(p[0])) / w, F.lit(float(p[1])) / h)
        return shapes.withColumns({"shape_type": kind_, "points": moved, "width": F.lit(float(p[0])), "height": F.lit(float(p[1])), "mapping": F.lit("affine")})
    if does == "mirror":
        return shapes.withColumns({"points": g.flip(points, w, h, bool(p[0])), "width": w, "height": h, "mapping": F.lit("affine")})
    if does == "rotate":
        a, b = (h, w) if p[0] % 180 else (w, h)
        return shapes.withColumns({"points": g.turn(points, w, h, int(p[0])), "width": a, "height": b, "mapping": F.lit("affine")})
    if does == "tile_clip_translate":
        raise ValueError("tiles have several outputs: use tiles and tile_shapes")
    return shapes.withColumns({"width": w, "height": h, "mapping": F.lit("identity")})


def scaled_by_operator(shapes: DataFrame, new_width: Column, new_height: Column) -> DataFrame:
    """Shapes after a user's operator that changes sizes: points by the two ratios, types as they are."""
    fx, fy = new_width / F.col("width"), new_height / F.col("height")
    return shapes.withColumns({"points": g.scale(F.col("points"), fx, fy), "width": new_width, "height": new_height})


_SHAPES = "array<struct<label: string, shape_type: string, points: array<array<double>>>>"


def user_transform(documents: DataFrame, transform: Callable[[dict, dict, dict], dict], parameters: dict) -> DataFrame:
    """A user's function over annotation documents (asset_id, document, width, height): the new document, and
    ``violation`` where it fails, gives no object or no shapes, breaks a shape rule or leaves the image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for asset, text, w, h in pdf[["asset_id", "document", "width", "height"]].itertuples(index=False):
                try:
                    out = transform(json.loads(text), dict(parameters), {"width": w, "height": h})
                    bad = "no object" if not isinstance(out, dict) else None
                    rows.append((asset, None if bad else json.dumps(out, ensure_ascii=False), w, h, bad))
                except Exception as e:  # a user's code may raise anything; the row says so
                    rows.append((asset, None, w, h, type(e).__name__))
            yield pd.DataFrame(rows, columns=["asset_id", "document", "width", "height", "violation"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select("asset_id", "document", "width", "height").schema)
    out = documents.select("asset_id", "document", "width", "height").mapInPandas(run, schema + ", violation string")
    shapes = F.from_json(F.get_json_object("document", "$.shapes"), _SHAPES)
    inside = lambda q: (q[0] >= 0) & (q[1] >= 0) & (q[0] <= F.col("width")) & (q[1] <= F.col("height"))
    fine = lambda s: F.exists(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b or 1 << 30).alias("b")) for k, (a, b) in POINT_COUNTS.items())), lambda r: (r["k"] == s["shape_type"]) & F.size(s["points"]).between(r["a"], r["b"]))
    rules = F.when(shapes.isNull(), "no shapes").when(~F.coalesce(F.forall(shapes, fine), F.lit(False)), "shape rules").when(~F.coalesce(F.forall(shapes, lambda s: F.forall(s["points"], inside)), F.lit(False)), "out of bounds")
    out = out.withColumn("violation", F.coalesce("violation", rules))
    return out.withColumn("document", F.when(F.col("violation").isNull(), F.col("document")))
