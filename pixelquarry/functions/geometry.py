"""Geometry of annotation shapes as column expressions: points are ``array<array<double>>``, no Python runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<array<double>>"


def let(value: Column, body) -> Column:
    """``body`` of a value computed once, however often it names it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however many filters and columns name it: the optimiser does not
    copy what a list of one is exploded to."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def point(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p[0])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p[1])


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Four corners from any two opposite ones: left top, right top, right bottom, left bottom."""
    left, right, top, bottom = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    return F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom))


def bounds(points: Column) -> Column:
    """struct x0, y0, x1, y1; nulls without points."""
    sides = lambda p: F.struct(F.array_min(xs(p)).alias("x0"), F.array_min(ys(p)).alias("y0"), F.array_max(xs(p)).alias("x1"), F.array_max(ys(p)).alias("y1"))
    return let(points, sides)


def area(points: Column) -> Column:
    """Area of a polygon by the shoelace rule, 0 under three points."""

    def shoelace(p: Column) -> Column:
        n = F.size(p)
        after = F.concat(F.slice(p, 2, n - 1), F.slice(p, 1, 1))
        turns = F.zip_with(p, after, lambda a, b: a[0] * b[1] - b[0] * a[1])
        return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(turns, F.lit(0.0), lambda t, v: t + v)) / 2)

    return let(points, shoelace)


def direction(points: Column) -> Column:
    """Angle of the first edge in 0 to 2 pi; null where it has no length."""
    dx, dy = points[1][0] - points[0][0], points[1][1] - points[0][1]
    return F.when((dx == 0) & (dy == 0), None).otherwise(F.pmod(F.atan2(dy, dx), F.lit(2) * F.pi()))


def moved(points: Column, x, y) -> Column:
    """Each point by x(px, py) and y(px, py)."""
    return F.transform(points, lambda p: F.array(x(p[0], p[1]).cast("double"), y(p[0], p[1]).cast("double")))


def flip(points: Column, width: Column, height: Column, horizontal: bool) -> Column:
    return moved(points, lambda x, y: width - x, lambda x, y: y) if horizontal else moved(points, lambda x, y: x, lambda x, y: height - y)


def turn(points: Column, width: Column, height: Column, degrees: int) -> Column:
    """Clockwise by a right angle's multiple; width and height are of the image before."""
    x, y = {0: (lambda a, b: a, lambda a, b: b), 90: (lambda a, b: height - b, lambda a, b: a), 180: (lambda a, b: width - a, lambda a, b: height - b), 270: (lambda a, b: b, lambda a, b: width - a)}[degrees % 360]
    return moved(points, x, y)


def scale(points: Column, fx: Column, fy: Column) -> Column:
    return moved(points, lambda x, y: x * fx, lambda x, y: y * fy)


def shift(points: Column, dx: Column, dy: Column) -> Column:
    return moved(points, lambda x, y: x + dx, lambda x, y: y + dy)


def clamp(points: Column, width: Column, height: Column) -> Column:
    return moved(points, lambda x, y: F.least(F.greatest(x, F.lit(0.0)), width), lambda x, y: F.least(F.greatest(y, F.lit(0.0)), height))


def shift_inside(points: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """A shift cut so that the shape stays in the image."""
    box = bounds(points)
    return shift(points, F.least(F.greatest(dx, -box["x0"]), width - box["x1"]), F.least(F.greatest(dy, -box["y0"]), height - box["y1"]))


def rotate(points: Column, angle: Column) -> Column:
    """About the centre of the bounds."""
    box = bounds(points)
    frame = F.struct(((box["x0"] + box["x1"]) / 2).alias("x"), ((box["y0"] + box["y1"]) / 2).alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    return let(frame, lambda m: moved(points, lambda x, y: m["x"] + (x - m["x"]) * m["c"] - (y - m["y"]) * m["s"], lambda x, y: m["y"] + (x - m["x"]) * m["s"] + (y - m["y"]) * m["c"]))


def centre(points: Column) -> Column:
    """Middle of the first and third of four corners; null for other shapes."""
    return F.when(F.size(points) == 4, F.array((points[0][0] + points[2][0]) / 2, (points[0][1] + points[2][1]) / 2))


def corner_handle(points: Column) -> Column:
    """Where four corners are turned by: the second one; null for other shapes."""
    return F.when(F.size(points) == 4, points[1])


def rotate_box(points: Column, angle: Column) -> Column:
    """Four corners about their centre; other shapes stay."""
    frame = F.struct(centre(points)[0].alias("x"), centre(points)[1].alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    turned = let(frame, lambda m: moved(points, lambda x, y: m["x"] + (x - m["x"]) * m["c"] - (y - m["y"]) * m["s"], lambda x, y: m["y"] + (x - m["x"]) * m["s"] + (y - m["y"]) * m["c"]))
    return F.when(F.size(points) == 4, turned).otherwise(points)


def circle_polygon(points: Column, corners: int = 32) -> Column:
    """A circle given by its centre and a point on it, as a polygon."""
    r = F.sqrt(F.pow(points[1][0] - points[0][0], F.lit(2.0)) + F.pow(points[1][1] - points[0][1], F.lit(2.0)))
    angles = [F.lit(i) * 2 * F.pi() / corners for i in range(corners)]
    unit = F.array(*(F.array(F.cos(a), F.sin(a)) for a in angles))  # a constant of the plan
    frame = F.struct(points[0][0].alias("x"), points[0][1].alias("y"), r.alias("r"))
    return let(frame, lambda c: F.transform(unit, lambda u: F.array(c["x"] + c["r"] * u[0], c["y"] + c["r"] * u[1])))


def resize_shape(shape_type: Column, points: Column, fx: Column, fy: Column) -> tuple[Column, Column]:
    """(type, points) on a resized image: under unequal factors circles and rotated boxes become polygons."""
    even = fx == fy
    kind = F.when(~even & shape_type.isin("circle", "rotation"), "polygon").otherwise(shape_type)
    return kind, F.when(~even & (shape_type == "circle"), scale(circle_polygon(points), fx, fy)).otherwise(scale(points, fx, fy))


def _cross(a: Column, b: Column, axis: int, at: Column) -> Column:
    """Where the edge from a to b meets the line on which the coordinate is ``at``."""
    t = (at - a[axis]) / (b[axis] - a[axis])
    other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
    return F.array(at, other) if axis == 0 else F.array(other, at)


def _clip_edge(points: Column, axis: int, at: Column, upper: bool) -> Column:
    n = F.size(points)
    inside = (lambda p: p[axis] <= at) if upper else (lambda p: p[axis] >= at)

    def step(i: Column) -> Column:
        a, b = points[F.pmod(i - 1 + n, n).cast("int")], points[i]
        meet = _cross(a, b, axis, at)
        return F.when(inside(b) & inside(a), F.array(b)).when(inside(b), F.array(meet, b)).when(inside(a), F.array(meet)).otherwise(F.array().cast(POINTS))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), step))).otherwise(points)


def clip_polygon(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Polygon within a window, edge by edge; may be empty."""

    def cut(points: Column, axis: int, at: Column, upper: bool) -> Column:
        return let(points, lambda p: _clip_edge(p, axis, at.cast("double"), upper))

    return cut(cut(cut(cut(points, 0, x0, False), 0, x1, True), 1, y0, False), 1, y1, True)


def is_upright(points: Column) -> Column:
    """Whether the points are left top, right top, right bottom and left bottom of an upright box."""
    # the fourth point of a triangle, which may be looked up before the size is, is null
    at = lambda i, j: F.get(F.get(points, F.lit(i)), F.lit(j))
    sides = (at(0, 0) == at(3, 0)) & (at(1, 0) == at(2, 0)) & (at(0, 1) == at(1, 1)) & (at(2, 1) == at(3, 1)) & (at(0, 0) <= at(1, 0)) & (at(0, 1) <= at(2, 1))
    return F.coalesce((F.size(points) == 4) & sides, F.lit(False))


def clip_upright(box: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """What ``clip_polygon`` leaves of an upright box that meets the window: the same corners in the same order."""
    left, top, right, bottom = F.greatest(box["x0"], x0), F.greatest(box["y0"], y0), F.least(box["x1"], x1), F.least(box["y1"], y1)
    a, b, c, d = point(left, top), point(right, top), point(right, bottom), point(left, bottom)
    return F.when(box["y1"] > y1, F.array(d, a, b, c)).otherwise(F.array(a, b, c, d))


def clip_line(a: Column, b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Part of a segment within a window as two points; null if none."""
    dx, dy = b[0] - a[0], b[1] - a[1]

    def ratios(p: Column, q: Column) -> tuple[Column, Column, Column]:
        """Entering and leaving ratio, and whether the segment lies on the wrong side altogether."""
        r = q / F.nullif(p, F.lit(0.0))
        return F.when(p < 0, r).otherwise(0.0), F.when(p > 0, r).otherwise(1.0), (p == 0) & (q < 0)

    sides = [ratios(-dx, a[0] - x0), ratios(dx, x1 - a[0]), ratios(-dy, a[1] - y0), ratios(dy, y1 - a[1])]
    enter, leave = F.greatest(F.lit(0.0), *(s[0] for s in sides)), F.least(F.lit(1.0), *(s[1] for s in sides))
    out = sides[0][2] | sides[1][2] | sides[2][2] | sides[3][2]
    at = lambda t: F.array(a[0] + t * dx, a[1] + t * dy)
    return F.when(~out & (enter <= leave), F.array(at(enter), at(leave)))


def in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    n = F.size(points)

    def crosses(i: Column) -> Column:
        a, b = points[i], points[(i + 1) % n]
        return ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0])

    count = F.size(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(crosses(i), F.lit(False))))
    return (n >= 3) & (count % 2 == 1)


def edge_distance(points: Column, x: Column, y: Column, closed: bool = True) -> Column:
    """Distance to the nearest edge."""
    n = F.size(points)

    def one(i: Column) -> Column:
        a, b = points[i], points[(i + 1) % n]
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a[0]) * dx + (y - a[1]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
        return F.sqrt(F.pow(x - a[0] - t * dx, F.lit(2.0)) + F.pow(y - a[1] - t * dy, F.lit(2.0)))

    last = n - 1 if closed else F.greatest(n - 2, F.lit(0))
    return F.array_min(F.transform(F.sequence(F.lit(0), last), one))


def edges(points: Column) -> Column:
    """Edges of a closed shape as struct x, y (begin), dx, dy (to the end) and square (of the length)."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    sides = F.zip_with(points, after, lambda a, b: F.struct(a[0].alias("x"), a[1].alias("y"), (b[0] - a[0]).alias("dx"), (b[1] - a[1]).alias("dy")))
    return F.transform(sides, lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"), e["dx"].alias("dx"), e["dy"].alias("dy"), (e["dx"] * e["dx"] + e["dy"] * e["dy"]).alias("square")))


def distance_to_edges(sides: Column, x: Column, y: Column) -> Column:
    """The same as ``edge_distance`` from edges that were made once per shape."""

    def square(e: Column) -> Column:
        ux, uy = x - e["x"], y - e["y"]
        along, across = ux * e["dx"] + uy * e["dy"], ux * e["dy"] - uy * e["dx"]
        far = (ux - e["dx"]) * (ux - e["dx"]) + (uy - e["dy"]) * (uy - e["dy"])
        return F.when(along <= 0, ux * ux + uy * uy).when(along >= e["square"], far).otherwise(across * across / e["square"])

    return F.sqrt(F.array_min(F.transform(sides, square)))


def inside_edges(sides: Column, x: Column, y: Column) -> Column:
    """The same as ``in_polygon`` from edges."""
    crosses = lambda e: ((e["y"] > y) != (e["y"] + e["dy"] > y)) & (x < e["dx"] * (y - e["y"]) / F.nullif(e["dy"], F.lit(0.0)) + e["x"])
    return (F.size(sides) >= 3) & (F.size(F.filter(sides, crosses)) % 2 == 1)


def compose(first: Column, then: Column) -> Column:
    """Affine maps as struct a, b, c, d, e, f (x' = a x + c y + e, y' = b x + d y + f): ``first``, then ``then``."""
    f, t = first, then
    return F.struct(
        (t["a"] * f["a"] + t["c"] * f["b"]).alias("a"), (t["b"] * f["a"] + t["d"] * f["b"]).alias("b"), (t["a"] * f["c"] + t["c"] * f["d"]).alias("c"),
        (t["b"] * f["c"] + t["d"] * f["d"]).alias("d"), (t["a"] * f["e"] + t["c"] * f["f"] + t["e"]).alias("e"), (t["b"] * f["e"] + t["d"] * f["f"] + t["f"]).alias("f"),
    )


def affine(a, b, c, d, e, f) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for v, n in zip((a, b, c, d, e, f), "abcdef", strict=True)))


def inverse(m: Column) -> Column:
    """Null where the map flattens the plane."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    safe = F.when(F.abs(det) > 1e-12, det)
    a, b, c, d = m["d"] / safe, -m["b"] / safe, -m["c"] / safe, m["a"] / safe
    return F.when(safe.isNotNull(), F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (-(a * m["e"] + c * m["f"])).alias("e"), (-(b * m["e"] + d * m["f"])).alias("f")))


def apply(m: Column, points: Column) -> Column:
    return moved(points, lambda x, y: m["a"] * x + m["c"] * y + m["e"], lambda x, y: m["b"] * x + m["d"] * y + m["f"])


def compact(points: Column, least: float) -> Column:
    """Freehand points nearer than ``least`` to the last kept one go."""
    far = lambda kept, p: F.sqrt(F.pow(p[0] - F.element_at(kept, -1)[0], F.lit(2.0)) + F.pow(p[1] - F.element_at(kept, -1)[1], F.lit(2.0))) >= least
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1), lambda kept, p: F.when(far(kept, p), F.concat(kept, F.array(p))).otherwise(kept))


def resample(points: Column, budget: int) -> Column:
    """At most ``budget`` points, evenly by index, ends kept."""
    n = F.size(points)
    even = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: points[F.bround(i * (n - 1) / (budget - 1)).cast("int")])
    return F.when(n <= budget, points).otherwise(even)


def as_text(points: Column, digits: int = 4) -> Column:
    """Points as text, for reports and keys."""
    number = lambda v: F.format_string(f"%.{digits}f", F.round(v, digits) + 0.0)
    return F.array_join(F.transform(points, lambda p: F.concat(number(p[0]), F.lit(" "), number(p[1]))), ",")
