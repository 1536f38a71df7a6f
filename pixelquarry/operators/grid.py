"""Pairs of boxes that touch, by a grid with a level for every octave of size.

A box lies at the level whose cells are as wide as its longer side, or up to twice that, so in four cells at most.  Two
boxes meet at the level of the larger one: the smaller is looked up there and at every other level above its own that
its group has.  So a box as large as the image costs each small one four look-ups more, and does not make their cells
larger.  A pair is taken in one cell only, that of the first corner of what both share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
FINEST = 40  # octaves below a box's coordinates, so that numbers of cells stay small


def level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    far = F.greatest(*(F.abs(c) for c in (x0, y0, x1, y1)), F.lit(1e-300))
    size = F.greatest(x1 - x0, y1 - y0, far * 2.0**-FINEST)
    return F.ceil(F.log2(size)).cast("int")


def _placed(boxes: DataFrame, keys: list[str], name: str) -> DataFrame:
    sides = [F.col(c).cast("double") for c in SIDES]
    rows = boxes.where(" AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('Infinity')" for c in SIDES))
    return rows.select(*keys, level(*sides).alias("own"), F.struct("*").alias(name))


def _cells(rows: DataFrame, name: str, at: str) -> DataFrame:
    """A row for every cell of the level ``at`` that the box reaches."""
    span = lambda a, b: F.explode(F.sequence(*(F.floor(F.col(f"{name}.{c}") / F.pow(F.lit(2.0), F.col(at))) for c in (a, b))))
    return rows.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))


def _met(small: DataFrame, large: DataFrame, keys: list[str], a: str, b: str, strict: bool) -> DataFrame:
    """Pairs (struct a of ``small``, struct b of ``large``) of which b's level is a's or above (above only, if ``strict``)."""
    homes = _cells(large.withColumnRenamed("own", "level"), b, "level").alias("h")
    levels = large.select(*keys, F.col("own").alias("level")).distinct().alias("l")
    same = " AND ".join(f"s.{k} <=> l.{k}" for k in keys)
    asked = small.alias("s").join(levels, F.expr(f"{same} AND l.level {'>' if strict else '>='} s.own")).select("s.*", "level")
    asked = _cells(asked, a, "level").alias("q")
    cell = lambda c: f"floor(greatest(q.{a}.{c}, h.{b}.{c}) / pow(2D, q.level))"
    same = " AND ".join([*(f"q.{k} <=> h.{k}" for k in keys), "q.level = h.level AND q.cx = h.cx AND q.cy = h.cy"])
    touch = f"q.{a}.x0 <= h.{b}.x1 AND h.{b}.x0 <= q.{a}.x1 AND q.{a}.y0 <= h.{b}.y1 AND h.{b}.y0 <= q.{a}.y1"
    met = asked.join(homes, F.expr(f"{same} AND {touch} AND {cell('x0')} = q.cx AND {cell('y0')} = q.cy"))
    return met.select(*(F.col(f"q.{k}").alias(k) for k in keys), f"q.{a}", f"h.{b}", "q.own", "q.level")


DENSE = 128


def crowded(left: DataFrame, right: DataFrame, keys: list[str], dense: int = DENSE) -> DataFrame:
    """Keys of more than ``dense`` rows of either side."""
    many = lambda rows: rows.groupBy(*keys).count().where(F.col("count") > dense).select(*keys)
    return many(left).unionByName(many(right)).distinct()


def of_keys(rows: DataFrame, some: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` whose keys are among ``some`` (left_semi) or not (left_anti); nulls are equal."""
    return rows.alias("r").join(some.alias("s"), F.expr(" AND ".join(f"r.{k} <=> s.{k}" for k in keys)), how)


def meeting(left: DataFrame, right: DataFrame, keys: list[str], dense: int = DENSE) -> DataFrame:
    """(keys, a, b): every row of ``left`` with every row of ``right`` of the same keys whose box it touches, borders
    included, as structs; both have x0, y0, x1, y1.  Boxes with a side that is null or not finite touch none.  Keys of up
    to ``dense`` rows a side are joined as they are, others by the grid."""
    large = crowded(left, right, keys, dense)
    if large.isEmpty():
        return _met_by_keys(left, right, keys)
    by_keys = _met_by_keys(*(of_keys(rows, large, keys, "left_anti") for rows in (left, right)), keys)
    return by_keys.unionByName(_met_by_grid(*(of_keys(rows, large, keys, "left_semi") for rows in (left, right)), keys))


def _met_by_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a, b = _placed(left, keys, "a").alias("l"), _placed(right, keys, "b").alias("r")
    same = " AND ".join(f"l.{k} <=> r.{k}" for k in keys)
    met = a.join(b, F.expr(f"{same} AND l.a.x0 <= r.b.x1 AND r.b.x0 <= l.a.x1 AND l.a.y0 <= r.b.y1 AND r.b.y0 <= l.a.y1"))
    return met.select(*(F.col(f"l.{k}").alias(k) for k in keys), "l.a", "r.b")


def _met_by_grid(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a, b = _placed(left, keys, "a"), _placed(right, keys, "b")
    up = _met(a, b, keys, "a", "b", strict=False)
    down = _met(b, a, keys, "b", "a", strict=True)
    return up.select(*keys, "a", "b").unionByName(down.select(*keys, "a", "b"))


def touching(boxes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, a, b): the pairs of boxes of a group that touch, each once; ``order`` (a condition on a and b) picks which of the
    two comes first: it must hold for (a, b) or for (b, a)."""
    placed = _placed(boxes, keys, "a")
    met = _met(placed, placed.withColumnRenamed("a", "b"), keys, "a", "b", strict=False)
    swapped = F.expr(f"NOT ({order})")
    first, second = F.when(swapped, F.col("b")).otherwise(F.col("a")), F.when(swapped, F.col("a")).otherwise(F.col("b"))
    met = met.where(F.expr(f"own < level OR ({order})"))  # on one level each pair is met from both sides, and a box itself
    return met.select(*keys, first.alias("a"), second.alias("b"))
