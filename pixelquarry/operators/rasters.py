"""Raster tables (image, height, width, pixels: uint8 bytes, row by row): one job over many images or tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .annotations import pyramid

SCHEMA = "image string, height int, width int, pixels binary"


def map_rasters(rasters: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each raster through ``f`` (height x width, uint8)."""

    def run(batches):
        for pdf in batches:
            out = [f(np.frombuffer(bytes(p), np.uint8).reshape(h, w)) for h, w, p in zip(pdf["height"], pdf["width"], pdf["pixels"], strict=True)]
            yield pd.DataFrame({"image": pdf["image"], "height": [a.shape[0] for a in out], "width": [a.shape[1] for a in out], "pixels": [np.ascontiguousarray(a, np.uint8).tobytes() for a in out]})

    return rasters.select("image", "height", "width", "pixels").mapInPandas(run, SCHEMA)


def crop(rasters: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return map_rasters(rasters, lambda a: a[y : y + h, x : x + w])


def flip(rasters: DataFrame, horizontal: bool) -> DataFrame:
    return map_rasters(rasters, lambda a: a[:, ::-1] if horizontal else a[::-1])


def turn(rasters: DataFrame, degrees: int) -> DataFrame:
    """Clockwise by a right angle's multiple."""
    return map_rasters(rasters, lambda a: np.rot90(a, -degrees // 90))


def resize(rasters: DataFrame, width: int, height: int) -> DataFrame:
    """Bilinear between pixel centres, halves rounded to even."""

    def one(a: np.ndarray) -> np.ndarray:
        at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        y, x = at(height, a.shape[0]), at(width, a.shape[1])
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        y1, x1, b = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1), a.astype(float)
        fy, fx = (y - y0)[:, None], x - x0
        return np.rint((b[y0][:, x0] * (1 - fx) + b[y0][:, x1] * fx) * (1 - fy) + (b[y1][:, x0] * (1 - fx) + b[y1][:, x1] * fx) * fy)

    return map_rasters(rasters, one)


def lookup(rasters: DataFrame, table: np.ndarray) -> DataFrame:
    """A point function by a table of 256 values."""
    return map_rasters(rasters, lambda a: table[a])


def invert() -> np.ndarray:
    return np.arange(255, -1, -1).astype(np.uint8)


def gamma(power: float) -> np.ndarray:
    return np.rint(255 * (np.arange(256) / 255) ** power).astype(np.uint8)


def threshold(at: int, kind: str = "binary", top: int = 255) -> np.ndarray:
    v = np.arange(256)
    out = {"binary": np.where(v > at, top, 0), "binary_inv": np.where(v > at, 0, top), "trunc": np.minimum(v, at), "tozero": np.where(v > at, v, 0), "tozero_inv": np.where(v > at, 0, v)}
    return out[kind].astype(np.uint8)


def histogram(rasters: DataFrame) -> DataFrame:
    """(image, bin, n): partial counts per tile, added up by image."""

    def run(batches):
        for pdf in batches:
            for image, p in zip(pdf["image"], pdf["pixels"], strict=True):
                n = np.bincount(np.frombuffer(bytes(p), np.uint8), minlength=256)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"image": image, "bin": some, "n": n[some]})

    return rasters.select("image", "pixels").mapInPandas(run, "image string, bin int, n long").groupBy("image", "bin").agg(F.sum("n").alias("n"))


def by_histogram(rasters: DataFrame, value: Callable[[DataFrame], Column]) -> DataFrame:
    """Each image through a table made from its histogram: ``value`` gives the new value of a bin from columns bin, n, c
    (pixels up to it), total, low (c of the darkest bin), least, most and mean of the image.  Tables meet rasters by
    image, so tiles of one image share one."""
    w = Window.partitionBy("image")
    h = histogram(rasters).withColumns({"c": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w), "least": F.min("bin").over(w), "most": F.max("bin").over(w), "mean": F.sum(F.col("bin") * F.col("n")).over(w) / F.sum("n").over(w)})
    h = h.withColumn("low", F.min("c").over(w))
    tables = value(h).groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.least(F.greatest(F.bround("value"), F.lit(0)), F.lit(255)).cast("int")))).alias("table"))

    def run(batches):
        for pdf in batches:
            out = []
            for p, t in zip(pdf["pixels"], pdf["table"], strict=True):
                table = np.zeros(256, np.uint8)
                pairs = dict(t)
                table[list(pairs)] = list(pairs.values())
                out.append(table[np.frombuffer(bytes(p), np.uint8)].tobytes())
            yield pdf.assign(pixels=out)[["image", "height", "width", "pixels"]]

    return rasters.select("image", "height", "width", "pixels").join(tables, "image").mapInPandas(run, SCHEMA)


def equalise(rasters: DataFrame) -> DataFrame:
    """Each image by its cumulative histogram."""
    return by_histogram(rasters, lambda h: h.withColumn("value", F.coalesce((F.col("c") - F.col("low")) * 255.0 / F.nullif(F.col("total") - F.col("low"), F.lit(0)), F.col("bin").cast("double"))))


def minmax(rasters: DataFrame, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """The darkest value of each image to ``low``, the brightest to ``high``; an image of one value becomes ``low``."""
    return by_histogram(rasters, lambda h: h.withColumn("value", F.coalesce((F.col("bin") - F.col("least")) * (high - low) / F.nullif(F.col("most") - F.col("least"), F.lit(0)), F.lit(0.0)) + low))


def contrast(rasters: DataFrame, factor: float) -> DataFrame:
    """Values away from (or, below 1, to) the image's mean, which is rounded up from a half."""
    middle = F.floor(F.col("mean") + 0.5)
    return by_histogram(rasters, lambda h: h.withColumn("value", middle + (F.col("bin") - middle) * factor))


def brightness(factor: float) -> np.ndarray:
    return np.clip(np.rint(np.arange(256) * factor), 0, 255).astype(np.uint8)


def stretch(rasters: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Each image between two percentiles (linearly interpolated) to 0..255, cut there, fractions dropped."""

    def value(h: DataFrame) -> DataFrame:
        marks = h.groupBy("image").agg(F.percentile("bin", F.array(F.lit(low), F.lit(high)), F.col("n")).alias("_p"))
        a = F.col("_p")[0]
        b = F.when(F.col("_p")[1] <= a, a + 1).otherwise(F.col("_p")[1])
        return h.join(marks, "image").withColumn("value", F.floor(F.least(F.greatest((F.col("bin") - a) * 255.0 / (b - a), F.lit(0.0)), F.lit(255.0)).cast("double") + 1e-9).cast("double"))

    return by_histogram(rasters, value)


def saturate(pixels: DataFrame, factor: float) -> DataFrame:
    """Colour rasters (three bytes a pixel) away from or to their grey."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["pixels"]:
                v = np.frombuffer(bytes(p), np.uint8).reshape(-1, 3).astype(float)
                grey = np.rint(v @ [0.299, 0.587, 0.114])[:, None]
                out.append(np.clip(np.rint(grey + (v - grey) * factor), 0, 255).astype(np.uint8).tobytes())
            yield pdf.assign(pixels=out)[["image", "height", "width", "pixels"]]

    return pixels.select("image", "height", "width", "pixels").mapInPandas(run, SCHEMA)


def otsu(histograms: DataFrame) -> DataFrame:
    """(image, threshold): the bin that parts the histogram with the greatest variance between classes, the first of
    equals."""
    w, up = Window.partitionBy("image"), Window.partitionBy("image").orderBy("bin")
    c = histograms.withColumn("n0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("bin")).over(up)).withColumn("n", F.sum("n").over(w)).withColumn("s", F.max("s0").over(w))
    n1 = F.nullif(F.col("n") - F.col("n0"), F.lit(0))
    between = F.col("n0") * n1 * F.pow(F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1, F.lit(2.0))
    return c.withColumn("v", F.coalesce(between, F.lit(0.0))).groupBy("image").agg(F.max_by("bin", F.struct("v", -F.col("bin"))).alias("threshold"))


def focal(rasters: DataFrame, radius: int, how: str) -> DataFrame:
    """Mean, median, min or max over a square window, edges repeated."""
    reduce = {"mean": lambda v: np.rint(v.mean(axis=(2, 3))), "median": lambda v: np.median(v, axis=(2, 3)), "min": lambda v: v.min(axis=(2, 3)), "max": lambda v: v.max(axis=(2, 3))}[how]
    size = 2 * radius + 1
    return map_rasters(rasters, lambda a: reduce(np.lib.stride_tricks.sliding_window_view(np.pad(a, radius, "edge"), (size, size))))


def opened(rasters: DataFrame, radius: int) -> DataFrame:
    return morphology(rasters, radius, "open")


def closed(rasters: DataFrame, radius: int) -> DataFrame:
    return morphology(rasters, radius, "close")


def _views(a: np.ndarray, radius: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, radius, "edge"), (2 * radius + 1, 2 * radius + 1))


def morphology(rasters: DataFrame, radius: int, how: str) -> DataFrame:
    """Erode, dilate, open, close, gradient, tophat or blackhat with a square, edges repeated."""
    low, high = lambda a: _views(a, radius).min(axis=(2, 3)), lambda a: _views(a, radius).max(axis=(2, 3))
    steps = {
        "erode": low, "dilate": high, "open": lambda a: high(low(a)), "close": lambda a: low(high(a)), "gradient": lambda a: high(a) - low(a),
        "tophat": lambda a: a - np.minimum(a, high(low(a))), "blackhat": lambda a: np.maximum(a, low(high(a))) - a,
    }
    return map_rasters(rasters, steps[how])


def _blurred(a: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    """Gaussian mean, one side after the other, edges mirrored without the edge."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = a.astype(float)
    for axis in (0, 1):
        pad = [(radius, radius) if i == axis else (0, 0) for i in (0, 1)]
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, "reflect" if out.shape[axis] > radius else "edge"), 2 * radius + 1, axis=axis) @ k
    return out


def gaussian(rasters: DataFrame, sigma: float, radius: int) -> DataFrame:
    return map_rasters(rasters, lambda a: np.rint(_blurred(a, sigma, radius)))


def local_threshold(rasters: DataFrame, radius: int, less: float, how: str = "mean", sigma: float | None = None, top: int = 255) -> DataFrame:
    """``top`` where a value is above its surroundings' mean (plain or Gaussian) minus ``less``, else 0."""
    mean = (lambda a: np.rint(_views(a, radius).mean(axis=(2, 3)))) if how == "mean" else (lambda a: np.rint(_blurred(a, sigma or 0.3 * (radius - 1) + 0.8, radius)))
    return map_rasters(rasters, lambda a: np.where(a > mean(a) - less, top, 0))


def unsharp(rasters: DataFrame, sigma: float, amount: float, radius: int, threshold: int = 0) -> DataFrame:
    """Values away from their blurred ones, where they differ by the threshold or more."""

    def one(a: np.ndarray) -> np.ndarray:
        soft = np.rint(_blurred(a, sigma, radius))
        sharp = np.clip(np.rint(a * (1 + amount) - soft * amount), 0, 255)
        return np.where(np.abs(a - soft) < threshold, a, sharp)

    return map_rasters(rasters, one)


#: Kernels of the gradients.
KERNELS = {"sobel_x": [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], "sobel_y": [[-1, -2, -1], [0, 0, 0], [1, 2, 1]], "scharr_x": [[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], "scharr_y": [[-3, -10, -3], [0, 0, 0], [3, 10, 3]], "laplacian": [[0, 1, 0], [1, -4, 1], [0, 1, 0]]}


def gradient(rasters: DataFrame, kernel: str) -> DataFrame:
    """Size of the kernel's answer, cut at 255; edges mirrored without the edge."""
    k = np.array(KERNELS[kernel])
    return map_rasters(rasters, lambda a: np.minimum(255, np.abs((np.lib.stride_tricks.sliding_window_view(np.pad(a.astype(int), 1, "reflect"), (3, 3)) * k).sum(axis=(2, 3)))))


def haar(a: np.ndarray) -> dict[str, np.ndarray]:
    """One level of the Haar pyramid; odd sides are padded with their edge."""
    a = np.pad(a.astype(float), ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), "edge")
    p, q, r, s = a[::2, ::2], a[::2, 1::2], a[1::2, ::2], a[1::2, 1::2]
    return {"LL": (p + q + r + s) / 4, "LH": (p + q - r - s) / 4, "HL": (p - q + r - s) / 4, "HH": (p - q - r + s) / 4}


def haar_pyramid(rasters: DataFrame, levels: int) -> DataFrame:
    """(image, level, band, height, width, energy) of 1 to 5 levels."""

    def run(batches):
        for pdf in batches:
            rows = []
            for image, h, w, p in pdf[["image", "height", "width", "pixels"]].itertuples(index=False):
                a = np.frombuffer(bytes(p), np.uint8).reshape(h, w).astype(float)
                for level in range(1, levels + 1):
                    bands = haar(a)
                    rows += [(image, level, n, b.shape[0], b.shape[1], float((b * b).sum())) for n, b in bands.items()]
                    a = bands["LL"]
            yield pd.DataFrame(rows, columns=["image", "level", "band", "height", "width", "energy"])

    return rasters.select("image", "height", "width", "pixels").mapInPandas(run, "image string, level int, band string, height int, width int, energy double")


def thumbnails(rasters: DataFrame, longest: int) -> DataFrame:
    """Block means so that no side is longer."""

    def one(a: np.ndarray) -> np.ndarray:
        f = max(1, -(-max(a.shape) // longest))
        b = np.pad(a.astype(float), ((0, -a.shape[0] % f), (0, -a.shape[1] % f)), "edge")
        return np.rint(b.reshape(b.shape[0] // f, f, b.shape[1] // f, f).mean(axis=(1, 3)))

    return map_rasters(rasters, one)


def regions(rasters: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (image, x, y, w, h, out_w, out_h and any key columns) of rasters, cut at the raster and brought to the
    output size by block means (edges repeated).  A raster is sent once for all its windows of a task."""
    keys = [c for c in windows.columns if c not in ("image", "x", "y", "w", "h", "out_w", "out_h")]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width)[r.y : r.y + r.h, r.x : r.x + r.w].astype(float)
                fy, fx = -(-a.shape[0] // r.out_h), -(-a.shape[1] // r.out_w)
                b = np.pad(a, ((0, fy * r.out_h - a.shape[0]), (0, fx * r.out_w - a.shape[1])), "edge")
                out = np.rint(b.reshape(r.out_h, fy, r.out_w, fx).mean(axis=(1, 3))).astype(np.uint8)
                rows.append((r.image, *(getattr(r, k) for k in keys), r.out_h, r.out_w, out.tobytes()))
            yield pd.DataFrame(rows, columns=["image", *keys, "height", "width", "pixels"])

    types = dict(windows.dtypes)
    schema = "image string, " + "".join(f"{k} {types[k]}, " for k in keys) + "height int, width int, pixels binary"
    return rasters.select("image", "height", "width", "pixels").join(windows, "image").mapInPandas(run, schema)


def pyramid_tiles(rasters: DataFrame, tile: int = 256) -> DataFrame:
    """Every tile of every level of the rasters' pyramids: image, level, column, row, height, width, pixels."""
    rows = pyramid(rasters.select("image", "width", "height"), tile)
    box = lambda at, size, side: F.least(F.col(size) * F.col("factor"), F.col(side) - F.col(at))
    windows = rows.select("image", "level", "column", "row", *(F.col(c).cast("int").alias(c) for c in ("x", "y")), box("x", "out_w", "width").cast("int").alias("w"), box("y", "out_h", "height").cast("int").alias("h"), F.col("out_w").cast("int").alias("out_w"), F.col("out_h").cast("int").alias("out_h"))
    return regions(rasters, windows)


def user_operator(rasters: DataFrame, process: Callable[[np.ndarray, dict], np.ndarray], parameters: dict, size: str = "preserve") -> DataFrame:
    """A user's function over rasters, with ``violation`` where it breaks its size contract or fails."""

    def run(batches):
        for pdf in batches:
            rows = []
            for image, h, w, p in pdf[["image", "height", "width", "pixels"]].itertuples(index=False):
                try:
                    out = np.asarray(process(np.frombuffer(bytes(p), np.uint8).reshape(h, w), parameters))
                    bad = "no raster" if out.ndim != 2 or out.dtype != np.uint8 else "size changed" if size == "preserve" and out.shape != (h, w) else None
                except Exception as e:  # a user's code may raise anything; the row says so
                    out, bad = None, type(e).__name__
                rows.append((image, *((None, None, None) if bad else (*out.shape, out.tobytes())), bad))
            yield pd.DataFrame(rows, columns=["image", "height", "width", "pixels", "violation"]).astype({"height": "Int32", "width": "Int32"})

    return rasters.select("image", "height", "width", "pixels").mapInPandas(run, SCHEMA + ", violation string")


def expand(steps: list, named: dict[str, list], depth: int = 4, most: int = 64) -> list:
    """Steps with composite names replaced by their lists, to a depth, without recursion."""

    def go(steps: list, left: int, seen: tuple) -> list:
        out = []
        for step in steps:
            if step in named if isinstance(step, str) else False:
                if step in seen or not left:
                    raise ValueError(f"{step} is nested in itself or too deep")
                out += go(named[step], left - 1, (*seen, step))
            else:
                out.append(step)
        return out

    out = go(steps, depth, ())
    if len(out) > most:
        raise ValueError("too many steps")
    return out


def pipeline(rasters: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], taps: tuple[int, ...] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """The raster frame after all steps, and after each tapped one (at most four).  A tap is a written table, from which
    the later steps go on, so its prefix runs once and nothing is held in memory."""
    if len(taps) > 4:
        raise ValueError("at most four taps")
    tapped, out = [], rasters
    for k, step in enumerate(steps):
        out = step(out)
        if k in taps:
            out = stored(out, "tap")
            tapped.append(out)
    return out, tapped
