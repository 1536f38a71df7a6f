"""Feature vectors: projections, principal axis and normalising."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let


def token_projection(tokens: DataFrame, key: str, vector: str, how: str, channel: int = 0) -> DataFrame:
    """One vector or value per key from its tokens' vectors: mean, max, or the channel of each token in order."""
    if how == "channel":
        ordered = F.array_sort(F.collect_list(F.struct("token", F.get(vector, F.lit(channel)).cast("double").alias("v"))))
        return tokens.groupBy(key).agg(F.transform(ordered, lambda s: s["v"]).alias("projected"))
    parts = tokens.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("c", "v"))
    by = parts.groupBy(key, "c").agg((F.avg if how == "mean" else F.max)("v").alias("v"))
    return by.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("projected"))


def shaped_projection(values: str, shape: str, how: str, channel: int = 0) -> Column:
    """A tensor (row-major ``values`` and ``shape``) projected over its channels, as a struct of values and shape.

    C stays.  TC (tokens by channels) gives a value a token, one token its vector; NTC a map for each n, square if its
    tokens make a square, else one row; NCHW one channel.  ``how``: mean, max, channel, none, or token_grid: the mean,
    as a square grid of the tokens, an error if they make none.  So are a channel beyond the tensor's and other shapes."""
    if how not in ("mean", "max", "channel", "none", "token_grid"):
        raise ValueError(f"no such projection: {how}")
    rank, dims = f"size({shape})", f"transform({shape}, d -> cast(d AS bigint))"
    c = f"CASE {rank} WHEN 2 THEN get({dims}, 1) WHEN 3 THEN get({dims}, 2) ELSE get({dims}, 1) END"
    inner = f"CASE {rank} WHEN 4 THEN get({dims}, 2) * get({dims}, 3) ELSE 1L END"
    tokens = f"CASE {rank} WHEN 2 THEN get({dims}, 0) WHEN 3 THEN get({dims}, 1) ELSE 1L END"
    fits = f"size({values}) = aggregate({dims}, 1L, (s, d) -> s * d)"
    x = "x.v[cast(((o div x.inner) * x.c + {0}) * x.inner + o % x.inner AS int)]"
    over = "sequence(0L, x.c - 1)"
    one = {"max": f"array_max(transform({over}, k -> {x.format('k')}))", "channel": x.format(f"{channel}L")}.get(how, f"aggregate({over}, 0D, (s, k) -> s + {x.format('k')}) / x.c")
    every = f"CASE WHEN size(x.v) = 0 THEN x.v ELSE transform(sequence(0L, size(x.v) div x.c - 1), o -> {one}) END"
    side = "cast(round(sqrt(x.tokens)) AS bigint)"
    square = f"{side} * {side} = x.tokens"
    grid = how == "token_grid"
    to = f"CASE x.rank WHEN 2 THEN {f'array({side}, {side})' if grid else 'array(x.tokens)'} WHEN 3 THEN array(get(x.dims, 0), 1L, CASE WHEN {square} THEN {side} ELSE 1L END, CASE WHEN {square} THEN {side} ELSE x.tokens END) ELSE array(get(x.dims, 0), 1L, get(x.dims, 2), get(x.dims, 3)) END"
    same = "x.rank = 1 OR x.rank = 2 AND get(x.dims, 0) = 1" + (" OR x.rank <= 4" if how == "none" else "")
    wrong = "CASE WHEN NOT x.fits THEN 'values do not fill the shape' WHEN x.rank NOT BETWEEN 1 AND 4 THEN 'no C, TC, NTC or NCHW tensor'"
    wrong += f" WHEN NOT ({same}) AND {channel} >= x.c THEN 'no such channel'" if how == "channel" else ""
    wrong += f" WHEN NOT ({same}) AND x.rank IN (2, 3) AND NOT ({square}) THEN 'tokens make no square'" if grid else ""
    whole = "named_struct('values', x.v, 'shape', CASE WHEN x.rank = 2 AND get(x.dims, 0) = 1" + (" AND false" if how == "none" else "") + " THEN array(get(x.dims, 1)) ELSE x.dims END)"
    body = f"CASE WHEN {wrong} END IS NOT NULL THEN raise_error({wrong} END) WHEN {same} THEN {whole} ELSE named_struct('values', {every}, 'shape', {to}) END"
    bound = f"named_struct('v', transform({values}, v -> cast(v AS double)), 'dims', {dims}, 'rank', {rank}, 'c', {c}, 'inner', {inner}, 'tokens', {tokens}, 'fits', {fits})"
    return F.expr(f"transform(array({bound}), x -> {body})[0]")


def principal_axis(vectors: DataFrame, vector: str, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axis) of all vectors: each task adds up sums and products of its vectors, Spark adds up the
    tasks', and a few power steps run on the d x d covariance.  The sign is such that the first loading that is not zero is positive."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = None, None, 0
        for batch in batches:
            lists = batch.column("v")
            v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))
            if len(v):
                total = v.T @ v + (0 if total is None else total)
                sums, n = v.sum(axis=0) + (0 if sums is None else sums), n + len(v)
        if n:
            i, j = np.divmod(np.arange(total.size), len(sums))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel()), pa.array(sums[i]), pa.array(np.full(total.size, n))], names=["i", "j", "xy", "x", "n"])

    v = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    rows = v.mapInArrow(partial, "i int, j int, xy double, x double, n long").groupBy("i", "j").agg(F.sum("xy").alias("xy"), F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # d * d rows
    if not rows:
        return np.empty(0), np.empty(0)
    d = max(r["i"] for r in rows) + 1
    xy, mean = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        xy[r["i"], r["j"]], mean[r["i"]] = r["xy"] / r["n"], r["x"] / r["n"]
    covariance, axis = xy - np.outer(mean, mean), np.ones(d) / np.sqrt(d)
    for _ in range(steps):
        new = covariance @ axis
        size = np.linalg.norm(new)
        if size < 1e-12:
            break
        axis = new / size
    first = axis[np.abs(axis) > 1e-12]
    return mean, axis if not len(first) or first[0] > 0 else -axis


def project(vector: Column, mean: np.ndarray, axis: np.ndarray) -> Column:
    """Coordinate along the axis."""
    terms = F.zip_with(vector.cast("array<double>"), F.array(*(F.lit(float(a)) for a in axis)), lambda v, a: v * a)
    return F.aggregate(terms, F.lit(-float(mean @ axis)), lambda s, v: s + v)


def finite(x: Column, fill: float = 0.0) -> Column:
    """Values that are no finite numbers become ``fill``."""
    return F.transform(x.cast("array<double>"), lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(fill)).otherwise(v))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _with(x: Column, body, **values) -> Column:
    """``body`` of the vector and values of it, each computed once per vector."""
    return let(x, lambda v: let(F.struct(v.alias("x"), *(f(v).alias(n) for n, f in values.items())), body))


def minmax(x: Column) -> Column:
    scaled = lambda s: F.transform(s["x"], lambda v: F.coalesce((v - s["low"]) / F.nullif(s["high"] - s["low"], F.lit(0.0)), F.lit(0.0)))
    return _with(x, scaled, low=F.array_min, high=F.array_max)


def zscore(x: Column) -> Column:
    """By the deviation of the whole population."""
    centred = _with(x, lambda s: F.transform(s["x"], lambda v: v - s["mean"]), mean=lambda v: _total(v) / F.size(v))
    scaled = lambda s: F.transform(s["x"], lambda v: F.coalesce(v / F.nullif(s["deviation"], F.lit(0.0)), F.lit(0.0)))
    return _with(centred, scaled, deviation=lambda c: F.sqrt(_total(F.transform(c, lambda v: v * v)) / F.size(c)))


def unit(x: Column) -> Column:
    scaled = lambda s: F.transform(s["x"], lambda v: F.coalesce(v / F.nullif(s["size"], F.lit(0.0)), F.lit(0.0)))
    return _with(x, scaled, size=lambda c: F.sqrt(_total(F.transform(c, lambda v: v * v))))


def clip_percentiles(x: Column, low: float, high: float) -> Column:
    """Values cut at linearly interpolated percentiles of their vector."""

    def at(q: float):
        def value(s: Column) -> Column:
            place = (F.size(s) - 1) * F.lit(q)
            k = F.floor(place).cast("int")
            a, b = F.get(s, k), F.get(s, F.least(k + 1, F.size(s) - 1))
            return a + (b - a) * (place - k)

        return lambda v: let(F.array_sort(v), value)

    return _with(x, lambda s: F.transform(s["x"], lambda v: F.least(F.greatest(v, s["low"]), s["high"])), low=at(low), high=at(high))


def gamma(x: Column, power: float, gain: float = 1.0) -> Column:
    """Power of the size, the sign kept."""
    return F.transform(x, lambda v: F.signum(v) * F.pow(F.abs(v), F.lit(power)) * gain)


def depth(x: Column, invert: bool = False, low: float = 0.02, high: float = 0.98) -> Column:
    """Depth values to 0..1 after a cut at percentiles."""
    out = minmax(clip_percentiles(finite(x), low, high))
    return F.transform(out, lambda v: 1 - v) if invert else out
