"""Exact ranks of any number of values a key, by counting instead of sorting.

A number's IEEE bits, turned so that they order like it, are read as four digits of 16 bits.  Each round counts one digit
below the digits found so far, so a key has 65,536 counts at most, and goes on in the bucket that holds the wanted rank.
After four rounds the value is known; no task ever holds a key's values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored

DIGIT = 16
_TURN = np.int64((1 << 63) - 1)


def counted(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, bits, c): how often each value of a key occurs, nulls left out; stored."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), (F.col(value).cast("double") + 0.0).alias("value")).agg(F.count("*").alias("c"))
    schema = T.StructType([*counts.schema.fields, T.StructField("bits", T.LongType())])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("value").to_numpy().copy()
            x[np.isnan(x)] = np.nan  # one NaN, behind all numbers
            b = x.view(np.int64)
            yield batch.append_column("bits", pa.array(b ^ ((b >> np.int64(63)) & _TURN)))

    return stored(counts.mapInArrow(bits, schema), "counted")


def _doubles(found: DataFrame) -> DataFrame:
    schema = T.StructType([f for f in found.schema.fields if f.name != "bits"] + [T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("bits").to_numpy()
            x = (b ^ ((b >> np.int64(63)) & _TURN)).view(np.float64)
            rest = batch.drop_columns(["bits"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(x)], names=[*rest.schema.names, "value"])

    return found.mapInArrow(run, schema)


def at_ranks(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, mark, value): the value at each of ``ranks`` (key, mark, rank from 0) of ``counted`` values."""
    state = ranks.select(F.col("key").alias("of"), "mark", F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift + DIGIT == 64
        digit = F.shiftright("bits", shift) if first else F.shiftright("bits", shift).bitwiseAND((1 << DIGIT) - 1)
        below = F.lit(0).cast("long") if first else F.shiftright("bits", shift + DIGIT)
        here = counts.select("key", digit.alias("digit"), below.alias("below"), "c")
        if first:  # the same counts serve all marks
            here = here.groupBy("key", "digit", "below").agg(F.sum("c").alias("c"))
        met = here.join(state, F.col("key").eqNullSafe(F.col("of")) & (F.col("below") == F.col("prefix")))
        met = met.groupBy("of", "mark", "rank", "prefix", "digit").agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("of", "mark").orderBy("digit"))  # over one digit's counts
        hit = met.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        state = hit.select("of", "mark", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), (F.col("prefix") * (1 << DIGIT) + F.col("digit")).alias("prefix"))
    return _doubles(state.select(F.col("of").alias("key"), "mark", F.col("prefix").alias("bits")))


def summaries(counts: DataFrame) -> DataFrame:
    """key, n, min, max and mean of ``counted`` values."""
    mean = F.sum(F.col("value") * F.col("c")) / F.sum("c")
    return counts.groupBy("key").agg(F.sum("c").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), mean.alias("mean"))


def quantiles(counts: DataFrame, places: dict[str, Column]) -> DataFrame:
    """``summaries`` with a column for each of ``places``, ranks as columns of n; a broken rank is between its neighbours, as
    far as its fraction says."""
    known = summaries(counts)
    ends = [(f"{name} {end}", f(place).cast("long")) for name, place in places.items() for end, f in (("low", F.floor), ("high", F.ceil))]
    wanted = F.explode(F.array(*(F.struct(F.lit(mark).alias("mark"), rank.alias("rank")) for mark, rank in ends))).alias("w")
    found = at_ranks(counts, known.select("key", wanted).select("key", "w.*"))
    each = found.groupBy(F.col("key").alias("of")).agg(*(F.max(F.when(F.col("mark") == mark, F.col("value"))).alias(mark) for mark, _ in ends))
    joined = known.join(each, F.col("key").eqNullSafe(F.col("of")))

    def between(name: str, place: Column) -> Column:
        low, high, share = F.col(f"`{name} low`"), F.col(f"`{name} high`"), place - F.floor(place)
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name)

    return joined.select("key", "n", "min", "max", "mean", *(between(name, place) for name, place in places.items()))
