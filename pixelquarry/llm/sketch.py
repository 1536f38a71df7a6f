"""Count-min sketches in shards that stay a table: what rows get back are the cells that their own keys hit.

Rows are dealt into buckets by their own hash.  A first pass over the texts sends, per sketch row, shard of cells and
bucket, the cells that the bucket's keys hit (repeated as often as hit, up to the highest level), as differences of
sorted cells.  A shuffle by shard adds up each shard by itself: of all keys that share a cell the counts add, so a cell
reaches a level whenever a key's true count does.  Each shard answers each bucket with those of its cells that reach a
level.  The second pass deals texts and answers out by bucket, answers first, and streams: a bucket's texts meet the part
of the sketch that they can ask for, and no other.

Nothing is broadcast or gathered: the width grows with the input, and with it the number of shards and of buckets, each
of a fixed size.  A shard holds one number a cell, a bucket the cells its texts hit.  Texts move once.  A cell that every
row hits is sent once a flush and bucket, ``most`` times at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parts
from .textkit import chunks, mix

#: (text, key) of the keys of a chunk's texts.
Pairs = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_SENT = pa.schema([("shard", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary()), ("cells", pa.binary())])
_ANSWER = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("level", pa.int32()), ("cells", pa.binary())])


class Layout(NamedTuple):
    """Cells of a shard (a power of two), bytes of text for a bucket, keys that a task holds before it sends, and cells of a
    row of the sketch for each key, and rows.  One wide row sends half of what two narrow ones do."""

    shard_bits: int = 22
    bucket_bytes: int = 8 << 20
    flush: int = 1 << 21
    cells_per_key: float = 6
    rows: int = 2


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys, 11 + row) >> np.uint64(64 - bits)).astype(np.int64)


def packed(x: np.ndarray, begin: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Runs of sorted non-negative integers (each starts at ``begin``) as bytes of differences, seven bits a byte, the last
    byte of a number marked; and where the runs' bytes begin, with the end."""
    step = np.diff(x, prepend=0)
    step[begin] = x[begin]
    size = np.ones(len(x), np.int64)
    for k in range(7, 63, 7):
        more = step >> k > 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    left = np.arange(len(x))
    for k in range(int(size.max()) if len(x) else 0):  # the k-th byte from the end
        left = left[size[left] > k]
        out[ends[left] - 1 - k] = (step[left] >> (7 * k)) & 127
    out[ends - 1] |= 128
    return out.tobytes(), np.append(np.concatenate([[0], ends])[begin], len(out))


def unpacked(data: bytes, counts: np.ndarray) -> np.ndarray:
    """The integers of ``packed`` runs laid end to end, ``counts`` of them in each (none is empty)."""
    x = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(x & 128)
    first = np.concatenate([[0], last[:-1] + 1])
    step = (x[last] & 127).astype(np.int64)
    size = last - first + 1
    live = np.flatnonzero(size > 1)
    k = 1
    while len(live):
        step[live] += (x[last[live] - k] & 127).astype(np.int64) << (7 * k)
        k += 1
        live = live[size[live] > k]
    total = np.cumsum(step)
    begin = np.cumsum(counts) - counts
    base = total[begin] - step[begin]
    return total - np.repeat(base, counts)


def _blobs(data: bytes, cut: np.ndarray) -> pa.Array:
    """Stretches of ``data`` from each place in ``cut`` to the next."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _sorted_cells(at: np.ndarray, bucket: np.ndarray, shard_bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, bucket, cell in the shard), sorted: as one number each where that fits."""
    room = max(1, int(buckets - 1).bit_length())
    inside = (1 << shard_bits) - 1
    if int(at.max(initial=0)) >> shard_bits < 1 << (63 - shard_bits - room):
        x = np.sort(((at >> shard_bits) << (room + shard_bits)) | (bucket << shard_bits) | (at & inside))
        return x >> (room + shard_bits), (x >> shard_bits) & ((1 << room) - 1), x & inside
    order = np.lexsort((at & inside, bucket, at >> shard_bits))
    return at[order] >> shard_bits, bucket[order], at[order] & inside


class Sketch:
    """The part of the merged sketch that a bucket can ask for: per level and row the sorted cells that reach it."""

    def __init__(self, bits: int, levels: tuple[int, ...], rows: int):
        self.bits, self.rows = bits, rows
        self._new: dict[tuple[int, int], list[np.ndarray]] = {(level, row): [] for level in levels for row in range(rows)}
        self._all: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def learn(self, level: int, row: int, found: np.ndarray) -> None:
        self._new[level, row].append(found)

    def _cells(self, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted cells, and a table of their last bits, which most others miss."""
        new = self._new[level, row]
        if new or (level, row) not in self._all:
            old = self._all[level, row][0] if (level, row) in self._all else np.empty(0, np.int64)
            have = np.sort(np.concatenate([old, *new]))
            some = np.zeros(1 << min(22, int(8 * len(have) + 1).bit_length()), bool)
            some[have & (len(some) - 1)] = True
            self._all[level, row] = have, some
            new.clear()
        return self._all[level, row]

    def reaches(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Whether each key's estimate is at least ``level``; true for every key whose count is."""
        live = np.arange(len(keys))
        for row in range(self.rows):
            have, some = self._cells(level, row)
            if not len(have):
                return np.zeros(len(keys), dtype=bool)
            at = cells(keys[live], row, self.bits)
            maybe = np.flatnonzero(some[at & (len(some) - 1)])
            at = at[maybe]
            live = live[maybe[have[np.minimum(np.searchsorted(have, at), len(have) - 1)] == at]]
        out = np.zeros(len(keys), dtype=bool)
        out[live] = True
        return out


def text_bytes(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


class Lookup:
    """Estimates of how often the keys of the texts of ``rows`` occur, in all of them.

    ``apply`` runs a function over the rows: its batches come with a ``Sketch`` whose ``reaches(keys, level)`` is true for
    every key of the batch whose count is at least the level, and for few others."""

    def __init__(self, rows: DataFrame, pairs_of: Pairs, keys_per_byte: float, levels: tuple[int, ...], layout: Layout = Layout()):
        self.text_bytes = text_bytes(rows)
        keys = max(1.0, layout.cells_per_key * keys_per_byte * self.text_bytes)
        self.bits = min(60, max(layout.shard_bits, int(np.ceil(np.log2(keys)))))
        self.levels, self.layout = levels, layout
        buckets = max(1, -(-self.text_bytes // layout.bucket_bytes))
        own = F.xxhash64(*(c for c in rows.columns if c != "text"), F.xxhash64("text")) if len(rows.columns) > 1 else F.xxhash64("text")
        self.rows = rows.withColumn("_bucket", F.pmod(own, F.lit(buckets)).cast("long"))
        self.answers = self._answers(pairs_of)

    def _answers(self, pairs_of: Pairs) -> DataFrame:
        bits, levels, shard_bits, flush = self.bits, self.levels, self.layout.shard_bits, self.layout.flush
        most, per_row, rows = max(levels), 1 << (bits - shard_bits), self.layout.rows

        def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            """One row for each shard: its cells by bucket, with the buckets and how many cells each has."""
            bucket, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            names, bucket = np.unique(bucket, return_inverse=True)
            for row in range(rows):
                shard, of, cell = _sorted_cells(cells(keys, row, bits), bucket, shard_bits, len(names))
                if len(cell) > most:  # no more of a cell and bucket than the highest level counts
                    keep = np.concatenate([np.ones(most, bool), (cell[most:] != cell[:-most]) | (of[most:] != of[:-most]) | (shard[most:] != shard[:-most])])
                    shard, of, cell = shard[keep], of[keep], cell[keep]
                new = np.concatenate([[True], shard[1:] != shard[:-1]])
                begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]) | new)  # of each bucket in each shard
                data, cut = packed(cell, begin)
                first = np.append(np.flatnonzero(new[begin]), len(begin))  # of each shard, among the buckets
                count = np.diff(np.append(begin, len(cell))).astype(np.int32)
                columns = (_blobs(names[of[begin]].tobytes(), 8 * first), _blobs(count.tobytes(), 4 * first), _blobs(data, cut[first]))
                yield pa.RecordBatch.from_arrays([pa.array(row * per_row + shard[begin[first[:-1]]]), *columns], schema=_SENT)

        def partition_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for batch in batches:
                bucket = batch.column("_bucket").to_numpy()
                for first, _, raw, off in chunks(batch.column("text")):
                    text, keys = pairs_of(raw, off)
                    held.append((bucket[first + text], keys))
                    size += len(keys)
                    if size >= flush:
                        yield from send(held)
                        held, size = [], 0
            if size:
                yield from send(held)

        def answer(shard: int, held: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            bucket, count = (np.concatenate([np.frombuffer(h[i], t) for h in held]) for i, t in ((0, np.int64), (1, np.int32)))
            at = np.concatenate([unpacked(h[2], np.frombuffer(h[1], np.int32).astype(np.int64)) for h in held])
            of = np.repeat(bucket, count)
            total = np.bincount(at)
            for level in levels:
                pick = np.flatnonzero(total[at] >= level)
                if not len(pick):
                    continue
                order = pick[np.lexsort((at[pick], of[pick]))]
                a, o = at[order], of[order]
                keep = np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])])
                a, o = a[keep], o[keep]
                begin = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                data, cut = packed(a, begin)
                yield pa.RecordBatch.from_arrays([pa.array(o[begin]), pa.array(np.full(len(begin), shard)), pa.array(np.full(len(begin), level, np.int32)), _blobs(data, cut)], schema=_ANSWER)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[bytes, bytes, bytes]] = []
            now = -1
            for batch in batches:
                for shard, *blobs in zip(*(batch.column(c).to_pylist() for c in _SENT.names), strict=True):
                    if shard != now and held:
                        yield from answer(now, held)
                        held = []
                    now = shard
                    held.append(tuple(blobs))
            if held:
                yield from answer(now, held)

        sent = self.rows.select("_bucket", "text").mapInArrow(partition_sketch, "shard long, buckets binary, counts binary, cells binary")
        sent = sent.repartition(parts(sent.sparkSession), "shard").sortWithinPartitions("shard")
        return sent.mapInArrow(merge, "bucket long, shard long, level int, cells binary")

    def apply(self, f: Callable[[Iterator[tuple[pa.RecordBatch, Sketch]]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
        """``f`` over the rows; a bucket's rows come with what the sketch tells about it."""
        bits, levels, per_row, shard_bits, depth = self.bits, self.levels, 1 << (self.bits - self.layout.shard_bits), self.layout.shard_bits, self.layout.rows
        columns = [c for c in self.rows.columns if c != "_bucket"]
        told = self.answers.select(F.col("bucket").alias("_bucket"), F.lit(0).alias("_kind"), "shard", "level", "cells", *(F.lit(None).cast(self.rows.schema[c].dataType).alias(f"_{i}") for i, c in enumerate(columns)))
        asked = self.rows.select("_bucket", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("shard"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("binary").alias("cells"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Sketch]]:
            sketch, now = Sketch(bits, levels, depth), -1
            for batch in batches:
                bucket, kind = batch.column("_bucket").to_numpy(), batch.column("_kind").to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(bucket) else []
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    if bucket[lo] != now:
                        sketch, now = Sketch(bits, levels, depth), bucket[lo]
                    part = batch.slice(lo, hi - lo)
                    if kind[lo]:
                        yield pa.RecordBatch.from_arrays([part.column(f"_{i}") for i in range(len(columns))], names=columns), sketch
                        continue
                    for shard, level, blob in zip(part.column("shard").to_pylist(), part.column("level").to_pylist(), part.column("cells"), strict=True):
                        row, s = divmod(shard, per_row)
                        data = blob.as_py()
                        n = int((np.frombuffer(data, np.uint8) >> 7).sum())
                        sketch.learn(level, row, unpacked(data, np.array([n])) + (s << shard_bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(stream(batches))

        rows = told.unionByName(asked)
        return rows.repartition(parts(rows.sparkSession), "_bucket").sortWithinPartitions("_bucket", "_kind").mapInArrow(run, schema)
