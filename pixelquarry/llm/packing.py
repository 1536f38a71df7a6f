"""Mixture-controlled packing: deficit round-robin over source queues into sequences of fixed length.

Every source has a weight: its target share of the tokens, by default its share of all tokens.  A source whose share of
a sequence is ``OWN`` tokens or more is a queue; the others share one queue.  In each round a queue's deficit grows by
its weight's part of ``length`` tokens; it serves the whole tokens of its deficit and carries the fraction.  A queue
that has run out leaves its part to the others, by their weights, so every round has ``length`` tokens to the end.  The
rounds, one after the other, are one stream, and the sequences are its stretches of ``length`` tokens: each has the
target proportions of the queues that still have tokens, to within a token a queue and a round; none but the last is
padded, and every token is in exactly one piece.

In the shared queue a small source serves a whole document as soon as its deficit covers it: documents follow each other
by (tokens of the source up to their end) / weight, sorted by Spark.

What a queue has served after r rounds has a closed form, so any task can start at any round without the ones before:
deficits carry over between sequences and partitions alike.  The driver holds the totals of the queues (at most
``length / OWN`` + 1); where the sources of a task begin is a table that is joined, as a broadcast while it has at most
``BROADCAST`` rows.  The ids are encoded once, written, and read by the task that cuts them.

Nulls: a null text is an empty one, whose only token is the end mark; a null source is a source.  Rows are packed as
they come: equal ids or texts are not special.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CHUNK, encoder
from .shared import stored
from .textkit import chunks, ranges

LENGTH = 2048
OWN = 16
END = 1
BROADCAST = 1 << 20
_TOKENS = pa.schema([("task", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokens(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(task, row, doc_id, source, before, n, ids): each document's ids with the end mark, its place in its task, and how
    many tokens of its source its task has before it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, place = TaskContext.get().partitionId(), np.zeros(0, np.int64), 0
        known: dict[str | None, int] = {}
        enc = encoder(path)
        for batch in batches:
            source = batch.column("source").dictionary_encode(null_encoding="encode")
            number = np.array([known.setdefault(s, len(known)) for s in source.dictionary.to_pylist()], np.int64)
            before = np.concatenate([before, np.zeros(len(known) - len(before), np.int64)])
            queue = number[source.indices.to_numpy()]
            for row, rows_in, raw, off in chunks(batch.column("text"), CHUNK):
                ids, count = enc.chunk(raw, off)
                n = count + 1
                out = np.empty(int(n.sum()), enc.dtype)
                mark = np.cumsum(n) - 1
                body = np.ones(len(out), bool)
                body[mark] = False
                out[mark], out[body] = end, ids
                q = queue[row : row + rows_in]
                by = np.argsort(q, kind="stable")
                sums = np.cumsum(n[by]) - n[by]
                first = np.flatnonzero(np.diff(q[by], prepend=-1))
                at = np.empty(rows_in, np.int64)
                at[by] = sums - np.repeat(sums[first] - before[q[by[first]]], np.diff(np.append(first, rows_in)))
                np.add.at(before, q, n)
                places = place + np.arange(rows_in)
                place += rows_in
                blobs = pa.Array.from_buffers(pa.binary(), rows_in, [None, pa.py_buffer((np.append(0, np.cumsum(n)) * out.itemsize).astype(np.int32)), pa.py_buffer(out)]) if out.nbytes < 1 << 31 else pa.array([x.tobytes() for x in np.split(out, mark[:-1] + 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows_in, task, np.int32)), pa.array(places), batch.column("doc_id").slice(row, rows_in), batch.column("source").slice(row, rows_in), pa.array(at), pa.array(n), blobs], schema=_TOKENS)

    return rows.mapInArrow(encode, "task int, row long, doc_id long, source string, before long, n long, ids binary")


class Schedule:
    """Where the tokens of each queue are in the stream: queues with ``totals`` tokens are served by ``weights``.

    At virtual time v a queue has been granted weight * v tokens, at most its total; after r rounds as much time has
    passed as grants r * length tokens in all, a line that bends where a queue runs out."""

    def __init__(self, totals: np.ndarray, length: int, weights: np.ndarray | None = None):
        self.totals, self.length = np.asarray(totals, np.int64), length
        self.weights = np.asarray(self.totals if weights is None else weights, np.float64)
        self.rounds = -(-int(self.totals.sum()) // length)
        self.out = self.totals / np.where(self.weights > 0, self.weights, 1.0)
        self.time = np.unique(np.append(0.0, self.out))
        self.granted = np.array([np.minimum(self.totals, self.weights * t).sum() for t in self.time])

    def served(self, queue: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Tokens a queue has served after r rounds."""
        total, time = self.totals[queue], np.interp(np.asarray(r, np.float64) * self.length, self.granted, self.time)
        grown = np.floor(self.weights[queue] * time).astype(np.int64)
        return np.where((r >= self.rounds) | (time >= self.out[queue]), total, np.minimum(total, grown))

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round that serves a queue's token: the first after which more than ``token`` are served."""
        granted = np.interp((token + 1) / self.weights[queue], self.time, self.granted)
        r = np.clip(np.ceil(granted / self.length).astype(np.int64), 1, self.rounds)
        while (low := self.served(queue, r) <= token).any():
            r[low] += 1
        while (high := (r > 1) & (self.served(queue, r - 1) > token)).any():
            r[high] -= 1
        return r

    def position(self, queue: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Stream position of the first token that a queue serves in round r."""
        every = np.arange(len(self.totals))
        kinds, which = np.unique(r, return_inverse=True)
        old, new = self.served(every, (kinds - 1)[:, None]), self.served(every, kinds[:, None])
        turn = old.sum(axis=1)[:, None] + np.cumsum(new - old, axis=1) - (new - old)
        return turn[which, queue]

    def pieces(self, queue: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start in it, length, stream position) of the pieces of documents at ``begin`` in their queues."""
        first, last = self.round_of(queue, begin), self.round_of(queue, begin + n - 1)
        doc = np.repeat(np.arange(len(n)), last - first + 1)
        r = ranges(first, last - first + 1)
        q = queue[doc]
        start = self.served(q, r - 1)
        lo, hi = np.maximum(begin[doc], start), np.minimum((begin + n)[doc], self.served(q, r))
        at = np.concatenate([self.position(q[i : i + 8192], r[i : i + 8192]) for i in range(0, len(q), 8192)] or [np.empty(0, np.int64)])
        at += lo - start
        keep = hi > lo
        doc, lo, hi, at = doc[keep], lo[keep], hi[keep], at[keep]
        cuts = (at + hi - lo - 1) // self.length - at // self.length + 1
        part = np.repeat(np.arange(len(doc)), cuts)
        k = ranges(at // self.length, cuts)
        a, b = np.maximum(at[part], k * self.length), np.minimum((at + hi - lo)[part], (k + 1) * self.length)
        return doc[part], a - at[part] + lo[part] - begin[doc[part]], b - a, a


def weighted(sums: DataFrame, total: int, targets: Mapping[str | None, float] | None) -> Column:
    """Weight of each source of ``sums`` (source, total): its target share; sources without one divide what the targets
    leave by their tokens (at least a millionth of that share: they then come last)."""
    natural = F.col("total") / F.lit(float(total))
    if not targets:
        return natural
    if min(targets.values()) <= 0 or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target shares must be positive and add up to 1 at most")
    named = F.coalesce(*(F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in targets.items()))
    others = sums.where(named.isNull()).agg(F.sum("total")).first()[0] or total
    rest = max(1e-6, 1 - sum(targets.values())) / others
    return F.coalesce(named, F.col("total") * F.lit(rest))


def placed(made: DataFrame, length: int, targets: Mapping[str | None, float] | None) -> tuple[DataFrame, Schedule]:
    """``made`` (tokens) with ``queue`` and ``begin``, each document's place in its queue, and the schedule of the queues."""
    per_task = made.groupBy("task", "source").agg(F.sum("n").alias("n"))
    bases = stored(per_task.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("task")) - F.col("n")), "bases")
    sums = bases.groupBy("source").agg(F.sum("n").alias("total"))
    total, many = bases.agg(F.sum("n"), F.count("*")).first()
    sums = sums.withColumn("weight", weighted(sums, total or 0, targets))
    own = F.col("weight") * length >= OWN
    queues = sums.where(own).orderBy(F.desc("total"), F.asc_nulls_first("source")).collect()  # at most length / OWN rows
    small_total, small_weight = sums.where(~own).agg(F.sum("total"), F.sum("weight")).first()
    small = len(queues) if small_total else -1
    number = F.coalesce(*(F.when(F.col("source").eqNullSafe(F.lit(r["source"])), F.lit(i)) for i, r in enumerate(queues)), F.lit(small))
    schedule = Schedule(np.array([r["total"] for r in queues] + [small_total] * bool(small_total), np.int64), length, np.array([r["weight"] for r in queues] + [small_weight] * bool(small_total)))
    ranked = bases.join(sums.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s"))) if small_total else bases.withColumn("weight", F.lit(1.0))
    where = ranked.select(F.col("task").alias("_task"), F.col("source").alias("_source"), "base", "weight", number.cast("int").alias("queue"))
    met = (F.col("task") == F.col("_task")) & F.col("source").eqNullSafe(F.col("_source"))
    out = made.join(F.broadcast(where) if many <= BROADCAST else where, met).withColumn("begin", F.col("base") + F.col("before"))
    if small_total:
        turns = by_turn(out.where(F.col("queue") == small).select("task", "row", "source", F.col("n"), ((F.col("begin") + F.col("n")) / F.col("weight")).alias("turn")))
        out = out.join(turns, ["task", "row"], "left").withColumn("begin", F.coalesce("turn_begin", "begin"))
    return out, schedule


def by_turn(rows: DataFrame) -> DataFrame:
    """(task, row, turn_begin): tokens of all rows of an earlier turn.  Rows are sorted by range; the sums of the ranges go
    through the driver, one number for each."""
    ordered = stored(rows.repartitionByRange("turn", "source", "task", "row").sortWithinPartitions("turn", "source", "task", "row").withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("part").orderBy("turn", "source", "task", "row").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dict(ordered.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, at = [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    begins = rows.sparkSession.createDataFrame(starts, "part int, part_begin long")
    out = ordered.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return out.join(F.broadcast(begins), "part").select("task", "row", (F.col("part_begin") + F.col("within")).alias("turn_begin"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, targets: Mapping[str | None, float] | None = None) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text, source): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    source.  ``targets`` maps sources to their wanted shares of each sequence."""
    path = path or tokenizer_path()
    made = stored(tokens(docs, path, end), "tokens", compression="zstd")
    rows, schedule = placed(made, length, targets)
    plan, dtype = docs.sparkSession.sparkContext.broadcast(schedule), encoder(path).dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = plan.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = batch.slice(i, 500)
                queue, begin, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("queue", "begin", "n"))
                doc, start, size, at = schedule.pieces(queue, begin, n)
                ids = [memoryview(np.frombuffer(x.as_buffer(), dtype).astype("<u4")).cast("B") for x in rows.column("ids")]
                crc = [zlib.crc32(ids[d][4 * a : 4 * (a + m)]) for d, a, m in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(of), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(at // length), pa.array(at % length), rows.column("source").take(of)], names=[f.split()[0] for f in PIECES.split(", ")])

    return rows.select("doc_id", "source", "queue", "begin", "n", "ids").mapInArrow(cut, PIECES)
