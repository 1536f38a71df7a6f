"""Exact top-k inner products of integer vectors, by buckets of similar length.

Vectors are cut into buckets by length (a tenth of a power of two apart), large buckets into blocks.  A first pass
gives every query a score that k of its candidates reach: its k-th best in the longest block of each part of the
table.  With that score t, a bucket of greatest length l can hold better candidates of query q only if their cosine
with q is at least t / (|q| l):

* above 1 the bucket is skipped,
* below ``COORDINATE`` candidates are pruned by length, |v| >= t / |q|,
* else also by coordinates: on q's largest coordinates, a unit vector that close to q/|q| lies in an interval.

What is left is verified by its exact product, and t rises with what is found.

Components x become floor(scale * x); products are exact in double precision while dimension * max**2 < 2**53, and
computed in Python integers beyond that (scores are then clamped to 64 bits).  Vectors null or holding null or
non-finite components take no part; a query's candidates have as many components as it.  Rows with a null id take no
part as queries or candidates.  Equal scores go to the smaller id, a query never meets rows of its own id, and rows that
are equal otherwise each count.

Query blocks are sent to groups of ``GROUP`` vector blocks of like length, and only to those whose longest vector can
reach the score that one of the block's queries has for sure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import parts, stored

SCALE = 256.0
BLOCK = 1024
QUERY_BLOCK = 256
SAMPLE_BLOCKS = 64
GROUP = 16
COORDINATE = 0.6
FOCUS = 4
_BLOCKS = pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_EXACT = float(2**53)


def usable(vector: str) -> Column:
    """Neither null nor holding a null or non-finite component."""
    x = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.float64).reshape(len(i), dim)


def blocks(rows: DataFrame, salts: int) -> DataFrame:
    """Rows (id, x) packed by dimension, length bucket and one of ``salts`` salts, so no length fills one block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        key = None
        for batch in batches:
            for dim, bucket, salt, i, x in zip(*(batch.column(c).to_pylist() for c in ("dim", "bucket", "salt", "id")), batch.column("x"), strict=True):
                if (dim, bucket, salt) != key or len(held) >= 4 * BLOCK:
                    if held:
                        yield block(held, key[0])
                    held, key = [], (dim, bucket, salt)
                held.append((i, x.values.to_numpy()))
        if held:
            yield block(held, key[0])

    def block(held: list[tuple[int, np.ndarray]], dim: int) -> pa.RecordBatch:
        v = np.array([x for _, x in held], np.float64).reshape(len(held), dim)
        norm = np.sqrt((v * v).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        ids = np.array([i for i, _ in held], np.int64)[order]
        return pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([dim], pa.int32()), pa.array([float(norm[order[0]])]), pa.array([ids.tobytes()], pa.binary()), pa.array([v[order].tobytes()], pa.binary())], schema=_BLOCKS)

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    dealt = salted.repartition(parts(rows.sparkSession), "dim", "bucket", "salt").sortWithinPartitions("dim", "bucket", "salt", "id")
    return dealt.select("dim", "bucket", "salt", "id", "x").mapInArrow(pack, "part long, dim int, longest double, ids binary, vectors binary")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of q with rows of v."""
    if not v.size or not q.size or float(np.abs(q).max()) * float(np.abs(v).max()) * v.shape[1] < _EXACT:
        return (q @ v.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    exact = big(q) @ big(v).T
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -scores.astype(np.float64), -scores))
    return order[:k]


def search_block(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """For each query the candidates of one block, longest first, that may be among its k best: at most k of them."""
    out: list[tuple[int, int, int]] = []
    if not len(v):
        return out
    norm = np.sqrt((v * v).sum(axis=1))
    safe = norm * (1 + 1e-9)
    unit = v / np.where(norm > 0, norm, 1)[:, None]
    qnorm = np.sqrt((q * q).sum(axis=1))
    everything = np.flatnonzero(~np.isfinite(floor) | (floor <= 0) | (qnorm == 0))
    plan = {int(i): None for i in everything}
    focused: dict[int, np.ndarray] = {}
    for i in np.setdiff1d(np.arange(len(q)), everything):
        local = floor[i] / (qnorm[i] * safe[0])
        if local > 1:
            continue
        reach = int(np.searchsorted(-safe, -floor[i] / qnorm[i], "right"))
        if local < COORDINATE:
            plan[int(i)] = np.arange(reach)
            continue
        side = q[i] / qnorm[i]
        near = np.ones(reach, bool)
        for f in np.argsort(-np.abs(side))[:FOCUS]:
            slack = np.sqrt(max(0.0, (1 - side[f] ** 2) * (1 - local**2))) + 1e-9
            near &= np.abs(unit[:reach, f] - side[f] * local) <= slack if abs(side[f]) <= local else _beyond(unit[:reach, f], side[f], local, slack)
        focused[int(i)] = np.flatnonzero(near)
    whole = [i for i, at in plan.items() if at is None or len(at) > len(v) // 2]
    if whole:  # most of the block: one matrix product
        scores = products(q[whole], v)
        for row, i in enumerate(whole):
            out += _keep(qid[i], vid, scores[row], floor[i], k)
    for i, at in [*((i, a) for i, a in plan.items() if i not in set(whole)), *focused.items()]:
        if len(at):
            out += _keep(qid[i], vid[at], products(q[i : i + 1], v[at])[0], floor[i], k)
    return out


def _beyond(x: np.ndarray, side: float, local: float, slack: float) -> np.ndarray:
    """The interval where the query's own coordinate exceeds the cosine: it then reaches the unit bound on that side."""
    low, high = side * local - slack, side * local + slack
    return x >= low if side > 0 else x <= high


def _keep(qid: int, ids: np.ndarray, scores: np.ndarray, floor: float, k: int) -> list[tuple[int, int, int]]:
    ok = (ids != qid) & (scores >= floor)
    ids, scores = ids[ok], scores[ok]
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= cut], scores[scores >= cut]
    best = _top(ids, scores, k)
    return [(int(qid), int(ids[j]), int(scores[j])) for j in best]


def top_products(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest exact scores of each row that ``queries`` selects against every
    row of another id."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector) & F.col(id_column).isNotNull())
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.when(F.abs(v) < 2.0**50, F.floor(v * scale).cast("double")).otherwise(v * scale))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), x.alias("x"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    rows = rows.withColumn("dim", F.size("x")).withColumn("bucket", F.floor(10 * F.log2(length + 1.0)).cast("long"))
    many, asking = rows.agg(F.count("*"), F.count_if("is_query")).first()
    index = stored(blocks(rows, -(-many // BLOCK) or 1), "vectors")
    asked = blocks(rows.where("is_query").withColumn("bucket", F.lit(0).cast("long")), -(-asking // QUERY_BLOCK) or 1)
    asked = stored(asked.select(F.col("part").alias("q_part"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "queries")
    n_blocks = index.count()

    def met(asked: DataFrame, index: DataFrame, salts: int) -> DataFrame:
        """Each block of queries with each block of vectors that can win: queries are sent once to a group of blocks of
        one dimension, octave of length and salt, if its longest vector is long enough."""
        index = index.withColumn("octave", F.floor(F.log2(F.col("longest") + 1)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(salts)).cast("int"))
        groups = index.groupBy("dim", "octave", "salt").agg(F.max("longest").alias("far"))
        sent = asked.join(groups, "dim").where(F.col("far") * (1 + 1e-9) >= F.col("reach")).drop("far")
        return sent.join(index, ["dim", "octave", "salt"]).where(F.col("longest") * (1 + 1e-9) >= F.col("reach"))

    def search(floors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                    dim = get("dim")
                    qid, q = _unpack(get("q_ids"), get("q_vectors"), dim)
                    vid, v = _unpack(get("ids"), get("vectors"), dim)
                    floor = np.frombuffer(get("floors"), np.float64) if floors else np.full(len(qid), -np.inf)
                    found = search_block(q, qid, floor, v, vid, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, schema=_FOUND)

        return run

    found = "query_id long, vec_id long, score long"
    # the stated queries against a few of the longest blocks: scores that k candidates reach
    longest = index.select("part", "longest").orderBy(F.desc("longest"), "part").limit(max(1, min(SAMPLE_BLOCKS, n_blocks // 16))).select("part").distinct()
    first = met(asked.withColumn("reach", F.lit(0.0)), index.join(longest, "part", "left_semi"), max(1, min(SAMPLE_BLOCKS, n_blocks // 16))).mapInArrow(search(False), found)
    reached = best(first, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    ids = asked.select("q_part", "dim", "q_ids", "q_vectors")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, dim, blob, vectors in zip(*(batch.column(c).to_pylist() for c in ("q_part", "dim", "q_ids", "q_vectors")), strict=True):
                i, q = _unpack(blob, vectors, dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), part)), pa.array(i), pa.array(np.arange(len(i), dtype=np.int32)), pa.array(np.sqrt((q * q).sum(axis=1)))], names=["q_part", "query_id", "at", "length"])

    floors = ids.mapInArrow(unfold, "q_part long, query_id long, at int, length double").join(reached, "query_id", "left")
    floors = floors.withColumn("f", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))))
    # a vector as long as this reaches the floor of a query in the block, were it to point the same way
    reach = F.min(F.when((F.col("f") > 0) & (F.col("length") > 0), F.col("f") / F.col("length")).otherwise(0.0)).alias("reach")
    floors = floors.groupBy("q_part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "f"))), lambda s: s["f"]).alias("f"), reach)

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("q_part"), batch.column("reach"), pa.array([np.array(x, np.float64).tobytes() for x in batch.column("f").to_pylist()], pa.binary())], names=["q_part", "reach", "floors"])

    asked = stored(asked.join(floors.select("q_part", "f", "reach").mapInArrow(binary, "q_part long, reach double, floors binary"), "q_part"), "floors")
    salts = max(1, min(parts(spark), n_blocks), -(-n_blocks // GROUP))
    return best(met(asked, index, salts).mapInArrow(search(True), found), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query with their ranks; a query has at most k rows per block, so its group is small."""
    top = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
