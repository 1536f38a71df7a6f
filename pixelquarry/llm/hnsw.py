"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, results merged.

Rows are dealt by length, an octave each, and within it by a hash of their id to shards of about ``SHARD`` vectors.  Each
shard becomes one row: its vectors and, per level, the nodes and a flat array of neighbours (-1 for none).  Its vectors
are scaled by a power of two and get one more coordinate that gives all the same length, so the largest inner product is
the nearest point; within an octave that coordinate never drowns the others, however far apart lengths are.  A node is
linked, in a fixed order, to diverse near ones among its predecessors (found exactly, as a shard is small) and they to
it; its level follows from its id.  Equal vectors are one node.

Query blocks go to every group of shards of their dimension.  A block descends the upper levels greedily and searches the
lowest with a beam of ``EF``, all queries at once; the beam's candidates are scored exactly in double precision, and
the k best of all shards are kept.

Vectors null, zero or holding null or non-finite components and rows with a null id take no part.  Equal scores go to
the smaller id; rows of a query's own id are no candidates of it; rows that are equal otherwise each count.  Products
beyond the range of doubles are infinite, and where two of those cancel (not a number) they come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import parts, stored
from .textkit import mix
from .topk_search import usable

SHARD = 8192
LINKS = 16
BUILD = 48
EF = 128
QUERY_BLOCK = 256
GROUP = 4
_INDEX = pa.schema([("dim", pa.int32()), ("octave", pa.int32()), ("salt", pa.int32()), ("ids", pa.binary()), ("first", pa.binary()), ("vectors", pa.binary()), ("levels", pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())])))])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _diverse(points: np.ndarray, node: int, near: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of nearness those nearer to the node than to any chosen before; then the nearest rest."""
    chosen: list[int] = []
    mine = points[near]
    to_node, among = mine @ points[node], mine @ mine.T
    closest = np.full(len(near), -np.inf, points.dtype)
    for i in range(len(near)):
        if closest[i] < to_node[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            np.maximum(closest, among[i], out=closest)
    rest = [i for i in range(len(near)) if i not in set(chosen)]
    return near[sorted(chosen + rest[: max(0, most // 2 - len(chosen))])].tolist()


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings the largest component to between a half and 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1]) if v.size else v


def raised(v: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that makes all as long as the longest, scaled to length 1."""
    v = scaled(v)
    square = (v * v).sum(axis=1)
    longest = square.max() if len(v) else 1.0
    return (np.concatenate([v, np.sqrt(np.maximum(0, longest - square))[:, None]], axis=1) / np.sqrt(longest)).astype(np.float32)


def directions(q: np.ndarray) -> np.ndarray:
    """Queries each scaled by its own power of two, which changes no order."""
    return np.ldexp(q, -np.frexp(np.abs(q).max(axis=1))[1][:, None])


def build_levels(points: np.ndarray, seed: np.ndarray, links: int = LINKS, build: int = BUILD) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, top first, its nodes and their neighbours (positions in the shard)."""
    u = (seed.astype(np.float64) + 1) / 2.0**64
    level = np.minimum(6, np.floor(-np.log(np.clip(u, 1e-18, 1)) / np.log(links)).astype(int))
    out = []
    for height in range(int(level.max()), -1, -1):
        nodes = np.flatnonzero(level >= height)
        nodes = nodes[np.argsort(mix(seed[nodes], 5), kind="stable")]
        most = 2 * links if height == 0 else links
        mine = points[nodes]
        joined: list[set[int]] = [set() for _ in nodes]
        for at in range(0, len(nodes), 256):  # nearest predecessors, 256 nodes at a time
            sims = mine[at : at + 256] @ mine[: at + 256].T
            for i in range(max(1, at), min(at + 256, len(nodes))):
                before = sims[i - at, :i]
                near = np.arange(i) if i <= build else np.argpartition(-before, build)[:build]
                for j in _diverse(mine, i, near[np.argsort(-before[near], kind="stable")], links):
                    joined[i].add(j)
                    joined[j].add(i)
        table = np.full((len(nodes), most), -1, np.int32)
        for i, others in enumerate(joined):
            near = np.array(sorted(others), np.int64)
            if len(near) > most:
                near = np.array(_diverse(mine, i, near[np.argsort(-(mine[near] @ mine[i]), kind="stable")], most))
            table[i, : len(near)] = nodes[near] if len(near) else []
        by = np.argsort(nodes)
        out.append((nodes[by].astype(np.int32), table[by]))
    return out


def search_shard(points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, ef: int) -> np.ndarray:
    """Positions of the ef nodes found for each query, -1 for none."""
    n, many = len(points), len(q)
    q = np.concatenate([q, np.zeros((many, 1))], axis=1).astype(np.float32)
    at = np.full(many, levels[0][0][0])
    score = np.einsum("qd,qd->q", q, points[at])
    for nodes, links in levels[:-1]:
        moving = np.arange(many)
        while len(moving):
            near = links[np.searchsorted(nodes, at[moving])]
            s = np.where(near >= 0, np.einsum("qd,qmd->qm", q[moving], points[near]), -np.inf)
            best = s.argmax(axis=1)
            top = s[np.arange(len(moving)), best]
            better = top > score[moving]
            moving = moving[better]
            at[moving], score[moving] = near[better, best[better]], top[better]
    links = levels[-1][1]
    ef = min(ef, n)
    beam = np.full((many, ef), -1, np.int64)
    sims = np.full((many, ef), -np.inf, np.float32)
    done = np.ones((many, ef), bool)
    beam[:, 0], sims[:, 0], done[:, 0] = at, score, False
    seen = np.zeros((many, n + 1), bool)  # the last column stands for no neighbour
    seen[np.arange(many), at] = True
    seen[:, n] = True
    active = np.arange(many)
    step = min(4, ef)
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if step < ef else np.tile(np.arange(ef), (len(active), 1))
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        keep = live.any(axis=1)
        active, pick, live = active[keep], pick[keep], live[keep]
        if not len(active):
            break
        done[active[:, None], pick] = True
        from_ = np.where(live, beam[active[:, None], pick], -1)
        near = np.where(from_[:, :, None] >= 0, links[from_], -1).reshape(len(active), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[active[:, None], near]] = n
        seen[active[:, None], near] = True
        s = np.where(near < n, np.einsum("qd,qmd->qm", q[active], points[np.minimum(near, n - 1)]), -np.inf)
        all_s = np.concatenate([sims[active], s], axis=1)
        all_b = np.concatenate([beam[active], np.where(near < n, near, -1)], axis=1)
        all_d = np.concatenate([done[active], s == -np.inf], axis=1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        beam[active], sims[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_b, all_s, all_d))
    return np.where(sims > -np.inf, beam, -1)


def octave(x: str) -> Column:
    """Which power of two the length of a vector reaches."""
    top = F.array(F.array_max(F.transform(x, F.abs)))  # a list of one, so that its value is bound once
    length = lambda m: F.log2(m) + F.log2(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v / m) * (v / m))) / 2
    return F.floor(F.transform(top, length)[0]).cast("int")


def build_index(rows: DataFrame, shard: int | None = None) -> DataFrame:
    """One row per shard of ``rows`` (id, x, dim): a dimension, an octave of lengths and a salt."""
    rows = rows.withColumn("octave", octave("x"))
    sizes = rows.groupBy("dim", "octave").agg(F.ceil(F.count("*") / (shard or SHARD)).cast("int").alias("salts"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        key = None
        for batch in batches:
            for *new, i, x in zip(*(batch.column(c).to_pylist() for c in ("dim", "octave", "salt", "id")), batch.column("x"), strict=True):
                if new != key or len(held) >= 4 * SHARD:
                    if held:
                        yield index(held, key)
                    held, key = [], new
                held.append((i, x.values.to_numpy()))
        if held:
            yield index(held, key)

    def index(held: list[tuple[int, np.ndarray]], key: list[int]) -> pa.RecordBatch:
        v = np.array([x for _, x in held], np.float64).reshape(len(held), key[0])
        ids = np.array([i for i, _ in held], np.int64)
        kinds, which = np.unique(v, axis=0, return_inverse=True)
        order = np.lexsort((ids, which))
        first = np.searchsorted(which[order], np.arange(len(kinds) + 1))
        levels = build_levels(raised(kinds), mix(ids[order][first[:-1]].view(np.uint64), 3))
        packed = [{"nodes": a.tobytes(), "links": b.tobytes()} for a, b in levels]
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[order], first, kinds)), pa.array([packed], _INDEX.field("levels").type)], schema=_INDEX)

    keys = ["dim", "octave", "salt"]
    dealt = rows.join(sizes, ["dim", "octave"]).withColumn("salt", F.expr("CAST(pmod(xxhash64(id), salts) AS INT)")).select(*keys, "id", "x")
    dealt = dealt.repartition(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(build, "dim int, octave int, salt int, ids binary, first binary, vectors binary, levels array<struct<nodes: binary, links: binary>>")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``queries`` selects."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector) & F.col(id_column).isNotNull() & F.exists(F.col(vector), lambda v: v != 0))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("is_query")).withColumn("dim", F.size("x"))
    asking = rows.agg(F.count_if("is_query")).first()[0]
    query_parts = -(-asking // QUERY_BLOCK) or 1
    index = stored(build_index(rows), "graphs")
    groups = max(1, min(parts(spark), index.count()), -(-index.count() // GROUP))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims = 0, batch.column("dim").to_numpy()
            ids = batch.column("id").to_numpy()
            while at < len(dims):
                to = at
                while to < len(dims) and dims[to] == dims[at] and to - at < 4 * QUERY_BLOCK:
                    to += 1
                x = np.concatenate([v.values.to_numpy() for v in batch.column("x").slice(at, to - at)])
                yield pa.RecordBatch.from_arrays([pa.array([int(dims[at])], pa.int32()), pa.array([ids[at:to].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["dim", "q_ids", "q_vectors"])
                at = to

    asked = rows.where("is_query").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(query_parts)))
    asked = asked.repartition(parts(spark), "part").sortWithinPartitions("dim", "part", "id").select("dim", "id", "x").mapInArrow(block, "dim int, q_ids binary, q_vectors binary")
    index = index.withColumn("group", F.pmod(F.xxhash64("dim", "octave", "salt"), F.lit(groups)).cast("int"))
    sent = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(index, ["dim", "group"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"])
                ids, first = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["first"], np.int64)
                levels = [(np.frombuffer(x["nodes"], np.int32), np.frombuffer(x["links"], np.int32)) for x in r["levels"]]
                levels = [(a, b.reshape(len(a), -1)) for a, b in levels]
                q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"], np.float64).reshape(-1, r["dim"])
                points = raised(v)
                out = []
                for i in range(0, len(q), QUERY_BLOCK):
                    beam = search_shard(points, levels, directions(q[i : i + QUERY_BLOCK]), max(ef, k + 1))
                    for row, nodes in enumerate(beam):
                        nodes = nodes[nodes >= 0]
                        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                            s = (v[nodes] * q[i + row]).sum(axis=1)
                        copies = np.minimum(first[nodes + 1] - first[nodes], k + 1)
                        start = np.repeat(first[nodes] - (np.cumsum(copies) - copies), copies)
                        found, s = ids[start + np.arange(len(start))], np.repeat(s, copies)
                        ok = found != q_ids[i + row]
                        found, s = found[ok], s[ok]
                        best = np.lexsort((found, -s))[:k]
                        out.append((np.full(len(best), q_ids[i + row]), found[best], s[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_FOUND)

    found = sent.mapInArrow(search, "query_id long, vec_id long, score double")
    top = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
