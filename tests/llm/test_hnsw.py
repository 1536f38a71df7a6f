
import numpy as np
import pytest

from pyspark.sql import functions as F

from pixelquarry.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, v, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (v * v[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["unit", "lengths", "lognormal", "decades", "outlier", "huge", "tiny", "clusters", "copies"])
def test_recall_and_scores(spark, monkeypatch, kind):
    monkeypatch.setattr(hnsw, "SHARD", 700)
    r = np.random.default_rng(4)
    n, d = 3000, 24
    v = r.normal(size=(n, d))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif kind == "lengths":
        v *= r.uniform(0.2, 3, (n, 1))
    elif kind == "lognormal":
        v *= r.lognormal(0, 1, (n, 1))
    elif kind == "decades":
        v *= 10 ** r.uniform(-3, 3, (n, 1))
    elif kind in ("outlier", "huge"):
        v /= np.linalg.norm(v, axis=1)[:, None]
        v[7] *= 1e5 if kind == "outlier" else 1e200
    elif kind == "tiny":
        v *= 1e-150
    elif kind == "clusters":
        v = r.normal(size=(12, d))[r.integers(0, 12, n)] + 0.1 * v
    else:
        v[1000:2200] = v[5]
    ids = np.arange(n) * 5
    docs = spark.createDataFrame(list(zip(ids.tolist(), v.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got = {}
    for x in hnsw.nearest(docs, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = brute(ids, v, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, 21))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:], strict=False))
        assert all(abs(s - (v[i // 5] * v[q // 5]).sum()) <= 1e-12 * max(1, abs(s)) for _, i, s in rows)
        hits += len({x[1] for x in rows} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.95, hits / (20 * len(want))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [float("nan"), 1.0]), (40, None), (60, [None, 1.0]), (80, [0.0, 0.0]), (100, [3.0]), (120, []), (None, [1.0, 1.0]), (1, [-1.0, -3.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS shard", "'x' AS id")
    got = sorted(map(tuple, hnsw.nearest(docs, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 2, 1.5), (0, 2, 2, 1.5), (0, 3, 3, 1.5), (0, 4, 1, -7.0)]
    assert hnsw.nearest(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_products_out_of_range(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e200, -1e200]), (3, [1.0, 1.0]), (20, [1e-200, 1e-200]), (5, [5e-324, 0.0])]
    got = sorted(map(tuple, hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()))
    assert [(q, i) for q, _, i, _ in got] == [(0, 1), (0, 3), (0, 20), (0, 5), (0, 2), (20, 0), (20, 1), (20, 3), (20, 2), (20, 5)]
