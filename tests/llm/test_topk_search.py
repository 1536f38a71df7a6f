import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from pixelquarry.llm import topk_search as tk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every, scale=256):
    ok = [(i, [math.floor(scale * np.float64(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def table(kind, n=700):
    r = random.Random(kind)
    if kind == "unit":
        rows = []
        for i in range(n):
            v = [r.gauss(0, 1) for _ in range(12)]
            s = math.sqrt(sum(x * x for x in v))
            rows.append((i, [x / s for x in v]))
    elif kind == "lengths":
        rows = [(i, [r.gauss(0, 1) * 10 ** r.uniform(-2, 1) for _ in range(8)]) for i in range(n)]
    elif kind == "clusters":
        centres = [[r.gauss(0, 1) for _ in range(10)] for _ in range(6)]
        rows = [(i, [x + r.gauss(0, 0.05) for x in r.choice(centres)]) for i in range(n)]
    else:
        rows = [(i, [r.choice([0.0, 0.25]) for _ in range(4)]) for i in range(n)]
    return rows


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters", "ties"])
def test_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(tk, "BLOCK", 40)
    rows = table(kind)
    got = tk.top_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 20)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [float("nan"), 1.0]), (100, None), (150, [None, 1.0]), (200, [float("inf"), 0.0]), (250, [0.0, 0.0]), (300, [1.0]), (350, []), (1, [-1.0, -3.0]), (2, [0.5, 0.5]), (3, [2.0]), (400, [1e30, 1e30]), (None, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS bucket", "2 AS id")
    got = sorted(map(tuple, tk.top_products(docs, F.col("vec_id") % 50 == 0, k=3).collect()))
    want = [(q, r, i, max(min(s, 2**63 - 1), 1 - 2**63)) for q, r, i, s in brute(rows, 3, 50)]
    assert got == want
    assert tk.top_products(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pruning_keeps_what_can_win():
    r = np.random.default_rng(3)
    v = np.floor(256 * r.normal(size=(400, 6)) * r.uniform(0.9, 1, (400, 1)))
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    q = np.floor(v[::40] + r.normal(0, 20, (10, 6)))
    scores = (q @ v.T).astype(np.int64)
    for k in (1, 4):
        floor = np.sort(scores, axis=1)[:, -k].astype(float)
        got = sorted(tk.search_block(q, np.arange(1000, 1010), floor, v, np.arange(400), k))
        want = sorted((1000 + i, int(j), int(scores[i, j])) for i in range(10) for j in np.lexsort((np.arange(400), -scores[i]))[:k])
        assert got == want


def test_repeated_rows_each_count(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.5, 0.5]), (0, [3.0, 3.0])]
    got = sorted(map(tuple, tk.top_products(spark.createDataFrame(rows[:4], SCHEMA), F.col("vec_id") % 50 == 0, k=3).collect()))
    assert [x[1:3] for x in got] == [(1, 1), (2, 1), (3, 2)]
