import math
import random

import numpy as np
import pytest

from pixelquarry.operators import analytics as a
from pixelquarry.operators import selection as s


def values(seed):
    r = random.Random(seed)
    kinds = [lambda: r.gauss(0, 1), lambda: 10.0 ** r.randrange(-300, 300) * r.choice([-1, 1]), lambda: 7.25, lambda: float(r.randrange(-5, 5)), lambda: 1 + r.random() * 1e-13]
    rows = [(f"k{i % 5}" if i % 5 else None, kinds[i % 5]()) for i in range(1500)]
    return rows + [("edge", x) for x in (0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324)] + [("one", 3.5), ("none", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_rank(spark, seed):
    rows = values(seed)
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    counts = s.counted(df, "k", "v")
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v + 0.0)
    wanted = [(k, f"{i}", i) for k, v in by.items() for i in sorted({0, len(v) - 1, len(v) // 2, len(v) // 3})]
    got = s.at_ranks(counts, spark.createDataFrame(wanted, "key string, mark string, rank int")).collect()
    assert len(got) == len(wanted)
    assert all(r["value"] == sorted(by[r["key"]])[int(r["mark"])] for r in got)


def test_percentiles_are_numpys(spark):
    rows = [(k, v) for k, v in values(3) if v is not None and abs(v) < 1e6]
    got = {r["k"]: r for r in a.tensor_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    for k in {k for k, _ in rows}:
        x = np.array([v for n, v in rows if n == k])
        want = np.quantile(x, [0.01, 0.05, 0.5, 0.95, 0.99])
        assert np.allclose([got[k][f"p{p}"] for p in ("01", "05", "50", "95", "99")], want, rtol=1e-12, atol=1e-300)


def test_no_window_over_values(spark):
    """The only windows are over the counts of one digit."""
    df = spark.range(100).selectExpr("id % 3 AS k", "cast(id AS double) AS v")
    plan = a.latency(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("mark#" in line.split("windowspecdefinition(")[1] and "digit#" in line for line in windows)


def test_tree_fingerprint(spark):
    rows = [("a", f"i{n}", f"p{n * n}") for n in range(3000)] + [("b", "x", "y"), (None, None, None)] + [("c", f"i{n}", "p") for n in range(70)]
    of = lambda x, parts: {r["d"]: r["fingerprint"] for r in a.tree_fingerprint(spark.createDataFrame(x, "d string, i string, p string").repartition(parts), "d", "i", "p", 16).collect()}
    first = of(rows, 3)
    assert len(set(first.values())) == 4
    shuffled = rows[::-1]
    assert of(shuffled, 7) == first
    changed = of([*rows[:1500], ("a", "i1500", "other"), *rows[1501:]], 3)
    assert changed["a"] != first["a"] and changed["b"] == first["b"] and changed["c"] == first["c"]
    assert of([*rows, rows[5]], 3)["a"] != first["a"]  # how often an item occurs counts
    assert of([("a", "1", "23")], 1) != of([("a", "12", "3")], 1)
