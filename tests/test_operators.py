"""Operators on small frames with the odd cases: nulls, ties, empty tables, large groups."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.functions import text as tx
from pixelquarry.operators import analytics as a
from pixelquarry.operators import annotations as an
from pixelquarry.operators import features as ft
from pixelquarry.operators import matching as m
from pixelquarry.operators import predictions as pr
from pixelquarry.operators import search as s
from pixelquarry.scratch import positions, shared_dir

ASSETS = "asset_id string, display_path string, status string, width long, height long, annotation_count long, selectable boolean, annotation_file_exists boolean, labels array<string>, shape_types array<string>"


@pytest.fixture(scope="module")
def assets(spark):
    rows = [
        ("a", "x/One.png", "valid", 10, 20, 3, True, True, ["Cat", "big dog"], ["polygon"]),
        ("b", "x/two.png", "corrupt_image", None, 9000, None, False, None, None, None),
        ("c", None, None, None, None, 0, None, False, [], []),
        ("d", 'q"uote.png', "valid", 8001, 1, 1, True, True, ['say "hi"', None], ["rectangle", "line"]),
    ]
    return spark.createDataFrame(rows, ASSETS)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("annotated:no", "bc"), ("not:annotated:yes", "bc"), ("has:annotations", "ad"), ("has:标注", "ad"), ("not:has:annotation", "bc"),
        ("class:CAT", "a"), ("not:class:cat", "bcd"), ("class:", "ad"), ("type:line", "d"), ("status:error", "b"), ("not:status:error", "acd"),
        ("selectable:是", "ad"), ("not:selectable:yes", "bc"), ("selectable:no", "b"), ("size>8k", "bd"), ("size>9k", ""), ("pixels<=0", "bc"), ("WIDTH>=10", "ad"),
        ("'[\"cat\", \"big dog\"]'", "a"), ("[]", "bc"), ("'[\"rectangle\", \"line\"]'", "d"), ("path:two or class:dog", "ab"), ("", "abcd"), ("annotations=0", "bc"),
    ],
)
def test_conditions(assets, query, want):
    assert "".join(sorted(r["asset_id"] for r in assets.where(s.condition(query)).collect())) == want


@pytest.mark.parametrize("query", ["colour:red", "has:luck", "annotated:maybe", "a or", "or a"])
def test_conditions_that_are_errors(query):
    with pytest.raises(ValueError):
        s.condition(query)


def test_facets_of_unknown_counts(assets):
    ids = lambda c: sorted(r["asset_id"] for r in assets.where(c).collect())
    assert ids(s.facets(None, False)) == ["b", "c"] and ids(s.facets(None, True)) == ["a", "d"] and ids(s.facets("exception")) == ["b"]


def test_categories_in_normal_form(spark):
    e = unicodedata.normalize("NFD", "é")
    rows = [("1", [f" caf{e} "]), ("2", ["café"]), ("3", ["Kelvin", None]), ("4", None)]
    df = spark.createDataFrame(rows, "asset_id string, labels array<string>")
    ids = lambda c: sorted(r["asset_id"] for r in df.where(c).collect())
    assert ids(s.has_category("café")) == ids(s.has_category(f"caf{e} ")) == ["1", "2"] and ids(s.has_category("Kelvin")) == ["3"]
    shapes = spark.createDataFrame([("i", f"caf{e}"), ("i", "café "), ("i", None), ("i", " ")], "image string, label string")
    assert sorted((r["category"], r["count"]) for r in a.category_counts(shapes).collect()) == sorted([("café", 2), (tx.UNNAMED, 2)])
    renamed = an.rename_category(shapes, "café", "tea").collect()
    assert [r["renamed"] for r in renamed] == [True, True, False, False] and {r["label"] for r in renamed if r["renamed"]} == {"tea"}
    assert a.label_choices(shapes, ["café"], 1).collect()[0]["count"] == 2


def test_visible_is_no_silent_limit(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert s.visible(rows, rows.where("k < 200"), "k").count() == 200
    with pytest.raises(ValueError):
        s.visible(rows, rows.where("k < 201"), "k")


def test_results_without_a_payload_are_errors(spark):
    items = spark.createDataFrame([("j", "b", "succeeded", "2"), ("j", "a", "succeeded", "1"), ("j", "c", "failed", None)], "job_id string, item_id string, state string, result string")
    assert [(r["item_id"], r["position"], r["page"]) for r in s.item_results(items, page_size=1).orderBy("position").collect()] == [("a", 0, 0), ("b", 1, 1)]
    with pytest.raises(Exception, match="no result of item c"):
        s.item_results(items, "failed").collect()
    with pytest.raises(ValueError):
        s.item_results(items, page_size=0)


def test_positions(spark):
    df = spark.range(5000).withColumn("v", F.hash("id") % 97).repartition(7)
    got = positions(df.orderBy("v", "id")).collect()
    want = sorted((r["v"], r["id"]) for r in got)
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["position"])] == want and sorted(r["position"] for r in got) == list(range(5000))
    assert positions(df.where("id < 0").orderBy("v")).count() == 0
    numbered = m.numbered(spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "path string")).collect()
    assert {r["path"]: r["sequence"] for r in numbered} == {"A": 0, "a": 1, "B": 2, "b": 3}


def test_quality_flags(spark):
    schema = "image string, idx long, label string, shape_type string, points array<array<double>>, width long, height long"
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
    rows = [
        ("i", 0, "a", "polygon", square, 10, 10), ("i", 1, "a", "polygon", square[::-1], 10, 10), ("i", 2, None, None, None, 10, 10), ("i", 3, "a", "line", [], 10, 10),
        ("i", 4, "a", "line", [[1.0, float("nan")]], 10, 10), ("i", 5, "a", "point", [[1.0, 1.0], [1.0, 1.0001]], 10, 10), ("i", 6, "a", "point", [[1.0, 1.0], [2.0, 1.0]], 10, 10),
        ("i", 7, "a", "line", [[1.0, 1.0], [1.0, 1.0]], 10, 10), ("i", 8, "a", "linestrip", [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]], 10, 10), ("i", 9, "", "", [[-1.0, 0.0], [1.0, 2.0]], 10, 10),
        ("i", 10, "b", "polygon", [[-1.0, 0.0], [1.0, 2.0], [50.0, 0.0]], None, 10), ("i", 11, "a", "line", [[1.0], [2.0]], 10, 10),
    ]
    got = {r["idx"]: [n for n in an.ISSUES if r[n]] for r in an.quality(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: [], 1: ["duplicate"], 2: ["invalid_shape"], 3: ["invalid_points"], 4: ["invalid_points"], 5: [], 6: ["degenerate"], 7: ["degenerate"], 8: ["degenerate"], 9: ["out_of_bounds"], 10: [], 11: ["invalid_points"]}
    flagged = an.quality(spark.createDataFrame(rows, schema))
    images = spark.createDataFrame([("i",), ("j",)], "image string")
    assert {r["issue"]: r["count"] for r in an.quality_counts(flagged, images).collect()} == {"duplicate": 1, "invalid_shape": 1, "invalid_points": 3, "degenerate": 3, "out_of_bounds": 1, "empty_annotation": 1}
    assert {r["label"]: (r["shapes"], r["with_issue"]) for r in an.label_counts(flagged).collect()} == {"a": (9, 7), "unlabeled": (1, 1), "b": (1, 0)}


def test_suppression_of_large_groups_agrees(spark):
    r = random.Random(4)
    rows = []
    for i in range(900):
        x, y = r.randrange(0, 200), r.randrange(0, 200)
        rows.append(("i" if i % 3 else "j", "c", i, r.choice([0.1, 0.5, 0.5, 0.9]), float(x), float(y), float(x + r.randrange(1, 40)), float(y + r.randrange(1, 40))))
    rows += [("k", "c", 1, 0.5, 0.0, 0.0, 0.0, 0.0), ("k", "c", 2, 0.5, 0.0, 0.0, 0.0, 0.0)]
    boxes = spark.createDataFrame(rows, "image string, label string, idx long, score double, x0 double, y0 double, x1 double, y1 double")

    def brute():
        kept = []
        for row in sorted(rows, key=lambda x: (-x[3], x[2])):
            def ratio(o):
                w, h = max(0, min(row[6], o[6]) - max(row[4], o[4])), max(0, min(row[7], o[7]) - max(row[5], o[5]))
                union = (row[6] - row[4]) * (row[7] - row[5]) + (o[6] - o[4]) * (o[7] - o[5]) - w * h
                return w * h / union if union else 0.0
            if not any(o[0] == row[0] and ratio(o) > 0.3 for o in kept):
                kept.append(row)
        return sorted(kept)

    want = brute()
    for gathered in (10**6, 400, 1):
        out = pr.suppress(boxes, 0.3, gathered)
        assert out.columns == boxes.columns and sorted(map(tuple, out.collect())) == want
    assert pr.suppress(boxes.where("idx < 0"), 0.3).count() == 0


def test_turned_boxes_by_a_fine_grid(spark):
    """Kept boxes against shared areas measured by counting points of a grid."""
    r = np.random.default_rng(7)
    rows = [("i", "c", i, float(r.random()), *map(float, r.uniform(20, 60, 2)), *map(float, r.uniform(10, 30, 2)), float(r.uniform(0, 3))) for i in range(25)]
    boxes = spark.createDataFrame(rows, "image string, label string, idx long, score double, cx double, cy double, w double, h double, angle double")
    g = np.stack(np.meshgrid(np.arange(0, 80, 0.1), np.arange(0, 80, 0.1)), axis=-1).reshape(-1, 2)

    def inside(b):
        d = g - np.array(b[4:6])
        c, s_ = np.cos(b[8]), np.sin(b[8])
        return (np.abs(d[:, 0] * c + d[:, 1] * s_) <= b[6] / 2) & (np.abs(d[:, 1] * c - d[:, 0] * s_) <= b[7] / 2)

    kept, masks, close = [], [], False
    for b in sorted(rows, key=lambda x: (-x[3], x[2])):
        mine = inside(b)
        ratios = [(mine & o).sum() / (mine | o).sum() for o in masks]
        close |= any(abs(x - 0.3) < 0.003 for x in ratios)
        if all(x <= 0.3 for x in ratios):
            kept.append(b[2])
            masks.append(mine)
    assert not close
    assert sorted(x["idx"] for x in pr.suppress_rotated(boxes, 0.3).collect()) == sorted(kept)


def test_principal_axis(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(500, 6)) @ np.diag([5, 1, 1, 1, 1, 0.5]) @ np.linalg.qr(r.normal(size=(6, 6)))[0] + 3
    df = spark.createDataFrame([(x.tolist(),) for x in v] + [(None,)], "v array<double>").repartition(5)
    mean, axis = ft.principal_axis(df, "v", 60)
    want = np.linalg.eigh(np.cov(v.T, bias=True))[1][:, -1]
    assert np.allclose(mean, v.mean(axis=0)) and abs(abs(axis @ want) - 1) < 1e-6 and axis[0] > 0
    assert ft.principal_axis(df.where("v IS NULL"), "v")[1].size == 0


def test_mask_parts_across_bands(spark):
    """Arms that join at the bottom, a spiral and chance, whatever rows a band has."""
    two = spark.createDataFrame([("i", y, x, x) for y in range(6) for x in ([0, 2] if y < 5 else [0, 1, 2])], "image string, y long, x0 long, x1 long")
    assert pr.mask_components(two.where("y < 5")).count() == 2 and pr.mask_components(two.where("y < 0")).count() == 0
    r = random.Random(8)
    cells = {(k, y, x) for k in "ab" for y in range(-7, 23) for x in range(30) if r.random() < 0.55}
    spiral = "#######,#.....#,#.###.#,#.#.#.#,#.#...#,#.#####,#......".split(",")
    cells |= {("s", y, x) for y, line in enumerate(spiral) for x, c in enumerate(line) if c == "#"}
    runs = [(k, y, x, x + next(n for n in range(99) if (k, y, x + n + 1) not in cells)) for k, y, x in cells if (k, y, x - 1) not in cells]
    want, left = {}, set(cells)
    while left:  # parts of cells joined up and down and along rows
        part, todo = set(), [left.pop()]
        while todo:
            k, y, x = todo.pop()
            part.add((k, y, x))
            for step in ((k, y - 1, x), (k, y + 1, x), (k, y, x - 1), (k, y, x + 1)):
                if step in left:
                    left.remove(step)
                    todo.append(step)
        box = (min(p[2] for p in part), min(p[1] for p in part), max(p[2] for p in part), max(p[1] for p in part))
        want[(min(part)[0], *sorted((p[1], p[2]) for p in part)[0])] = (len(part), *box)
    df = spark.createDataFrame(runs, "image string, y long, x0 long, x1 long").repartition(4)
    for band in (1, 2, 5, 64):
        got = pr.mask_components(df, band=band).collect()
        assert sorted((x["image"], x["area"], x["x0"], x["y0"], x["x1"], x["y1"]) for x in got) == sorted((k[0], *v) for k, v in want.items())
    numbers = {k: [(y, x) for kk, y, x, _ in sorted(runs) if kk == k] for k in "abs"}
    assert {(x["image"], *numbers[x["image"]][x["component"] - 1]) for x in got} == set(want)


def test_one_mask_of_many_runs(spark, monkeypatch):
    """A comb of 40,000 runs in one image: the tables written do not grow with its height."""
    from pixelquarry.operators import components, masks

    written = []
    for module in (components, masks):
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: (written.append(name), f(df, name))[1])
    runs = spark.range(40_000).selectExpr("'i' AS image", "id div 20 AS y", "id % 20 * 4 AS x0", "id % 20 * 4 + if(id div 20 = 1999, 3, 1) AS x1")
    got = pr.mask_components(runs.unionByName(spark.sql("SELECT 'i' AS image, 2000L AS y, 0L AS x0, 79L AS x1"))).collect()
    assert [(x["area"], x["component"]) for x in got] == [(39_980 * 2 + 20 * 4 + 80, 1)]
    assert len(written) < 40


def test_latency_and_percentiles(spark):
    log = spark.createDataFrame([("k", float(x)) for x in [5, 1, 1, 2, 9, 9, 9]] + [("n", None)], "key string, ms double")
    got = a.latency(log, "key").collect()
    assert [(r["key"], r["n"], r["p50"], r["p95"], r["max"]) for r in got] == [("k", 7, 5.0, 9.0, 9.0)]
    t = {r["key"]: r for r in a.tensor_statistics(log, "key", "ms").collect()}
    assert t["k"]["p50"] == 5.0 and abs(t["k"]["mean"] - 36 / 7) < 1e-12


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
