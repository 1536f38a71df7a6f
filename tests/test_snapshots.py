import os

from pyspark.sql import functions as F

from pixelquarry.sources import snapshots as s


def assets(spark, n, name="a"):
    return spark.range(n).selectExpr(f"concat('{name}', id) AS asset_id", f"concat('{name}-', lpad(id, 4, '0')) AS display_path", "id % 5 <> 0 AS selectable")


def test_a_walk_ends_on_its_own_revision(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    s.create(spark, root)
    assert s.current(spark, root, "ds") is None
    old = s.write(assets(spark, 25), root, "ds")
    walked, last, total, stale = [], None, None, []
    while rows := s.page(spark, root, old, 10, last, total).collect():
        walked += rows[:10]
        stale.append(rows[0]["stale"])
        last, total = (rows[: 10][-1]["selectable"], rows[:10][-1]["display_path"], rows[:10][-1]["asset_id"]), rows[0]["total"]
        if len(stale) == 1:  # the index is written behind the first page, from what it holds
            s.write(s.read(spark, root, old).where("selectable").drop("index_revision").unionByName(assets(spark, 3, "b")), root, "ds")
        if len(rows) <= 10:
            break
    assert stale == [False, True, True] and len({r["asset_id"] for r in walked}) == 25 and {r["index_revision"] for r in walked} == {1}
    new = s.current(spark, root, "ds")
    assert new.revision == 2 and not s.is_stale(spark, root, new)
    first = s.page(spark, root, new, 100, where=F.col("asset_id").startswith("b")).collect()
    assert [r["asset_id"] for r in first] == ["b1", "b2", "b0"] and {(r["index_revision"], r["total"], r["stale"]) for r in first} == {(2, 3, False)}


def test_a_half_written_revision_is_not_seen(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    s.create(spark, root)
    old = s.write(assets(spark, 5), root, "ds")
    broken = assets(spark, 5).withColumn("x", F.raise_error(F.lit("lost")))
    try:
        s.write(broken, root, "ds")
        raise AssertionError
    except Exception as e:
        assert "lost" in str(e)
    assert s.current(spark, root, "ds") == old and s.read(spark, root, old).count() == 5


def test_removal_spares_what_is_read(spark, tmp_path):
    root, there = f"file://{tmp_path}/index", lambda at: os.path.isdir(f"{tmp_path}/index/{at.folder}")
    s.create(spark, root)
    one, two, three = (s.write(assets(spark, n), root, "ds") for n in (3, 4, 5))
    other = s.write(assets(spark, 2), root, "other")
    s.enter(spark, root, one, "walk 7")
    assert s.remove_unread(spark, root) == [two.folder] and there(one) and not there(two) and there(three) and there(other)
    s.leave(spark, root, one, "walk 7")
    assert s.remove_unread(spark, root) == [one.folder] and not there(one)
    assert s.remove_unread(spark, root) == []
    s.unregister(spark, root, "ds")
    assert s.current(spark, root, "ds") is None and s.is_stale(spark, root, three) and s.read(spark, root, three).count() == 5
    assert s.remove_unread(spark, root) == [three.folder]
    assert s.write(assets(spark, 1), root, "ds").revision == 5
