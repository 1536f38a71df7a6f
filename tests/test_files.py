import hashlib
import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from pixelquarry.operators import matching, rasters, search
from pixelquarry.sources import files
from pixelquarry.streaming import jobs


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + b"\0" * w) * h)) + chunk(b"IEND", b"")


def test_listing_and_probing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".workspace").mkdir()
    (tmp_path / "a/x.PNG").write_bytes(png(12, 8))
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "c.bmp").write_bytes(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -7))
    (tmp_path / "d.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (3).to_bytes(3, "little"))
    (tmp_path / "e.tif").write_bytes(b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHII", 256, 3, 1, 40) + struct.pack("<HHII", 257, 4, 1, 30))
    (tmp_path / "f.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 30))
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / ".workspace/y.png").write_bytes(png(1, 1))
    listed = files.images(files.list_files(spark, [f"file://{tmp_path}"]))
    assert listed.count() == 6
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}")
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["error"]) for r in files.probe(content.join(listed.select("path"), "path")).collect()}
    assert got == {"x.PNG": (12, 8, None), "broken.png": (None, None, "not an image"), "c.bmp": (5, 7, None), "d.webp": (10, 4, None), "e.tif": (40, 30, None), "f.jpg": (30, 20, None)}
    decoded = spark.read.format("image").load(f"file://{tmp_path}/a").select("image.width", "image.height").first()
    assert tuple(decoded) == (12, 8)


def test_annotation_facts(spark):
    docs = ["{", "[]", '{"shapes": {}}', "{}", '{"shapes": [{"label": "b", "shape_type": "line"}, 3, {"label": "a"}, {"label": ""}], "imagePath": "p.png"}', None]
    got = files.annotation_facts(spark.createDataFrame(list(enumerate(docs)), "k int, document string")).orderBy("k").collect()
    assert [r["error"] for r in got] == ["no JSON", "no object", "shapes is no list", None, None, "no JSON"]
    assert (got[3]["shape_count"], got[4]["shape_count"], got[4]["labels"], got[4]["shape_types"], got[4]["image_path"]) == (0, 4, ["a", "b"], ["line"], "p.png")


def _files(spark, images, notes):
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    i = spark.createDataFrame([(p, p.rsplit(".", 1)[0], stem(p), b) for p, b in images], "path string, rel_stem string, stem string, broken boolean")
    n = spark.createDataFrame([(f"ann/{p}", p.rsplit(".", 1)[0], stem(p), ip, b) for p, ip, b in notes], "path string, rel_stem string, stem string, image_path string, broken boolean")
    return i, n


def test_matching(spark):
    i, n = _files(spark, [("train/valid.png", False), ("train/hidden.png", False), ("broken.png", True), ("bad-json.png", False)], [("train/valid.json", None, False), ("orphan.json", None, False), ("broken.json", None, False), ("bad-json.json", None, True)])
    pairs = matching.by_relative_stem(i, n)
    row = matching.summary(matching.resolve(i, n, pairs), matching.hidden(i, pairs)).first()
    assert (row["valid"], row["hidden"], row["orphan_annotation"], row["corrupt_image"], row["corrupt_annotation"]) == (1, 1, 1, 1, 1)
    i, n = _files(spark, [("a/same.png", False), ("b/same.png", False)], [("same.json", None, False)])
    assert matching.summary(matching.resolve(i, n, matching.by_basename(i, n))).first()["duplicate_match"] == 2
    i, n = _files(spark, [("nested/target.png", False)], [("custom-name.json", "nested/target.png", False)])
    assert [r["status"] for r in matching.resolve(i, n, matching.by_image_path(i, n)).collect()] == ["valid"]
    i, n = _files(spark, [("nested/existing.png", False), ("nested/new.png", False), ("a/s.jpg", False), ("b/s.png", False)], [("other/existing.json", None, False)])
    got = {r["path"]: r["status"] for r in matching.resolve(i, n, matching.by_basename(i, n), managed=True).collect()}
    assert got == {"nested/existing.png": "valid", "nested/new.png": "valid", "a/s.jpg": "duplicate_match", "b/s.png": "duplicate_match"}


def test_search_and_keyset_walk(spark):
    rows = [("large-scratch.png", 9001, 10, 1, ["scratch"], ["rotation"]), ("particle.png", 20, 20, 1, ["particle"], ["polygon"]), ("empty.png", 20, 10, 0, [], [])]
    assets = spark.createDataFrame([(str(k), p, w, h, n, True, "valid", True, ls, ts) for k, (p, w, h, n, ls, ts) in enumerate(rows)], "asset_id string, display_path string, width int, height int, annotation_count int, annotation_file_exists boolean, status string, selectable boolean, labels array<string>, shape_types array<string>")
    count = lambda c: assets.where(c).count()
    assert count(search.text("particle")) == 1 and count(search.regex(r"large-.*\.png")) == 1
    assert count(search.condition("class:scratch AND type:rotation OR annotations=0")) == 2 and count(search.condition("")) == 3
    big = spark.range(9).selectExpr("concat('a', id) AS asset_id", "concat('asset-00', id, '.png') AS display_path", "id % 4 <> 0 AS selectable")
    walked, last = [], None
    while page := search.keyset_page(big, 2, last).collect():
        walked += [r["asset_id"] for r in page[:2]]
        if len(page) <= 2:
            break
        last = (page[1]["selectable"], page[1]["display_path"], page[1]["asset_id"])
    assert walked == [r["asset_id"] for r in search.ordered(big).collect()]


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    one = spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, x int")
    files.write_index(one, root + "/index", 1)
    files.write_index(one.where("x = 2").withColumn("x", F.lit(9)), root + "/index", 2)
    assert sorted((r["dataset_id"], r["x"], r["index_revision"]) for r in spark.read.parquet(root + "/index").collect()) == [("a", 1, 1), ("b", 9, 2)]
    files.unregister(spark, root + "/index", "a", root + "/after")
    assert [r["dataset_id"] for r in spark.read.parquet(root + "/after").collect()] == ["b"]
    items = spark.range(5).withColumnRenamed("id", "sequence")
    assert files.append_scan(items, root + "/scan", 0, 3) == 3
    assert files.append_scan(items, root + "/scan", 0, 3) == 3 and files.append_scan(items, root + "/scan", 3, 5) == 2  # a retry
    assert sorted(r["sequence"] for r in spark.read.parquet(root + "/scan").collect()) == [0, 1, 2, 3, 4]
    try:
        files.append_scan(items, root + "/scan", 3, 9)
        raise AssertionError
    except ValueError:
        assert spark.read.parquet(root + "/scan").count() == 5
    docs = spark.createDataFrame([("a", "{}"), ("b", "[]")], "asset_id string, document string")
    revision = docs.select(F.sha2(F.lit("{}"), 256)).first()[0]
    edits = spark.createDataFrame([("a", revision, '{"n":1}'), ("b", "old", "{}")], "asset_id string, if_match string, document string")
    after, conflicts, backups = files.save_documents(docs, edits)
    assert {r["asset_id"]: r["document"] for r in after.collect()} == {"a": '{"n":1}', "b": "[]"}
    assert [r["asset_id"] for r in conflicts.collect()] == ["b"] and [r["document"] for r in backups.collect()] == ["{}"]
    outputs = lambda n: spark.range(n).withColumnRenamed("id", "output_id").withColumn("document", F.when(F.col("output_id") < 2, F.lit("{}")))
    files.publish(outputs(3), root + "/pub")
    folder = files.publish(outputs(4), root + "/pub")
    assert files.published(spark, root + "/pub").count() == 4
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["item"], r["bytes"], r["fingerprint"] == empty) for r in files.manifest(spark, root + "/pub").collect()) == [("0", 2, False), ("1", 2, False), ("2", 0, True), ("3", 0, True)]
    assert sorted(json.loads(r["value"])["item"] for r in spark.read.text(folder + "/json").collect()) == ["0", "1"]
    log = spark.createDataFrame([("r", 1), ("r", 3), ("s", 2), ("r", 2)], "run_id string, audit_id long")
    files.append_log(log, root + "/log")
    assert [r["audit_id"] for r in files.read_log(spark, root + "/log", "r", 1).collect()] == [2, 3]
    good, bad = files.checked_tensors(spark.createDataFrame([(1, [1.0, 3.0]), (2, []), (3, [float("nan")]), (4, None)], "k int, values array<double>"))
    assert [tuple(r)[2:] for r in good.collect()] == [(1.0, 3.0, 2.0)] and bad.count() == 3


def test_rasters(spark):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    df = spark.createDataFrame([("i", 3, 4, a.tobytes())], rasters.SCHEMA)
    out = lambda d: (lambda r: np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(r["height"], r["width"]))(d.first())
    assert (out(rasters.turn(df, 90)) == np.rot90(a, -1)).all() and (out(rasters.crop(df, 1, 0, 2, 2)) == a[:2, 1:3]).all()
    assert (out(rasters.flip(df, True)) == a[:, ::-1]).all() and (out(rasters.resize(df, 4, 3)) == a).all()
    assert (out(rasters.lookup(df, rasters.threshold(100))) == np.where(a > 100, 255, 0)).all()
    assert (out(rasters.focal(df, 1, "max"))[0] == [100, 120, 140, 140]).all() and out(rasters.equalise(df)).max() == 255
    assert rasters.otsu(rasters.histogram(df)).first()["threshold"] == 100
    failed = rasters.user_operator(df, lambda p, o: p[: o["n"]], {"n": 2}).first()
    assert failed["violation"] == "size changed" and rasters.user_operator(df, lambda p, o: 255 - p, {}).first()["violation"] is None
    assert rasters.expand(["x", "c"], {"c": ["y", "d"], "d": ["z"]}) == ["x", "y", "z"]
    square = lambda f: out(f)[1:2, 1:3].tolist()
    assert square(rasters.morphology(df, 1, "gradient")) == [[200, 200]] and square(rasters.morphology(df, 1, "dilate")) == [[200, 220]]
    assert (out(rasters.opened(df, 1)) <= a).all() and (out(rasters.closed(df, 1)) >= a).all()
    assert (out(rasters.morphology(df, 1, "tophat")) == a - out(rasters.opened(df, 1))).all() and (out(rasters.morphology(df, 1, "blackhat")) == out(rasters.closed(df, 1)) - a).all()
    assert np.abs(out(rasters.gaussian(df, 0.8, 1)).astype(int) - a)[1, 1:3].max() <= 20 and (out(rasters.unsharp(df, 0.8, 0.0, 1)) == a).all()
    assert out(rasters.minmax(df, 10, 110)).min() == 10 and out(rasters.minmax(df, 10, 110)).max() == 110
    assert (out(rasters.contrast(df, 1.0)) == a).all() and set(out(rasters.contrast(df, 0.0)).ravel()) == {110}
    assert out(rasters.stretch(df)).min() == 0 and out(rasters.stretch(df)).max() == 255
    colour = spark.createDataFrame([("i", 1, 2, bytes([10, 20, 30, 200, 100, 0]))], rasters.SCHEMA)
    assert list(rasters.saturate(colour, 0.0).first()["pixels"]) == [18, 18, 18, 118, 118, 118] and list(rasters.saturate(colour, 1.0).first()["pixels"]) == [10, 20, 30, 200, 100, 0]
    windows = spark.createDataFrame([("i", 1, 1, 2, 2, 1, 1, "k")], "image string, x int, y int, w int, h int, out_w int, out_h int, key string")
    assert [tuple(r) for r in rasters.regions(df, windows).collect()] == [("i", "k", 1, 1, bytes([int(np.rint(a[1:3, 1:3].mean()))]))]
    assert rasters.pyramid_tiles(df, 2).where("level = 2").count() == 4
    last, taps = rasters.pipeline(df, [lambda d: rasters.turn(d, 90), lambda d: rasters.flip(d, True)], (0,))
    assert (out(taps[0]) == np.rot90(a, -1)).all() and (out(last) == np.rot90(a, -1)[:, ::-1]).all()
    bands = rasters.haar(np.array([[1, 2], [3, 4]]))
    assert (bands["LL"][0, 0], bands["LH"][0, 0], bands["HL"][0, 0], bands["HH"][0, 0]) == (2.5, -1, -0.5, 0)
    assert json.dumps([r["level"] for r in rasters.haar_pyramid(df, 2).collect()]) == "[1, 1, 1, 1, 2, 2, 2, 2]"


def test_progressive_registration(spark, tmp_path):
    """Batches can be read while the scan runs; a batch that runs again is written once; an old generation is left out."""
    schema = "asset_id string, status string, generation long"
    source, index = f"{tmp_path}/in", f"{tmp_path}/index"
    spark.createDataFrame([("a", "valid", 2), ("b", "valid", 2), ("z", "valid", 1)], schema).coalesce(1).write.parquet(source)
    jobs.register(spark.readStream.schema(schema).parquet(source), index, f"{tmp_path}/check", 2).awaitTermination()
    assert sorted(r["asset_id"] for r in jobs.registered(spark, index, 2).collect()) == ["a", "b"]
    spark.createDataFrame([("b", "corrupt_image", 2), ("c", "valid", 2)], schema).coalesce(1).write.mode("append").parquet(source)
    jobs.register(spark.readStream.schema(schema).parquet(source), index, f"{tmp_path}/check", 2).awaitTermination()
    assert {r["asset_id"]: r["status"] for r in jobs.registered(spark, index, 2).collect()} == {"a": "valid", "b": "corrupt_image", "c": "valid"}
    summary = {r["status"]: (r["count"], r["index_revision"]) for r in jobs.scan_summary(spark, index, 2, 5).collect()}
    assert summary == {"valid": (2, 8), "corrupt_image": (1, 8)} and jobs.registered(spark, index, 1).count() == 0
