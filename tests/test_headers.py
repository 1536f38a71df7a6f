import struct

from pyspark.sql import functions as F

from pixelquarry.sources.headers import HEAD, ImageHeaders
from pixelquarry.operators import features as ft


def heads():
    ifd = lambda o: struct.pack(o + "H", 2) + b"".join(struct.pack(o + "HHI", t, 4, 1) + struct.pack(o + "I", v) for t, v in ((256, 70), (257, 50)))
    jpeg = lambda gap: b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", 60002) + bytes(60000) for _ in range(gap)) + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 50, 70) + bytes(20)
    return {
        "a.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 70, 50), "b.bmp": b"BM" + bytes(16) + struct.pack("<ii", 70, -50), "c.jpg": jpeg(0), "far.jpeg": jpeg(3),
        "d.webp": b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (69).to_bytes(3, "little") + (49).to_bytes(3, "little"), "e.tif": b"II*\0" + struct.pack("<I", 8) + ifd("<"), "f.tiff": b"MM\0*" + struct.pack(">I", 8) + ifd(">"),
    }


def test_sizes_of_seven_formats_by_their_heads(spark, tmp_path):
    for name, data in heads().items():
        (tmp_path / name).write_bytes(data + bytes(100))
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"x")
    with open(tmp_path / "huge.png", "wb") as f:  # 1 GB, of which the disk holds the head
        f.write(heads()["a.png"])
        f.truncate(1 << 30)
    spark.dataSource.register(ImageHeaders)
    got = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.format("image_headers").option("path", str(tmp_path)).option("parts", 3).load().collect()}
    assert {k: (r["width"], r["height"]) for k, r in got.items() if r["error"] is None} == {k: (70, 50) for k in [*heads(), "huge.png"]}
    assert got["broken.png"]["error"] == got["empty.png"]["error"] == "not an image"
    assert got["huge.png"]["length"] == 1 << 30 and got["huge.png"]["bytes_read"] == HEAD and got["far.jpeg"]["bytes_read"] > 180_000
    assert spark.read.format("image_headers").option("path", f"file://{tmp_path}").load().count() == len(got)


def test_stream_of_new_files(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    spark.dataSource.register(ImageHeaders)
    for names in (["a.png", "b.bmp"], ["c.jpg"]):
        for n in names:
            (source / n).write_bytes(heads()[n] + bytes(50))
        query = spark.readStream.format("image_headers").option("path", str(source)).load().writeStream.option("checkpointLocation", check).format("parquet").option("path", out).start()
        query.processAllAvailable()
        query.stop()
    got = spark.read.parquet(out).select(F.element_at(F.split("path", "/"), -1).alias("n"), "width", "height").collect()
    assert sorted(map(tuple, got)) == [(n, 70, 50) for n in ("a.png", "b.bmp", "c.jpg")]


def test_shaped_projections(spark):
    def of(shape, how, channel=0, n=None):
        total = n or eval("*".join(shape.split(",")))
        r = spark.range(1).selectExpr(f"transform(sequence(0, {total} - 1), i -> cast(i AS float)) AS v").select(ft.shaped_projection("v", f"array({shape})", how, channel).alias("p")).first()["p"]
        return r["values"], list(r["shape"])

    def fails(*a, **k):
        try:
            of(*a, **k)
        except Exception as e:
            return str(e)
        return ""

    assert of("1, 2, 2, 2", "mean") == ([2, 3, 4, 5], [1, 1, 2, 2]) and of("1,2,2,2", "max") == ([4, 5, 6, 7], [1, 1, 2, 2])
    assert of("1, 4, 3", "token_grid") == ([1, 4, 7, 10], [1, 1, 2, 2]) and of("1,3,2", "mean") == ([0.5, 2.5, 4.5], [1, 1, 1, 3])
    assert of("4, 3", "token_grid") == ([1, 4, 7, 10], [2, 2]) and of("4,3", "channel", 2) == ([2, 5, 8, 11], [4])
    assert of("1, 3", "max") == ([0, 1, 2], [3]) and of("3", "mean") == ([0, 1, 2], [3]) and of("2,2", "none") == ([0, 1, 2, 3], [2, 2])
    assert "no square" in fails("3, 2", "token_grid") and "no such channel" in fails("4, 3", "channel", 3) and "NCHW" in fails("1,1,1,1,2", "mean") and "fill" in fails("4, 3", "mean", n=11)
