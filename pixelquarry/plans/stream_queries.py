"""Queries that run event streams over the given tables, and raster and annotation-file queries."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rasters as r
from ..operators import search
from ..scratch import shared_dir
from ..sources import files, snapshots
from ..streaming import jobs
from .views import VIEWS, view, with_views


def shared(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job log as a stream."""
    schema = view(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(re.sub(r"\bFROM events\b", "FROM {events}", VIEWS["job_events"]), events=raw).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(frame_of, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        where, frame = shared(spark), frame_of(spark, sf_dir)
        folder = lambda number: f"{where}/out/" + ("all" if mode == "complete" else f"batch={number}")
        # a batch that runs again writes its own folder again
        jobs.drain(frame, f"{where}/checkpoint", mode, lambda batch, number: batch.write.mode("overwrite").parquet(folder(number)))
        return spark.read.schema(frame.schema).option("recursiveFileLookup", "true").parquet(f"{where}/out")

    return run


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for streams that end here."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _states(spark, sf):
    with rocks_state(spark):
        out = _drained(lambda s, d: jobs.item_states(_events(s, d)), "update")(spark, sf)
    return out.groupBy("job_id", "item_id").agg(F.max_by("state", "attempts").alias("state"), F.max("attempts").alias("attempts"), F.sum("rejected").alias("rejected"))


def _results(spark, sf):
    """Claims and results of the job log; every fifth success is committed."""
    where = shared(spark)
    stream = _events(spark, sf).select("job_id", "item_id", "event_id", "state", (F.col("event_id") % 2).cast("string").alias("token"), ((F.col("state") == "succeeded") & (F.col("event_id") % 5 == 0)).alias("committed"))
    with rocks_state(spark):
        jobs.write_results(stream, where, f"{where}/checkpoint").awaitTermination()
    both = [spark.read.parquet(f"{where}/{n}").select("job_id", "item_id", "event_id", F.lit(n).alias("output"), "reason") for n in ("accepted", "rejected")]
    return both[0].unionByName(both[1])


def _pairing(spark, sf):
    """Image and annotation files that come in by parts, in any order, some twice and some of an older scan."""
    columns = ["path", "rel_stem", "stem", "broken"]
    every = view(spark, sf, "image_files").select(F.lit("image").alias("kind"), *columns).unionByName(view(spark, sf, "annotation_files").select(F.lit("annotation").alias("kind"), *columns))
    every = every.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(3)))
    where = shared(spark)
    with rocks_state(spark):
        for part in range(3):  # each is a run of its own, which goes on where the one before ended
            sent = every.where(F.col("part") == part).withColumn("generation", F.lit(1).cast("long"))
            late = every.where((F.col("part") == part - 1) & F.startswith("path", F.lit("img/1"))).select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("generation"))
            sent.unionByName(late).drop("part").write.mode("append").parquet(f"{where}/files")
            stream = jobs.pairing(spark.readStream.schema(sent.drop("part").schema).parquet(f"{where}/files"))
            jobs.register(stream, f"{where}/index", f"{where}/checkpoint", 1).awaitTermination()
    return jobs.registered(spark, f"{where}/index", 1).select("kind", F.col("asset_id").alias("path"), "status")


def _snapshots(spark, sf):
    """A walk through a data set that is written anew behind its first page, and the first page of a walk after that."""
    assets, root = view(spark, sf, "assets").where("dataset_id = 'ds1'"), shared(spark)
    snapshots.create(spark, root)
    old = snapshots.write(assets.where("index_revision < 3"), root, "ds1")
    begun = search.ordered(snapshots.page(spark, root, old, 100)).limit(100)
    last = begun.where("total > 100").orderBy("selectable", F.desc("display_path"), F.desc("asset_id")).take(1)
    new = snapshots.write(snapshots.read(spark, root, old).drop("index_revision").unionByName(assets.where("index_revision >= 3").drop("index_revision")), root, "ds1")
    rest = snapshots.read(spark, root, old).where(search.after(*(last[0][c] for c in ("selectable", "display_path", "asset_id"))) if last else F.lit(False))
    rest = rest.withColumn("stale", F.lit(snapshots.is_stale(spark, root, old)))
    fresh = search.ordered(snapshots.page(spark, root, new, 100)).limit(100)
    parts = [("first", begun), ("rest", rest), ("new", fresh)]
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("part"), "asset_id", F.col("index_revision").alias("revision"), "stale") for n, df in parts])


def _rasters(spark, sf):
    """Vectors as 8 x 8 grey images."""
    e = view(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("image"), F.transform(F.slice("embedding", 1, 64), lambda v: F.pmod(F.floor(v * 256), F.lit(256))).alias("v"))
    hexes = F.array_join(F.transform("v", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    return e.select("image", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(hexes).alias("pixels"))


def _documents(spark, sf):
    """Annotation documents of each image as JSON text; some broken."""
    shape = F.struct("label", F.lit("rectangle").alias("shape_type"))
    docs = view(spark, sf, "boxes").groupBy("image").agg(F.to_json(F.struct(F.concat(F.lit("img"), F.first("image").cast("string")).alias("imagePath"), F.array_sort(F.collect_list(shape)).alias("shapes"))).alias("document"))
    return docs.withColumn("document", F.when(F.col("image") % 13 == 0, "{").when(F.col("image") % 17 == 0, "[1]").when(F.col("image") % 19 == 0, '{"shapes": 3}').otherwise(F.col("document")))


def _quarter(a, parameters):
    """A user's operator: halves values, breaks its size contract on dark corners and fails on bright ones."""
    if a[0, 0] > 250:
        raise ValueError("too bright")
    return a // 2 if a[0, 0] >= parameters["least"] else a[1:]


QUERIES = {
    "k04_event_tail": _drained(lambda s, d: jobs.tail(_events(s, d), 900).select("event_id", "job_id", "state"), "append"),
    "k05_running_progress": _drained(lambda s, d: jobs.progress(_events(s, d)), "complete"),
    "k06_item_states": _states,
    "k01_pairing": _pairing,
    "k07_results": _results,
    "s06_snapshots": _snapshots,
    "k08_burst_sessions": _drained(lambda s, d: jobs.burst_sessions(_events(s, d), "1 hour").select("job_id", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total")), "complete"),
    "k10_activity_windows": _drained(lambda s, d: jobs.activity(_events(s, d), "24 hours").select(F.unix_micros("start").alias("start_us"), "state", "n", F.round("total", 4).alias("total")), "complete"),
    "s04_annotation_facts": lambda s, d: files.annotation_facts(_documents(s, d)).select("image", "error", F.col("shape_count").cast("long").alias("shape_count"), "image_path", F.array_join("labels", ",").alias("labels")),
    "s09_save_documents": lambda s, d: files.save_documents(_documents(s, d).select(F.col("image").alias("asset_id"), "document"), _documents(s, d).where("image % 3 = 0").select(F.col("image").alias("asset_id"), F.when(F.col("image") % 2 == 0, F.sha2("document", 256)).otherwise("old").alias("if_match"), F.lit("{}").alias("document")))[0].select("asset_id", "document"),
    "s11_tensor_statistics": lambda s, d: files.checked_tensors(view(s, d, "embeddings"), "embedding")[0].select("vec_id", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("mean", 6).alias("mean")),
    "a18_histogram": lambda s, d: r.histogram(_rasters(s, d)).groupBy("bin").agg(F.sum("n").alias("n")),
    "r01_turn": lambda s, d: r.turn(_rasters(s, d), 90).select("image", F.hex("pixels").alias("pixels")),
    "r02_gamma": lambda s, d: r.lookup(_rasters(s, d), r.gamma(0.5)).select("image", F.hex("pixels").alias("pixels")),
    "r03_otsu": lambda s, d: r.otsu(r.histogram(_rasters(s, d))),
    "r03_equalise": lambda s, d: r.equalise(_rasters(s, d)).select("image", F.hex("pixels").alias("pixels")),
    "r01_crop_flip": lambda s, d: r.flip(r.crop(_rasters(s, d), 1, 2, 5, 4), True).select("image", F.hex("pixels").alias("pixels")),
    "r02_minmax": lambda s, d: r.minmax(_rasters(s, d)).select("image", F.hex("pixels").alias("pixels")),
    "r02_contrast": lambda s, d: r.contrast(_rasters(s, d), 1.25).select("image", F.hex("pixels").alias("pixels")),
    "r02_brightness": lambda s, d: r.lookup(_rasters(s, d), r.brightness(1.25)).select("image", F.hex("pixels").alias("pixels")),
    "r03_stretch": lambda s, d: r.stretch(_rasters(s, d)).select("image", F.hex("pixels").alias("pixels")),
    "r04_gradient": lambda s, d: r.morphology(_rasters(s, d), 1, "gradient").select("image", F.hex("pixels").alias("pixels")),
    "r04_local_threshold": lambda s, d: r.local_threshold(_rasters(s, d), 1, 2.0).select("image", F.hex("pixels").alias("pixels")),
    "r07_pyramid_tiles": lambda s, d: r.pyramid_tiles(_rasters(s, d), 4).select("image", "level", "column", "row", "height", "width", F.hex("pixels").alias("pixels")),
    "d01_user_operator": lambda s, d: r.user_operator(_rasters(s, d), _quarter, {"least": 40}).select("image", "violation", F.hex("pixels").alias("pixels")),
    "r04_median": lambda s, d: r.focal(_rasters(s, d), 1, "median").select("image", F.hex("pixels").alias("pixels")),
    "r05_sobel": lambda s, d: r.gradient(_rasters(s, d), "sobel_x").select("image", F.hex("pixels").alias("pixels")),
    "r06_haar": lambda s, d: r.haar_pyramid(_rasters(s, d), 3),
    "r07_thumbnails": lambda s, d: r.thumbnails(_rasters(s, d), 4).select("image", "height", "width", F.hex("pixels").alias("pixels")),
}

_fold = (
    "CASE WHEN b.s = 'queued' AND b.g >= a.g THEN {'s': b.s, 'g': b.g, 'n': a.n, 'r': a.r} WHEN b.g <> a.g THEN {'s': a.s, 'g': a.g, 'n': a.n, 'r': a.r + 1} "
    "WHEN b.s = 'running' AND a.s IN ('queued', 'new') THEN {'s': b.s, 'g': a.g, 'n': a.n + 1, 'r': a.r} "
    "WHEN b.s IN ('succeeded', 'failed', 'canceled') AND a.s IN ('queued', 'running') THEN {'s': b.s, 'g': a.g, 'n': a.n, 'r': a.r} ELSE {'s': a.s, 'g': a.g, 'n': a.n, 'r': a.r + 1} END"
)
_told = "list_append(a.out, {'e': b.e, 'o': {0}, 'r': {1}})"
_verdict = (
    "CASE WHEN b.s = 'queued' THEN {'s': 'queued', 't': NULL, 'c': false, 'e': b.e, 'k': false, 'out': a.out} "
    "WHEN b.s = 'canceled' THEN {'s': CASE WHEN a.s IN ('new', 'queued') THEN 'canceled' ELSE a.s END, 't': a.t, 'c': true, 'e': b.e, 'k': false, 'out': a.out} "
    "WHEN b.s = 'running' AND a.s IN ('new', 'queued') AND NOT a.c THEN {'s': 'running', 't': b.t, 'c': a.c, 'e': b.e, 'k': false, 'out': " + _told.replace("{0}", "'accepted'").replace("{1}", "'claimed'") + "} "
    "WHEN b.s <> 'running' AND a.s = 'running' AND a.t = b.t AND (NOT a.c OR b.k) THEN {'s': b.s, 't': NULL, 'c': a.c, 'e': b.e, 'k': false, 'out': " + _told.replace("{0}", "'accepted'").replace("{1}", "CASE WHEN a.c THEN 'committed' ELSE 'finished' END") + "} "
    "ELSE {'s': a.s, 't': a.t, 'c': a.c, 'e': b.e, 'k': false, 'out': " + _told.replace("{0}", "'rejected'").replace("{1}", "CASE WHEN b.s = 'running' THEN 'not to be claimed' WHEN a.s <> 'running' THEN 'not running' WHEN a.t <> b.t THEN 'another claim' ELSE 'canceled' END") + "} END"
)
_none = "CAST([] AS STRUCT(e BIGINT, o VARCHAR, r VARCHAR)[])"
_ref = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_near = "b.i = (" + _ref.format("a.i // 8 + k.dy") + ") * 8 + (" + _ref.format("a.i % 8 + k.dx") + ")"
_sobel = "k AS (SELECT unnest([-1, -1, 0, 0, 1, 1]) AS dy, unnest([-1, 1, -1, 1, -1, 1]) AS dx, unnest([-1, 1, -2, 2, -1, 1]) AS w)"


def _level(k: int, cells: str, finer: str | None, side: int) -> str:
    """Energies e<k> of the bands of a level of the Haar pyramid, and the cells of the next one."""
    bands = {"LL": "p + q + r + s", "LH": "p + q - r - s", "HL": "p - q + r - s", "HH": "p - q - r + s"}
    out = f"e{k} AS (" + " UNION ALL ".join(f"SELECT image, {k} AS level, '{b}' AS band, {side} AS side, sum(power(({e}) / 4, 2)) AS energy FROM {cells} GROUP BY image" for b, e in bands.items()) + ")"
    if finer:
        corner = lambda n, y, x: f"max(CASE WHEN y % 2 = {y} AND x % 2 = {x} THEN (p + q + r + s) / 4 END) AS {n}"
        out += f", {finer} AS (SELECT image, y // 2 AS y, x // 2 AS x, {corner('p', 0, 0)}, {corner('q', 0, 1)}, {corner('r', 1, 0)}, {corner('s', 1, 1)} FROM {cells} GROUP BY image, {cells}.y // 2, {cells}.x // 2)"
    return out


_px = "px AS (SELECT CAST(vec_id AS STRING) AS image, i - 1 AS i, CAST(((floor(256 * embedding[i]) % 256) + 256) % 256 AS INT) AS v FROM embeddings, unnest(range(1, 65)) AS t(i))"
_hex = "string_agg(format('{:02X}', v), '' ORDER BY i)"
ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "k04_event_tail": "SELECT event_id, job_id, state FROM job_events WHERE event_id > 900",
        "k05_running_progress": "SELECT job_id, state, count(*) AS count FROM job_events GROUP BY ALL",
        "k06_item_states": f"WITH l AS (SELECT job_id, item_id, list({{'s': state, 'g': generation, 'n': 0::BIGINT, 'r': 0::BIGINT}} ORDER BY event_id) AS e FROM job_events GROUP BY ALL), f AS (SELECT job_id, item_id, list_reduce(list_prepend({{'s': 'new', 'g': -1::BIGINT, 'n': 0::BIGINT, 'r': 0::BIGINT}}, e), lambda a, b: {_fold}) AS x FROM l) SELECT job_id, item_id, x.s AS state, x.n AS attempts, x.r AS rejected FROM f",
        "k07_results": f"WITH l AS (SELECT job_id, item_id, list({{'s': state, 't': CAST(event_id % 2 AS VARCHAR), 'c': false, 'e': CAST(event_id AS BIGINT), 'k': state = 'succeeded' AND event_id % 5 = 0, 'out': {_none}}} ORDER BY event_id) AS e FROM job_events GROUP BY ALL), f AS (SELECT job_id, item_id, list_reduce(list_prepend({{'s': 'new', 't': NULL, 'c': false, 'e': CAST(-1 AS BIGINT), 'k': false, 'out': {_none}}}, e), lambda a, b: {_verdict}) AS x FROM l), u AS (SELECT job_id, item_id, unnest(x.out) AS o FROM f) SELECT job_id, item_id, o.e AS event_id, o.o AS output, o.r AS reason FROM u",
        "k01_pairing": "WITH f AS (SELECT 'image' AS kind, path, lower(stem) AS k, broken FROM image_files UNION ALL SELECT 'annotation', path, lower(stem), broken FROM annotation_files), c AS (SELECT k, count(*) FILTER (kind = 'image') AS n, count(*) FILTER (kind = 'annotation') AS m, bool_or(broken) FILTER (kind = 'annotation') AS b FROM f GROUP BY k) SELECT kind, path, CASE WHEN kind = 'annotation' THEN CASE WHEN n = 0 THEN 'orphan_annotation' ELSE 'used' END WHEN m = 0 THEN 'hidden' WHEN n > 1 OR m > 1 THEN 'duplicate_match' WHEN broken THEN 'corrupt_image' WHEN b THEN 'corrupt_annotation' ELSE 'valid' END AS status FROM f JOIN c USING (k)",
        "s06_snapshots": "WITH o AS (SELECT asset_id, row_number() OVER (ORDER BY selectable DESC, display_path, asset_id) AS i FROM assets WHERE dataset_id = 'ds1' AND index_revision < 3), n AS (SELECT asset_id, row_number() OVER (ORDER BY selectable DESC, display_path, asset_id) AS i FROM assets WHERE dataset_id = 'ds1') SELECT CASE WHEN i <= 100 THEN 'first' ELSE 'rest' END AS part, asset_id, CAST(1 AS BIGINT) AS revision, i > 100 AS stale FROM o UNION ALL SELECT 'new', asset_id, 2, false FROM n WHERE i <= 100",
        "k08_burst_sessions": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts) >= 3600000000 THEN 1 ELSE 0 END AS nw FROM job_events), b AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT job_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(ms), 4) AS total FROM b GROUP BY job_id, k",
        "k10_activity_windows": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, state, count(*) AS n, round(sum(ms), 4) AS total FROM job_events GROUP BY ALL",
        "s04_annotation_facts": "SELECT image, CASE WHEN image % 13 = 0 THEN 'no JSON' WHEN image % 17 = 0 THEN 'no object' WHEN image % 19 = 0 THEN 'shapes is no list' END AS error, CASE WHEN image % 13 <> 0 AND image % 17 <> 0 AND image % 19 <> 0 THEN count(*) END AS shape_count, CASE WHEN image % 13 <> 0 AND image % 17 <> 0 AND image % 19 <> 0 THEN concat('img', image) END AS image_path, CASE WHEN image % 13 <> 0 AND image % 17 <> 0 AND image % 19 <> 0 THEN string_agg(DISTINCT label, ',' ORDER BY label) ELSE CASE WHEN image % 13 = 0 THEN '' ELSE '' END END AS labels FROM boxes GROUP BY image",
        "s09_save_documents": "WITH d AS (SELECT image, CASE WHEN image % 13 = 0 THEN '{' WHEN image % 17 = 0 THEN '[1]' WHEN image % 19 = 0 THEN '{\"shapes\": 3}' ELSE concat('{\"imagePath\":\"img', image, '\",\"shapes\":[', string_agg(concat('{\"label\":\"', label, '\",\"shape_type\":\"rectangle\"}'), ',' ORDER BY label), ']}') END AS document FROM boxes GROUP BY image) SELECT image AS asset_id, CASE WHEN image % 6 = 0 THEN '{}' ELSE document END AS document FROM d",
        "s11_tensor_statistics": "SELECT vec_id, round(CAST(list_min(embedding) AS DOUBLE), 6) AS min, round(CAST(list_max(embedding) AS DOUBLE), 6) AS max, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean FROM embeddings",
        "a18_histogram": f"WITH {_px} SELECT v AS bin, count(*) AS n FROM px GROUP BY v",
        "r01_turn": f"WITH {_px}, q AS (SELECT image, v, i % 8 * 8 + 7 - i // 8 AS i FROM px) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r02_gamma": f"WITH {_px}, q AS (SELECT image, i, CAST(round_even(255 * sqrt(v / 255), 0) AS INT) AS v FROM px) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r01_crop_flip": f"WITH {_px}, q AS (SELECT image, i // 8 * 8 - i % 8 AS i, v FROM px WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 1 AND 5) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r02_minmax": f"WITH {_px}, m AS (SELECT image, i, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image)), q AS (SELECT image, i, CAST(coalesce(round_even((v - lo) * 255.0 / nullif(hi - lo, 0), 0), 0) AS INT) AS v FROM m) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r02_contrast": f"WITH {_px}, m AS (SELECT image, i, v, floor(avg(v) OVER (PARTITION BY image) + 0.5) AS c FROM px), q AS (SELECT image, i, CAST(least(255, greatest(0, round_even(c + (v - c) * 1.25::DOUBLE, 0))) AS INT) AS v FROM m) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r02_brightness": f"WITH {_px}, q AS (SELECT image, i, CAST(least(255, round_even(v * 1.25::DOUBLE, 0)) AS INT) AS v FROM px) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r03_stretch": f"WITH {_px}, m AS (SELECT image, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px GROUP BY image), q AS (SELECT px.image, i, CAST(floor(least(255.0, greatest(0.0, (v - lo) * 255.0 / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END))) + 1e-9) AS INT) AS v FROM px JOIN m USING (image)) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r04_gradient": f"WITH {_px}, d AS (SELECT unnest([-1, 0, 1]) AS o), q AS (SELECT a.image, a.i, max(b.v) - min(b.v) AS v FROM px AS a, d AS e, d AS f, px AS b WHERE b.image = a.image AND b.i = greatest(0, least(7, a.i // 8 + e.o)) * 8 + greatest(0, least(7, a.i % 8 + f.o)) GROUP BY a.image, a.i) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r04_local_threshold": f"WITH {_px}, d AS (SELECT unnest([-1, 0, 1]) AS o), q AS (SELECT a.image, a.i, CASE WHEN any_value(a.v) > round_even(avg(b.v), 0) - 2 THEN 255 ELSE 0 END AS v FROM px AS a, d AS e, d AS f, px AS b WHERE b.image = a.image AND b.i = greatest(0, least(7, a.i // 8 + e.o)) * 8 + greatest(0, least(7, a.i % 8 + f.o)) GROUP BY a.image, a.i) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r07_pyramid_tiles": f"WITH {_px}, l AS (SELECT unnest([0, 1, 2, 3]) AS level), q AS (SELECT image, level, i // 8 // (1 << (3 - level)) AS y, i % 8 // (1 << (3 - level)) AS x, CAST(round_even(avg(v), 0) AS INT) AS v FROM px, l GROUP BY ALL) SELECT image, CAST(level AS INT) AS level, CAST(x // 4 AS INT) AS column, CAST(y // 4 AS INT) AS row, CAST(least(4, 1 << level) AS INT) AS height, CAST(least(4, 1 << level) AS INT) AS width, string_agg(format('{{:02X}}', v), '' ORDER BY y, x) AS pixels FROM q GROUP BY image, level, x // 4, y // 4",
        "d01_user_operator": f"WITH {_px}, q AS (SELECT image, max(CASE WHEN i = 0 THEN v END) AS c, string_agg(format('{{:02X}}', v // 2), '' ORDER BY i) AS pixels FROM px GROUP BY image) SELECT image, CASE WHEN c > 250 THEN 'ValueError' WHEN c < 40 THEN 'size changed' END AS violation, CASE WHEN c BETWEEN 40 AND 250 THEN pixels END AS pixels FROM q",
        "r03_otsu": f"WITH {_px}, h AS (SELECT image, v AS bin, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT image, bin, sum(n) OVER up AS n0, sum(n * bin) OVER up AS s0, sum(n) OVER w AS n, sum(n * bin) OVER w AS s FROM h WINDOW up AS (PARTITION BY image ORDER BY bin), w AS (PARTITION BY image)), d AS (SELECT image, bin, CASE WHEN n > n0 THEN CAST(n0 * (n - n0) AS DOUBLE) * power(s0 / n0 - (s - s0) / (n - n0), 2) ELSE 0 END AS b FROM c) SELECT image, bin AS threshold FROM d QUALIFY row_number() OVER (PARTITION BY image ORDER BY b DESC, bin) = 1",
        "r03_equalise": f"WITH {_px}, h AS (SELECT image, v, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT image, v, sum(n) OVER (PARTITION BY image ORDER BY v) AS c, sum(n) OVER (PARTITION BY image) AS t FROM h), l AS (SELECT *, min(c) OVER (PARTITION BY image) AS low FROM c), q AS (SELECT px.image, px.i, CAST(CASE WHEN t = low THEN px.v ELSE round_even((c - low) * 255.0 / (t - low), 0) END AS INT) AS v FROM px JOIN l ON l.image = px.image AND l.v = px.v) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r05_sobel": f"WITH {_px}, {_sobel}, q AS (SELECT a.image, a.i, CAST(least(255, abs(sum(k.w * b.v))) AS INT) AS v FROM px AS a, k, px AS b WHERE b.image = a.image AND {_near} GROUP BY a.image, a.i) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
        "r06_haar": "WITH RECURSIVE " + _px + ", l1 AS (SELECT image, i // 16 AS y, i % 8 // 2 AS x, max(CASE WHEN i // 8 % 2 = 0 AND i % 2 = 0 THEN v END) AS p, max(CASE WHEN i // 8 % 2 = 0 AND i % 2 = 1 THEN v END) AS q, max(CASE WHEN i // 8 % 2 = 1 AND i % 2 = 0 THEN v END) AS r, max(CASE WHEN i // 8 % 2 = 1 AND i % 2 = 1 THEN v END) AS s FROM px GROUP BY ALL), " + _level(1, "l1", "l2", 4) + ", " + _level(2, "l2", "l3", 2) + ", " + _level(3, "l3", None, 1) + " SELECT image, level, band, side AS height, side AS width, energy FROM e1 UNION ALL SELECT image, level, band, side, side, energy FROM e2 UNION ALL SELECT image, level, band, side, side, energy FROM e3",
        "r07_thumbnails": f"WITH {_px}, q AS (SELECT image, i // 16 * 4 + i % 8 // 2 AS i, CAST(round_even(avg(v), 0) AS INT) AS v FROM px GROUP BY ALL) SELECT image, 4 AS height, 4 AS width, {_hex} AS pixels FROM q GROUP BY image",
        "r04_median": f"WITH {_px}, d AS (SELECT unnest([-1, 0, 1]) AS o), q AS (SELECT a.image, a.i, CAST(median(b.v) AS INT) AS v FROM px AS a, d AS e, d AS f, px AS b WHERE b.image = a.image AND b.i = greatest(0, least(7, a.i // 8 + e.o)) * 8 + greatest(0, least(7, a.i % 8 + f.o)) GROUP BY a.image, a.i) SELECT image, {_hex} AS pixels FROM q GROUP BY image",
    }.items()
}
