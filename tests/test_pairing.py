import random

from pyspark.sql import functions as F

from pixelquarry.operators import matching
from pixelquarry.plans.stream_queries import rocks_state
from pixelquarry.streaming import jobs

FILES = "generation long, kind string, path string, rel_stem string, stem string, broken boolean"


def made_up(seed):
    r = random.Random(seed)
    rows = {}
    for _ in range(120):
        kind, stem = r.choice(["image", "annotation"]), f"S{r.randrange(45)}"
        path = f"{r.randrange(3)}/{stem}.{'png' if kind == 'image' else 'json'}"
        rows[path] = (1, kind, path, path.rsplit(".", 1)[0], stem, r.random() < 0.15)
    return list(rows.values())


def at_once(spark, rows):
    df = spark.createDataFrame(rows, FILES)
    images, annotations = (df.where(F.col("kind") == k) for k in ("image", "annotation"))
    annotations = annotations.withColumn("image_path", F.lit(None).cast("string"))
    pairs = matching.by_basename(images, annotations)
    out = {r["path"]: r["status"] for r in matching.resolve(images, annotations, pairs).collect()}
    out |= {r["path"]: "hidden" for r in matching.hidden(images, pairs).collect()}
    return out | {r["path"]: "used" for r in annotations.collect() if r["path"] not in out}


def test_batches_and_restarts_give_what_all_files_at_once_give(spark, tmp_path):
    rows = made_up(5)
    source, index, check = (f"file://{tmp_path}/{x}" for x in ("files", "index", "check"))
    sent = []
    with rocks_state(spark):
        for part in (rows[:30], rows[30:31], rows[31:70] + rows[:10], rows[70:]):
            sent += part
            spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").parquet(source)
            stream = jobs.pairing(spark.readStream.schema(FILES).parquet(source))
            jobs.register(stream, index, check, 1).awaitTermination()  # a new run each time
            got = {r["asset_id"]: r["status"] for r in jobs.registered(spark, index, 1).collect()}
            assert got == at_once(spark, list(dict.fromkeys(sent)))
    assert {"valid", "duplicate_match", "orphan_annotation", "hidden", "used"} <= set(got.values())


def test_a_file_comes_out_only_when_its_status_may_have_changed(spark, tmp_path):
    """A second candidate corrects the first pair, a late partner the orphan; a third one leaves the others alone."""
    f = lambda kind, path: (1, kind, path, path, "same", False)
    source, index, check = (f"file://{tmp_path}/{x}" for x in ("files", "index", "check"))
    news = []
    with rocks_state(spark):
        for part in ([f("annotation", "a.json")], [f("image", "a.png")], [f("image", "b/a.png")], [f("image", "c/a.png")], [f("image", "c/a.png")]):
            spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").parquet(source)
            jobs.register(jobs.pairing(spark.readStream.schema(FILES).parquet(source)), index, check, 1).awaitTermination()
            out = spark.read.parquet(index)
            newest = out.agg(F.max("batch_id")).first()[0]
            news.append({r["asset_id"]: r["status"] for r in out.where(F.col("batch_id") == newest).collect()})
    assert news[:4] == [
        {"a.json": "orphan_annotation"},
        {"a.json": "used", "a.png": "valid"},
        {"a.json": "used", "a.png": "duplicate_match", "b/a.png": "duplicate_match"},
        {"c/a.png": "duplicate_match"},
    ]


def test_a_tail_ends_with_its_job(spark, tmp_path):
    schema = "event_id long, job_id string, state string"
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("events", "out", "check"))
    rows = [(1, "a", "queued"), (2, "b", "failed"), (3, "a", "running"), (4, "a", "succeeded"), (5, "a", "queued")]
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    assert not jobs.follow(stream, "a", 1, out, check, seconds=8)
    spark.createDataFrame(rows[3:], schema).coalesce(1).write.mode("append").parquet(source)
    assert jobs.follow(stream, "a", 1, out, check, seconds=60)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [3, 4]
