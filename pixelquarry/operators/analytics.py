"""Statistics of data sets, predictions, jobs and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfc, trimmed_category
from ..scratch import stored
from . import selection

ACTIVE, FINISHED = ("queued", "running"), ("succeeded", "failed", "canceled")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def distribution(assets: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """How many assets have each value of an array column (once per asset), or of a plain one; the ``n`` commonest."""
    value = F.explode(F.array_distinct(column)) if dict(assets.dtypes)[column].startswith("array") else F.col(column)
    out = assets.select(value.alias("value")).groupBy("value").count()
    return top(out, n) if n else out


def top(counts: DataFrame, n: int, key: str = "value") -> DataFrame:
    """The commonest; equal counts in key order."""
    return counts.orderBy(F.desc("count"), key).limit(n)


def category_counts(shapes: DataFrame) -> DataFrame:
    """Shapes of each category per image."""
    raw = shapes.groupBy("image", trimmed_category(F.col("label")).alias("_label")).count()
    return raw.withColumn("category", nfc(F.col("_label"))).groupBy("image", "category").agg(F.sum("count").alias("count"))


def label_choices(shapes: DataFrame, preferred: list[str], limit: int) -> DataFrame:
    """Labels to offer, with their position: preferred ones first, then by count."""
    raw = shapes.groupBy(trimmed_category(F.col("label")).alias("_label")).count()
    counts = raw.withColumn("label", nfc(F.col("_label"))).groupBy("label").agg(F.sum("count").alias("count")).withColumn("preferred", F.col("label").isin(preferred))
    return counts.orderBy(F.desc("preferred"), F.desc("count"), "label").limit(limit)


def prediction_groups(predictions: DataFrame) -> DataFrame:
    """Per image and label: count and best score, a score that is not finite as 0."""
    finite = F.when(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf")), 0.0).otherwise(F.col("score"))
    return predictions.groupBy("image", "label").agg(F.count("*").alias("n"), F.max(finite).alias("best"))


def final_states(events: DataFrame, *key: str) -> DataFrame:
    """Latest state of each item by event id."""
    return events.groupBy(*key).agg(F.max_by("state", "event_id").alias("state"), F.max("event_id").alias("event_id"))


def progress(items: DataFrame, key: str = "job_id") -> DataFrame:
    """Items per state, finished ones and their ratio (1 for a job without items)."""
    out = items.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in (*ACTIVE, *FINISHED)))
    out = out.withColumn("finished", F.col("succeeded") + F.col("failed") + F.col("canceled"))
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("finished") / F.col("total")))


def job_outcome(progressed: DataFrame) -> DataFrame:
    """A job's state from its items' counts."""
    state = F.when(F.col("finished") < F.col("total"), "running").when((F.col("failed") > 0) & (F.col("succeeded") > 0), "succeeded_with_errors").when(F.col("failed") > 0, "failed").when(F.col("canceled") == F.col("total"), "canceled")
    return progressed.withColumn("state", state.otherwise("succeeded"))


def operator_timings(log: DataFrame, *key: str, ms: str = "ms") -> DataFrame:
    """Mean milliseconds and samples per operator."""
    return log.groupBy(*key).agg(F.avg(ms).alias("mean_ms"), F.count(ms).alias("samples"))


def latency(log: DataFrame, key: str, ms: str = "ms", fractions: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles (rank round((n - 1) f), ties to even), mean and maximum; ranks are found by counting."""
    places = {f"p{int(f * 100)}": F.bround((F.col("n") - 1) * F.lit(f)) for f in fractions}
    out = selection.quantiles(selection.counted(log, key, ms), places)
    return out.select(F.col("key").alias(key), "n", *places, "mean", "max")


def throughput(log: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Rows a second between first and last, and failures."""
    span = F.max(_micros(ts)) - F.min(_micros(ts))
    return log.groupBy(key).agg(F.count("*").alias("n"), (F.count("*") / (F.nullif(span, F.lit(0)) / 1e6)).alias("per_second"), F.count_if(F.col("state") == "failed").alias("errors"))


def top_errors(log: DataFrame, key: str, message: str, n: int = 3) -> DataFrame:
    """The ``n`` commonest messages of each key with their counts; equal counts in text order."""
    counts = log.where(F.col(message).isNotNull()).groupBy(key, message).count()
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), message))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def jobs_with_running_items(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that have a running item."""
    return jobs.join(items.where("state = 'running'").select("job_id").distinct(), "job_id", "left_semi")


def settled_jobs(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs without a queued or running item left."""
    return jobs.join(items.where(F.col("state").isin(*ACTIVE)).select("job_id").distinct(), "job_id", "left_anti")


def usage(runs: DataFrame) -> DataFrame:
    """How often and when last each model was used."""
    return runs.groupBy("model_id").agg(F.count("*").alias("uses"), F.max("updated_at").alias("last_used_at"))


def first_wins(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the repeats."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def override(built_in: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Imported rows replace built-in ones of the same key; ``overrides`` tells which did."""
    a, b = built_in.alias("a"), imported.alias("b")
    columns = [c for c in built_in.columns if c != key]
    both = a.join(b, key, "full_outer")
    has = F.col(f"b.{columns[0]}").isNotNull()
    return both.select(key, *(F.when(has, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns), (has & F.col(f"a.{columns[0]}").isNotNull()).alias("overrides"))


def catalog(models: DataFrame, used: DataFrame) -> DataFrame:
    """Models in catalog order: readiness (unloaded where unknown), uses, last use, name."""
    models = models.withColumn("readiness", F.coalesce("readiness", F.lit("unloaded")))
    rank = F.when(F.col("readiness") == "loaded", 0).when(F.col("readiness") == "loading", 1).when(F.col("readiness") == "available", 2).when(F.col("readiness") == "missing_weights", 3).otherwise(4)
    out = models.join(used, "model_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("readiness_rank", rank)
    return out.orderBy("readiness_rank", F.desc("uses"), F.desc_nulls_last("last_used_at"), F.lower("name"), "model_id")


#: States that come first, and second, as what stands for a burst.
BURST_FIRST, BURST_SECOND = ("queued", "running"), ("failed", "succeeded_with_errors", "interrupted")


def bursts(rows: DataFrame, key: list[str], ts: str, seconds: float, total: str, item: str | None = None, preferred: str | None = None, indices: str | None = None) -> DataFrame:
    """Rows of a key closer than ``seconds`` to the one before are one burst.  With ``item`` (rows have a state), the row
    that stands for it: active before in trouble before the rest, then the preferred item, then the newest.  With
    ``indices`` (an array column) the burst has the sorted union of them."""
    w = Window.partitionBy(*key).orderBy(ts, total)
    gap = (_micros(ts) - F.lag(_micros(ts)).over(w)) > int(seconds * 1_000_000)
    grouped = rows.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("long")).withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = []
    if item:
        priority = F.when(F.col("state").isin(*BURST_FIRST), 0).when(F.col("state").isin(*BURST_SECOND), 1).otherwise(2)
        order = F.struct(priority, ~F.col(item).eqNullSafe(F.lit(preferred)), -_micros(ts), item)
        more = [F.min_by(item, order).alias("representative")]
    if indices:
        more.append(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(F.coalesce(indices, F.array().cast(rows.schema[indices].dataType))))))).alias(indices))
    return grouped.groupBy(*key, "burst").agg(F.count("*").alias("n"), F.sum(total).alias("total"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), *more)


def latest(rows: DataFrame, key: list[str], active: Column, ts: str, tie: str) -> DataFrame:
    """The newest row of each key, active ones before others."""
    w = Window.partitionBy(*key).orderBy(active.desc(), F.desc(ts), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_turns(log: DataFrame, key: str, order: str, n: int, longest: int = 4000) -> DataFrame:
    """The last ``n`` turns of each key with their place, oldest first, long texts cut."""
    back = log.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), "role"))).where(F.col("_back") <= n)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_back"))).alias("place")
    return back.select(key, order, "role", F.substring("text", 1, longest).alias("text"), place)


def state_changes(events: DataFrame, *key: str) -> DataFrame:
    """Events whose state differs from the one before of the same item, with that state."""
    before = F.lag("state").over(Window.partitionBy(*key).orderBy("event_id"))
    return events.withColumn("previous", before).where("previous IS NULL OR previous <> state")


def reusable_run(runs: DataFrame) -> DataFrame:
    """Per data set and signature the newest run that neither failed nor was canceled."""
    return latest(runs.where("state NOT IN ('failed', 'canceled')"), ["dataset_id", "signature"], F.lit(True), "updated_at", "run_id")


def stale_runs(runs: DataFrame, kept: DataFrame) -> DataFrame:
    """Whole-dataset runs whose signature is not the kept one of their data set (null-safe)."""
    return runs.where("whole_dataset").join(kept.select("dataset_id", F.col("signature").alias("_kept")), "dataset_id").where(~F.col("signature").eqNullSafe(F.col("_kept"))).drop("_kept")


def dataset_fingerprint(items: DataFrame, key: str, item: str, print_: str) -> DataFrame:
    """Order-free digest of each data set's items: hashes of (item, fingerprint) are summed as decimals and hashed, so
    no group is ever gathered.  ``sorted_fingerprint`` is the digest of the sorted list, for small sets."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", item, print_), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return items.groupBy(key).agg(F.sum(part).alias("_sum"), F.count("*").alias("n")).select(key, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("_sum").cast("string")), 256).alias("fingerprint"))


def sorted_fingerprint(items: DataFrame, key: str, item: str, print_: str) -> DataFrame:
    """SHA-256 of each data set's sorted (item, fingerprint) list as JSON, which one row must hold: for sets of a size that
    allows it.  ``tree_fingerprint`` is for any."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(print_).alias("f"))))
    listed = F.concat(F.lit('{"dataset_id":"'), F.col(key).cast("string"), F.lit('","items":'), F.to_json(F.transform("_pairs", lambda p: F.array(p["i"], p["f"]))), F.lit("}"))
    return items.groupBy(key).agg(pairs.alias("_pairs")).select(key, F.sha2(listed, 256).alias("fingerprint"))


def tensor_statistics(values: DataFrame, key: str, value: str) -> DataFrame:
    """Minimum, maximum, mean and linearly interpolated percentiles of exploded tensors; ranks are found by counting."""
    places = {f"p{int(f * 100):02d}": (F.col("n") - 1) * F.lit(f) for f in (0.01, 0.05, 0.5, 0.95, 0.99)}
    out = selection.quantiles(selection.counted(values, key, value), places)
    return out.select(F.col("key").alias(key), "min", "max", "mean", *places)


def tree_fingerprint(items: DataFrame, key: str, item: str, print_: str, leaf: int = 256) -> DataFrame:
    """Digest of each data set's items at any size: a tree over ranges of the items' own hashes.

    An item (with its fingerprint and how often it occurs) falls into the range of its SHA-256's first d hex digits, d
    the least with ``leaf`` items a range or fewer on average.  A range's digest is that of its items in order, and of a
    digit less that of the up to 16 ranges below, up to none.  Where a range begins is in the items, so neither order nor
    partitioning matters, and no row holds more than a range."""
    once = items.groupBy(F.col(key).alias("key"), F.col(item).cast("string").alias("item"), F.col(print_).cast("string").alias("print")).agg(F.count("*").alias("n"))
    depth = sum(((F.count("*") > leaf * 16**d).cast("int") for d in range(14)), F.lit(0)).alias("depth")
    sizes = stored(once.groupBy(F.col("key").alias("of")).agg(depth, F.sum("n").alias("items")), "sizes")
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    text = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    line = F.concat(text("item"), text("print"), F.lit("x"), F.col("n").cast("string"))
    named = once.join(sizes, F.col("key").eqNullSafe(F.col("of"))).select("key", "items", "depth", F.expr("substr(sha2(coalesce(item, ''), 256), 1, depth)").alias("range"), line.alias("line"))
    nodes = named.groupBy("key", "items", "depth", "range").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    for level in range(deepest, 0, -1):
        low = nodes.where(F.col("depth") == level)
        ordered = F.array_sort(F.collect_list(F.struct("range", "digest")))
        merged = low.groupBy("key", "items", F.expr("depth - 1").alias("depth"), F.expr("substr(range, 1, depth - 1)").alias("range")).agg(ordered.alias("below"))
        merged = merged.select("key", "items", "depth", "range", F.sha2(F.array_join("below.digest", "\n"), 256).alias("digest"))
        nodes = nodes.where(F.col("depth") < level).unionByName(merged)
    return nodes.select(F.col("key").alias(key), F.col("items").alias("n"), F.col("digest").alias("fingerprint"))
