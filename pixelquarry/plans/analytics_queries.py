"""Queries of matching, statistics and ordered computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics as a
from ..operators import matching as m
from ..scratch import positions
from .views import view, with_views


def _files(spark, sf):
    return view(spark, sf, "image_files"), view(spark, sf, "annotation_files")


def _pairs(strategy):
    return lambda spark, sf: m.STRATEGIES[strategy](*_files(spark, sf))


def _resolved(strategy, managed=False):
    def run(spark, sf):
        images, annotations = _files(spark, sf)
        return m.resolve(images, annotations, m.STRATEGIES[strategy](images, annotations), managed)

    return run


def _shown(strategy, managed=False):
    return lambda spark, sf: _resolved(strategy, managed)(spark, sf).select("path", F.size("annotation_paths").cast("long").alias("n_annotations"), "status", "selectable")


def _summary(spark, sf):
    images, annotations = _files(spark, sf)
    pairs = m.by_relative_stem(images, annotations)
    return m.summary(m.resolve(images, annotations, pairs), m.hidden(images, pairs))


def _progress(spark, sf):
    events = view(spark, sf, "job_events")
    return a.job_outcome(a.progress(a.final_states(events, "job_id", "item_id")))


def _states_and_jobs(spark, sf):
    """Latest states of items, and all jobs."""
    events = view(spark, sf, "job_events")
    return a.final_states(events, "job_id", "item_id"), events.select("job_id").distinct()


def _rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _catalog(spark, sf):
    first, _ = a.first_wins(view(spark, sf, "models"), "model_id", "file_order")
    return positions(a.catalog(first, a.usage(view(spark, sf, "runs"))).select("model_id", "readiness_rank", "uses", "last_used_at"))


def _override(spark, sf):
    first, again = a.first_wins(view(spark, sf, "models"), "model_id", "file_order")
    return a.override(first, again, "model_id").select("model_id", "name", "readiness", "overrides")


def _stale(spark, sf):
    runs = view(spark, sf, "runs")
    kept = a.latest(runs, ["dataset_id"], F.col("state") == "running", "updated_at", "run_id")
    return a.stale_runs(runs, kept).select("run_id", "dataset_id", "signature")


def _health(spark, sf):
    return view(spark, sf, "models").agg(F.count("*").alias("n_files"), F.countDistinct("model_id").alias("n_models"), F.countDistinct(F.when(F.col("can_predict"), F.col("description"))).alias("n_adapters"))


def _indicator(spark, sf):
    """Status of each asset from its newest job event."""
    events = view(spark, sf, "job_events").withColumn("asset_id", F.concat(F.lit("a"), F.expr("CAST(event_id % 2500 AS STRING)")))
    newest = a.latest(events, ["asset_id"], F.col("state").isin(*a.ACTIVE), "ts", "event_id").withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ms") / 100)))
    shown = F.when(F.col("state").isNull(), "none").when(F.col("state") == "running", "busy").when(F.col("state") == "queued", "waiting").when(F.col("state") == "failed", "error").otherwise("done")
    return view(spark, sf, "assets").join(newest, "asset_id", "left").select("asset_id", shown.alias("indicator"), F.coalesce("p", F.lit(0.0)).alias("progress"))


def _overlay(spark, sf):
    """Rasters (documents stand in: sizes by length) against asset sizes."""
    rasters = view(spark, sf, "documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("asset_id"), (F.col("n_chars") % 40 * 200).alias("w"), ((F.col("doc_id") % 50 + 1) * 150).alias("h"), "source")
    kind = F.when(F.col("width").isNull(), "unsupported").when((F.col("w") == F.col("width")) & (F.col("h") == F.col("height")), "overlay").when(F.abs(F.col("w") / F.col("h") - F.col("width") / F.col("height")) < 0.5, "overlay_scaled").otherwise("standalone")
    return rasters.join(view(spark, sf, "assets"), "asset_id").select("asset_id", kind.alias("kind"))


QUERIES = {
    "j01_relative_stem": _pairs("relative_stem"),
    "j02_sidecar": lambda spark, sf: m.by_sidecar(_files(spark, sf)[0], _files(spark, sf)[1].withColumn("path", F.regexp_replace("path", "^ann/", "img/"))),
    "j03_basename": _pairs("basename"),
    "j04_image_path": _pairs("image_path"),
    "j05_managed_storage": _shown("basename", True),
    "j06_ambiguity": _shown("basename"),
    "j08_orphans": lambda spark, sf: m.orphans(_files(spark, sf)[1], m.by_image_path(*_files(spark, sf))).select("path"),
    "j09_hidden": lambda spark, sf: m.hidden(_files(spark, sf)[0], m.by_relative_stem(*_files(spark, sf))).select("path"),
    "u01_files_of_roots": lambda spark, sf: m.files_of_roots(*(view(spark, sf, t).select("path") for t in ("annotation_files", "annotation_files", "image_files"))),
    "a01_status_counts": lambda spark, sf: view(spark, sf, "assets").groupBy("dataset_id", "status").count(),
    "a02_scan_summary": _summary,
    "w08_sequence": lambda spark, sf: m.numbered(_files(spark, sf)[0]).select("path", "sequence"),
    "a03_label_distribution": lambda spark, sf: a.distribution(view(spark, sf, "assets"), "labels", 8),
    "a03_shape_types": lambda spark, sf: a.distribution(view(spark, sf, "assets"), "shape_types"),
    "a04_category_counts": lambda spark, sf: a.category_counts(view(spark, sf, "boxes").withColumn("label", F.expr("CASE WHEN label = 'R' THEN '  ' ELSE concat(' ', label, ' ') END"))),
    "a05_label_choices": lambda spark, sf: a.label_choices(view(spark, sf, "assets").select(F.explode("labels").alias("label")), ["gizmo", "blue"], 7).select("label", "count", "preferred"),
    "a06_prediction_groups": lambda spark, sf: a.prediction_groups(view(spark, sf, "boxes")),
    "a07_job_progress": _progress,
    "a09_operator_timings": lambda spark, sf: _rounded(a.operator_timings(view(spark, sf, "job_events"), "job_id", "state")),
    "a13_latency": lambda spark, sf: _rounded(a.latency(view(spark, sf, "job_events"), "job_id")),
    "a14_throughput": lambda spark, sf: _rounded(a.throughput(view(spark, sf, "job_events"), "job_id")),
    "a14_top_errors": lambda spark, sf: a.top_errors(view(spark, sf, "job_events").where("state = 'failed'").withColumn("message", F.concat(F.lit("error "), (F.floor("ms") % 7).cast("string"))), "job_id", "message", 2).select("job_id", "message", "count", F.col("place").cast("long").alias("place")),
    "a19_representatives": lambda spark, sf: _rounded(a.bursts(view(spark, sf, "job_events"), ["job_id"], "ts", 3600, "ms", "event_id", 7).select("job_id", "burst", "n", "representative"), 4),
    "j11_running_jobs": lambda spark, sf: a.jobs_with_running_items(*_states_and_jobs(spark, sf)),
    "j15_unloaded": lambda spark, sf: a.catalog(view(spark, sf, "models").withColumn("readiness", F.when(F.col("readiness") != "missing_weights", F.col("readiness"))), a.usage(view(spark, sf, "runs"))).groupBy("readiness", "readiness_rank").agg(F.count("*").alias("n"), F.sum("uses").alias("uses")),
    "a15_model_usage": lambda spark, sf: a.usage(view(spark, sf, "runs")),
    "a16_catalog_health": _health,
    "a17_repeated_models": lambda spark, sf: a.first_wins(view(spark, sf, "models"), "model_id", "file_order")[1].select("model_id", "file_order"),
    "a19_weight_indices": lambda spark, sf: a.bursts(view(spark, sf, "job_events").withColumn("weights", F.expr("CASE WHEN event_id % 4 <> 0 THEN array(event_id % 7, event_id % 3) END")), ["job_id"], "ts", 3600, "ms", indices="weights").select("job_id", "burst", F.array_join("weights", ",").alias("weights")),
    "a19_bursts": lambda spark, sf: _rounded(a.bursts(view(spark, sf, "job_events"), ["job_id"], "ts", 3600, "ms"), 4),
    "a11_dataset_fingerprint": lambda spark, sf: a.sorted_fingerprint(view(spark, sf, "assets"), "dataset_id", "asset_id", "display_path"),
    "a11_tree_fingerprint": lambda spark, sf: a.tree_fingerprint(view(spark, sf, "assets"), "dataset_id", "asset_id", "display_path", 64),
    "a11_item_sum_fingerprint": lambda spark, sf: a.dataset_fingerprint(view(spark, sf, "assets"), "dataset_id", "asset_id", "display_path"),
    "a12_tensor_statistics": lambda spark, sf: _rounded(a.tensor_statistics(view(spark, sf, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x")), "label", "x")),
    "f22_status_indicator": _indicator,
    "f23_overlay_kind": _overlay,
    "j10_item_progress": lambda spark, sf: view(spark, sf, "job_events").alias("e").join(view(spark, sf, "runs").alias("r"), F.expr("e.event_id = r.run_id AND e.generation = r.run_id % 4")).select("event_id", "model_id", "ms"),
    "j11_jobs_running": lambda spark, sf: a.settled_jobs(*_states_and_jobs(spark, sf)),
    "j14_catalog_override": _override,
    "t11_catalog_order": _catalog,
    "j20_reusable_run": lambda spark, sf: a.reusable_run(view(spark, sf, "runs")).select("dataset_id", "signature", "run_id"),
    "j21_stale_runs": _stale,
    "w07_latest_run": lambda spark, sf: a.latest(view(spark, sf, "runs"), ["dataset_id", "model_id"], F.col("state") == "running", "updated_at", "run_id").select("dataset_id", "model_id", "run_id", "state"),
    "w09_last_turns": lambda spark, sf: a.last_turns(view(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role", "place", F.length("text").cast("long").alias("n")),
    "w11_state_changes": lambda spark, sf: a.state_changes(view(spark, sf, "job_events"), "job_id", "item_id").select("event_id", "state", "previous"),
    "x18_fingerprint": lambda spark, sf: view(spark, sf, "runs").select("run_id", tx.fingerprint("dataset_id", "model_id", "run_id", "signature").alias("fingerprint")),
}

_F = "files AS (SELECT DISTINCT * FROM image_files), notes AS (SELECT DISTINCT * FROM annotation_files)"
_CAND = {
    "relative_stem": "SELECT DISTINCT i.path AS image, n.path AS annotation FROM files AS i JOIN notes AS n ON i.rel_stem = n.rel_stem",
    "basename": "SELECT DISTINCT i.path AS image, n.path AS annotation FROM files AS i JOIN notes AS n ON lower(i.stem) = lower(n.stem)",
    "image_path": "SELECT DISTINCT i.path AS image, n.path AS annotation FROM files AS i JOIN notes AS n ON lower(n.image_path) IN (lower(concat(i.stem, '.png')), lower(concat(i.rel_stem, '.png')))",
}


def _resolve_sql(strategy, managed, select):
    return f"""WITH {_F}, cand AS ({_CAND[strategy]}),
    counted AS (SELECT *, count(*) OVER (PARTITION BY image) AS ci, count(*) OVER (PARTITION BY annotation) AS ca FROM cand),
    found AS (SELECT image, count(*) AS n, max(greatest(ci, ca)) AS most, bool_or(notes.broken) AS bad FROM counted JOIN notes ON notes.path = counted.annotation GROUP BY image),
    stems AS (SELECT *, count(*) OVER (PARTITION BY lower(stem)) AS s FROM files),
    items AS (SELECT path, coalesce(n, 0) AS n_annotations, CASE WHEN most > 1 {"OR (most IS NULL AND s > 1)" if managed else ""} THEN 'duplicate_match'
      WHEN broken THEN 'corrupt_image' WHEN bad THEN 'corrupt_annotation' ELSE 'valid' END AS status FROM stems {"LEFT" if managed else ""} JOIN found ON path = image
      UNION ALL SELECT path, 1, 'orphan_annotation' FROM notes WHERE path NOT IN (SELECT annotation FROM cand))
    {select}"""


_items = "SELECT path, CAST(n_annotations AS BIGINT) AS n_annotations, status, status = 'valid' AS selectable FROM items"
_last = "last AS (SELECT job_id, item_id, arg_max(state, event_id) AS state FROM job_events GROUP BY job_id, item_id)"
ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "j01_relative_stem": f"WITH {_F} {_CAND['relative_stem']}",
        "j02_sidecar": f"WITH {_F} SELECT DISTINCT i.path AS image, replace(n.path, 'ann/', 'img/') AS annotation FROM files AS i JOIN notes AS n ON i.rel_stem = n.rel_stem",
        "j03_basename": f"WITH {_F} {_CAND['basename']}",
        "j04_image_path": f"WITH {_F} {_CAND['image_path']}",
        "j05_managed_storage": _resolve_sql("basename", True, _items),
        "j06_ambiguity": _resolve_sql("basename", False, _items),
        "j08_orphans": f"WITH {_F}, cand AS ({_CAND['image_path']}) SELECT path FROM notes WHERE path NOT IN (SELECT annotation FROM cand)",
        "j09_hidden": f"WITH {_F}, cand AS ({_CAND['relative_stem']}) SELECT path FROM files WHERE path NOT IN (SELECT image FROM cand)",
        "u01_files_of_roots": "SELECT path FROM annotation_files UNION SELECT path FROM image_files",
        "a01_status_counts": "SELECT dataset_id, status, count(*) AS count FROM assets GROUP BY ALL",
        "a02_scan_summary": _resolve_sql("relative_stem", False, "SELECT " + ", ".join(f"count_if(status = '{s}') AS {s}" for s in m.STATUSES) + ", count_if(status <> 'valid') AS abnormal, (SELECT count(*) FROM files WHERE path NOT IN (SELECT image FROM cand)) AS hidden FROM items"),
        "w08_sequence": f"WITH {_F} SELECT path, row_number() OVER (ORDER BY lower(path), path) - 1 AS sequence FROM files",
        "a03_label_distribution": "SELECT value, count(*) AS count FROM (SELECT unnest(list_distinct(labels)) AS value FROM assets) GROUP BY value ORDER BY count DESC, value LIMIT 8",
        "a03_shape_types": "SELECT value, count(*) AS count FROM (SELECT unnest(list_distinct(shape_types)) AS value FROM assets) GROUP BY value",
        "a04_category_counts": "SELECT image, CASE WHEN label = 'R' THEN '未命名' ELSE label END AS category, count(*) AS count FROM boxes GROUP BY ALL",
        "a05_label_choices": "SELECT label, count(*) AS count, label IN ('gizmo', 'blue') AS preferred FROM (SELECT unnest(labels) AS label FROM assets) GROUP BY label ORDER BY preferred DESC, count DESC, label LIMIT 7",
        "a06_prediction_groups": "SELECT image, label, count(*) AS n, max(score) AS best FROM boxes GROUP BY ALL",
        "a07_job_progress": f"WITH {_last}, p AS (SELECT job_id, count(*) AS total, " + ", ".join(f"count_if(state = '{s}') AS {s}" for s in (*a.ACTIVE, *a.FINISHED)) + " FROM last GROUP BY job_id), q AS (SELECT *, succeeded + failed + canceled AS finished FROM p) SELECT *, finished / total AS ratio, CASE WHEN finished < total THEN 'running' WHEN failed > 0 AND succeeded > 0 THEN 'succeeded_with_errors' WHEN failed > 0 THEN 'failed' WHEN canceled = total THEN 'canceled' ELSE 'succeeded' END AS state FROM q",
        "a09_operator_timings": "SELECT job_id, state, round(avg(ms), 6) AS mean_ms, count(ms) AS samples FROM job_events GROUP BY ALL",
        "a13_latency": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY job_id) AS c FROM job_events) SELECT job_id, count(*) AS n, " + ", ".join(f"max(CASE WHEN k = round_even((c - 1) * {f}, 0) THEN ms END) AS p{p}" for f, p in ((0.5, 50), (0.95, 95), (0.99, 99))) + ", round(avg(ms), 6) AS mean, max(ms) AS max FROM r GROUP BY job_id",
        "a14_throughput": "SELECT job_id, count(*) AS n, round(count(*) / (nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0) / 1e6), 6) AS per_second, count_if(state = 'failed') AS errors FROM job_events GROUP BY job_id",
        "a14_top_errors": "WITH m AS (SELECT job_id, concat('error ', CAST(floor(ms) AS BIGINT) % 7) AS message, count(*) AS count FROM job_events WHERE state = 'failed' AND ms IS NOT NULL GROUP BY ALL) SELECT job_id, message, count, row_number() OVER (PARTITION BY job_id ORDER BY count DESC, message) AS place FROM m QUALIFY place <= 2",
        "a19_representatives": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, ms) > 3600000000 THEN 1 ELSE 0 END AS nw FROM job_events), b AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY ts, ms ROWS UNBOUNDED PRECEDING) AS burst FROM g), r AS (SELECT job_id, burst, event_id, count(*) OVER (PARTITION BY job_id, burst) AS n, row_number() OVER (PARTITION BY job_id, burst ORDER BY CASE WHEN state IN ('queued', 'running') THEN 0 WHEN state = 'failed' THEN 1 ELSE 2 END, event_id IS DISTINCT FROM 7, ts DESC, event_id) AS k FROM b) SELECT job_id, CAST(burst AS BIGINT) AS burst, n, event_id AS representative FROM r WHERE k = 1",
        "j11_running_jobs": f"WITH {_last} SELECT DISTINCT job_id FROM last WHERE state = 'running'",
        "j15_unloaded": "WITH u AS (SELECT model_id, count(*) AS uses FROM runs GROUP BY model_id), m AS (SELECT CASE WHEN readiness = 'missing_weights' THEN 'unloaded' ELSE readiness END AS readiness, coalesce(uses, 0) AS uses FROM models LEFT JOIN u USING (model_id)) SELECT readiness, CASE readiness WHEN 'loaded' THEN 0 WHEN 'loading' THEN 1 WHEN 'available' THEN 2 ELSE 4 END AS readiness_rank, count(*) AS n, CAST(sum(uses) AS BIGINT) AS uses FROM m GROUP BY ALL",
        "a15_model_usage": "SELECT model_id, count(*) AS uses, max(updated_at) AS last_used_at FROM runs GROUP BY model_id",
        "a16_catalog_health": "SELECT count(*) AS n_files, count(DISTINCT model_id) AS n_models, count(DISTINCT CASE WHEN can_predict THEN description END) AS n_adapters FROM models",
        "a17_repeated_models": "SELECT model_id, file_order FROM models QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY file_order) > 1",
        "a19_weight_indices": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, ms) > 3600000000 THEN 1 ELSE 0 END AS nw FROM job_events), b AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY ts, ms ROWS UNBOUNDED PRECEDING) AS burst FROM g), w AS (SELECT job_id, burst, CASE WHEN event_id % 4 <> 0 THEN [event_id % 7, event_id % 3] ELSE [] END AS x FROM b) SELECT job_id, CAST(burst AS BIGINT) AS burst, array_to_string(list_sort(list_distinct(flatten(list(x)))), ',') AS weights FROM w GROUP BY job_id, burst",
        "a19_bursts": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, ms) > 3600000000 THEN 1 ELSE 0 END AS nw FROM job_events), b AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY ts, ms ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT job_id, CAST(burst AS BIGINT) AS burst, count(*) AS n, round(sum(ms), 4) AS total, min(ts) AS created_at, max(ts) AS updated_at FROM b GROUP BY ALL",
        "a11_dataset_fingerprint": """SELECT dataset_id, sha256(concat('{"dataset_id":"', dataset_id, '","items":[', string_agg(concat('["', asset_id, '","', display_path, '"]'), ',' ORDER BY asset_id, display_path), ']}')) AS fingerprint FROM assets GROUP BY dataset_id""",
        "a11_tree_fingerprint": "WITH RECURSIVE o AS (SELECT dataset_id, asset_id, display_path, count(*) AS n FROM assets GROUP BY ALL), i AS (SELECT dataset_id, sha256(asset_id) AS h, concat(length(asset_id), ':', asset_id, length(display_path), ':', display_path, 'x', n) AS line FROM o), s AS (SELECT dataset_id, len(list_filter(range(0, 14), lambda d: c > 64 * 16 ** d)) AS depth, n FROM (SELECT dataset_id, count(*) AS c, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY dataset_id)), t AS (SELECT dataset_id, depth, substr(h, 1, depth) AS r, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM i JOIN s USING (dataset_id) GROUP BY dataset_id, depth, substr(h, 1, depth) UNION ALL SELECT dataset_id, depth - 1, substr(r, 1, depth - 1), sha256(string_agg(d, chr(10) ORDER BY r)) FROM t WHERE depth > 0 GROUP BY dataset_id, depth, substr(r, 1, depth - 1)) SELECT t.dataset_id, s.n, d AS fingerprint FROM t JOIN s USING (dataset_id) WHERE t.depth = 0",
        "a11_item_sum_fingerprint": "WITH p AS (SELECT dataset_id, CAST(concat('0x', substr(sha256(concat(asset_id, '|', display_path)), 1, 15)) AS BIGINT) AS v FROM assets), s AS (SELECT dataset_id, count(*) AS n, sum(CAST(v AS HUGEINT)) AS t FROM p GROUP BY dataset_id) SELECT dataset_id, n, sha256(concat(n, '|', t)) AS fingerprint FROM s",
        "a12_tensor_statistics": "SELECT label, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, " + ", ".join(f"round(quantile_cont(x, {q}), 6) AS p{p}" for q, p in ((0.01, "01"), (0.05, "05"), (0.5, "50"), (0.95, "95"), (0.99, "99"))) + " FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label",
        "f22_status_indicator": "WITH e AS (SELECT *, concat('a', CAST(event_id % 2500 AS STRING)) AS asset_id FROM job_events QUALIFY row_number() OVER (PARTITION BY event_id % 2500 ORDER BY state IN ('queued', 'running') DESC, ts DESC, event_id DESC) = 1) SELECT asset_id, CASE WHEN state IS NULL THEN 'none' WHEN state = 'running' THEN 'busy' WHEN state = 'queued' THEN 'waiting' WHEN state = 'failed' THEN 'error' ELSE 'done' END AS indicator, coalesce(least(1.0, greatest(0.0, ms / 100)), 0.0) AS progress FROM (SELECT asset_id FROM assets) LEFT JOIN (SELECT asset_id, state, ms FROM e) USING (asset_id)",
        "f23_overlay_kind": "WITH r AS (SELECT concat('a', CAST(doc_id AS STRING)) AS asset_id, n_chars % 40 * 200 AS w, (doc_id % 50 + 1) * 150 AS h FROM documents) SELECT asset_id, CASE WHEN width IS NULL THEN 'unsupported' WHEN w = width AND h = height THEN 'overlay' WHEN abs(w / h - width / height) < 0.5 THEN 'overlay_scaled' ELSE 'standalone' END AS kind FROM r JOIN (SELECT asset_id, width, height FROM assets) USING (asset_id)",
        "j10_item_progress": "SELECT event_id, model_id, ms FROM job_events AS e JOIN runs AS r ON e.event_id = r.run_id AND e.generation = r.run_id % 4",
        "j11_jobs_running": f"WITH {_last} SELECT DISTINCT job_id FROM job_events WHERE job_id NOT IN (SELECT job_id FROM last WHERE state IN ('queued', 'running'))",
        "j14_catalog_override": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY file_order) AS k FROM models), a AS (SELECT * FROM r WHERE k = 1), b AS (SELECT * FROM r WHERE k > 1) SELECT a.model_id, coalesce(b.name, a.name) AS name, coalesce(b.readiness, a.readiness) AS readiness, b.name IS NOT NULL AS overrides FROM a LEFT JOIN b USING (model_id)",
        "t11_catalog_order": "WITH u AS (SELECT model_id, count(*) AS uses, max(updated_at) AS last_used_at FROM runs GROUP BY model_id), f AS (SELECT * FROM models QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY file_order) = 1) SELECT model_id, CASE readiness WHEN 'loaded' THEN 0 WHEN 'loading' THEN 1 WHEN 'available' THEN 2 WHEN 'missing_weights' THEN 3 ELSE 4 END AS readiness_rank, coalesce(uses, 0) AS uses, last_used_at, row_number() OVER (ORDER BY readiness_rank, coalesce(uses, 0) DESC, last_used_at DESC NULLS LAST, lower(name), model_id) - 1 AS position FROM f LEFT JOIN u USING (model_id)",
        "j20_reusable_run": "SELECT dataset_id, signature, run_id FROM runs WHERE state NOT IN ('failed', 'canceled') QUALIFY row_number() OVER (PARTITION BY dataset_id, signature ORDER BY updated_at DESC, run_id DESC) = 1",
        "j21_stale_runs": "WITH k AS (SELECT dataset_id, signature AS kept FROM runs QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY state = 'running' DESC, updated_at DESC, run_id DESC) = 1) SELECT run_id, dataset_id, signature FROM runs JOIN k USING (dataset_id) WHERE whole_dataset AND signature IS DISTINCT FROM kept",
        "w07_latest_run": "SELECT dataset_id, model_id, run_id, state FROM runs QUALIFY row_number() OVER (PARTITION BY dataset_id, model_id ORDER BY state = 'running' DESC, updated_at DESC, run_id DESC) = 1",
        "w09_last_turns": "WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS back FROM conversations) SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY back DESC) AS INT) AS place, length(substr(text, 1, 4000)) AS n FROM b WHERE back <= 3",
        "w11_state_changes": "SELECT event_id, state, previous FROM (SELECT *, lag(state) OVER (PARTITION BY job_id, item_id ORDER BY event_id) AS previous FROM job_events) WHERE previous IS NULL OR previous <> state",
        "x18_fingerprint": """SELECT run_id, sha256(concat('{"dataset_id":"', dataset_id, '","model_id":"', model_id, '","run_id":', CAST(run_id AS STRING), ',"signature":"', signature, '"}')) AS fingerprint FROM runs""",
    }.items()
}
