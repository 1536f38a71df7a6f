"""Queries of catalog search and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics as a
from ..operators import search as s
from ..scratch import positions
from .views import view, with_views

_SHOW = ["asset_id", "display_path", "status", "width", "height", "annotation_count"]
_C = ", ".join(_SHOW)


def _where(condition, columns=_SHOW, table="assets"):
    return lambda spark, sf: view(spark, sf, table).where(condition()).select(*columns)


def _page(spark, sf):
    assets = view(spark, sf, "assets")
    return s.keyset_page(assets.where(s.condition("class:ring annotations>2 or type:polygon width>=8000")), 50, (True, "Brand#12/", ""), 4711).select(*_SHOW, "total")


def _offset(spark, sf):
    return s.offset_page(view(spark, sf, "assets").where(s.text("ring")), 40, 100).select(*_SHOW, "total", "next_offset")


def _preferred(spark, sf):
    assets = view(spark, sf, "assets")
    wanted = assets.where("annotation_count = 5").select("asset_id", F.col("height").alias("preference"))
    return positions(s.preferred_first(assets.where("dataset_id = 'ds1'"), wanted).select("asset_id", "display_path", "preference"))


def _unknown(spark, sf):
    asked = view(spark, sf, "lineitem").select(F.concat(F.lit("a"), (F.col("l_partkey") * 2).cast("string")).alias("asset_id")).distinct()
    return s.unknown_ids(asked, view(spark, sf, "assets"))


def _repeated(spark, sf):
    asked = view(spark, sf, "lineitem").select(F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("asset_id"))
    return s.repeated_ids(asked)


def _merge(spark, sf):
    """Pages of one revision are merged, a page of a newer one replaces what was seen."""
    assets = view(spark, sf, "assets").where("index_revision = 2")
    seen, page = assets.where("annotation_count < 5"), assets.where("annotation_count > 3")
    newer = page.where("dataset_id = 'ds1'").withColumn("index_revision", F.lit(3).cast("long"))
    both = [s.merge_pages(seen, page).withColumn("case", F.lit("same")), s.merge_pages(seen, newer).withColumn("case", F.lit("newer"))]
    return both[0].unionByName(both[1]).select("case", "asset_id", "index_revision")


def _stale(spark, sf):
    pages = view(spark, sf, "runs").select("dataset_id", (F.col("run_id") % 6).alias("index_revision")).distinct()
    return s.page_states(pages, view(spark, sf, "assets").where("dataset_id <> 'ds2' OR index_revision < 3"))


def _results(spark, sf):
    items = a.final_states(view(spark, sf, "job_events"), "job_id", "item_id").withColumn("result", F.concat("state", F.lit(":"), F.col("event_id").cast("string")))
    return s.item_results(items, "succeeded", 3).select("job_id", "item_id", "result", F.col("position").cast("long").alias("position"), "page")


def _colours(spark, sf):
    hashed = tx.fnv1a(F.col("display_path"))
    return view(spark, sf, "assets").select("asset_id", hashed.alias("hash"), tx.palette_colour(F.col("display_path"), [f"c{i}" for i in range(12)]).alias("colour"))


def _history(spark, sf):
    runs = view(spark, sf, "runs")
    newest = runs.agg(F.max("updated_at").alias("now"))
    dismissed = runs.where("run_id % 11 = 0").select("run_id", "updated_at")
    kept = runs.join(F.broadcast(newest)).where("state = 'running' OR updated_at >= now - INTERVAL 168 HOURS").join(dismissed, ["run_id", "updated_at"], "left_anti")
    return kept.select("run_id", "state", "updated_at")


def _latest_page(spark, sf):
    return s.after_id(view(spark, sf, "job_events"), "event_id", 500, 200).select("event_id", "job_id", "state")


QUERIES = {
    "f01_text_search": _where(lambda: s.text(" Widget ")),
    "f02_regex_search": _where(lambda: s.regex(r"brand#1\d/small.*[05]\.PNG$")),
    "f04_numeric_conditions": _where(lambda: s.condition("pixels>=9000000 height<4000 annotations>1")),
    "f05_label_contains": _where(lambda: s.condition("class:idg")),
    "f06_shape_type": _where(lambda: s.condition("type:polygon")),
    "f07_status_error": _where(lambda: s.condition("status:error")),
    "f08_path_contains": _where(lambda: s.condition("path:#2/RED")),
    "f09_truth_words": _where(lambda: s.condition("annotated:是 selectable:no")),
    "f10_large_side": _where(lambda: s.condition("size>8k")),
    "f11_free_text": _where(lambda: s.condition("promo")),
    "f12_condition_groups": _where(lambda: s.condition("class:ring not:type:rotation and width>2000 or annotations=0 status:valid")),
    "f13_facets": _where(lambda: s.text("ring") & s.facets("exception", True, False)),
    "f14_file_filter": _where(lambda: s.file_filter("without_json")),
    "f09_unknown_counts": _where(lambda: s.condition("annotated:no or not:has:annotations"), table="sparse_assets"),
    "f09_has_annotations": _where(lambda: s.condition("has:标注 not:class:ring"), table="sparse_assets"),
    "f11_json_text": _where(lambda: s.condition("'\", \"gizmo' not:'[\"rotation\"]'"), table="sparse_assets"),
    "f13_unknown_counts": _where(lambda: s.facets(None, False, True), table="sparse_assets"),
    "f15_selectable_ids": lambda spark, sf: positions(view(spark, sf, "assets").where("selectable").orderBy("display_path", "asset_id").select("asset_id", "display_path")),
    "f16_category_member": _where(lambda: s.has_category(" promo ")),
    "f17_match_key": lambda spark, sf: view(spark, sf, "assets").select("asset_id", tx.stem_of(F.col("display_path")).alias("match_key"), F.substring(F.sha1(F.concat_ws("|", "dataset_id", tx.stem_of(F.col("display_path")))), 1, 20).alias("stable_id")),
    "f18_model_task": lambda spark, sf: view(spark, sf, "models").select("model_id", "file_order", tx.task_of(F.col("description")).alias("task")),
    "f19_host_kind": lambda spark, sf: view(spark, sf, "pages").select("page_id", tx.host_kind(F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "//[^/]+/", "//cdn.github.com/")).otherwise(F.col("url"))).alias("kind")),
    "f20_job_history": _history,
    "t02_offset_page": _offset,
    "t04_keyset_page": _page,
    "t05_pinned_page": lambda spark, sf: s.keyset_page(s.pinned(view(spark, sf, "assets"), 3), 30).select(*_SHOW),
    "t05_stale_pages": _stale,
    "t06_after_id_page": _latest_page,
    "t07_item_results": _results,
    "t09_preferred_first": _preferred,
    "j13_unknown_ids": _unknown,
    "u03_page_merge": _merge,
    "u05_repeated_ids": _repeated,
    "x17_category_colour": _colours,
}

_all = f"SELECT {_C} FROM assets WHERE "
_some = f"SELECT {_C} FROM sparse_assets WHERE "
_json = lambda c: f"CASE WHEN {c} IS NULL OR len({c}) = 0 THEN '[]' ELSE concat('[\"', array_to_string({c}, '\", \"'), '\"]') END"
_text = f"lower(concat_ws(' ', display_path, status, {_json('labels')}, {_json('shape_types')}))"
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"
_w, _h = "coalesce(width, 0)", "coalesce(height, 0)"
_ring = "len(list_filter(labels, lambda x: contains(lower(x), 'ring'))) > 0"
#: The same over UTF-16 code units.
FNV16 = (
    "list_reduce(list_prepend(2166136261::BIGINT, flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN ord(c) < 65536 THEN [ord(c)::BIGINT] "
    "ELSE [55296 + (ord(c)::BIGINT - 65536) // 1024, 56320 + (ord(c)::BIGINT - 65536) % 1024] END))), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"
)
ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "f01_text_search": _all + "instr(lower(display_path), 'widget') > 0",
        "f02_regex_search": _all + r"regexp_matches(display_path, 'brand#1\d/small.*[05]\.PNG$', 'i')",
        "f04_numeric_conditions": _all + f"{_w} * {_h} >= 9000000 AND {_h} < 4000 AND annotation_count > 1",
        "f05_label_contains": _all + "len(list_filter(labels, lambda x: contains(lower(x), 'idg'))) > 0",
        "f06_shape_type": _all + "list_contains(shape_types, 'polygon')",
        "f07_status_error": _all + "status <> 'valid'",
        "f08_path_contains": _all + "contains(lower(display_path), '#2/red')",
        "f09_truth_words": _all + "annotation_count > 0 AND NOT selectable",
        "f10_large_side": _all + f"greatest({_w}, {_h}) > 8000",
        "f09_unknown_counts": _some + "coalesce(annotation_count, 0) = 0",
        "f09_has_annotations": _some + f"coalesce(annotation_count, 0) > 0 AND NOT coalesce({_ring}, false)",
        "f11_free_text": _all + f"contains({_text}, 'promo')",
        "f11_json_text": _some + f"contains({_text}, '\", \"gizmo') AND NOT contains({_text}, '[\"rotation\"]')",
        "f13_unknown_counts": _some + "coalesce(annotation_count, 0) = 0 AND annotation_file_exists",
        "f12_condition_groups": _all + f"({_ring} AND NOT list_contains(shape_types, 'rotation') AND {_w} > 2000) OR (annotation_count = 0 AND status = 'valid')",
        "f13_facets": _all + "contains(lower(display_path), 'ring') AND status <> 'valid' AND annotation_count > 0 AND NOT annotation_file_exists",
        "f14_file_filter": _all + "NOT annotation_file_exists",
        "f15_selectable_ids": "SELECT asset_id, display_path, row_number() OVER (ORDER BY display_path, asset_id) - 1 AS position FROM assets WHERE selectable",
        "f16_category_member": _all + "list_contains(labels, 'promo')",
        "f17_match_key": r"SELECT asset_id, regexp_replace(display_path, '\.[^./]*$', '') AS match_key, substr(sha1(concat(dataset_id, '|', regexp_replace(display_path, '\.[^./]*$', ''))), 1, 20) AS stable_id FROM assets",
        "f18_model_task": "SELECT model_id, file_order, CASE WHEN contains(description, 'obb') THEN 'oriented_detection' WHEN contains(description, 'seg') THEN 'segmentation' WHEN contains(description, 'class') THEN 'classification' WHEN contains(description, 'depth') THEN 'depth' WHEN contains(description, 'ocr') THEN 'ocr' ELSE 'detection' END AS task FROM models",
        "f19_host_kind": "SELECT page_id, CASE WHEN page_id % 4 = 0 AND regexp_matches(url, '//[^/]+/') THEN 'github' ELSE 'other' END AS kind FROM pages",
        "f20_job_history": "SELECT run_id, state, updated_at FROM runs WHERE (state = 'running' OR updated_at >= (SELECT max(updated_at) FROM runs) - INTERVAL 168 HOUR) AND run_id % 11 <> 0",
        "t02_offset_page": f"SELECT {_C}, total, CASE WHEN total > 140 THEN CAST(140 AS BIGINT) END AS next_offset FROM (SELECT *, count(*) OVER () AS total FROM assets WHERE contains(lower(display_path), 'ring')) ORDER BY selectable DESC, display_path, asset_id LIMIT 100 OFFSET 40",
        "t04_keyset_page": f"SELECT {_C}, 4711 AS total FROM assets WHERE (({_ring} AND annotation_count > 2) OR (list_contains(shape_types, 'polygon') AND {_w} >= 8000)) AND (NOT selectable OR display_path > 'Brand#12/') ORDER BY selectable DESC, display_path, asset_id LIMIT 51",
        "t05_pinned_page": _all + "index_revision = 3 ORDER BY selectable DESC, display_path, asset_id LIMIT 31",
        "t05_stale_pages": "WITH n AS (SELECT dataset_id, max(index_revision) AS current FROM assets WHERE dataset_id <> 'ds2' OR index_revision < 3 GROUP BY dataset_id), p AS (SELECT DISTINCT dataset_id, run_id % 6 AS index_revision FROM runs) SELECT dataset_id, index_revision, current, index_revision IS DISTINCT FROM current AS stale FROM p LEFT JOIN n USING (dataset_id)",
        "t07_item_results": "WITH l AS (SELECT job_id, item_id, arg_max(state, event_id) AS state, max(event_id) AS event_id FROM job_events GROUP BY job_id, item_id), r AS (SELECT job_id, item_id, concat(state, ':', event_id) AS result, row_number() OVER (PARTITION BY job_id ORDER BY item_id) - 1 AS position FROM l WHERE state = 'succeeded') SELECT *, position // 3 AS page FROM r",
        "x17_category_colour": f"WITH h AS (SELECT asset_id, {FNV.format('display_path')} AS hash FROM assets) SELECT asset_id, hash, concat('c', hash % 12) AS colour FROM h",
        "t06_after_id_page": "SELECT event_id, job_id, state FROM job_events WHERE event_id > 500 ORDER BY event_id LIMIT 200",
        "t09_preferred_first": "WITH p AS (SELECT *, CASE WHEN annotation_count = 5 THEN height END AS preference FROM assets WHERE dataset_id = 'ds1') SELECT asset_id, display_path, preference, row_number() OVER (ORDER BY preference NULLS LAST, selectable DESC, display_path, asset_id) - 1 AS position FROM p",
        "j13_unknown_ids": "SELECT DISTINCT concat('a', CAST(l_partkey * 2 AS STRING)) AS asset_id FROM lineitem WHERE concat('a', CAST(l_partkey * 2 AS STRING)) NOT IN (SELECT asset_id FROM assets WHERE selectable)",
        "u03_page_merge": "SELECT 'same' AS case, asset_id, index_revision FROM assets WHERE index_revision = 2 UNION ALL SELECT 'newer', asset_id, 3 FROM assets WHERE index_revision = 2 AND annotation_count > 3 AND dataset_id = 'ds1'",
        "u05_repeated_ids": "SELECT concat('a', CAST(l_partkey AS STRING)) AS asset_id, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    }.items()
}
