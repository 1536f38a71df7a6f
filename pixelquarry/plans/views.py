"""Tables of the engine's data model, derived from the given tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (SQL, tables and views it reads)
VIEWS: dict[str, str] = {
    # one image per part, with labels, sizes and an index status
    "assets": """
        SELECT concat('ds', CAST(p_partkey % 3 AS STRING)) AS dataset_id, concat('a', CAST(p_partkey AS STRING)) AS asset_id,
               concat(p_brand, '/', replace(p_name, ' ', '_'), '-', CAST(p_partkey AS STRING), '.png') AS display_path,
               CAST(CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_size * 200 END AS BIGINT) AS width,
               CAST((p_partkey % 50 + 1) * 150 AS BIGINT) AS height, CAST(p_partkey % 8 AS BIGINT) AS annotation_count,
               p_partkey % 3 <> 0 AS annotation_file_exists,
               CASE p_partkey % 17 WHEN 3 THEN 'duplicate_match' WHEN 5 THEN 'orphan_annotation' WHEN 7 THEN 'corrupt_image'
                    WHEN 11 THEN 'corrupt_annotation' ELSE 'valid' END AS status,
               p_partkey % 17 NOT IN (3, 5, 7, 11) AS selectable,
               split(concat(lower(p_type), ',', replace(p_name, ' ', ',')), ',') AS labels,
               split(CASE WHEN p_partkey % 7 = 0 THEN 'rotation' WHEN p_partkey % 5 = 0 THEN 'polygon,rectangle' ELSE 'rectangle' END, ',') AS shape_types,
               CAST(p_partkey % 5 AS BIGINT) AS index_revision, CAST(p_retailprice AS DOUBLE) AS price
        FROM part""",
    # the same with unknown numbers of annotations and unknown labels
    "sparse_assets": """
        SELECT dataset_id, asset_id, display_path, width, height, CASE WHEN price * 100 % 5 = 0 THEN NULL ELSE annotation_count END AS annotation_count,
               annotation_file_exists, status, selectable, CASE WHEN height % 450 = 0 THEN NULL ELSE labels END AS labels, shape_types, index_revision
        FROM assets""",
    # one box per line item; an order is an image of 640 x 240
    "boxes": """
        SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS BIGINT) AS idx,
               l_returnflag AS label, CAST(round(l_quantity * 11) AS DOUBLE) AS x0, CAST(round(l_tax * 2000) AS DOUBLE) AS y0,
               CAST(round(l_quantity * 11) + 40 + round(l_discount * 1000) AS DOUBLE) AS x1, CAST(round(l_tax * 2000) + 30 + l_linenumber * 10 AS DOUBLE) AS y1,
               round(l_extendedprice / 110000, 6) AS score, l_partkey AS part, l_quantity AS quantity
        FROM lineitem""",
    # images and annotation files to be paired; stems repeat on both sides
    "image_files": """
        SELECT concat('img/', CAST(p_partkey % 40 AS STRING), '/', replace(p_name, ' ', '_'), CAST(p_partkey % 150 AS STRING), '.png') AS path,
               concat(CAST(p_partkey % 40 AS STRING), '/', replace(p_name, ' ', '_'), CAST(p_partkey % 150 AS STRING)) AS rel_stem,
               concat(upper(substr(p_name, 1, 1)), substr(replace(p_name, ' ', '_'), 2), CAST(p_partkey % 150 AS STRING)) AS stem,
               bool_or(p_partkey % 29 = 0) AS broken
        FROM part GROUP BY 1, 2, 3""",
    "annotation_files": """
        SELECT concat('ann/', CAST(p_partkey % 40 AS STRING), '/', replace(p_name, ' ', '_'), CAST(p_partkey % 150 AS STRING), '.json') AS path,
               concat(CAST(p_partkey % 40 AS STRING), '/', replace(p_name, ' ', '_'), CAST(p_partkey % 150 AS STRING)) AS rel_stem,
               concat(replace(p_name, ' ', '_'), CAST(p_partkey % 150 AS STRING)) AS stem,
               min(concat(replace(p_name, ' ', '_'), CAST(p_partkey % 130 AS STRING), '.PNG')) AS image_path, bool_or(p_partkey % 31 = 0) AS broken
        FROM part WHERE p_partkey % 4 <> 1 GROUP BY 1, 2, 3""",
    # job log: one row per event
    "job_events": """
        SELECT event_id, ts, concat('job', CAST(user_id % 40 AS STRING)) AS job_id, concat('item', CAST(user_id AS STRING)) AS item_id,
               CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'canceled' END AS state,
               value AS ms, props, CAST(event_id % 3 AS BIGINT) AS generation
        FROM events""",
    # runs of models over data sets
    "runs": """
        SELECT o_orderkey AS run_id, concat('model', CAST(o_custkey % 25 AS STRING)) AS model_id, concat('ds', CAST(o_custkey % 7 AS STRING)) AS dataset_id,
               CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS state, o_orderdate AS updated_at,
               concat('sig', CAST(o_orderkey % 4 AS STRING)) AS signature, o_orderpriority AS lane, o_totalprice AS cost, o_orderkey % 2 = 0 AS whole_dataset
        FROM orders""",
    "models": """
        SELECT concat('model', CAST(s_suppkey % 60 AS STRING)) AS model_id, s_suppkey AS file_order, s_name AS name,
               CASE s_suppkey % 6 WHEN 0 THEN 'yolov8-obb' WHEN 1 THEN 'resnet classification' WHEN 2 THEN 'depth-anything' WHEN 3 THEN 'u2net segmentation' WHEN 4 THEN 'ppocr text' ELSE 'detr' END AS description,
               CASE s_suppkey % 5 WHEN 0 THEN 'loaded' WHEN 1 THEN 'loading' WHEN 2 THEN 'available' WHEN 3 THEN 'missing_weights' ELSE 'unloaded' END AS readiness,
               s_suppkey % 4 <> 0 AS can_predict, s_acctbal AS balance
        FROM supplier""",
}


def reads(sql: str) -> list[str]:
    return [n for n in (*TABLES, *VIEWS) if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str, dealt: str | None = None) -> DataFrame:
    """A given table or a derived one.  Given tables are dealt by the column ``dealt`` first: what follows by it, under
    whatever name, is not dealt again."""
    if name in TABLES:
        given = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return given.repartition(dealt) if dealt else given
    sql = VIEWS[name]
    used = reads(sql)
    for n in used:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n, dealt) for n in used})


def with_views(sql: str) -> str:
    """The SQL behind the definitions of the derived tables that it reads."""
    names = [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    below = [n for name in names for n in reads(VIEWS[name]) if n in VIEWS]
    names = [n for n in VIEWS if n in names or n in below]  # those that others read come first
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not heads:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
