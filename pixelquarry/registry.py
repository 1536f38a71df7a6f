"""Queries and their SQL, gathered from the modules of ``plans``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search
from .plans import analytics_queries, geometry_queries, search_queries, stream_queries
from .plans.views import view

_MODULES = (search_queries, analytics_queries, geometry_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of a condition search over the asset index, each hit with how many hits share its first label."""
    hits = view(spark, sf_dir, "assets").where(search.condition("class:ring annotations>2 or type:polygon") & search.facets("valid"))
    often = hits.groupBy(F.element_at("labels", 1).alias("label")).agg(F.count("*").alias("hits_with_label"))
    page = search.keyset_page(hits, 100).withColumn("label", F.element_at("labels", 1))
    return page.join(often, "label").select("asset_id", "display_path", "label", "hits_with_label", "annotation_count")
