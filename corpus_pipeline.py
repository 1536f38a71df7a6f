"""A training-data pipeline over ``documents``: quality, near duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.llm import jaccard_join, packing, quality, secret_scan, substring_dedup
from pixelquarry.llm.shared import documents, numbered, renamed, stored


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars counted anew."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.classify(docs, documents(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id (and text hash), once."""
    found = jaccard_join.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    keep = found.where("component IS NOT NULL").groupBy("component").agg(first).select("first.doc_id", "first.text_key")
    keep = keep.unionByName(found.where("component IS NULL").select("doc_id", "text_key")).distinct()
    rows, names = numbered(docs)
    doc, body = (f"c{[c.lower() for c in names].index(c)}" for c in ("doc_id", "text"))
    rows = rows.withColumn("key", F.xxhash64(body))
    rows = rows.join(keep, F.col(doc).eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_semi")
    # of rows that repeat a doc_id with its text, the one whose other columns come first as JSON text stays
    rest = [c for c in rows.columns if c not in (doc, "key")]
    others = F.to_json(F.struct(F.lit(0), *(c for c in rest if c != body)))
    out = rows.groupBy(doc, "key").agg(F.min_by(F.struct(*rest), others).alias("row"))
    return renamed(out.select(doc, "row.*"), names)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; texts that lose none stay as they are."""
    cut = substring_dedup.dedup_substrings(docs)
    return _with_text(cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each finding replaced."""
    return _with_text(secret_scan.scan(docs, secret_scan.learn(docs), redact="[SECRET]"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("secret scans", without_secrets),
    ("packing", packed),
]
#: No SQL says what the trained stages keep; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
