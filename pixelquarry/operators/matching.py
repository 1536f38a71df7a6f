"""Pairing of images with annotation files.

``images`` (path, rel_stem, stem, broken) and ``annotations`` (path, rel_stem, stem, image_path, broken).  Every
strategy gives candidate pairs by equi-join; resolving them is the same for all: windows count the partners on each
side, so a popular stem is one more key, not a local set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import positions

STATUSES = ("valid", "duplicate_match", "orphan_annotation", "corrupt_image", "corrupt_annotation")


def _pairs(images: DataFrame, annotations: DataFrame, image_key: Column, annotation_key: Column) -> DataFrame:
    left = images.select(F.col("path").alias("image"), image_key.alias("_key"))
    right = annotations.select(F.col("path").alias("annotation"), annotation_key.alias("_key"))
    return left.join(right, "_key").select("image", "annotation").distinct()


def by_relative_stem(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Same path below the two roots, suffix apart."""
    return _pairs(images, annotations, F.col("rel_stem"), F.col("rel_stem"))


def by_sidecar(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Same folder and stem: whole path without the suffix."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    return _pairs(images, annotations, bare, bare)


def by_basename(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Same stem anywhere, letter case apart."""
    return _pairs(images, annotations, F.lower("stem"), F.lower("stem"))


def by_image_path(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """The annotation names the image, by its file name or its relative path, letter case apart."""
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    names = images.withColumn("_name", F.explode(F.array_distinct(F.array(F.lower(F.concat("stem", suffix)), F.lower(F.concat("rel_stem", suffix))))))
    return _pairs(names, annotations, F.col("_name"), F.lower("image_path"))


STRATEGIES = {"relative_stem": by_relative_stem, "same_directory": by_sidecar, "basename": by_basename, "image_path": by_image_path}


def resolve(images: DataFrame, annotations: DataFrame, pairs: DataFrame, managed: bool = False) -> DataFrame:
    """One row per indexed item: path, annotation_paths, status, selectable.

    An image with several candidates, or one whose candidate serves several images, is ``duplicate_match``; then a
    broken image or annotation file shows in the status.  Images without a candidate are hidden, but with ``managed``
    storage they are valid with no annotation yet, unless their stem repeats.  Annotations in no pair are orphans."""
    counted = pairs.withColumn("_of_image", F.count("*").over(Window.partitionBy("image"))).withColumn("_of_annotation", F.count("*").over(Window.partitionBy("annotation")))
    good = annotations.select(F.col("path").alias("annotation"), F.col("broken").alias("_broken_annotation"))
    found = counted.join(good, "annotation").groupBy("image").agg(
        F.array_sort(F.collect_set("annotation")).alias("annotation_paths"), F.max(F.greatest("_of_image", "_of_annotation")).alias("_most"), F.bool_or("_broken_annotation").alias("_broken_annotation")
    )
    joined = images.withColumn("_stems", F.count("*").over(Window.partitionBy(F.lower("stem")))).join(found, images["path"] == found["image"], "left" if managed else "inner")
    status = F.when(F.col("_most") > 1, "duplicate_match")
    if managed:
        status = status.when(F.col("_most").isNull() & (F.col("_stems") > 1), "duplicate_match")
    status = status.when(F.col("broken"), "corrupt_image").when(F.col("_broken_annotation"), "corrupt_annotation").otherwise("valid")
    items = joined.select("path", F.coalesce("annotation_paths", F.array().cast("array<string>")).alias("annotation_paths"), status.alias("status"))
    orphans = annotations.join(pairs, annotations["path"] == pairs["annotation"], "left_anti").select("path", F.array("path").alias("annotation_paths"), F.lit("orphan_annotation").alias("status"))
    return items.unionByName(orphans).withColumn("selectable", F.col("status") == "valid")


def hidden(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Images without a candidate."""
    return images.join(pairs, images["path"] == pairs["image"], "left_anti")


def orphans(annotations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Annotations that no image uses."""
    return annotations.join(pairs, annotations["path"] == pairs["annotation"], "left_anti")


def files_of_roots(*roots: DataFrame) -> DataFrame:
    """Files of several roots, each path once."""
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["path"])


def summary(items: DataFrame, n_hidden: DataFrame | None = None) -> DataFrame:
    """One row: how many items have each status; ``n_hidden`` is a frame of hidden images."""
    wide = items.groupBy().agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    wide = wide.withColumn("abnormal", F.col("duplicate_match") + F.col("orphan_annotation") + F.col("corrupt_image") + F.col("corrupt_annotation"))
    return wide if n_hidden is None else wide.join(n_hidden.agg(F.count("*").alias("hidden")))


def item_ids(items: DataFrame, root: str) -> DataFrame:
    """Stable ids: of the data set by its root, of an item by data set and path without suffix."""
    dataset = F.substring(F.sha1(F.lit(root)), 1, 16)
    return items.withColumn("dataset_id", dataset).withColumn("asset_id", F.substring(F.sha1(F.concat_ws("|", dataset, F.regexp_replace("path", r"\.[^./]*$", ""))), 1, 20))


def numbered(items: DataFrame) -> DataFrame:
    """Scan items with ``sequence`` from 0, by path without letter case, then path."""
    return positions(items.orderBy(F.lower("path"), "path"), "sequence")
