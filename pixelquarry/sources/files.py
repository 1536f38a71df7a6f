"""Files of image data sets: listing, probing, annotation parsing, and the sinks of the index."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


def suffixes(names) -> list[str]:
    """Lower case, with a dot."""
    return sorted({n.lower() if n.startswith(".") else "." + n.lower() for n in names})


def list_files(spark: SparkSession, roots: list[str], recursive: bool = True, hidden: str = ".workspace") -> DataFrame:
    """path, length and modificationTime of all files below the roots but those under a ``hidden`` folder; no content
    is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots).drop("content")
    return files.where(~F.col("path").contains(f"/{hidden}/")).dropDuplicates(["path"])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def images(files: DataFrame, allowed=IMAGE_SUFFIXES) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(suffixes(allowed)))


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the head of a PNG, GIF, BMP, JPEG, WebP or TIFF file; None if it is none."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[:4] in (b"II*\0", b"MM\0*"):
            order = "<" if data[:2] == b"II" else ">"
            at = struct.unpack(order + "I", data[4:8])[0]
            found = {}
            for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
                tag, kind, _ = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
                value = data[at + 10 + 12 * k : at + 14 + 12 * k]
                found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
            return found[256], found[257]
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data):
                if data[at] != 0xFF:
                    return None
                if data[at + 1] in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (struct.error, KeyError, IndexError):
        pass
    return None


def probe(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with width, height and an error where no size is found."""

    def run(batches):
        for pdf in batches:
            sizes = [image_size(bytes(c)) if c is not None else None for c in pdf["content"]]
            good = [s if s and s[0] > 0 and s[1] > 0 else None for s in sizes]
            yield pd.DataFrame({"path": pdf["path"], "width": [s[0] if s else None for s in good], "height": [s[1] if s else None for s in good], "error": [None if s else "not an image" for s in good]}).astype({"width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, width long, height long, error string")


def annotation_facts(documents: DataFrame, column: str = "document") -> DataFrame:
    """``documents`` (JSON text) with error, shape_count, image_path, labels and shape_types.

    The root must be an object; without ``shapes`` there are none; ``shapes`` that is no list is an error.  Labels and
    types are distinct and sorted, empty ones left out; an element that is no object counts but has none."""
    v = F.try_parse_json(column)
    kind = F.schema_of_variant(v)
    shapes = F.try_variant_get("_v", "$.shapes", "variant")
    items = F.try_variant_get("_v", "$.shapes", "array<variant>")
    text = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform("_items", lambda s: F.try_variant_get(s, f"$.{name}", "string")), lambda t: t.isNotNull() & (t != ""))))
    out = documents.withColumn("_v", v).withColumn("_kind", kind).withColumn("_shapes", shapes).withColumn("_items", F.coalesce(items, F.array().cast("array<variant>")))
    error = F.when(F.col("_v").isNull(), "no JSON").when(~F.startswith("_kind", F.lit("OBJECT")), "no object").when(F.col("_shapes").isNotNull() & ~F.startswith(F.schema_of_variant("_shapes"), F.lit("ARRAY")), "shapes is no list")
    out = out.withColumn("error", error).withColumn("shape_count", F.when(F.col("error").isNull(), F.size("_items"))).withColumn("image_path", F.try_variant_get("_v", "$.imagePath", "string"))
    return out.withColumn("labels", text("label")).withColumn("shape_types", text("shape_type")).drop("_v", "_kind", "_shapes", "_items")


def annotation_roots(root: str, layout: str, have: list[str], custom: str | None = None) -> list[str]:
    """Folders to search: ``auto`` joins the annotation folders that exist and the image root."""
    named = [f"{root}/{n}" for n in ("annotations", "labels") if n in have]
    return {"auto": [*named, root], "same_directory": [root], "parallel": named, "custom": [custom] if custom else [], "managed": [custom or f"{root}/annotations"]}[layout]


def write_index(assets: DataFrame, path: str, revision: int) -> None:
    """Replace the data sets in ``assets`` in the index; others stay."""
    assets.withColumn("index_revision", F.lit(revision).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def unregister(spark: SparkSession, path: str, dataset_id: str, target: str) -> None:
    """The index without a data set, written anew; source files are not touched."""
    spark.read.parquet(path).where(F.col("dataset_id") != dataset_id).write.partitionBy("dataset_id").parquet(target)


def append_scan(items: DataFrame, path: str, sequence_from: int, sequence_to: int) -> int:
    """Add the items of a range of sequence numbers, which has a folder of its own; an error if some are missing or more.

    The plan runs once: what it wrote is counted and only then given the name that readers see.  A range that is sent
    again replaces itself, so a retry adds nothing twice."""
    spark, name = items.sparkSession, f"range={sequence_from}-{sequence_to}"
    staged = f"{path}/_{name}-{uuid.uuid4().hex}"
    items.where((F.col("sequence") >= sequence_from) & (F.col("sequence") < sequence_to)).write.parquet(staged)
    found = spark.read.schema(items.schema).parquet(staged).agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("d")).first()
    hadoop = spark._jvm.org.apache.hadoop.fs
    from_, to = hadoop.Path(staged), hadoop.Path(f"{path}/{name}")
    files = from_.getFileSystem(spark._jsc.hadoopConfiguration())
    if found["n"] != sequence_to - sequence_from or found["d"] != found["n"]:
        files.delete(from_, True)
        raise ValueError(f"{found['n']} items, {found['d']} numbers, for {sequence_to - sequence_from}")
    files.delete(to, True)
    files.rename(from_, to)
    return found["n"]


def save_documents(current: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents after the edits, conflicts, backups): an edit counts if its ``if_match`` is the current revision, the
    SHA-256 of the document; of several for one asset none does."""
    n = F.count("*").over(Window.partitionBy("asset_id"))
    joined = current.withColumn("revision", F.sha2("document", 256)).join(edits.withColumn("_n", n).withColumnRenamed("document", "_new"), "asset_id", "left")
    fits = (F.col("if_match") == F.col("revision")) & (F.col("_n") == 1)
    conflicts = joined.where(F.col("_new").isNotNull() & ~fits).select("asset_id", "if_match", "revision")
    backups = joined.where(fits).select("asset_id", "revision", "document")
    after = joined.withColumn("_out", F.when(fits, F.col("_new")).otherwise(F.col("document"))).dropDuplicates(["asset_id"]).select("asset_id", F.col("_out").alias("document"), F.sha2("_out", 256).alias("revision"))
    return after, conflicts, backups


def publish(outputs: DataFrame, root: str, item: str = "output_id") -> str:
    """Write outputs (``item``, document, and any columns such as pixels) to a staging folder of ``root``, each with its
    document as JSON text and a manifest row (item, SHA-256 of the document, size), and then a one-row manifest that
    names the folder: a reader follows it, so half-written outputs are never seen."""
    name = f"outputs-{uuid.uuid4().hex}"
    outputs.write.parquet(f"{root}/{name}/items")
    spark = outputs.sparkSession
    done = spark.read.parquet(f"{root}/{name}/items")
    text = F.coalesce(F.col("document"), F.lit("")) if "document" in outputs.columns else F.lit("")
    done.select(F.col(item).cast("string").alias("item"), F.sha2(text, 256).alias("fingerprint"), F.octet_length(text).cast("long").alias("bytes")).write.parquet(f"{root}/{name}/manifest")
    if "document" in outputs.columns:
        done.where("document IS NOT NULL").select(F.to_json(F.struct(F.col(item).cast("string").alias("item"), "document")).alias("value")).write.text(f"{root}/{name}/json")
    items = spark.read.parquet(f"{root}/{name}/manifest")
    items.groupBy().agg(F.count("*").alias("outputs")).withColumn("folder", F.lit(name)).withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return f"{root}/{name}"


def _newest(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/manifest").agg(F.max_by("folder", "published_at")).first()[0]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(item, fingerprint, bytes) of the outputs that the newest manifest names."""
    return spark.read.parquet(f"{root}/{_newest(spark, root)}/manifest")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The outputs that the newest manifest names."""
    return spark.read.parquet(f"{root}/{_newest(spark, root)}/items")


def checked_tensors(tensors: DataFrame, values: str = "values") -> tuple[DataFrame, DataFrame]:
    """(tensors with min, max and mean; rejects: empty or not finite)."""
    x = F.col(values).cast("array<double>")
    bad = F.coalesce(F.size(x) < 1, F.lit(True)) | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return tensors.where(~bad).select("*", F.array_min(x).alias("min"), F.array_max(x).alias("max"), (total / F.size(x)).alias("mean")), tensors.where(F.coalesce(bad, F.lit(True)))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, run_id: str | int, after: int = -1, key: str = "audit_id", limit: int = 1000) -> DataFrame:
    """The next entries of a run behind ``after``, in id order."""
    return spark.read.parquet(path).where((F.col("run_id") == run_id) & (F.col(key) > after)).orderBy(key).limit(limit)
