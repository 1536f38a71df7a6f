"""String and hash columns."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

UNNAMED = "未命名"


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode normal form C; null stays."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(ArrayType(StringType()))
def nfc_list(values: pd.Series) -> pd.Series:
    """Normal form C of each string of a list; nulls stay."""
    form = lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v)
    return values.map(lambda x: None if x is None else [form(v) for v in x])


def ascii_form(text: Column) -> Column:
    """Text with the only three letters whose normal form C is ASCII in that form, so that it can be compared with ASCII
    text without Python."""
    return F.translate(text, "\u212a\u037e\u1fef", "K;`")


def trimmed_category(label: Column, default: str = UNNAMED) -> Column:
    """Trimmed label, ``default`` where blank."""
    trimmed = F.trim(F.coalesce(label, F.lit("")))
    return F.when(trimmed == "", F.lit(default)).otherwise(trimmed)


def category(label: Column, default: str = UNNAMED) -> Column:
    """Trimmed label in normal form C, ``default`` where blank."""
    return nfc(trimmed_category(label, default))


def is_category(label: Column, wanted: str) -> Column:
    """Whether a label is of the category, both trimmed and in normal form C; no Python for an ASCII category."""
    wanted = unicodedata.normalize("NFC", wanted.strip())
    trimmed = F.trim(F.coalesce(label, F.lit("")))
    return (ascii_form(trimmed) if wanted.isascii() else nfc(trimmed)) == wanted


@F.pandas_udf(LongType())
def fnv1a(values: pd.Series) -> pd.Series:
    """32-bit FNV-1a over the UTF-16 code units of a string; null stays.  All texts of a batch go on unit by unit together."""
    texts = values.dropna()
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    size = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-size, kind="stable")  # the longest first, so those that go on are the first ones
    flat = np.concatenate([*units, np.zeros(1, "<u2")]).astype(np.uint32)
    begin, left = (np.cumsum(size) - size)[order], np.sort(size)
    h = np.full(len(units), 2166136261, np.uint32)
    for at in range(int(left[-1]) if len(left) else 0):
        n = len(left) - int(np.searchsorted(left, at, "right"))
        h[:n] = (h[:n] ^ flat[begin[:n] + at]) * np.uint32(16777619)
    out = np.empty(len(h), np.int64)
    out[order] = h
    return pd.Series(out, index=texts.index, dtype="Int64").reindex(values.index)


def prediction_key(text: Column) -> Column:
    """``prediction:`` and the hash as eight hexadecimal digits."""
    return F.concat(F.lit("prediction:"), F.lower(F.lpad(F.hex(fnv1a(text)), 8, "0")))


def number_text(value: Column) -> Column:
    """A number as JSON text, whole ones without a fraction."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))


def prediction_text(model: Column, image: Column, label: Column, score: Column, kind: Column, points: Column) -> Column:
    """A prediction as JSON text with its fields in the order that keys are made from."""
    bare = lambda v: F.transform(F.array(F.to_json(F.array(v))), lambda t: F.substr(t, F.lit(2), F.length(t) - 2))[0]
    listed = F.array_join(F.transform(points, lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, number_text), ","), F.lit("]"))), ",")
    fields = (("modelId", bare(model)), ("imagePath", bare(image)), ("label", bare(F.trim(label))), ("score", number_text(score)), ("shape_type", bare(kind)), ("points", F.concat(F.lit("["), listed, F.lit("]"))))
    parts = [x for k, v in fields for x in (F.lit(f',"{k}":'), v)]
    parts[0] = F.lit('{"modelId":')
    return F.concat(*parts, F.lit("}"))


def palette_colour(label: Column, palette: list[str]) -> Column:
    """A label's colour: its hash picks one, the same in every data set."""
    return F.element_at(F.array(*map(F.lit, palette)), (fnv1a(label) % len(palette) + 1).cast("int"))


def fingerprint(*columns: str | Column) -> Column:
    """SHA-256 of the columns as one JSON object in the given order, nulls left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def stem_of(path: Column) -> Column:
    """Path without its suffix."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def host_kind(url: Column) -> Column:
    """Where weights come from, by host."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    named = lambda h: (host == h) | host.endswith("." + h)
    return F.when(named("github.com") | named("githubusercontent.com"), "github").when(named("modelscope.cn"), "modelscope").when(named("huggingface.co") | named("hf.co"), "huggingface").otherwise("other")


#: Keywords of the task rules, first hit wins.
TASK_RULES = (("obb|rotated", "oriented_detection"), ("pose|keypoint", "pose"), ("seg|mask|u2net", "segmentation"), ("class", "classification"), ("depth", "depth"), ("ocr|text", "ocr"), ("tag|ram", "tagging"))


def task_of(description: Column) -> Column:
    """Task of a model by ordered keyword rules; detection if none hits."""
    low, out = F.lower(description), None
    for pattern, task in TASK_RULES:
        hit = low.rlike(pattern)
        out = F.when(hit, task) if out is None else out.when(hit, task)
    return out.otherwise("detection")


def byte_size_text(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one digit."""
    unit = lambda n, name: F.concat(F.format_number(size / n, 1), F.lit(name))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, unit(1024, " KB")).when(size < 1024**3, unit(1024**2, " MB")).otherwise(unit(1024**3, " GB"))
