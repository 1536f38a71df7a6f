"""Quality classifier: a generalised additive model with pairwise interactions over counted text features.

Cyclic boosting visits the features in turn; each visit fits a tree of few leaves to the current gradient over the
feature's bins and adds it to the feature's lookup table.  Then the pairs that explain most of the remaining gradient
get two-dimensional tables in the same way.  A score is the sum of the tables' entries at a document's bins.

Training takes at most ``max_train`` labelled rows (those of the smallest xxhash64(doc_id), so the choice is stable);
features and scores cover every whole text.  Nulls: a null text counts as empty; rows without a label, or with a null
one, teach nothing; with labels of one class only, every score is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import chunks, gram_hashes, inside, span_hashes, words

MAX_TRAIN = 20_000
BINS = 48
THRESHOLD = 0.3
FEATURES = (
    "log_words", "log_chars", "word_length", "upper", "digit", "sentence_marks", "symbols", "exclamation", "bars", "not_ascii",
    "distinct_words", "doubled_words", "top_repeats", "repeated_trigrams", "lines", "repeated_lines", "long_words", "sentences",
)


def _class(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in members]] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_MARKS = _class(".,;:?")
_SYMBOLS = _class("#$%&*@^~<>/\\{}[]=+_`")
_HIGH = np.arange(256) >= 0xC0


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per text, and the most often one value occurs in it."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(h))))
    return np.bincount(doc[at], minlength=n), most


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(off) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    w = words(raw, off)
    text, size = w.text(), np.diff(w.first)
    hashes = span_hashes(raw, w.start, w.end)
    length = w.end - w.start
    some, letters, nbytes = np.maximum(size, 1), count(_LETTER[raw]), np.maximum(np.diff(off), 1)
    distinct, most = _distinct(text, hashes, n)
    twice = np.zeros(len(text), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    at = np.flatnonzero(inside(w, 3))
    grams, _ = _distinct(text[at], gram_hashes(hashes, 3)[at], n)
    n_grams = np.maximum(size - 2, 0)
    newline = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], newline + 1]))
    begin = begin[begin < len(raw)]
    end = np.append(begin[1:], len(raw))
    line_of = np.searchsorted(off, begin, "right") - 1
    lines = np.bincount(line_of, minlength=n)
    line_kinds, _ = _distinct(line_of, span_hashes(raw, begin, end), n)
    ends_sentence = _class(".!?")[raw[w.end - 1]] if len(w.end) else np.empty(0, bool)
    per_text = lambda mask: np.bincount(text[mask], minlength=n)
    columns = [
        np.log1p(size), np.log1p(np.diff(off)), np.bincount(text, weights=length, minlength=n) / some, count(_UPPER[raw]) / np.maximum(letters, 1),
        count(_DIGIT[raw]) / nbytes, count(_MARKS[raw]) / some, count(_SYMBOLS[raw]) / some, count(raw == 33) / some, count(raw == 124) / some, count(_HIGH[raw]) / nbytes,
        distinct / some, per_text(twice) / some, most / some, 1 - grams / np.maximum(n_grams, 1), lines / some, 1 - line_kinds / np.maximum(lines, 1),
        per_text(length > 20) / some, per_text(ends_sentence) / some,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Model:
    """Bin edges and lookup tables; ``pairs`` maps two features to a table over their coarse bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        z = np.full(len(x), self.intercept)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edge, x[:, f], "right")]
        if self.pairs:
            used = sorted({f for p in self.pairs for f in p})
            bins = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for f in used}
            for (a, b), table in self.pairs.items():
                z += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """Newton steps of a tree of at most ``leaves`` leaves over ordered bins, from the bins' gradient and curvature."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    spans = [(0, len(g))]
    gain_of = lambda lo, hi: (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for lo, hi in spans:
            cut = np.arange(lo + 1, hi)
            cut = cut[(ch[cut] - ch[lo] >= least) & (ch[hi] - ch[cut] >= least)]
            if len(cut):
                gain = gain_of(lo, cut) + gain_of(cut, hi) - gain_of(lo, hi)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (lo, hi), int(cut[k]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for lo, hi in spans:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, np.ndarray]:
    """Best cut of a two-dimensional table into four, its gain and Newton steps."""
    G, H = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = g.shape
    best = (0.0, np.zeros_like(g))
    for i in range(1, a):
        for j in range(1, b):
            parts = [(0, i, 0, j), (0, i, j, b), (i, a, 0, j), (i, a, j, b)]
            sums = [M[q, t] - M[p, t] - M[q, s] + M[p, s] for p, q, s, t in parts for M in (G, H)]
            gs, hs = sums[::2], sums[1::2]
            if min(hs) < least:
                continue
            gain = sum(x * x / (y + ridge) for x, y in zip(gs, hs, strict=True)) - G[a, b] ** 2 / (H[a, b] + ridge)
            if gain > best[0]:
                out = np.zeros_like(g)
                for (p, q, s, t), x, y in zip(parts, gs, hs, strict=True):
                    out[p:q, s:t] = x / (y + ridge)
                best = (gain, out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, leaves: int = 4, pairs: int = 6, pair_rounds: int = 30, ridge: float = 2.0) -> Model:
    """Cyclic boosting on labels 0 and 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        empty = [np.empty(0)] * len(FEATURES)
        return Model(intercept, empty, [np.zeros(1)] * len(FEATURES), empty, {})
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), intercept)
    least = max(2.0, 5e-4 * len(y))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), leaves, least, ridge)
            table += step
            z += step[bins[f]]

    def cut_pair(a: int, b: int) -> tuple[float, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = wide[a] * shape[1] + wide[b]
        g, h = (np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in slopes())
        return _quadrants(g, h, 0.005 * h.sum(), ridge)  # curvature shrinks as the fit improves: a share of it, not a count

    ranked = sorted(((cut_pair(a, b)[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model = Model(intercept, edges, tables, coarse, {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for gain, a, b in ranked[:pairs] if gain > 0})
    for _ in range(pair_rounds):
        for (a, b), table in model.pairs.items():
            step = rate * cut_pair(a, b)[1]
            table += step
            z += step[wide[a], wide[b]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_train`` labelled documents, by doc_id.  Rows that repeat a doc_id count once, by
    the least features, so no more rows than that go to the driver."""
    chosen = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "quality").limit(max_train).groupBy("doc_id").agg(F.min("quality").alias("quality"))  # 12 bytes a row, so small enough to broadcast

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, raw, off in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), batch.column("quality").slice(row, n), pa.array(list(features(raw, off)), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    measured = rows.select("doc_id", "text", "quality").mapInArrow(measure, "doc_id long, quality int, x array<double>")
    got = measured.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return x, got["quality"].to_numpy(np.float64)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; a column of that name is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(features(raw, off)) for _, _, raw, off in chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.empty(0))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Every fifth row by CRC-32 of its doc_id; a null one is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with score, held_out and predicted (1 from ``threshold`` on).  Learns
    from labels of rows that are not held out; only the text enters a score."""
    x, y = training_rows(docs, labels.where(~held_out(F.col("doc_id"))), max_train)
    out = scored(docs.drop("held_out", "predicted"), fit(x, y))
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
