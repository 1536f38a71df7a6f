"""Substring deduplication: drop every word that a repeated 35-word window covers.

1. Each partition sketches the anchors of its windows (below); the merged count-min sketch, whose shards stay a table,
   overestimates how often an anchor, and so any window that has it, occurs.
2. A second pass sends only the windows estimated to occur twice to shards by their anchor, where they are grouped by 96
   bits of two independent hashes of their words' bytes.  No window that occurs twice is lost: its estimate is at least
   its count; two different windows count as equal only where all 96 bits collide.
3. The repeated windows go back to their documents as ranges of words.

The anchor of a window is its smallest 8-word hash.  Equal windows have equal anchors at equal places, so an anchor
occurs at least as often as its windows; neighbouring windows mostly share one, which makes the sketch about fourteen
times smaller and keeps neighbouring windows together.  A window that occurs twice within one batch needs no answer
from a shard; it is sent once, without its places, so a passage in a third of all rows sends one entry per batch.

Nulls: a null text has no words.  Rows are told apart by doc_id and text; rows equal in both get the same result, and
each counts as an occurrence.  A null doc_id is a value like others.  Texts under ``window`` words keep all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .shared import numbered, parts, renamed
from .textkit import Words, chunks, gram_hashes, inside, ranges, slide, span_hashes, words

WINDOW = 35
ANCHOR = 8
SHARD_BYTES = 1 << 22
HELD_BYTES = 1 << 26
FLUSH = 1 << 20
_ENTRY = "shard int, keys binary, docs binary, runs binary, hashes binary, marks binary"
_ENTRIES = pa.schema([("shard", pa.int32()), *((n, pa.binary()) for n in ("keys", "docs", "runs", "hashes", "marks"))])
_MARK = "doc_id long, text_key long, runs binary"
_MARKS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("runs", pa.binary())])


def _anchors(raw: np.ndarray, off: np.ndarray, window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, hashes of ANCHOR-word runs, each window's anchor, and which windows lie in one text."""
    w = words(raw, off)
    hashes = span_hashes(raw, w.start, w.end)
    short = gram_hashes(hashes, min(ANCHOR, window))
    if len(hashes) < window:
        none = np.empty(0, np.uint64)
        return w, hashes, short, none, np.empty(0, bool)
    return w, hashes, short, slide(short, window - min(ANCHOR, window) + 1, np.minimum), inside(w, window)


def _anchor_keys(window: int) -> sketch.Pairs:
    def pairs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, _, short, anchor, ok = _anchors(raw, off, window)
        if not ok.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        span = window - min(ANCHOR, window) + 1
        of = np.zeros(len(anchor) + 2 * (span - 1), np.uint64)  # an anchor's places: where it is the smallest of some window
        of[span - 1 : span - 1 + len(anchor)] = np.where(ok, anchor, np.uint64(0))
        at = np.flatnonzero(slide(of, span, np.maximum) == short)
        return np.searchsorted(w.first, at, "right") - 1, short[at]

    return pairs


def _runs(starts: np.ndarray) -> np.ndarray:
    """(first, length) of runs of consecutive sorted integers, as int32 pairs."""
    cut = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return np.stack([starts[cut], np.diff(np.append(cut, len(starts)))], axis=1).astype(np.int32)


def repeated_windows(docs: DataFrame, window: int = WINDOW, layout: sketch.Layout = sketch.Layout(), shard_bytes: int = SHARD_BYTES, limit: int = HELD_BYTES) -> DataFrame:
    """Rows (doc_id, text_key, runs) for rows of ``docs`` (doc_id, text) with repeated windows; a row may have
    several.  ``text_key`` is xxhash64(text); ``runs`` holds int32 pairs: first window, number of windows.  There is a shard
    for every ``shard_bytes`` of text; of a shard with more than ``limit`` bytes of hashes (a passage in very many rows)
    what repeats is answered as it comes, so what a task holds does not grow with the input."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).where(F.octet_length("text") >= 2 * window - 1)
    common = sketch.Lookup(rows, _anchor_keys(window), 1 / 80, (2,), layout)
    shards = min(1 << 30, max(4 * parts(spark), -(-common.text_bytes // shard_bytes)))

    def send(held: list[tuple]) -> pa.RecordBatch:
        """Entries by shard.  keys: (doc_id, text_key) pairs that docs points to; runs: first window and length of each
        run of neighbouring windows; hashes: 12 bytes a window, with those known to repeat first, outside any run."""
        doc, at, anchor, h1, h2 = (np.concatenate(x) for x in zip(*((d, a, k, x, y) for d, a, k, x, y, _ in held), strict=True))
        ids = np.concatenate([x[5] for x in held])
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        twin = np.zeros(len(order), bool)
        twin[1:] |= same
        first_of_twins = np.flatnonzero(np.append(same, False) & ~twin)
        twin[:-1] |= same
        twice = np.zeros(len(order), bool)
        twice[order] = twin
        shard = (anchor >> np.uint64(40)).astype(np.int64) % shards
        out: list[tuple] = []
        # windows repeated in this very batch: marked at once, announced without places
        t = np.flatnonzero(twice)
        for lo, hi in _groups(doc[t]):
            out.append((int(doc[t[lo]]) % shards, ids[doc[t[lo]]].tobytes(), None, None, None, _runs(at[t[lo:hi]]).tobytes()))
        known = order[first_of_twins]
        # the others: runs of neighbours with one anchor
        s = np.flatnonzero(~twice)
        new = np.ones(len(s), bool)
        if len(s) > 1:
            new[1:] = (doc[s][1:] != doc[s][:-1]) | (at[s][1:] != at[s][:-1] + 1) | (anchor[s][1:] != anchor[s][:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(s)))
        by = np.argsort(shard[s[begin]], kind="stable")
        begin, length = begin[by], length[by]
        run_shard = shard[s[begin]]
        known = known[np.argsort(shard[known], kind="stable")]
        known_shard = shard[known]
        for k in np.unique(np.concatenate([run_shard, known_shard])):
            lo, hi = np.searchsorted(run_shard, [k, k + 1])
            a, b = np.searchsorted(known_shard, [k, k + 1])
            b0, n = begin[lo:hi], length[lo:hi]
            win = np.concatenate([known[a:b], s[ranges(b0, n)]])
            mine, local = np.unique(doc[s[b0]], return_inverse=True)
            packed = np.empty((len(win), 3), np.uint32)
            packed[:, :2] = h1[win].view(np.uint32).reshape(-1, 2)
            packed[:, 2] = (h2[win] >> np.uint64(32)).astype(np.uint32)
            runs = np.stack([at[s[b0]], n], axis=1).astype(np.int32)
            out.append((int(k), ids[mine].tobytes(), local.astype(np.int32).tobytes(), np.concatenate([np.array([[b - a, 0]], np.int32), runs]).tobytes(), packed.tobytes(), None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ENTRIES, strict=True)], schema=_ENTRIES)

    def candidates(batches: Iterator[tuple[pa.RecordBatch, sketch.Sketch]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows = docs_held = 0
        for batch, seen in batches:
            ids = np.stack([batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(), batch.column("text_key").to_numpy()], axis=1)
            for row, n, raw, off in chunks(batch.column("text")):
                w, hashes, _, anchor, ok = _anchors(raw, off, window)
                at = np.flatnonzero(ok)
                at = at[seen.reaches(anchor[at], 2)]
                if not len(at):
                    continue
                text = w.text()[at]
                held.append((docs_held + text, at - w.first[text], anchor[at], gram_hashes(hashes, window, 2)[at], gram_hashes(span_hashes(raw, w.start, w.end, 1), window, 3)[at], ids[row : row + n]))
                docs_held += n
                windows += len(at)
                if windows >= FLUSH:
                    yield send(held)
                    held, windows, docs_held = [], 0, 0
        if held:
            yield send(held)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        shard, size = -1, 0
        for batch in batches:
            for entry in batch.to_pylist():
                if entry["marks"] is not None:
                    doc, key = np.frombuffer(entry["keys"], np.int64)
                    yield _mark_batch([(doc, key)], [entry["marks"]])
                    continue
                if entry["shard"] != shard:
                    yield from _answer(held)[0]
                    held, shard, size = [], entry["shard"], 0
                held.append(entry)
                size += len(entry["hashes"])
                if size > limit:  # what repeats so far is answered, and only its hashes and the others are kept
                    marks, rest = _answer(held)
                    yield from marks
                    held, size = rest, 0
        yield from _answer(held)[0]

    return common.apply(candidates, _ENTRY).repartition(parts(spark), "shard").sortWithinPartitions("shard").mapInArrow(group, _MARK)


def _groups(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    cut = np.append(np.flatnonzero(np.diff(x, prepend=x[0] - 1)), len(x))
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _mark_batch(keys: list[tuple[int, int]], runs: list[bytes]) -> pa.RecordBatch:
    doc = np.array([k[0] for k in keys], np.int64)
    ids = pa.array(doc, pa.int64(), mask=doc == np.iinfo(np.int64).min)
    return pa.RecordBatch.from_arrays([ids, pa.array([k[1] for k in keys], pa.int64()), pa.array(runs, pa.binary())], schema=_MARKS)


def _answer(held: list[dict]) -> tuple[list[pa.RecordBatch], list[dict]]:
    """The windows of one shard's entries that occur more than once, back to their documents; and one entry that stands
    for all of these: each repeated window once, as known to repeat, and the others with their places."""
    if not held:
        return [], []
    hashes = np.concatenate([np.frombuffer(e["hashes"], np.uint32).reshape(-1, 3) for e in held])
    run_parts, keys, known = [], [], np.zeros(len(hashes), bool)
    at = base = 0
    for e in held:
        runs = np.frombuffer(e["runs"], np.int32).reshape(-1, 2)
        n = int(runs[0, 0])
        known[at : at + n] = True
        mine = np.frombuffer(e["keys"], np.int64).reshape(-1, 2)
        run_parts.append((np.frombuffer(e["docs"], np.int32).astype(np.int64) + base, runs[1:, 0].astype(np.int64), runs[1:, 1].astype(np.int64), at + n))
        keys.append(mine)
        base += len(mine)
        at += len(np.frombuffer(e["hashes"], np.uint32)) // 3
    h1 = np.ascontiguousarray(hashes[:, :2]).view(np.uint64).ravel()
    order = np.lexsort((hashes[:, 2], h1))
    same = (h1[order][1:] == h1[order][:-1]) & (hashes[order, 2][1:] == hashes[order, 2][:-1])
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    hit = (np.bincount(group) > 1) | (np.bincount(group, weights=known[order]) > 0)
    twice = np.zeros(len(hashes), bool)
    twice[order] = hit[group]
    doc_of, start_of = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    for doc, first, length, begin in run_parts:
        total = int(length.sum())
        doc_of[begin : begin + total] = np.repeat(doc, length)
        start_of[begin : begin + total] = ranges(first, length)
    every = np.concatenate(keys)

    def placed(which: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        pick = np.flatnonzero(which & (doc_of >= 0))
        pick = pick[np.lexsort((start_of[pick], doc_of[pick]))]
        return pick, _groups(doc_of[pick])

    pick, groups = placed(twice)
    marks = [_mark_batch([tuple(every[doc_of[pick[lo]]].tolist()) for lo, _ in groups], [_runs(start_of[pick[lo:hi]]).tobytes() for lo, hi in groups])] if len(pick) else []
    first = order[np.concatenate([[True], ~same])]
    first = first[hit]
    pick, groups = placed(~twice)
    runs = [_runs(start_of[pick[lo:hi]]) for lo, hi in groups]
    rest = {
        "keys": np.concatenate([every[doc_of[pick[lo]]] for lo, _ in groups]).tobytes() if groups else b"", "docs": np.repeat(np.arange(len(groups)), [len(r) for r in runs]).astype(np.int32).tobytes(),
        "runs": np.concatenate([np.array([[len(first), 0]], np.int32), *runs]).tobytes(), "hashes": hashes[np.concatenate([first, pick])].tobytes(), "marks": None,
    }
    return marks, [rest]


def removed_words(n_words: int, runs: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Which words the windows in ``runs`` cover."""
    edge = np.zeros(n_words + 1, np.int32)
    for blob in runs:
        pairs = np.frombuffer(blob, np.int32).reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, np.minimum(n_words, pairs[:, 0] + pairs[:, 1] - 1 + window), -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, layout: sketch.Layout = sketch.Layout(), shard_bytes: int = SHARD_BYTES, limit: int = HELD_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with ``n_words``, ``n_removed`` and ``kept_text``: the words kept, joined
    by one space.  Columns of ``docs`` with these names are replaced;
    others may have any names."""
    # a row that repeats has the same marks each time
    marks = repeated_windows(docs, window, layout, shard_bytes, limit).distinct().groupBy("doc_id", "text_key").agg(F.collect_list("runs").alias("runs"))
    plain, names = numbered(docs, "n_words", "n_removed", "kept_text")
    doc, body = (f"c{[c.lower() for c in names].index(c)}" for c in ("doc_id", "text"))
    joined = plain.withColumn("key", F.xxhash64(body)).join(marks, F.col(doc).cast("long").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    joined = joined.drop("key", "doc_id", "text_key")
    schema = T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            n_words, n_removed, text = [], [], []
            for row, n, raw, off in chunks(batch.column(body)):
                w = words(raw, off)
                data = raw.tobytes()
                for i in range(n):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    keep = ~removed_words(hi - lo, runs[row + i], window) if runs[row + i] else np.ones(hi - lo, bool)
                    n_words.append(hi - lo)
                    n_removed.append(hi - lo - int(keep.sum()))
                    if keep.all():
                        text.append(b" ".join(data[int(off[i]) : int(off[i + 1])].split()))
                    else:
                        at = np.flatnonzero(keep) + lo
                        text.append(b" ".join([data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]))
            rest = batch.drop_columns(["runs"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=[*rest.schema.names, "n_words", "n_removed", "kept_text"])

    return renamed(joined.mapInArrow(cut, schema), names, "n_words", "n_removed", "kept_text")


def digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept text."""
    return deduped.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

