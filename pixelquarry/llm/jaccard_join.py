"""Exact word n-gram Jaccard join by token-combination prefixes, as connected groups.

The tokens of a document are its distinct shingles.  A merged count-min sketch of all documents sorts tokens into
private (estimate 1: in no other document), rare and frequent, which with the hash is one order for all.  A set of n
tokens that links with another lacks at most t = n - ceil(threshold * n) of its own tokens in it.  Its prefix holds
tokens in that order until more than t are used up, where

* a private token counts one and needs no index entry,
* a rare token counts one and is indexed alone,
* frequent tokens fall into classes by hash; a class with x of them in the prefix counts x - 1, so the prefix is
  longer, and each pair of a class is indexed.

If two sets link, then in the shorter prefix at most t tokens are missing from the other set, so a rare token, or two
frequent ones of one class, are in both prefixes: linked sets share an index key.  Keys also carry a size bucket
(buckets of linked sets are equal or neighbours), and the number of classes grows with it.

Shingles are told apart by 64-bit hashes of their words' bytes and sets by 128 bits, so results are exact up to
collisions of those.

Documents with equal sets are one node from the start.  Key lists are never expanded into pairs: each list tries its
node of fewest private tokens (what others were copied from) against the others; lists that still span several components then try a few nodes of each component
against the other components' nodes, eight times as many each round, until each list is one component or all its
pairs were tried.  So a large group of near copies costs a few pairs a document, and no link is lost.

Nulls: a null text has no words, an empty set and no links.  Rows with a null or repeated doc_id are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .shared import parts, stored
from .textkit import chunks, gram_hashes, inside, lowered, mix, span_hashes, words

K = 5
PERCENT = 80
FREQUENT = 32
SALTS = 16
LONG = 64
WIDE = sketch.Layout(cells_per_key=24, rows=1)
_SETS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("n", pa.int64()), ("n_rare", pa.int32()), ("may_link", pa.bool_()), ("tokens", pa.binary())])
_LISTS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("s", pa.int32()), ("rest", pa.int32())])
_STARS = pa.schema([*_LISTS, ("hub", pa.int64()), ("more", pa.bool_())])


def shingles(raw: np.ndarray, off: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles of each text in a chunk, by text and hash; a text of fewer words
    has one: all its words."""
    raw = lowered(raw)
    w = words(raw, off)
    hashes = span_hashes(raw, w.start, w.end)
    text = w.text()
    at = np.flatnonzero(inside(w, k))
    doc, out = [text[at]], [gram_hashes(hashes, k)[at]]
    count = np.diff(w.first)
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            doc.append(short)
            out.append(gram_hashes(hashes, m, 100 + m)[w.first[short]])
    doc, h = np.concatenate(doc), np.concatenate(out)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def token_sets(docs: DataFrame, k: int = K, percent: int = PERCENT, frequent: int = FREQUENT, layout: sketch.Layout = WIDE) -> DataFrame:
    """(doc_id, text_key, fa, fb, n, n_rare, may_link, tokens): each document's number of tokens and the 128-bit fingerprint
    of its set; ``text_key`` is xxhash64(text).
    ``tokens`` has the 64-bit hashes of those not private, rare ones first; null where they are too few for any link."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")

    common = sketch.Lookup(rows, lambda raw, off: shingles(raw, off, k), 1 / 8, (2, frequent), layout)

    def sets(batches: Iterator[tuple[pa.RecordBatch, sketch.Sketch]]) -> Iterator[pa.RecordBatch]:
        for batch, seen in batches:
            for row, rows_in, raw, off in chunks(batch.column("text")):
                doc, h = shingles(raw, off, k)
                shared = seen.reaches(h, 2)
                often = np.zeros(len(h), bool)
                often[shared] = seen.reaches(h[shared], frequent)
                first = np.searchsorted(doc, np.arange(rows_in + 1))
                n, c = np.diff(first), np.bincount(doc[shared], minlength=rows_in)
                rare = np.bincount(doc[shared & ~often], minlength=rows_in)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, s))]) for s in (21, 22)]
                fa, fb = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                order = np.flatnonzero(shared)
                order = order[np.lexsort((h[order], often[order], doc[order]))]
                ends = np.cumsum(c)
                data = h[order].tobytes()
                may = (100 * c >= percent * n) & (n > 0)
                blobs = [data[8 * (e - x) : 8 * e] if ok else None for e, x, ok in zip(ends.tolist(), c.tolist(), may.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, rows_in), batch.column("text_key").slice(row, rows_in), pa.array(fa), pa.array(fb), pa.array(n.astype(np.int64)), pa.array(rare.astype(np.int32)), pa.array(may), pa.array(blobs, pa.binary())], schema=_SETS)

    return common.apply(sets, "doc_id long, text_key long, fa long, fb long, n long, n_rare int, may_link boolean, tokens binary")


def _need(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def index_keys(tokens: np.ndarray, n: int, n_rare: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set, and how many of its tokens come up to each key's last one."""
    base = 100 / percent * 1.0001
    bucket = int(math.log(n) / math.log(base))
    need = _need(n, percent) - (n - len(tokens))
    keys, upto = [], []
    for g in (bucket, bucket + 1):
        salt = mix(np.array([g], np.uint64), 31)
        single = tokens[: min(n_rare, need)] if n > 1 else tokens[:1]
        keys.append(mix(single ^ salt, 32))
        upto.append(np.arange(1, len(single) + 1))
        want = need - n_rare
        if want <= 0 or n == 1:
            continue
        often = tokens[n_rare:]
        classes = max(1, int(percent / 100 * base ** (g - 1) / 16))
        cls = (mix(often ^ salt, 33) % np.uint64(classes)).astype(np.int64)
        by = np.argsort(cls, kind="stable")
        again = np.zeros(len(often), np.int64)
        again[by[1:]] = cls[by][1:] == cls[by][:-1]
        size = int(np.searchsorted(np.cumsum(again), want)) + 1
        by = by[by < size]
        cut = np.flatnonzero(np.diff(cls[by], prepend=-1))
        length = np.diff(np.append(cut, len(by)))
        for d in range(1, int(length.max()) if len(length) else 0):  # pairs of class members d apart
            a = np.arange(len(by) - d)
            a = a[cls[by[a]] == cls[by[a + d]]]
            keys.append(mix(mix(often[by[a]] ^ salt, 34) + often[by[a + d]], 35))
            upto.append(n_rare + by[a + d] + 1)
    return np.concatenate(keys), np.concatenate(upto)


def key_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, s, rest): the index.  s of the node's shared tokens come up to the key's last one, rest after."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for node, n, n_rare, blob in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "n_rare", "tokens")), strict=True):
                tokens = np.frombuffer(blob, np.uint64)
                keys, upto = index_keys(tokens, n, n_rare, percent)
                held.append((keys.view(np.int64), np.full(len(keys), node), np.full(len(keys), n), upto, len(tokens) - upto))
                size += len(keys)
                if size > 1 << 17:
                    yield _arrow(_LISTS, held)
                    held, size = [], 0
            if held:
                yield _arrow(_LISTS, held)

    return sets.mapInArrow(index, "key long, node long, n int, s int, rest int")


def _arrow(schema: pa.Schema, held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def stars(lists: DataFrame) -> DataFrame:
    """The index lists of at least two nodes; ``hub`` is the list's first node, ``more`` whether it has more than two.
    Nodes with fewer private tokens come first.  A list of two sends its second node only.  Rows stream in key order: no list is held."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.empty((0, 6), np.int64)  # the last list so far, at most three rows of it; column 5: rows of it already sent
        hub_key = hub = None
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            if not len(new):
                continue
            x = np.concatenate([carry[:, :5], new])
            begin = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0]))
            length = np.diff(np.append(begin, len(x)))
            hubs = np.repeat(x[begin, 1], length)
            if hub_key is not None and x[0, 0] == hub_key:
                hubs[: length[0]] = hub
            size = np.repeat(length, length)
            if hub_key is not None and x[0, 0] == hub_key:
                size[: length[0]] = 3
            last = begin[-1]
            if len(x) - last < 3 and not (hub_key is not None and x[last, 0] == hub_key):
                carry = np.concatenate([x[last:], np.zeros((len(x) - last, 1), np.int64)], axis=1)
                take = np.arange(last)
            else:
                hub_key, hub = x[last, 0], hubs[last]
                carry = np.empty((0, 6), np.int64)
                take = np.arange(len(x))
            take = take[size[take] > 1]
            if len(take):
                yield out(x[take], hubs[take], size[take])
        if len(carry) == 2:
            yield out(carry[:, :5], np.repeat(carry[:1, 1], 2), np.array([2, 2]))

    def out(x: np.ndarray, hubs: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        keep = (size > 2) | (hubs != x[:, 1])
        x, hubs = x[keep], hubs[keep]
        return pa.RecordBatch.from_arrays([*(pa.array(x[:, i]).cast(f.type) for i, f in zip(range(5), _STARS, strict=False)), pa.array(hubs), pa.array(size[keep] > 2)], schema=_STARS)

    return lists.repartition(parts(lists.sparkSession), "key").sortWithinPartitions("key", F.expr("n - s - rest"), "node").mapInArrow(star, "key long, node long, n int, s int, rest int, hub long, more boolean")


def _may_link(a: str, b: str, percent: int) -> str:
    """Sizes allow a link, and so do the tokens up to and after the common key's last one."""
    return (
        f"100L * least({a}.n, {b}.n) >= {percent}L * greatest({a}.n, {b}.n) AND "
        f"{100 + percent}L * (least({a}.s, {b}.s) + least({a}.rest, {b}.rest)) >= {percent}L * ({a}.n + {b}.n)"
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int, salts: int = SALTS) -> DataFrame:
    """The pairs (a, b) whose sets link.  A pair travels as b's tokens to a's, which are sent once per salt."""
    spark = pairs.sparkSession
    salt = F.pmod(F.hash("b"), F.lit(salts))
    member = pairs.withColumn("salt", salt).join(sets.select(F.col("node").alias("b"), "n", "tokens"), "b")
    hub = pairs.select("a", salt.alias("salt")).distinct().join(sets.select(F.col("node").alias("a"), "n", "tokens"), "a").withColumn("b", F.lit(None).cast("long"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, size = np.empty(0, np.uint64), 0
        for batch in batches:
            a_out, b_out = [], []
            for a, b, n, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "tokens")), strict=True):
                tokens = np.frombuffer(blob, np.uint64)
                if b is None:
                    mine, size = np.sort(tokens), n
                    continue
                if not len(mine):
                    continue
                at = np.searchsorted(mine, tokens)
                at[at == len(mine)] = 0
                both = int((mine[at] == tokens).sum())
                if 100 * both >= percent * (n + size - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    rows = member.select("a", "b", "salt", "n", "tokens").unionByName(hub.select("a", "b", "salt", "n", "tokens"))
    return rows.repartition(parts(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(check, "a long, b long")


def link_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of all nodes with a link, from ``sets`` (node, n, n_rare, tokens)."""
    found = stored(stars(key_lists(sets, percent)), "lists")
    # the first member of a list is not known to have the hub's s and rest; sizes decide here, verification follows
    pairs = found.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(pairs, sets, percent), "links")
    lists, hubs = found.where("more").withColumn("starred", F.col("hub") == F.col("node")).drop("hub", "more"), 1
    while True:
        labels = components(links)
        of = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        ranked = of.join(open_, "key", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("key", "component").orderBy(F.expr("n - s - rest"), "node")))
        ranked = stored(ranked, "open")
        # with as many hubs as the second largest component of a list has members, all its pairs across components are tried
        sizes = ranked.groupBy("key", "rank").count().groupBy("key").agg(F.max(F.when(F.col("count") > 1, F.col("rank"))).alias("second"), F.sum("count").alias("size"))
        ranked = ranked.join(sizes.where("second IS NOT NULL"), "key")
        keys = ranked.where(F.col("size") > LONG).groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        smaller = F.when(F.col("size") > LONG, F.expr("slice(keys, 1, CAST(array_position(keys, key) AS INT) - 1)"))
        lists = stored(ranked.join(keys, "node", "left").withColumn("keys", smaller), "open")
        if lists.isEmpty():
            return labels
        # pairs with a list's first node were tried before, two hubs need to meet once only, and a pair that shares
        # several long lists is tried in that of its smallest common key
        other = f"h.key = m.key AND h.component <> m.component AND (m.rank > {hubs} OR h.node < m.node)"
        tried = lists.where(F.col("rank") <= hubs).where("NOT starred").alias("h").join(lists.where("NOT starred").alias("m"), F.expr(f"{other} AND {_may_link('h', 'm', percent)} AND (h.keys IS NULL OR NOT arrays_overlap(h.keys, m.keys))"))
        tried = tried.select(F.least("h.node", "m.node").alias("a"), F.greatest("h.node", "m.node").alias("b")).distinct()
        new = stored(verified(tried, sets, percent), "links")
        lists = lists.where(F.col("second") > hubs).drop("component", "rank", "second", "size", "keys")
        if new.isEmpty() and lists.isEmpty():
            return labels
        links = links.union(new)
        if lists.isEmpty():
            return components(links)
        hubs *= 8


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, frequent: int = FREQUENT, layout: sketch.Layout = WIDE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id that links reach,
    its own included), text_key (xxhash64(text)) and component, one number for each group (null: a document that no other
    can link with, a group of its own)."""
    all_sets = stored(token_sets(docs, k, percent, frequent, layout), "sets")
    may = all_sets.where("may_link")
    nodes = may.groupBy("fa", "fb").agg(F.min("doc_id").alias("first_doc"), F.first("n").cast("int").alias("n"), F.first("n_rare").alias("n_rare"), F.first("tokens").alias("tokens"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = link_components(nodes.select("node", "n", "n_rare", "tokens"), percent)
    # the smallest document of a component is an aggregate, joined back in salted parts: no component meets in one task
    linked = nodes.select("fa", "fb", "node", "first_doc").join(labels, "node")
    smallest = linked.groupBy("component").agg(F.min("first_doc").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(smallest, ["component", "salt"]).select("fa", "fb", "component_id", "component")
    named = nodes.join(labels, "node", "left_anti").select("fa", "fb", F.col("first_doc").alias("component_id"), F.col("node").alias("component")).unionByName(named)
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_key", "component"]
    found = may.select("doc_id", "text_key", "n", "fa", "fb").join(named, ["fa", "fb"], "left").select(*columns)
    others = all_sets.where("NOT may_link").select("doc_id", "text_key", "n", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("component")).select(*columns)
    return found.unionByName(others)
