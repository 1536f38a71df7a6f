import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pixelquarry.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, lo string, `digest` int, tree string, more string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def grown(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def around(levels, i):
    for level in levels[:-1]:
        begin = i // 8 * 8
        yield "".join(level[begin:i]), "".join(level[i + 1 : begin + 8])
        i //= 8


def brute(rows):
    trees = {}
    for r in rows:
        own = leaf(r, r["text"])
        now = own
        if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            now = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, own, now))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown_trees = {k: grown([x[2] for x in sorted(trees[k])]) for k in names}
    top = grown([grown_trees[k][-1][0] for k in names])
    out = []
    for j, k in enumerate(names):
        for i, (named, doc_id, own, now) in enumerate(sorted(trees[k])):
            path = [*around(grown_trees[k], i), *around(top, j)]
            for a, b in path:
                now = h(a + now + b)
            out.append((doc_id if named else None, own, grown_trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=str)


def rows(n, langs):
    return [(i if i % 50 else None, "s", langs[i % len(langs)], i % 3 or None, f"Text {i} É" if i % 7 else None, "x", 1, "t", "m") for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, ["en", None]), (70, ["en"]), (600, ["é", "en", "", None, "z"]), (300, [f"l{i}" for i in range(75)])])
def test_brute_force(spark, n, langs):
    data = spark.createDataFrame(rows(n, langs), SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in merkle.check_tampered(data).collect()), key=str)
    assert got == brute([r.asDict() for r in data.collect()])


def test_rows_that_repeat_and_an_empty_table(spark):
    data = spark.createDataFrame([(7, "q", "z", 3, "ABC", None, None, None, None)] * 70 + rows(20, ["z"]), SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in merkle.check_tampered(data).collect()), key=str)
    assert got == brute([r.asDict() for r in data.collect()])
    assert merkle.check_tampered(data.limit(0)).collect() == []


def test_intervals_of_nodes(spark):
    leaves = spark.range(100).select(F.lit("a").alias("tree"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.struct("id").alias("more"))
    nodes = merkle.levels(merkle.ranked(leaves))
    assert [sorted((r.lo, r.hi) for r in level.collect()) for level in nodes] == [[(i, min(100, i + w)) for i in range(0, 100, w)] for w in (8, 64, 512)]


def test_proof_folds_to_the_root_only_with_the_leaf(spark):
    data = spark.createDataFrame(rows(200, ["en", "de"]), SCHEMA)
    done = merkle.manifest(data).withColumn("wrong", F.sha2("leaf", 256))
    got = done.select("root", merkle.folded("leaf").alias("right"), merkle.folded("wrong").alias("other")).collect()
    assert len(got) == 200 and all(r.right == r.root and r.other != r.root for r in got)
