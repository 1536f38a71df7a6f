import hashlib
import random
from collections import Counter

import pytest

from pixelquarry.llm import substring_dedup as sd
from pixelquarry.llm.sketch import Layout

DOCS = "doc_id long, text string"


def brute(rows, window):
    import re

    texts = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(t), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(t) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    r = random.Random(7)
    fresh = lambda n: " ".join(str(r.randrange(10**9)) for _ in range(n))
    passage = fresh(50)
    rows = [(i, fresh(r.randrange(80))) for i in range(30)]
    rows += [(100 + i, fresh(r.randrange(20)) + " " + passage + "\n" + fresh(r.randrange(20))) for i in range(40)]
    rows += [(200, "The " * 90), (201, "a b c " * 30), (202, None), (203, ""), (None, fresh(40) + " " + passage), (204, " \t\n ")]
    rows += [(300 + i, rows[3][1] + " " + rows[4][1]) for i in range(3)] + [(300, rows[3][1] + " " + rows[4][1])]
    rows += [(400, fresh(34)), (401, "x y " * 20 + passage[:90]), (402, fresh(3000) + " " + passage + " " + fresh(3000))]
    return rows


ONE, MANY, CROWDED = Layout(), Layout(4, 2000, 100), Layout(4, 5000, 50, 0.1)  # many shards and buckets; and few cells for many keys


@pytest.mark.parametrize("window,layout,limit", [(35, ONE, 1 << 26), (5, ONE, 1 << 26), (35, MANY, 1), (35, MANY, 1 << 26), (5, MANY, 1), (5, ONE, 200), (35, CROWDED, 1 << 26)])
def test_matches_brute_force(spark, window, layout, limit):
    rows = cases()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sd.digest(sd.dedup_substrings(docs, window, layout, limit=limit))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, window)


def test_nothing_is_broadcast_and_texts_are_not_stored(spark, monkeypatch):
    """The sketch has no driver array and no copy of texts: one path, whatever its size."""
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: pytest.fail("broadcast"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sd.dedup_substrings(spark.createDataFrame(cases(), DOCS), 35, MANY)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, sd.digest(got).collect()), key=str) == brute(cases(), 35)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_any_column_names(spark):
    names = ["_text_key", "_doc_id", "_runs", "key", "text_key", "runs", "_bucket", "c0", "a.b"]
    rows = [(d, t, *(f"{n}{i}" for n in names)) for i, (d, t) in enumerate(cases())]
    docs = spark.createDataFrame(rows, DOCS + ", " + ", ".join(f"`{n}` string" for n in names))
    out = sd.dedup_substrings(docs)
    assert sorted(tuple(r[: 2 + len(names)]) for r in out.collect() if r[0]) == sorted(r for r in rows if r[0])
    assert sorted(map(tuple, sd.digest(out).collect()), key=str) == brute(cases(), 35)


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], DOCS)
    assert sd.dedup_substrings(none).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "k", [1])], DOCS + ", n_words int, _x string, runs array<int>")
    out = sd.dedup_substrings(odd)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_x", "runs", "n_words", "n_removed", "kept_text"])
    assert out.first()["kept_text"] == "a b"
