"""The pipeline's stages against brute force, each on what the one before kept."""

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as cp  # noqa: E402
import test_jaccard_join  # noqa: E402
import test_secret_scan  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randrange(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage = fresh(60)
    rows = []
    for i in range(240):
        text = fresh(r.randrange(5, 90)) + "."
        if i % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 7 == 0:
            text += " " + passage
        elif i % 11 == 0:
            text += " password=0123456789abcdef01 " + fresh(4)
        rows.append((i, text))
    rows += [(300 + i, rows[1 + i][1] + " " + word()) for i in range(6)] + [(400, rows[2][1]), (401, None), (2, rows[2][1])]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], [(i, 0 if i % 5 == 0 else 1, 0) for i in range(240)]


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    out, at = [], docs
    for name, stage in cp.STAGES:
        got = stage(spark, at, sf)
        path = str(tmp_path / name.replace(" ", "_"))
        got.write.parquet(path)
        at = spark.read.parquet(path)
        out.append(at)
    good = {r["doc_id"]: r["text"] for r in out[0].collect()}
    bad = {i for i, q, _ in labels if q == 0}
    assert len(bad & set(good)) <= len(bad) // 20 and len([i for i, q, _ in labels if q and i not in good]) <= 4
    assert all(x.columns == docs.columns for x in out[:4])
    kept = [(r["doc_id"], r["text"]) for r in out[0].collect()]
    want = {d for d, _, c in test_jaccard_join.brute(kept) if d == c}
    one = sorted(r["doc_id"] for r in out[1].collect())
    assert one == sorted(want)
    from collections import Counter

    before = {r["doc_id"]: r["text"] for r in out[1].collect()}
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in before.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    after = {r["doc_id"]: r["text"] for r in out[2].collect()}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert after[d] == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else before[d])
    for r in out[3].collect():
        assert not test_secret_scan.plain(r["text"]) and r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    total = {r["doc_id"]: r["doc_tokens"] for r in out[4].collect()}
    assert set(total) == set(after) and sum(r["length"] for r in out[4].collect()) == sum(total.values())
    assert cp.run(spark, sf).count() == out[4].count()


def test_repeated_ids(spark):
    """Two texts of one doc_id are two documents; in one group the least stays; repeated rows stay once."""
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, a + " more", "en", "s", 3), (1, a, "de", "s", 1), (3, None, "en", "s", 0), (3, "", "en", "s", 0), (None, b + " x", "en", "s", 4)]
    got = sorted(map(str, map(tuple, cp.one_of_each_group(spark, spark.createDataFrame(rows, COLUMNS), "").collect())))
    assert got == sorted(map(str, [(1, a, "de", "s", 1), (1, b, "en", "s", 2), (3, None, "en", "s", 0), (3, "", "en", "s", 0)]))


def test_any_columns(spark):
    """Columns called like the stages' own, and of types without an order, come back as they were."""
    names = ["_text_key", "_doc_id", "_key", "key", "row", "component", "c0"]
    rows = [(i, f"some words of document number {i} and {i * i}", *(f"{n}{i}" for n in names), {"a": i}) for i in range(12)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names) + ", m map<string,int>")
    got = cp.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
