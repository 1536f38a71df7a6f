import random
import zlib

import numpy as np

from pixelquarry.llm import quality as ql
from pixelquarry.llm.textkit import chunks

import pyarrow as pa


def corpus(n=900):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(5, 120))]
        bad = r.random() < 0.3
        if bad:
            kind = r.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else words[:2] * 40 if kind == 1 else [w + "%%%" for w in words]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(not bad), 0))
    return rows + [(None, None), (n, ""), (n + 1, None)], labels + [(None, 1, 0), (3, None, 0)]


def test_held_out_accuracy_and_shape(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'q' AS quality", "2 AS predicted")
    got = ql.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {d: q for d, q, _ in labels if q is not None}
    assert len(got) == len(rows) and got[0]["quality"] == "q"
    for x in got:
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.97


def test_features_match_plain_python():
    texts = ["The The cat. sat!\n\nThe cat. sat!", "", None, "ÉA | b | c 12 ##", " \n", "x" * 30 + " y"]
    got = np.concatenate([ql.features(raw, off) for _, _, raw, off in chunks(pa.array(texts), limit=20)])
    f = {n: got[:, i] for i, n in enumerate(ql.FEATURES)}
    assert np.allclose(np.expm1(f["log_words"]), [7, 0, 0, 7, 0, 2])
    assert np.allclose(f["distinct_words"], [3 / 7, 0, 0, 6 / 7, 0, 1])
    assert np.allclose(f["doubled_words"], [1 / 7, 0, 0, 0, 0, 0])
    assert np.allclose(f["lines"], [3 / 7, 0, 0, 1 / 7, 1, 1 / 2])
    assert np.allclose(f["repeated_trigrams"][:4], [1 - 4 / 5, 1, 1, 0])
    assert np.allclose(f["bars"], [0, 0, 0, 2 / 7, 0, 0]) and np.allclose(f["long_words"], [0, 0, 0, 0, 0, 1 / 2])


def test_pairs_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, len(ql.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    m = ql.fit(x[:3000], y[:3000], rounds=10)
    assert (5, 2) in m.pairs
    assert np.mean((m.score(x[3000:]) > 0.5) == y[3000:]) > 0.9


def test_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {x["predicted"] for x in ql.classify(docs, labels).collect()} == {1}
    assert len(ql.classify(docs, labels.limit(0)).collect()) == 2
    assert ql.classify(docs.limit(0), labels).count() == 0


def test_repeated_rows_of_a_labelled_document_train_once(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 50 + [(1, "other words here"), (2, "x"), (3, None), (None, "y")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    x, y = ql.training_rows(docs, labels)
    assert x.shape[0] == 3 and y.tolist() == [0.0, 1.0, 0.0]
