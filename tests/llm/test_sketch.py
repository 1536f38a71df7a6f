import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelquarry.llm import sketch
from pixelquarry.llm.textkit import mix


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**40), min_size=1, max_size=30), min_size=1, max_size=8))
def test_packed_runs_come_back(runs):
    x = np.concatenate([np.sort(np.array(r, np.int64)) for r in runs])
    counts = np.array([len(r) for r in runs])
    data, cut = sketch.packed(x, np.cumsum(counts) - counts)
    assert (sketch.unpacked(data, counts) == x).all()
    at = 0
    for i, n in enumerate(counts):
        assert (sketch.unpacked(data[cut[i] : cut[i + 1]], np.array([n])) == x[at : at + n]).all()
        at += n


def test_estimates_are_at_least_the_counts(spark):
    """Every key that occurs twice reaches 2 in each bucket that asks, however small shards, buckets and flushes are."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 4000, rng.integers(0, 60)))) for _ in range(300)] + [None, "", "7 7"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)

    def pairs(raw, off):
        text, key = [], []
        for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
            for w in raw[a:b].tobytes().split():
                text.append(i)
                key.append(int(w))
        return np.array(text, np.int64), mix(np.array(key, np.uint64), 1)

    every = [int(w) for t in texts for w in (t or "").split()]
    true = np.bincount(every, minlength=4000)
    for layout, most_wrong in ((sketch.Layout(), 0.1), (sketch.Layout(5, 300, 70), 0.15), (sketch.Layout(3, 500, 40, 0.1), 1.0)):
        look = sketch.Lookup(docs, pairs, 0.2, (2, 5), layout)

        def asked(stream):
            for batch, seen in stream:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = [int(w) for w in (text or "").split()]
                    keys = mix(np.array(words, np.uint64), 1)
                    two, five = seen.reaches(keys, 2), seen.reaches(keys, 5)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(words), pa.int64()), "word": pa.array(words, pa.int64()), "two": pa.array(two), "five": pa.array(five)})

        got = look.apply(asked, "doc_id long, word long, two boolean, five boolean").collect()
        assert sorted(r.word for r in got) == sorted(every)
        assert all(r.two for r in got if true[r.word] >= 2) and all(r.five for r in got if true[r.word] >= 5)
        wrong = [r.two for r in got if true[r.word] < 2]
        assert sum(wrong) <= most_wrong * max(1, len(wrong))
