import random

import numpy as np
import pyarrow as pa

from pixelquarry.llm import masked_lm as lm
from pixelquarry.llm.textkit import chunks


def texts(n=400):
    r = random.Random(3)
    after = {w: r.sample(range(60), 3) for w in range(60)}
    out = []
    for _ in range(n):
        w, line = r.randrange(60), []
        for _ in range(r.randrange(20, 80)):
            line.append(f"w{w}")
            w = r.choice(after[w])
        out.append(" ".join(line))
    return out


def test_both_sides_help_and_scores_add_up(spark):
    good = texts()
    shuffled = [" ".join(random.Random(i).sample(t.split(), len(t.split()))) for i, t in enumerate(good[:50])]
    rows = [*enumerate(good), (1000, None), (1001, ""), (None, "w1"), (3, good[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "'a' AS n_tokens", "1 AS n")
    of, share = lm.word_classes(lm.token_counts(docs, 12), 64)
    net = lm.train(docs, of, 64, every=2, rounds=3, bits=12)

    def brute(text):
        t = [int(lm.tokens(raw, off, 12)[0][0]) for w in text.split() for _, _, raw, off in chunks(pa.array([w]))]
        total = 0.0
        for i, x in enumerate(t):
            h = net.bias.astype(float).copy()
            for place, j in enumerate((i - 2, i - 1, i + 1, i + 2)):
                h += net.tables[place][of[t[j]] if 0 <= j < len(t) else 64]
            z = np.tanh(h) @ net.out + net.out_bias
            total += z[of[x]] - np.log(np.exp(z).sum()) + share[x]
        return total

    def ll(text):
        for _, _, raw, off in chunks(pa.array([text])):
            token, first = lm.tokens(raw, off, 12)
            return (net.log_probability(lm.contexts(of[token], first, 64), of[token]) + share[token]).sum()

    for t in good[:5]:
        assert abs(ll(t) - brute(t)) < 1e-2
    counts = lm.token_counts(docs, 12)
    unigram = np.log((counts + 0.5) / (counts + 0.5).sum())
    tok = np.concatenate([lm.tokens(raw, off, 12)[0] for _, _, raw, off in chunks(pa.array(good))])
    assert sum(ll(t) for t in good[:100]) / sum(len(t.split()) for t in good[:100]) > unigram[tok].mean() + 0.5
    assert np.mean([ll(a) > ll(b) for a, b in zip(good, shuffled, strict=False)]) > 0.95


def test_frame(spark):
    rows = [*enumerate(texts(30)), (1000, None), (1001, " "), (None, "w1"), (3, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS n_tokens", "1 AS share")
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        words = (x["text"] or "").split()
        assert x["n_tokens"] == len(words) and (x["mean_log_likelihood"] is None) == (not words)
        assert x["log_likelihood"] <= 0 if words else x["log_likelihood"] == 0
    assert lm.score(docs.limit(0)).count() == 0


def test_counts_and_classes(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a  c"), (3, None)], "doc_id long, text string")
    counts = lm.token_counts(docs)
    assert counts.sum() == 5 and counts.max() == 3
    of, share = lm.word_classes(counts, 16)
    assert of.max() == 15 and all(abs(np.exp(share[of == k]).sum() - 1) < 1e-9 for k in range(16))


def test_gradient():
    r = np.random.default_rng(1)
    net = lm.Network.start(6, 4)
    context, target = r.integers(0, 7, (20, 4)), r.integers(0, 6, 20)
    before, flat = -net.log_probability(context, target).mean(), net.flat()
    net.step(context, target, 1e-2)
    assert abs((before + net.log_probability(context, target).mean()) - ((flat - net.flat()) ** 2).sum() / 1e-2) < 1e-4


def test_production_rounds_train_on_every_position():
    """Frequent pairs are targets as often as they occur, and every position is one."""
    for _, rows, raw, off in chunks(pa.array(["of the cat"] * 200 + ["a b", None, "the of"])):
        token, first = lm.tokens(raw, off)
        key = np.arange(rows, dtype=np.uint64)
        seen = np.concatenate([lm.deal(key, first, lm.EVERY, n) for n in range(lm.ROUNDS)])
        assert sorted(seen) == list(range(len(token)))
        of = np.flatnonzero(token == token[0])
        assert 60 < np.isin(lm.deal(key, first, 2, 0), of).sum() < 140


def test_production_rounds_learn_frequent_pairs(spark):
    """Each of 40 words is always followed by its own next word: no pair may be left out of training."""
    r = random.Random(5)
    line = lambda: " ".join(f"a{k} b{k}" for k in (r.randrange(40) for _ in range(100)))
    docs = spark.createDataFrame([(i, line()) for i in range(400)], "doc_id long, text string").repartition(2)
    of, _ = lm.word_classes(lm.token_counts(docs))
    net = lm.train(docs, of)
    got = []
    for k in range(40):
        for _, _, raw, off in chunks(pa.array([f"a3 b3 a{k} b{k} a5 b5"])):
            token, first = lm.tokens(raw, off)
            p = net.log_probability(lm.contexts(of[token], first, lm.CLASSES), of[token])
            got.append(float(np.exp(p[3])))
    assert min(got) > 0.2, got


def test_each_word_has_its_own_count_at_every_size(spark):
    """More words than are known: shares within classes are those of exact counts, also of copies and null texts."""
    r = random.Random(7)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(r.randrange(1, 60)))) for i in range(300)]
    rows += [rows[0], (None, rows[1][1]), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = {}
    for w in " ".join(t or "" for _, t in rows).split():
        count[w] = count.get(w, 0) + 1
    counts = lm.word_counts(docs)
    assert sorted(x["n"] for x in counts.collect()) == sorted(count.values())
    words = lm.vocabulary(counts, 32, 50)
    assert 0 < len(words.known) <= 50 and words.rest > 1
    names = sorted(count)
    hashes = np.concatenate([lm.hashed(raw, off)[0] for _, _, raw, off in chunks(pa.array(names))])
    kind = dict(zip(names, words.kinds(hashes).tolist(), strict=True))
    total = np.bincount([kind[w] for w in names], [count[w] for w in names], 32)
    assert (total == words.total).all()
    net = lm.train(docs, words, 32)
    for x in lm.score(docs, 32, known=50).collect():
        t = (x["text"] or "").split()
        k = np.array([kind[w] for w in t], np.int64)
        want = net.log_probability(lm.contexts(k, np.array([0, len(k)]), 32), k).sum() + sum(np.log(count[w] / total[kind[w]]) for w in t)
        assert x["n_tokens"] == len(t) and abs(x["log_likelihood"] - want) < 1e-2 * (1 + len(t)), x
    assert len(lm.score(docs, 32, known=50).collect()) == len(rows)


def test_any_column_names(spark):
    """Names that the operator uses itself come back as they were, on the path of rare words too."""
    names = ["_text_key", "_key", "_rest", "key", "rest", "word", "c0"]
    rows = [(i, f"w{i} common words here w{i % 3}", *(f"{n}{i}" for n in names)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = lm.score(docs, known=5)
    assert got.columns == [*docs.columns, "n_tokens", "log_likelihood", "mean_log_likelihood"]
    assert sorted(tuple(r[: len(docs.columns)]) for r in got.collect()) == rows
