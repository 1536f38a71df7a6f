import random
import re

import numpy as np
import pytest

from pixelquarry.llm import jaccard_join as jj
from pixelquarry.llm.components import components
from pixelquarry.llm.sketch import Layout

DOCS = "doc_id long, text string"


def token_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=5, percent=80):
    sets = [token_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, families=12, copies=12, words=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    rows, at = [], 0
    for _ in range(families):
        base = [word() for _ in range(r.randrange(4, words))]
        for _ in range(r.randrange(1, copies)):
            text = list(base)
            for _ in range(r.randrange(0, 3)):
                text[r.randrange(len(text))] = word()
            if r.random() < 0.3:
                text += [word() for _ in range(r.randrange(len(base)))]
            if r.random() < 0.2:
                text = text[: max(1, len(text) * 4 // 5)]
            rows.append((at, " ".join(text)))
            at += 1
    boiler = " ".join(word() for _ in range(50))
    for i in range(25):
        rows.append((at + i, boiler + " " + " ".join(word() for _ in range(r.randrange(3, 9)))))
    at += 25
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two three"), (at + 6, "One  two\tthree"), (at + 7, "a " * 50), (at + 8, "a " * 9)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,frequent,layout,long", [(1, 32, Layout(), 64), (2, 3, Layout(), 4), (3, 2, Layout(), 2), (4, 4, Layout(6, 3000, 500), 64), (5, 3, Layout(4, 9000, 90, 0.2), 4)])
def test_matches_brute_force(spark, monkeypatch, seed, frequent, layout, long):
    monkeypatch.setattr(jj, "LONG", long)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = jj.near_duplicates(docs, frequent=frequent, layout=layout).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_other_thresholds(spark):
    rows = corpus(5, families=8)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for k, percent in ((3, 60), (2, 95), (5, 100)):
        got = jj.near_duplicates(docs, k=k, percent=percent, frequent=3).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute(rows, k, percent)


def test_prefixes_of_linked_sets_share_a_key():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 9, 40, 300, 2000):
        for _ in range(30):
            universe = np.unique(r.integers(0, 2**63, 2 * n, dtype=np.uint64))
            common = r.permutation(universe)[:n]
            drop = int(r.integers(0, n // 9 + 1))
            a, b = common[: n - drop], np.concatenate([common[drop:]])
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            rare = {int(x) for x in universe if x % np.uint64(3) == 0}
            keys = []
            for s in (a, b):
                s = np.sort(s)
                is_rare = np.array([int(x) in rare for x in s])
                keys.append(set(jj.index_keys(np.concatenate([s[is_rare], s[~is_rare]]), len(s), int(is_rare.sum()), 80)[0].tolist()))
            assert keys[0] & keys[1], n


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: i for i in range(2000)}
    for _ in range(2000):
        moved = False
        for a, b in edges:
            if a is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
        if not moved:
            break
    assert got == {i: root[i] for e in edges if e[0] is not None and e[0] != e[1] for i in e}


def test_empty_nulls_and_repeated_ids(spark):
    assert jj.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(None, "x y z"), (7, "x y z"), (7, "other words here now yes"), (None, None)], DOCS)
    got = sorted(map(str, jj.near_duplicates(odd.withColumn("node", odd.doc_id)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(["Row(doc_id=None, n_shingles=1, component_id=7)", "Row(doc_id=7, n_shingles=1, component_id=7)", "Row(doc_id=7, n_shingles=1, component_id=7)", "Row(doc_id=None, n_shingles=0, component_id=None)"])
