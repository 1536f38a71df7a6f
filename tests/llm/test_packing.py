import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelquarry.llm import packing
from pixelquarry.llm.bpe import encoder
from pixelquarry.llm.textkit import chunks

PATH = packing.tokenizer_path()


def own(texts):
    plain = Tokenizer.from_file(PATH)
    return [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def by_chunks(texts, limit):
    out = []
    for _, _, raw, off in chunks(pa.array(texts, pa.string()), limit):
        ids, count = encoder(PATH).chunk(raw, off)
        at = np.cumsum(count)
        out += [ids[b - n : b].tolist() for b, n in zip(at.tolist(), count.tolist(), strict=True)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Zé ß9²\n\t.'!s漢 \u0085\x1c<|endoftext>  ")), max_size=25), max_size=6))
def test_ids_are_the_tokenizers(texts):
    assert by_chunks(texts, 40) == own(texts)


def test_ids_of_odd_texts():
    texts = ["", None, " ", "  a", "a  ", "a \n b", "it's 'tis don't", "é'e", "<|endoftext|>", "\n\n\nx", "ab12cd", "a b", "日本 語", "Ǝɐ Ɏ ɏ", "x" * 3000, "÷×ª"]
    assert by_chunks(texts, 1 << 20) == own(texts)


def test_added_tokens_in_texts_are_ids_of_their_own():
    end = "<|endoftext|>"
    texts = [f"{end}a b", f"a b {end}", f"a {end} b {end} c", f"x{end}{end}", "<|endof", "text|>", "a <|endoftext|", f"one\n\n{end}  two"]
    assert by_chunks(texts, 1 << 20) == by_chunks(texts, 1) == own(texts)
    assert by_chunks(["hello <|endoftext|> world"], 1 << 20) == [[31373, 220, 50256, 995]]


def checked(got, rows, length=2048):
    """Every id in exactly one piece, pieces gapless in full sequences; the pieces by sequence."""
    ids = Counter((d, tuple(x + [1])) for (d, _, _), x in zip(rows, own([t for _, t, _ in rows]), strict=True))
    pieces = defaultdict(list)
    for p in got:
        pieces[p["doc_id"], p["doc_tokens"]].append(p)
    for (d, x), times in ids.items():
        mine = pieces[d, len(x)]
        assert Counter(p["start"] for p in mine)[0] == times
        for p in mine:
            part = np.array(x[p["start"] : p["start"] + p["length"]], "<u4")
            assert len(part) == p["length"] and p["ids_crc32"] == zlib.crc32(part.tobytes())
        assert sum(p["length"] for p in mine) == times * len(x)
    total = sum(len(x) * n for (_, x), n in ids.items())
    windows = defaultdict(list)
    for p in got:
        windows[p["sequence_id"]].append(p)
    assert sorted(windows) == list(range(-(-total // length)))
    for k, w in windows.items():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == (length if k < len(windows) - 1 else total - length * k)
    return windows


def have(window):
    out = Counter()
    for p in window:
        out[p["source"]] += p["length"]
    return out


def test_every_token_once_and_proportions(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["der", "un", "a12", "queße", "\n"]) for _ in range(r.randrange(0, 900))), r.choice(["big"] * 6 + ["mid"] * 3 + ["tiny", None])) for i in range(150)]
    rows += [(500, None, "big"), (501, "", "new"), (None, "x y", "big"), (7, "again", "mid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).selectExpr("*", "1 AS length", "'z' AS task")
    got = packing.pack(docs).collect()
    windows = checked(got, rows)
    share = Counter()
    for p in got:
        share[p["source"]] += p["length"] / sum(p["length"] for p in got)
    for k in range(len(windows) - 1):
        assert all(abs(have(windows[k])[s] - 2048 * share[s]) <= 2 * len(share) + 2 for s in share if s != "new")


def test_many_sources_keep_their_names_and_spread(spark):
    """Two hundred sources, most below a queue of their own: each is named and spread over the whole stream."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(5, 60))), f"s{i % 200}" if i % 4 else "hot") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    windows = checked(packing.pack(docs).collect(), rows)
    places = defaultdict(list)
    for k, w in windows.items():
        for p in w:
            places[p["source"]].append((k * 2048 + p["offset"]) / (2048 * len(windows)))
    assert set(places) == {s for _, _, s in rows}
    assert all(abs(np.mean(x) - 0.5) < 0.1 for x in places.values())


def test_targets_hold_until_a_queue_runs_out(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["one", "two"]) for _ in range(100)), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    windows = checked(packing.pack(docs, length=256, targets={"a": 0.5, "b": 0.25}).collect(), rows, 256)
    n = len(windows)
    for k in range(int(0.6 * n)):  # a lasts for two thirds of the stream
        assert all(abs(have(windows[k])[s] - 256 * x) <= 4 for s, x in (("a", 0.5), ("b", 0.25), ("c", 0.25)))
    for k in range(int(0.7 * n), n - 1):
        assert have(windows[k])["a"] == 0 and abs(have(windows[k])["b"] - 128) <= 4
    # a source without a share is served last
    windows = checked(packing.pack(docs, length=256, targets={"a": 0.5, "c": 0.5}).collect(), rows, 256)
    assert all(have(windows[k])["b"] <= 2 for k in range(int(0.6 * n))) and have(windows[n - 2])["b"] >= 254
    for bad in ({"a": 0.9, "b": 0.2}, {"a": 0.0}):
        with pytest.raises(ValueError):
            packing.pack(docs, targets=bad)


@pytest.mark.parametrize("weights", [None, [1, 1, 1, 1, 1], [5, 1, 0.5, 2, 2]])
def test_schedule_agrees_with_a_served_round_robin(weights):
    r = np.random.default_rng(2)
    for length in (7, 32):
        totals = r.integers(0, 200, 5)
        s = packing.Schedule(totals, length, None if weights is None else np.array(weights))
        served, stream = np.zeros(5, int), []
        for k in range(1, s.rounds + 1):
            now = s.served(np.arange(5), np.full(5, k))
            assert (now >= served).all() and (now <= totals).all()
            assert abs(now.sum() - min(k * length, totals.sum())) <= 5
            for q in range(5):
                stream += [(q, t) for t in range(served[q], now[q])]
            served = now
        assert (served == totals).all()
        for q in range(5):
            if totals[q]:
                doc, start, n, at = s.pieces(np.array([q]), np.array([0]), np.array([totals[q]]))
                assert sorted(stream.index((q, int(t))) for t in range(totals[q])) == sorted(x for a, m in zip(at, n, strict=True) for x in range(a, a + m))


def thue_morse(k, a, b):
    x = a
    y = b
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


def test_pieces_are_told_apart_by_their_bytes():
    """Long words whose sums of powers modulo 2**64 are equal, and words that differ in their last byte."""
    texts = [w for k in (10, 11, 12) for w in thue_morse(k, "a", "b")]
    texts += [" ".join(texts[:2]), "x" * 16 + "a", "x" * 16 + "b", "x" * 15 + "\0", "x" * 15, "\0", "\0\0"]
    for limit in (1, 1 << 20):
        assert by_chunks(texts, limit) == own(texts)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("limit", [10, 1000])
def test_cache_moves_on(limit):
    encoder(PATH).forget(5)
    texts = [f"word{i % 13} other{i} é supercalifragilistic{i % 3}" for i in range(60)]
    try:
        assert by_chunks(texts, limit) == own(texts)
    finally:
        encoder(PATH).forget()
