import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelquarry.llm.textkit import chunks, gram_hashes, span_hashes, words


def hashes(texts, salt=0):
    ((_, _, raw, off),) = chunks(pa.array(texts), 1 << 30)
    return span_hashes(raw, off[:-1], off[1:], salt)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\0", max_size=40), min_size=1, max_size=30))
def test_equal_hashes_are_equal_texts(texts):
    for salt in (0, 1):
        h = hashes(texts, salt)
        assert all((h[i] == h[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(i))


def test_words_whose_power_sums_collide():
    x, y = "a", "b"
    for _ in range(12):
        x, y = x + y, y + x
        for salt in (0, 1):
            assert len(set(hashes([x, y, x + "a", y + "a", x, "a" + x], salt).tolist())) == 5
    # the same with words for letters, in windows of many words
    x, y = [1], [2]
    for _ in range(10):
        x, y = x + y, y + x
        a, b = (gram_hashes(np.array(v, np.uint64), len(v)) for v in (x, y))
        assert a[0] != b[0]


def test_hashes_do_not_depend_on_what_is_around():
    long = "é" * 100
    a, b = hashes(["x" * 9, "abcdefgh", long, "q"]), hashes(["abcdefgh", long + "z", "x" * 9, long])
    assert a[0] == b[2] and a[1] == b[0] and a[2] == b[3] and a[2] != b[1]


def test_windows_of_any_length():
    r = np.random.default_rng(1)
    word = r.integers(0, 3, 200).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 35):
        h, text = gram_hashes(word, k), [tuple(word[i : i + k]) for i in range(200 - k + 1)]
        seen = {}
        assert all(seen.setdefault(t, x) == x for t, x in zip(text, h.tolist(), strict=True))
        assert len(set(seen.values())) == len(seen)
    assert len(gram_hashes(word[:3], 5)) == 0


def test_words_of_empty_chunk():
    w = words(np.empty(0, np.uint8), np.zeros(3, np.int64))
    assert len(w.start) == 0 and len(w.first) == 3
