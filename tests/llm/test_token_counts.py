import random

import pytest
import sentencepiece

from pixelquarry.llm import token_counts as t
from pixelquarry.llm.packing import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    pick = random.Random(5)
    vocabulary = "the of a\t日本 é zzz ▁ \U0001f600 Theory  a   \n\n ===== aaaa x1 \x00 𝒳 Ünï <s> </s>".split(" ")
    out = [None, "", " ", "▁", "a" * 3000, " " * 4000, "x" + " " * 2500 + "y " * 900, "日" * 1500, "=-" * 1500, "\U0001f600" * 900]
    out += [" ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, 1500))) for _ in range(25)]
    out += ["".join(pick.choice("ab a  é") for _ in range(pick.randint(1, 4000))) for _ in range(25)]
    return out + [out[12]] * 6


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (300, 16), (1024, 256)])
def test_counts_are_the_librarys(spark, model, chunk, overlap):
    data = spark.createDataFrame([(i, x, "k", -1, None) for i, x in enumerate(texts())], "doc_id long, text string, key string, n_tokens int, `part` string").repartition(3)
    got = t.token_counts(data, PATH, chunk, overlap)
    assert got.columns == ["doc_id", "text", "key", "part", "n_bytes", "n_tokens"]
    found = got.collect()
    assert len(found) == data.count()
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in found if (r.n_bytes, r.n_tokens) != (len((r.text or "").encode()), len(model.encode(r.text or "")))] == []


def test_a_seam_without_a_common_token_is_widened(spark, model):
    run = "b" + " " * 700 + "c"
    data = spark.createDataFrame([(run,)], "text string").selectExpr("sha2(text, 256) AS key", "text")
    assert t.spliced(data, PATH, 64, 8).first().n_tokens is None
    assert t.of_huge(data, PATH, 64, 8).first().n_tokens == len(model.encode(run))


def test_splice_needs_a_common_token(model):
    length = t.processor(PATH)[1]
    n, _, tail = t.borders(model, length, b"one two three four", 0, 10)
    m, head, _ = t.borders(model, length, b"three four five six", 10, 0)
    assert n + m - t.splice(tail, head, n) == len(model.encode("one two three four five six"))
    import numpy as np

    assert t.splice(np.array([0, 0, 4, 8]).tobytes(), np.array([0, 0, 2, 4, 6]).tobytes(), 3) is None


def test_limit_and_empty_table(spark):
    data = spark.createDataFrame([(1, "a " * 4096), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in t.digest(t.token_counts(data, PATH)).collect()}
    assert got == {1: (4097, True), 2: (1, False)}
    assert t.token_counts(data.limit(0), PATH).collect() == []


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        t.token_counts(spark.range(1).selectExpr("'' AS text"), PATH, 64, 32)
