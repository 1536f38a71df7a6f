import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from pixelquarry.llm import piece_transducer as pt
from pixelquarry.llm.packing import tokenizer_path
from pixelquarry.llm.textkit import chunks

PATH = tokenizer_path("piece_bpe_32k.model")
LIB = SentencePieceProcessor(model_file=PATH)


def encoded(texts, limit=1 << 20):
    out = []
    for _, _, raw, off in chunks(pa.array(texts, pa.string()), limit):
        ids, count = pt.transducer(PATH).encode(raw, off)
        ends = np.cumsum(count)
        out += [ids[e - c : e].tolist() for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
    return out


def merged(text):
    """By plain merging: of all neighbours that make a piece the best, the leftmost of equals, until none do."""
    parts = list(("▁" + text.replace(" ", "▁")) if text else "")
    while True:
        pairs = [(-LIB.get_score(LIB.piece_to_id(a + b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if LIB.piece_to_id(a + b) != LIB.unk_id()]
        if not pairs:
            break
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    ids = []
    for x in parts:
        k = LIB.piece_to_id(x)
        ids += [k] if k != LIB.unk_id() else [LIB.piece_to_id(f"<0x{b:02X}>") for b in x.encode()]
    return ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abteh Zéin9\n\t.▁漢𝄞①  ")), max_size=40), max_size=5))
def test_the_librarys_ids_and_restored(texts):
    fst = pt.transducer(PATH)
    for text, ids in zip(texts, encoded(texts, 50), strict=True):
        assert ids == merged(text) == LIB.encode(text)
        raw, off = fst.decode(np.array(ids, np.int64), np.array([len(ids)]))
        assert raw.tobytes().decode() == text.replace("▁", " ")


def test_the_librarys_ids_of_a_table_and_of_odd_texts(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"] is not None]
    texts += ["①", "a\tb", "", "  two  spaces ", " " * 40, " " * 3000 + "q", "a" * 5000, "ab" * 1500 + " x", "日本語の文章 ｱ 漢字かな交じり文" * 90, "the" * 1000 + "①" * 5]
    assert encoded(texts) == LIB.encode(texts)


@pytest.mark.parametrize("change", ["precompiled_charsmap", "remove_extra_whitespaces", "add_dummy_prefix", "model_type"])
def test_other_models_are_errors(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(PATH, "rb").read())
    if change == "model_type":
        spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
    else:
        setattr(spec.normalizer_spec, change, {"precompiled_charsmap": b"x", "remove_extra_whitespaces": True, "add_dummy_prefix": False}[change])
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pt._checked(None, str(tmp_path / "m.model"))


def test_frames(spark):
    rows = [(1, "hello  world"), (2, None), (3, ""), (4, "x" * 500 + " ①"), (None, "▁a"), (1, "hello  world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_pieces", "'p' AS decoded")
    got = pt.decode(pt.encode(docs, PATH), PATH).collect()
    assert [x["decoded"] for x in got] == ["hello  world", "", "", "x" * 500 + " ①", " a", "hello  world"]
    trips = pt.round_trip(docs, PATH).collect()
    assert all(x["restored"] for x in trips) and [x["n_bytes"] for x in trips] == [0, 0, 0, 3, 0, 0]
    ids = encoded(["hello  world"])[0]
    assert trips[0]["pieces_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert pt.round_trip(docs.limit(0), PATH).count() == 0
