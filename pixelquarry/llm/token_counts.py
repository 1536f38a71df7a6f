"""Token counts of whole texts; huge texts are encoded as overlapping chunks and spliced.

A text up to ``chunk`` bytes is encoded where it is read.  A longer one is cut every ``chunk`` bytes; each chunk goes on for
``overlap`` bytes into the next, and the chunks are dealt out to all tasks.  A chunk gives its number of tokens and where,
in normalised bytes, the tokens of its two overlaps begin and end.  Two neighbours are spliced behind a token that both
have at the same place: the first chunk counts up to it, the second from there.

Why that is exact: merging takes the best pair first, the leftmost of equals, so within any stretch that no merge crosses
it takes the same merges as on that stretch alone.  Hence two tokens that come out side by side anywhere come out
side by side of their own text, and a row of tokens whose neighbours all do is what the whole text gives: the first
merge across one of its borders would have been taken in that pair too.  Behind a common token every pair of neighbours
is from one of the two chunks.  One common border without a common token would not prove that.

Where an overlap has no common token (a run of one character, cut at different phases), chunk and overlap of that text
grow fourfold and it is encoded again, until all its seams are proven or it is one chunk; only such texts are.

Texts are told apart by their SHA-256, so copies have one count.  Nulls: a null text counts as empty: no bytes, no tokens.
Strings of special tokens inside texts are plain text, as the library has them.  Models that are not made of merged
pairs with byte fallback, change texts before, or have pieces of the user's, are errors: their seams are not proven.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parts, stored

CHUNK = 1 << 15
OVERLAP = 1 << 9
GROW = 4
LIMIT = 4096
BATCH_BYTES = 1 << 20
_MARK = "▁".encode()
_CHUNKS = pa.schema([("key", pa.string()), ("part", pa.int64()), ("back", pa.int32()), ("ahead", pa.int32()), ("body", pa.binary())])
_COUNTS = pa.schema([("key", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])
_SEAMS = pa.schema([("key", pa.string()), ("seam", pa.int64()), ("extra", pa.int64())])


@cache
def processor(path: str):
    """The model, and each id's length in normalised bytes; once per worker."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = SentencePieceProcessor(model_file=path)
    spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    n, t = spec.normalizer_spec, spec.trainer_spec
    plain = not (n.precompiled_charsmap or n.remove_extra_whitespaces) and n.add_dummy_prefix and n.escape_whitespaces
    if not plain or t.model_type != t.BPE or t.treat_whitespace_as_suffix or not t.byte_fallback or any(p.type == p.USER_DEFINED for p in spec.pieces):
        raise ValueError("chunks of this model are not proven to splice: it needs merged pairs, byte fallback and plain texts")
    return model, np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64)


def cuts(text: bytes, chunk: int) -> list[int]:
    """Where the chunks of a text begin: every ``chunk`` bytes or up to three later, never inside a character."""
    out = [0]
    for at in range(chunk, len(text), chunk):
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        if at < len(text):
            out.append(at)
    return out


def _to_character(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


def chunked(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, part, back, ahead, body): the chunks of ``texts`` (key, text); the first ``back`` bytes of a body are the last
    ``ahead`` of the one before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                text = text.as_py()
                begin = cuts(text, chunk)
                # where each chunk's overlap into the next one ends
                until = [_to_character(text, min(len(text), at + overlap)) for at in begin[1:]]
                for part, at in enumerate(begin):
                    last = part + 1 == len(begin)
                    end = len(text) if last else until[part]
                    back, ahead = (until[part - 1] - at if part else 0), (0 if last else end - begin[part + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([key], [part], [back], [ahead], [text[at:end]]), _CHUNKS, strict=True)], schema=_CHUNKS)

    return texts.mapInArrow(cut, "key string, part long, back int, ahead int, body binary")


def _normal_length(data: bytes) -> int:
    return len(data) + (len(_MARK) - 1) * data.count(b" ")


def borders(model, length: np.ndarray, body: bytes, back: int, ahead: int) -> tuple[int, bytes, bytes]:
    """Tokens of a chunk, and the borders of tokens in its two overlaps as int64: how many tokens end up to the first
    border, then the borders, in normalised bytes from the overlap's beginning."""
    ids = np.array(model.encode(body), np.int64)
    ends = np.concatenate([[0], np.cumsum(length[ids])])
    if ends[-1] != len(_MARK) + _normal_length(body):
        raise ValueError("the pieces of a chunk do not add up to its text")
    out = []
    for start, size in ((len(_MARK), _normal_length(body[:back])), (int(ends[-1]) - _normal_length(body[len(body) - ahead :]), _normal_length(body[len(body) - ahead :]))):
        lo, hi = np.searchsorted(ends, start), np.searchsorted(ends, start + size, "right")
        out.append(np.concatenate([[lo], ends[lo:hi] - start]).astype(np.int64).tobytes() if size else b"")
    return len(ids), out[0], out[1]


def splice(tail: bytes, head: bytes, n: int) -> int | None:
    """Tokens counted by both neighbours or by none of the whole text: those of the first chunk (``n`` tokens) behind the
    first common token, and those of the second up to it.  None: there is no common token."""
    a, b = np.frombuffer(tail, np.int64), np.frombuffer(head, np.int64)
    pairs = [(x[1:-1] << 32) + x[2:] for x in (a, b)]
    _, i, j = np.intersect1d(*pairs, assume_unique=True, return_indices=True)
    return int(n - (a[0] + i[0] + 1) + b[0] + j[0] + 1) if len(i) else None


def spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of ``texts`` (key, text); null where a seam is not proven."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, length = processor(path)
        for batch in batches:
            rows = [borders(model, length, body.as_py(), back, ahead) for back, ahead, body in zip(batch.column("back").to_pylist(), batch.column("ahead").to_pylist(), batch.column("body"), strict=True)]
            columns = [batch.column("key"), batch.column("part"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = [splice(t, h, n) for t, h, n in zip(*(batch.column(c).to_pylist() for c in ("tail", "head", "n")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seam"), pa.array(extra, pa.int64())], schema=_SEAMS)

    spread = chunked(texts, chunk, overlap).repartition(parts(texts.sparkSession))
    # copies of a text give the same rows
    counts = stored(spread.mapInArrow(count, "key string, part long, n long, head binary, tail binary").distinct(), "chunks")
    tails = counts.where(F.length("tail") > 0).select("key", F.col("part").alias("seam"), "n", "tail")
    heads = counts.where(F.length("head") > 0).select("key", (F.col("part") - 1).alias("seam"), "head")
    seams = tails.join(heads, ["key", "seam"]).mapInArrow(join, "key string, seam long, extra long")
    whole = counts.select("key", "n", F.lit(True).alias("proven")).unionByName(seams.select("key", (-F.coalesce("extra", F.lit(0))).alias("n"), F.col("extra").isNotNull().alias("proven")))
    return whole.groupBy("key").agg(F.sum("n").alias("n"), F.min("proven").alias("proven")).select("key", F.when(F.col("proven"), F.col("n")).alias("n_tokens"))


def of_huge(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of all ``texts`` (key, text), widening chunks and overlaps of those that do not splice."""
    done, todo = None, texts
    while True:
        now = stored(spliced(todo, path, chunk, overlap), "spliced")
        proven = now.where("n_tokens IS NOT NULL")
        done = proven if done is None else done.unionByName(proven)
        failed = now.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            return done
        todo, chunk, overlap = texts.join(failed, "key", "left_semi"), chunk * GROW, overlap * GROW


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` (text and any columns) with ``n_bytes`` (of UTF-8) and ``n_tokens``; columns of these names are replaced."""
    if not 0 < 4 * overlap <= chunk:
        raise ValueError("a chunk is four overlaps at least")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = processor(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            n, at = np.zeros(len(texts), np.int64), [i for i, x in enumerate(texts) if x]
            held: list[int] = []
            held_bytes = 0
            for i in at:
                held.append(i)
                held_bytes += len(texts[i])
                if held_bytes >= BATCH_BYTES or i == at[-1]:
                    n[held] = [len(x) for x in model.encode([texts[j] for j in held], num_threads=1)]
                    held, held_bytes = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, "n_tokens"])

    small = kept.where(size <= chunk).mapInArrow(count, schema)
    huge = kept.where(size > chunk)
    key = F.sha2(F.col("text").cast("binary"), 256)
    found = of_huge(huge.select(key.alias("key"), "text"), path, chunk, overlap)
    rows = huge.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"), key.alias("key")).join(found, "key").select("row.*", "n_tokens")
    rows = small.unionByName(rows)
    return rows.select(*(F.col(f"`{c}`") for c in kept.columns), size.alias("n_bytes"), "n_tokens")


def digest(counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a document has more tokens than ``limit``."""
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
