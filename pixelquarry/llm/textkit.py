"""Vectorised words, word n-grams and their 64-bit hashes over Arrow batches of texts.

A chunk is a run of whole texts whose UTF-8 bytes lie end to end in one array; everything is computed for all of a
chunk's bytes or words at once.  White space is ASCII (space and tab to carriage return), so bytes suffice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LONG_SPAN = 128


class Words(NamedTuple):
    """Words of a chunk: byte ranges, the text each is in, and where each text's words begin (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (splitmix64's finaliser); ``salt`` picks another one."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of whole texts; a null text has no bytes.  A run has at most
    ``limit`` bytes, or one text."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for array in arrays:
        if len(array):
            array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
            if array.null_count:
                array = array.fill_null(b"")
            _, offsets, data = array.buffers()
            off = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
            raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
            at = 0
            while at < len(array):
                to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
                yield base + at, to - at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
                at = to
            base += len(array)


def words(raw: np.ndarray, off: np.ndarray) -> Words:
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, np.zeros(len(off), np.int64))
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = off[(off > 0) & (off < n)]
    begins[cut] = solid[cut]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[cut - 1] = solid[cut - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one little-endian integer, zeros beyond the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, 0, (1,))


def first_bytes(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first ``count`` (at most 8) bytes of little-endian integers; the others become zero."""
    return x & _MASKS[count]


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; each ``salt`` gives another, independent one.

    Eight bytes at a time are mixed into what came before, so no sum of powers cancels; ranges beyond ``LONG_SPAN``
    bytes go through BLAKE2.  Equal hashes mean equal bytes up to collisions of 64 bits."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = np.asarray(end) - np.asarray(start)
    word = eights(raw)
    out = mix(size.astype(np.uint64), 70 + salt)
    live, at = None, np.asarray(start)
    left = np.where(size > LONG_SPAN, 0, size)
    while True:
        x = first_bytes(word[at], np.minimum(left, 8))
        if live is None:
            out = mix(out ^ x, 71 + salt)
        else:
            out[live] = mix(out[live] ^ x, 71 + salt)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN):
        digest = hashlib.blake2b(raw[int(start[i]) : int(end[i])], digest_size=8, person=b"%d" % salt).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of pairs of hashes; the order matters."""
    return mix(mix(a, salt) ^ b, salt)


def gram_hashes(word: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of each k consecutive words (len - k + 1 of them), across texts too: mask with ``inside``.

    Runs are doubled and joined, so a hash is a tree of mixes over its words."""
    n = len(word) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out, done, run, length = None, 0, word, 1
    while True:
        if k & length:
            piece = run[done : done + n]
            out = piece if out is None else _join(out, piece, 2 * salt + 80)
            done += length
        if 2 * length > k:
            return mix(out, salt)
        run = _join(run[:-length], run[length:], 2 * salt + 81)
        length *= 2


def inside(w: Words, k: int) -> np.ndarray:
    """Which of the chunk's k-word windows lie in one text."""
    n = len(w.start)
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    for back in range(1, k):
        at = w.first[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def slide(x: np.ndarray, k: int, op: np.ufunc) -> np.ndarray:
    """op over each k consecutive values."""
    have, out = 1, x
    while have * 2 <= k:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (k - have)], out[k - have :]) if have < k else out


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the next."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - before, count)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted non-negative integers as bytes of differences; 255 means 255 more."""
    if not len(x):
        return b""
    step = np.diff(x.astype(np.int64), prepend=0)
    long = step // 255
    out = np.full(int(long.sum()) + len(x), 255, dtype=np.uint8)
    out[np.cumsum(long + 1) - 1] = step - long * 255
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(x, dtype=np.int64)[x < 255]


def binary_column(blobs: list[bytes | None]) -> pa.Array:
    return pa.array(blobs, type=pa.binary())


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()], schema=schema)
