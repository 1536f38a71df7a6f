"""Byte-level BPE ids of whole Arrow columns: pieces of text between split points are encoded once per worker.

The tokenizer's split pattern is applied to all bytes of a chunk at once for texts up to U+024F without odd white
space, control characters or an apostrophe before a letter; other texts go to the tokenizer as they are.  Each distinct
piece is encoded by the tokenizer and its ids are kept, so the ids are the tokenizer's own.

Kept pieces are found by their bytes, never by a hash alone: those up to ``SHORT`` bytes are two integers and a length,
longer ones a key of a dict.  Entries are only ever appended; when ``CACHE`` of them are there they become the older
generation, from which a piece met again moves on, and the one before it goes.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import chain

import numpy as np

from .textkit import eights, first_bytes, mix, ranges

CHUNK = 1 << 20
CACHE = 1 << 20
SHORT = 16
KEPT_BYTES = 512
_LETTER, _NUMBER, _OTHER, _WHITE = range(4)


def _kind(code: int) -> int:
    group = unicodedata.category(chr(code))[0]
    return _WHITE if code in (0x20, *range(0x09, 0x0E)) else _LETTER if group == "L" else _NUMBER if group == "N" else _OTHER


_KINDS = np.array([_kind(c) for c in range(0x250)], np.uint8)
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), *range(0xCA, 256)]] = True


def split_points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where pieces begin, and which texts must go to the tokenizer whole."""
    n = len(raw)
    code = raw.astype(np.uint16)
    lead = np.flatnonzero(raw >= 0xC0)
    code[lead] = ((code[lead] & 0x1F) << 6) | (raw[np.minimum(lead + 1, n - 1)] & 0x3F)
    odd = _ODD[raw]
    odd[lead] |= (code[lead] == 0x85) | (code[lead] == 0xA0) | (code[lead] >= 0x250)
    quote = np.flatnonzero(raw[:-1] == 0x27)
    odd[quote] |= _KINDS[np.minimum(code[quote + 1], 0x24F)] == _LETTER
    kind = _KINDS[np.minimum(code, 0x24F)]
    tail = np.flatnonzero((raw & 0xC0) == 0x80)
    kind[tail] = kind[np.maximum(tail - 1, 0)]
    total = np.concatenate([[0], np.cumsum(odd)])
    whole = total[off[1:]] > total[off[:-1]]
    first = np.zeros(n + 1, bool)
    first[off] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    white, space = kind == _WHITE, raw == 0x20
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1] & ~first[1:n]
    begins = new & ~(after_space & ~white)
    last_white = white.copy()  # white space with something else behind it in the same text stands apart
    last_white[:-1] &= ~white[1:] & ~first[1:n]
    last_white[-1] = False
    return np.flatnonzero(begins | last_white), whole


class Generation:
    """Pieces with their ids: an open-addressed table over appended entries, and a dict for long pieces."""

    def __init__(self, most: int, dtype: type):
        self.bits = max(10, int(2 * most - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.n = self.used = 0
        self.key = np.empty((1024, 2), np.uint64)
        self.size = np.empty(1024, np.int32)
        self.start, self.length = np.empty(1024, np.int64), np.empty(1024, np.int32)
        self.ids = np.empty(4096, dtype)

    def _room(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if len(have) < need:
            new = np.empty((max(need, 2 * len(have)), *have.shape[1:]), have.dtype)
            new[: len(have)] = have
            setattr(self, name, new)

    def find(self, key: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Entry of each short piece, -1 for none."""
        out = np.full(len(key), -1, np.int64)
        at, live, mask = slot & ((1 << self.bits) - 1), np.arange(len(key)), (1 << self.bits) - 1
        while len(live):
            entry = self.slots[at[live]]
            live, entry = live[entry >= 0], entry[entry >= 0]
            same = (self.key[entry] == key[live]).all(axis=1) & (self.size[entry] == size[live])
            out[live[same]] = entry[same]
            live = live[~same]
            at[live] = (at[live] + 1) & mask
        return out

    def append(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """New entries; their numbers."""
        n = len(length)
        for name in ("start", "length", "size", "key"):
            self._room(name, self.n + n)
        self._room("ids", self.used + len(ids))
        self.start[self.n : self.n + n] = self.used + np.cumsum(length) - length
        self.length[self.n : self.n + n] = length
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[self.n : self.n + n] = -1
        self.n, self.used = self.n + n, self.used + len(ids)
        return np.arange(self.n - n, self.n)

    def place(self, entry: np.ndarray, key: np.ndarray, size: np.ndarray, slot: np.ndarray) -> None:
        """Make entries findable by their distinct keys."""
        self.key[entry], self.size[entry] = key, size
        mask = (1 << self.bits) - 1
        at = slot & mask
        while len(entry):
            _, first = np.unique(at, return_index=True)
            first = first[self.slots[at[first]] < 0]
            self.slots[at[first]] = entry[first]
            rest = np.ones(len(entry), bool)
            rest[first] = False
            entry, at = entry[rest], (at[rest] + 1) & mask


class PieceCache:
    """Ids of a chunk's texts from the ids of its distinct parts, kept from chunk to chunk.

    A subclass says where parts begin (``split``, with a flag for texts to be solved whole) and solves parts."""

    dtype: type

    def forget(self, most: int = CACHE) -> None:
        self.most = most
        self.new, self.old = Generation(most, self.dtype), Generation(1, self.dtype)

    def split(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def solve(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _entries(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each part in the newer generation, found, moved there from the older one or solved."""
        size = end - begin
        if self.new.n + len(size) > self.most:
            self.old, self.new = self.new, Generation(max(self.most, len(size)), self.dtype)
        word = eights(raw)
        key = np.empty((len(size), 2), np.uint64)
        key[:, 0] = first_bytes(word[begin], np.minimum(size, 8))
        more = np.flatnonzero(size > 8)
        key[:, 1] = 0
        key[more, 1] = first_bytes(word[begin[more] + 8], np.minimum(size[more] - 8, 8))
        slot = (mix(key[:, 0] ^ mix(key[:, 1], 91), 92) >> np.uint64(8)).astype(np.int64)
        out = self.new.find(key, size, slot)
        long = np.flatnonzero(size > SHORT)
        if len(long):
            data = raw.tobytes()
            texts = [data[a:b] for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
            out[long] = [self.new.long.get(t, -1) for t in texts]
        lost = np.flatnonzero((out < 0) & (size <= SHORT))
        if len(lost):
            lost = lost[np.argsort(slot[lost])]
            new = np.ones(len(lost), bool)  # a piece twice in the table, where slots clash, does no harm
            new[1:] = (key[lost[1:]] != key[lost[:-1]]).any(axis=1) | (size[lost[1:]] != size[lost[:-1]])
            pick, which = lost[new], np.cumsum(new) - 1
            entry = self._taken(self.old.find(key[pick], size[pick], slot[pick]), raw, begin[pick], end[pick])
            self.new.place(entry, key[pick], size[pick].astype(np.int32), slot[pick])
            out[lost] = entry[which]
        lost = long[out[long] < 0] if len(long) else long
        if len(lost):
            by = dict(zip(long.tolist(), texts, strict=True))
            kinds: dict[bytes, int] = {}
            which = np.array([kinds.setdefault(by[i], len(kinds)) for i in lost.tolist()])
            first = lost[np.unique(which, return_index=True)[1]]
            entry = self._taken(np.array([self.old.long.get(t, -1) for t in kinds]), raw, begin[first], end[first])
            self.new.long.update((t, int(e)) for t, e in zip(kinds, entry, strict=True) if len(t) <= KEPT_BYTES)
            out[lost] = entry[which]
        return out

    def _taken(self, known: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """New entries for distinct parts, from the older generation where ``known`` is its entry."""
        have = known >= 0
        at, length = self.old.start[known[have]], self.old.length[known[have]].astype(np.int64)
        out = np.empty(len(known), np.int64)
        out[have] = self.new.append(self.old.ids[ranges(at, length)], length)
        if not have.all():
            out[~have] = self.new.append(*self.solve(raw, begin[~have], end[~have]))
        return out

    def chunk(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        n = len(off) - 1
        if not len(raw):
            return np.empty(0, self.dtype), np.zeros(n, np.int64)
        begin, whole = self.split(raw, off)
        text = np.searchsorted(off, begin, "right") - 1
        end = np.append(begin[1:], len(raw))
        keep = ~whole[text]
        begin, end, text = begin[keep], end[keep], text[keep]
        entry = self._entries(raw, begin, end)
        length = self.new.length[entry].astype(np.int64)
        count = np.bincount(text, weights=length, minlength=n).astype(np.int64)
        ids = self.new.ids[ranges(self.new.start[entry], length)]
        if whole.any():
            parts, at = [], 0
            for i in range(n):
                if whole[i]:
                    got, _ = self.solve(raw, off[i : i + 1], off[i + 1 : i + 2])
                    count[i] = len(got)
                    parts.append(got)
                else:
                    parts.append(ids[at : at + count[i]])
                    at += int(count[i])
            ids = np.concatenate(parts)
        return ids, count


class Encoder(PieceCache):
    """Parts solved by a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def split(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, whole = split_points(raw, off)
        data = raw.tobytes()
        for token in self.added:  # the tokenizer takes these out of a text before it splits it
            at = data.find(token)
            while at >= 0:
                text = int(np.searchsorted(off, at, "right")) - 1
                whole[text] |= at + len(token) <= off[text + 1]
                at = data.find(token, at + 1)
        return begin, whole

    def solve(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        texts = [data[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, int(length.sum())), length


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer."""
    return Encoder(path)
