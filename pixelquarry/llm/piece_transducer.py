"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

Compiled from a model file trained by pair merging, over bytes:

* the normaliser puts a space before a text that is not empty and reads U+2581 as a space (models that change texts in
  other ways, and models of other kinds, are errors);
* the pieces are a trie whose final states write a piece at cost 1;
* byte fallback writes each byte of a character that is no piece, at cost 1;
* an automaton over pairs of neighbouring pieces gives a pair that the model's merges would not leave side by side an
  infinite cost.

A text composed with these is a lattice of arcs between its bytes; the shortest path in the tropical semiring (least sum
of costs) is its encoding.  A sequence of pieces is what merging gives just if each pair of neighbours is, so the path of
finite cost is the library's segmentation: every place is reached by one arc, that of the text before it.  Two pieces
may stand side by side if, taking the merges that made them back from the last to the first, no merge across their
border would have come earlier.  Runs of spaces, whose merges all rank last and alike, are merged from the left.

No piece goes on after a space that follows something else, so the lattice falls apart there, and equal parts are solved
once: all arcs of all new parts of a chunk at once, then the paths position by position.

Nulls: a null or empty text has no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CHUNK, PieceCache
from .textkit import chunks, ranges

SPACE = "▁"
LONG = 2048
_NEVER = np.iinfo(np.int64).max
_UNKNOWN, _NONE, _BEGIN = -1, -2, -3  # what reaches a place that no piece reaches


class Transducer(PieceCache):
    """Trie of pieces with costs, byte fallback, and the parts solved so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        _checked(model, path)
        size = model.vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.forget()
        pieces, scores, ids = [], [], []
        self.byte_ids = np.full(256, model.unk_id(), np.int64)
        self.text: list[bytes] = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace(SPACE, " ").encode()
                pieces.append(piece.replace(SPACE, " "))
                ids.append(i)
                scores.append(model.get_score(i))
        runs = {len(x): i for x, i in zip(pieces, ids, strict=True) if not x.strip(" ")}
        self.space, self.runs = runs.get(1, -1), {n: i for n, i in runs.items() if n > 1}
        keep = [k for k, x in enumerate(pieces) if len(x) == 1 or x.strip(" ")]
        self._merges([pieces[k] for k in keep], np.array([scores[k] for k in keep]))
        self._compile([pieces[k].encode() if self.order[j] != _NEVER else None for j, k in enumerate(keep)], np.array([ids[k] for k in keep]))
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.text_length = np.array([len(x) for x in self.text], np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length

    def _merges(self, pieces: list[str], scores: np.ndarray) -> None:
        """The order in which merges come (-1 for characters, never for pieces that no merge makes), and the two pieces
        that each is made of: by length, the one pair that may stand side by side before that merge."""
        n, at = len(pieces), {x: k for k, x in enumerate(pieces)}
        rank = np.empty(n, np.int64)
        rank[np.argsort(-scores, kind="stable")] = np.arange(n)
        self.order = np.where([len(x) == 1 for x in pieces], -1, _NEVER)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.pairs, self.pair_order, self.known_pairs = np.empty(0, np.int64), np.empty(0, np.int64), {}
        splits: dict[int, list[tuple[int, int, int]]] = {}
        for k, x in enumerate(pieces):
            for cut in range(1, len(x)):
                a, b = at.get(x[:cut]), at.get(x[cut:])
                if a is not None and b is not None:
                    splits.setdefault(len(x), []).append((k, a, b))
        for length in sorted(splits):
            whole, a, b = np.array(splits[length]).T
            able = (self.order[a] != _NEVER) & (self.order[b] != _NEVER)
            whole, a, b = whole[able], a[able], b[able]
            fine = self.side_by_side(a, b)
            whole, first = np.unique(whole[fine], return_index=True)
            self.left[whole], self.right[whole], self.order[whole] = a[fine][first], b[fine][first], rank[whole]
            keys, order = np.append(self.pairs, self.left[whole] * n + self.right[whole]), np.append(self.pair_order, rank[whole])
            by = np.argsort(keys)
            self.pairs, self.pair_order = keys[by], order[by]

    def side_by_side(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece v behind piece u."""
        u, v = u.copy(), v.copy()
        ok, limit, live = np.ones(len(u), bool), np.full(len(u), _NEVER), np.arange(len(u))
        while len(live):
            a, b = u[live], v[live]
            key = a * len(self.order) + b
            spot = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
            merge = np.where(self.pairs[spot] == key, self.pair_order[spot], _NEVER) if len(self.pairs) else np.full(len(a), _NEVER)
            early = merge < limit[live]
            ok[live[early]] = False
            oa, ob = self.order[a], self.order[b]
            more = ~early & ((oa >= 0) | (ob >= 0))
            live, a, b, oa, ob = live[more], a[more], b[more], oa[more], ob[more]
            last = oa > ob  # of two equal pieces the left one was merged first
            u[live[last]], limit[live[last]] = self.right[a[last]], oa[last]
            v[live[~last]], limit[live[~last]] = self.left[b[~last]], ob[~last] + 1
        return ok

    def run_of_spaces(self, n: int) -> list[int]:
        """Ids of n spaces that nothing else has taken: the leftmost merge that makes a piece, again and again."""
        size, after, alive = [1] * n, list(range(1, n + 1)), [True] * n
        before = list(range(-1, n - 1))
        heap = [(i, 1, 1) for i in range(n - 1)] if 2 in self.runs else []
        while heap:
            i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or size[i] != a or j >= n or size[j] != b:
                continue
            size[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if size[i] + size[after[i]] in self.runs:
                    heapq.heappush(heap, (i, size[i], size[after[i]]))
            if (h := before[i]) >= 0 and size[h] + size[i] in self.runs:
                heapq.heappush(heap, (h, size[h], size[i]))
        return [self.runs.get(size[i], self.space) for i in range(n) if alive[i]]

    def _compile(self, pieces: list[bytes | None], ids: np.ndarray) -> None:
        """States numbered as met; transitions in an open-addressed table of state * 256 + byte."""
        moves: dict[int, int] = {}
        final: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            state = 0
            if piece is None:
                continue
            for byte in piece:
                state = moves.setdefault(state * 256 + byte, len(moves) + 1)
            final[state] = k
        self.final = np.full(len(moves) + 1, -1, np.int64)
        self.final[list(final)] = list(final.values())
        self.piece_ids = ids
        keys, to = np.array(list(moves), np.int64), np.array(list(moves.values()), np.int64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys)))))
        self.table_keys, self.table_to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at = self._slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            _, first = np.unique(at, return_index=True)
            first = first[self.table_keys[at[first]] < 0]
            self.table_keys[at[first]], self.table_to[at[first]] = keys[first], to[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, at = keys[rest], to[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def move(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, 0 for none."""
        keys = state * 256 + byte
        at, out = self._slot(keys), np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for _ in range(self.probes):
            have = self.table_keys[at[live]]
            hit = have == keys[live]
            out[live[hit]] = self.table_to[at[live[hit]]]
            live = live[~hit & (have >= 0)]
            if not len(live):
                break
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
        return out

    def arcs(self, raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in ``raw``; ``stop`` is where the part of each byte ends."""
        at = np.arange(len(raw))
        state = np.zeros(len(raw), np.int64)
        out, step = [], 0
        while len(at):
            state = self.move(state, raw[at + step].astype(np.int64))
            keep = state > 0
            at, state = at[keep], state[keep]
            step += 1
            ends = self.final[state] >= 0
            out.append((at[ends], at[ends] + step, self.final[state[ends]]))
            keep = at + step < stop[at]
            at, state = at[keep], state[keep]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def shortest(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part) of the shortest paths of parts of ``raw`` between offsets ``off``."""
        size = np.diff(off)
        part = np.repeat(np.arange(len(size)), size)
        start, end, piece = self.arcs(raw, off[1:][part])
        # characters that are no piece: a byte after the other
        letter = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0)) if len(raw) else part
        known = np.zeros(len(raw), bool)
        known[start[self.order[piece] < 0]] = True
        lone = np.flatnonzero(~known[letter])
        start, end, piece = np.concatenate([start, lone]), np.concatenate([end, lone + 1]), np.concatenate([piece, np.full(len(lone), _UNKNOWN)])
        ids = np.where(piece >= 0, self.piece_ids[piece], self.byte_ids[raw[start]])
        # nodes: one for each byte of a part and one for its end
        into, from_, when = end + part[start], start + part[start], start - off[part[start]]
        reached = np.full(len(raw) + len(size), _NONE)
        first = off[:-1] + np.arange(len(size))
        reached[first] = _BEGIN
        back, wrote = np.zeros(len(reached), np.int64), np.zeros(len(reached), np.int64)
        long = size[part[start]] > LONG
        order = np.argsort(np.where(long, _NEVER, when), kind="stable")
        cut = np.searchsorted(when[order][: len(order) - int(long.sum())], np.arange(min(LONG, int(size.max()) if len(size) else 0) + 1))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):  # arcs by how far from the part's begin they start
            mine = order[lo:hi]
            u, v = reached[from_[mine]], piece[mine]
            ok = (u == _BEGIN) | (u == _UNKNOWN) | ((v == _UNKNOWN) & (u != _NONE))
            ask = np.flatnonzero((u >= 0) & (v >= 0))
            ok[ask] = self.side_by_side(u[ask], v[ask])
            mine = mine[ok]
            at = into[mine]
            reached[at], back[at], wrote[at] = piece[mine], from_[mine], ids[mine]
        if long.any():
            self._walk(*(x[order[cut[-1] :]] for x in (from_, into, piece, ids)), reached, back, wrote)
        count = np.zeros(len(size), np.int64)
        steps = []
        node, live = off[1:] + np.arange(len(size)), np.arange(len(size))
        live = live[size > 0]
        while len(live):
            steps.append((live, wrote[node[live]]))
            count[live] += 1
            node[live] = back[node[live]]
            live = live[node[live] > first[live]]
        out = np.empty(int(count.sum()), self.dtype)
        place = np.cumsum(count) - 1
        for mine, written in steps:
            out[place[mine]] = written
            place[mine] -= 1
        return self._with_runs(out, count)

    def _walk(self, from_: np.ndarray, into: np.ndarray, piece: np.ndarray, ids: np.ndarray, reached: np.ndarray, back: np.ndarray, wrote: np.ndarray) -> None:
        """The same for few long parts, arc by arc."""
        for k in np.argsort(from_, kind="stable").tolist():
            u, v = int(reached[from_[k]]), int(piece[k])
            if u == _NONE:
                continue
            if u >= 0 and v >= 0:
                ok = self.known_pairs.get((u, v))
                if ok is None:
                    if len(self.known_pairs) >= 1 << 20:
                        self.known_pairs.clear()
                    ok = self.known_pairs[u, v] = bool(self.side_by_side(np.array([u]), np.array([v]))[0])
                if not ok:
                    continue
            at = into[k]
            reached[at], back[at], wrote[at] = v, from_[k], ids[k]

    def _with_runs(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts with the spaces at their beginning merged."""
        if self.space < 0 or not self.runs:
            return ids, count
        ends = np.cumsum(count)
        some = np.flatnonzero((count > 1) & (ids[np.minimum(ends - count, max(0, len(ids) - 1))] == self.space)) if len(ids) else []
        parts, at, count = [], 0, count.copy()
        for k in some:
            lo, hi = int(ends[k] - count[k]), int(ends[k])
            n = int((np.append(ids[lo:hi], self.dtype(self.space + 1)) != self.space).argmax())
            if n > 1:
                new = np.array(self.run_of_spaces(n), self.dtype)
                parts += [ids[at:lo], new]
                at = lo + n
                count[k] += len(new) - n
        return (np.concatenate([*parts, ids[at:]]), count) if parts else (ids, count)

    def split(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts begin at a space behind something else, or where a text does."""
        space = raw == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[off[:-1][np.diff(off) > 0]] = True
        return np.flatnonzero(begins), np.zeros(len(off) - 1, bool)

    def solve(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.shortest(raw[ranges(begin, end - begin)], np.concatenate([[0], np.cumsum(end - begin)]))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a chunk."""
        return self.chunk(*normalised(raw, off))

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts from their ids, without the normaliser's space."""
        size = self.text_length[ids]
        raw = self.text_bytes[ranges(self.text_start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        keep = np.ones(len(raw), bool)
        first = ends[:-1][np.diff(ends) > 0]
        keep[first] = raw[first] != 0x20
        return raw[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def normalised(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normaliser's output: a space before each text that is not empty, U+2581 as a space."""
    size = np.diff(off)
    if len(raw) > 2:
        mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))
        if len(mark):
            raw = raw.copy()
            raw[mark] = 0x20
            keep = np.ones(len(raw), bool)
            keep[mark + 1] = keep[mark + 2] = False
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            raw, size = raw[keep], np.diff(off)
    some = (size > 0).astype(np.int64)
    new = np.concatenate([[0], np.cumsum(size + some)])
    out = np.full(int(new[-1]), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.cumsum(some), size)] = raw
    return out, new


def _checked(model, path: str) -> None:
    """An error for a model whose normaliser or kind is none that this module compiles."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    n, t = spec.normalizer_spec, spec.trainer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
        raise ValueError("the model's normaliser changes texts in ways that are not compiled")
    if t.model_type != t.BPE or t.treat_whitespace_as_suffix:
        raise ValueError("not a model of merged pairs with spaces before words")


@cache
def transducer(path: str) -> Transducer:
    """One per worker and model."""
    return Transducer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (text and any columns) with ``pieces``, the ids; a column of that name is replaced."""
    docs = docs.drop("pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, raw, off in chunks(batch.column("text"), CHUNK):
                ids, count = transducer(path).encode(raw, off)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(row, n).columns, column], names=[*batch.schema.names, "pieces"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (pieces and any columns) with ``decoded``, the text; bytes that are no UTF-8 become U+FFFD."""
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces").fill_null([]) if batch.column("pieces").null_count else batch.column("pieces")
            ids, count = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            raw, off = transducer(path).decode(ids.astype(np.int64), count)
            data = raw.tobytes()
            texts = [data[a:b].decode(errors="replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (pieces that are single bytes), pieces_crc32 (little-endian unsigned 32-bit ids) and
    restored: whether decoding gives the text back, U+2581 read as a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, raw, off in chunks(batch.column("text"), CHUNK):
                fst = transducer(path)
                clean, new = normalised(raw, off)
                ids, count = fst.chunk(clean, new)
                back, at = fst.decode(ids.astype(np.int64), count)
                data, have, want = ids.astype("<u4").tobytes(), back.tobytes(), clean.tobytes()
                ends = np.cumsum(count)
                crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
                same = [have[a:b] == want[c + 1 : d] for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), new[:-1].tolist(), new[1:].tolist(), strict=True)]
                fallback = np.concatenate([[0], np.cumsum(np.isin(ids, fst.byte_ids))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), pa.array(count), pa.array(fallback[ends] - fallback[ends - count]), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "n_bytes", "pieces_crc32", "restored"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, pieces_crc32 long, restored boolean")
