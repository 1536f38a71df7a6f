"""Secret scanning: three fixed patterns, and a character convolutional network over every other candidate.

Base findings, leftmost and non-overlapping per kind:

* ``assign``: a name such as ``password`` or ``api_key`` (ASCII letters in either case), ``=`` or ``:``, and a value of
  at least 12 characters;
* ``access``: ``AKIA`` and capitals or digits, 18 characters or more;
* ``hex``: a run of at least 16 lower-case hexadecimal digits.

Candidates are runs of token characters, of ``LEAST`` or more, of ``SHORT`` or more if a digit is in them, or of
``SHORT`` or more as a value behind one of the names.  Words and identifiers are among them, so there are findings and
others in any prose: those that overlap a base finding are the labelled findings.  The network reads the text around a
candidate and all of it, in pieces of ``INSIDE`` bytes; a candidate's score is that of its highest piece.  Names and signs
of assignments are taken out of what it reads: the patterns find those by themselves, and a network that saw them would
learn the patterns only.  Nor are all others known to be none: a first network that reads no surroundings tells which of
them look like findings, and those are left out of training and calibration.  A quarter,
by hash, is held back from training: on all of it the scores are calibrated and the threshold is set, the highest that
still finds ``recall`` of the findings, moved half the gap down to the next other candidate.

Every candidate of every whole text is scored; of one that a base finding covers in part, also each stretch that is left.
A candidate or stretch without a base finding becomes a finding of kind ``cnn`` from the threshold on.  Base findings
always stay.

Training takes at most ``MAX_EACH`` findings and as many others, each those of smallest hash among the distinct
candidates of all texts, with one piece of each.  Nulls: a null text counts as empty.  Without candidates of both labels
nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .textkit import chunks, lowered, mix, span_hashes

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KINDS = ("assign", "access", "hex", "cnn")

NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST, SHORT = 12, 6
LEFT, INSIDE, RIGHT = 24, 48, 24
WIDTH = LEFT + INSIDE + RIGHT
KERNEL = 5
BATCH = 64
MAX_EACH = 20_000
RECALL = 0.98
DIGIT, BINS, REACH = 16, 8000, 20.0


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_DIGITS = _table(b"0123456789")
_HEX = _table(b"0123456789abcdef")
_TOKEN = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
#: Byte classes of the network: printable ASCII apart, the rest by kind; 0 is beyond the text.
_CODE = np.full(256, 1, np.uint8)
_CODE[0x20:0x7F] = np.arange(3, 3 + 0x5F)
_CODE[0x80:] = 2
CODES = 3 + 0x5F


def _runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the runs of true values, cut at text ends, of at least that length."""
    n = len(mask)
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    cut = off[(off > 0) & (off < n)]
    begins[cut] = mask[cut]
    ends[cut - 1] = mask[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def _places(data: bytes, needles: tuple[bytes, ...]) -> list[int]:
    out = []
    for needle in needles:
        at = data.find(needle)
        while at >= 0:
            out.append(at)
            at = data.find(needle, at + 1)
    return out


Span = tuple[int, int, int, int]


def findings(raw: np.ndarray, off: np.ndarray) -> tuple[list[Span], list[tuple[int, int]], np.ndarray]:
    """(text, start, end, kind) of the base findings in bytes of the chunk, by text, start and kind, the ranges of
    assigned values too short for one, and for each byte whether the network reads it (not what names an assigned value)."""
    data, read = raw.tobytes(), np.ones(len(raw), bool)
    out, short = [], []
    for kind, needles, low in ((0, NAMES, True), (1, (b"AKIA",), False)):
        hits = _places(lowered(raw).tobytes() if low else data, needles)
        for text in sorted({int(x) for x in np.searchsorted(off, hits, "right") - 1}):
            lo, hi = int(off[text]), int(off[text + 1])
            for m in (ASSIGN if low else ACCESS).finditer(data, lo, hi):
                if (len(m[2]) >= ASSIGN_VALUE) if low else (m.end() - m.start() >= ACCESS_LENGTH):
                    out.append((text, m.start(), m.end(), kind))
                elif low:
                    short.append(m.span(2))
                if low:
                    read[m.start() : m.start(2)] = False
    start, end = _runs(_HEX[raw], off, HEX_LENGTH)
    out += zip((np.searchsorted(off, start, "right") - 1).tolist(), start.tolist(), end.tolist(), [2] * len(start), strict=True)
    return sorted(out, key=lambda s: (s[0], s[1], s[3])), short, read


def base_spans(raw: np.ndarray, off: np.ndarray) -> list[Span]:
    return findings(raw, off)[0]


def candidates(raw: np.ndarray, off: np.ndarray, base: list[Span], short: list[tuple[int, int]], rest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the candidates, and which overlap a base finding.  With ``rest``, the stretches that base findings
    leave of the latter come too, as candidates of their own."""
    token, covered = _TOKEN[raw], _covered(len(raw), base)
    start, end = _admitted(raw, *_runs(token, off, SHORT), short)
    total = np.concatenate([[0], np.cumsum(covered)])
    hit = total[end] > total[start]
    if rest and hit.any():
        part = np.zeros(len(raw) + 1, np.int64)
        part[start[hit]] += 1
        part[end[hit]] -= 1
        a, b = _admitted(raw, *_runs((np.cumsum(part[:-1]) > 0) & ~covered, off, SHORT), short)
        start, end, hit = np.concatenate([start, a]), np.concatenate([end, b]), np.concatenate([hit, np.zeros(len(a), bool)])
    return start, end, hit


def _admitted(raw: np.ndarray, start: np.ndarray, end: np.ndarray, short: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The runs that are candidates by length, a digit, or a name before them."""
    total = np.concatenate([[0], np.cumsum(_DIGITS[raw], dtype=np.int64)])
    keep = (end - start >= LEAST) | (total[end] > total[start])
    if short and len(start):
        lo, hi = np.array(short).T
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, np.searchsorted(end, lo, "right"), 1)
        np.add.at(edge, np.searchsorted(start, hi, "left"), -1)
        keep |= np.cumsum(edge[:-1]) > 0
    return start[keep], end[keep]


def _covered(n: int, base: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which bytes are in a base finding."""
    edge = np.zeros(n + 1, np.int64)
    for _, lo, hi, _ in base:
        edge[lo] += 1
        edge[hi] -= 1
    return np.cumsum(edge[:-1]) > 0


def windows(raw: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, read: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, candidate of each row): a row for each piece of INSIDE bytes of a candidate, with LEFT bytes before it and
    RIGHT behind; pieces overlap by what a filter spans, so each run of KERNEL bytes is whole in one.  Bytes that are not
    ``read`` are passed over."""
    if read is not None and not read.all():
        place = np.concatenate([[0], np.cumsum(read)])
        raw, off, start, end = raw[read], place[off], place[start], place[end]
    step = INSIDE - KERNEL + 1
    count = np.maximum(1, -(-(end - start - KERNEL + 1) // step))
    owner = np.repeat(np.arange(len(start)), count)
    at = start[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    to = np.minimum(at + INSIDE, end[owner])
    text = np.searchsorted(off, at, "right") - 1
    lo, hi = off[text][:, None], off[text + 1][:, None]
    spots = [(at[:, None] + np.arange(-LEFT, 0), lo, at[:, None]), (at[:, None] + np.arange(INSIDE), lo, to[:, None]), (to[:, None] + np.arange(RIGHT), to[:, None], hi)]
    out = [np.where((x >= a) & (x < b), _CODE[raw[np.clip(x, 0, max(0, len(raw) - 1))]], 0) for x, a, b in spots]
    return np.concatenate(out, axis=1), owner


def alone(codes: np.ndarray) -> np.ndarray:
    """Windows without what surrounds the candidate."""
    out = codes.copy()
    out[:, :LEFT] = out[:, LEFT + INSIDE :] = 0
    return out


def best_piece(logits: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Highest logit of each candidate's pieces, which lie together."""
    return np.maximum.reduceat(logits, np.flatnonzero(np.diff(owner, prepend=-1))) if len(owner) else logits


_PARTS = ((0, LEFT), (LEFT, LEFT + INSIDE), (LEFT + INSIDE, WIDTH))
FILTERS, EMBED = 16, 8


@dataclass
class Network:
    """Embedding, one convolution, the maximum of each filter over each of three parts, one output."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    recall: float = 0.0
    precision: float = 0.0
    first: Network | None = None  # reads candidates alone

    def logits(self, codes: np.ndarray) -> np.ndarray:
        light = Network({k: v.astype(np.float32) for k, v in self.p.items()})
        return np.concatenate([light._forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)] or [np.empty(0)]).astype(np.float64)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -REACH, REACH)))

    def takes(self, codes: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(codes)) >= self.threshold

    def calibrate(self, z: np.ndarray, yes: np.ndarray, no: np.ndarray, recall: float) -> Network:
        """Platt scaling and the threshold from logits ``z``, rising, with that many findings and others at each."""
        n1, n0 = yes.sum(), no.sum()
        if not n1 or not n0:
            return self
        w = yes + no
        want = (yes * (n1 + 1) / (n1 + 2) + no / (n0 + 2)) / np.maximum(1, w)
        x, at = np.stack([z, np.ones(len(z))]), np.array([1.0, 0.0])

        def loss(a: np.ndarray) -> float:
            return float((w * (np.logaddexp(0, a @ x) - want * (a @ x))).sum())

        for _ in range(40):  # Newton steps, halved until they help
            q = 1 / (1 + np.exp(-np.clip(at @ x, -500, 500)))
            curve = (x * (w * q * (1 - q))) @ x.T
            step = np.linalg.solve(curve + (1e-9 * np.trace(curve) + 1e-12) * np.eye(2), x @ (w * (q - want)))
            while np.abs(step).max() > 1e-9 and loss(at - step) > loss(at):
                step /= 2
            at = at - step
        if np.isfinite(at).all() and at[0] > 0:
            self.slope, self.shift = map(float, at)
        found = np.cumsum(yes[::-1])[::-1]
        least = np.flatnonzero(found >= recall * n1)[-1]  # the threshold may not be above this one
        below = np.flatnonzero(no[:least] > 0)
        below = below[-1] if len(below) else -1
        above = below + 1 + np.flatnonzero(yes[below + 1 :] > 0)[0]
        cut = (z[below] + z[above]) / 2 if below >= 0 else z[above] - 1.0
        self.threshold = float(self.calibrated(np.array([cut]))[0])
        self.recall = float(found[above] / n1)
        self.precision = float(found[above] / max(1, found[above] + no[above:].sum()))
        return self

    def _forward(self, codes: np.ndarray):
        p = self.p
        x = np.pad(p["embed"][codes], ((0, 0), (KERNEL // 2, KERNEL // 2), (0, 0)))
        cols = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), WIDTH, -1)
        act = cols @ p["conv"] + p["conv_b"]
        best = [act[:, a:b].argmax(axis=1) + a for a, b in _PARTS]
        top = np.stack([np.take_along_axis(act, k[:, None, :], 1)[:, 0] for k in best], axis=1)
        pooled = np.maximum(top, 0)
        return pooled.reshape(len(codes), -1) @ p["out"] + p["out_b"][0], cols, best, pooled

    def step(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss."""
        z, cols, best, pooled = self._forward(codes)
        d = (1 / (1 + np.exp(-z)) - y) * weight / len(y)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["out_b"] = pooled.reshape(len(y), -1).T @ d, np.array([d.sum()])
        dp = (d[:, None] * self.p["out"]).reshape(pooled.shape) * (pooled > 0)
        dact = np.zeros((len(y), WIDTH, FILTERS))
        for part, k in enumerate(best):
            np.put_along_axis(dact, k[:, None, :], dp[:, part, None, :], axis=1)
        dact = dact.reshape(-1, FILTERS)
        grad["conv"], grad["conv_b"] = cols.reshape(len(dact), -1).T @ dact, dact.sum(axis=0)
        back = (dact @ self.p["conv"].T).reshape(len(y), WIDTH, KERNEL, EMBED)
        dx = np.zeros((len(y), WIDTH + KERNEL - 1, EMBED))
        for j in range(KERNEL):
            dx[:, j : j + WIDTH] += back[:, :, j]
        flat = dx[:, KERNEL // 2 : KERNEL // 2 + WIDTH].reshape(-1, EMBED)
        grad["embed"] = np.stack([np.bincount(codes.ravel(), flat[:, e], CODES) for e in range(EMBED)], axis=1)
        return grad


def fitted(codes: np.ndarray, y: np.ndarray, held: np.ndarray, recall: float, epochs: int, seed: int) -> Network:
    """Adam on what is not ``held``; calibration and the threshold from what is."""
    r = np.random.default_rng(seed)
    net = Network({"embed": r.normal(0, 0.3, (CODES, EMBED)), "conv": r.normal(0, 0.2, (KERNEL * EMBED, FILTERS)), "conv_b": np.zeros(FILTERS), "out": r.normal(0, 0.2, 3 * FILTERS), "out_b": np.zeros(1)})
    if min(y[~held].sum(), (1 - y[~held]).sum()) < 1:
        return net
    xs, ys = codes[~held], y[~held]
    weight = np.where(ys > 0, 0.5 / ys.mean(), 0.5 / (1 - ys.mean()))
    m, v, t = ({k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0)
    for _ in range(epochs):
        order = r.permutation(len(ys))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            t += 1
            for k, g in net.step(xs[pick], ys[pick], weight[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    z, which = np.unique(net.logits(codes[held]), return_inverse=True)
    return net.calibrate(z, np.bincount(which, y[held], len(z)), np.bincount(which, 1 - y[held], len(z)), recall)


def train(codes: np.ndarray, y: np.ndarray, recall: float = RECALL, epochs: int = 6, seed: int = 5, held: np.ndarray | None = None) -> Network:
    """The network on findings and those others that do not look like findings, by a first one that reads them alone.
    One of four is held back, or those ``held``."""
    held = np.arange(len(y)) % 4 == 3 if held is None else held
    first = fitted(alone(codes), y, held, recall, epochs, seed)
    sure = (y > 0) | ~first.takes(alone(codes))
    net = fitted(codes[sure], y[sure], held[sure], recall, epochs, seed + 1)
    net.first = first
    return net


def _labelled(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, offsets, which are read, starts, ends, whether findings, hashes) of all candidates, once per chunk, surroundings and label."""
    for _, _, raw, off in chunks(column):
        base, short, read = findings(raw, off)
        start, end, hit = candidates(raw, off, base, short)
        if len(start):
            text = np.searchsorted(off, start, "right") - 1
            lo, hi = np.maximum(start - LEFT, off[text]), np.minimum(end + RIGHT, off[text + 1])
            mark = mix(span_hashes(raw, lo, hi) ^ mix((start - lo).astype(np.uint64), 7), 8)
            once = np.unique(np.stack([mark, hit.astype(np.uint64)]), axis=1, return_index=True)[1]
            yield raw, off, read, start[once], end[once], hit[once].astype(np.int32), mark[once].view(np.int64)


def _held(mark: np.ndarray) -> np.ndarray:
    return mark.view(np.uint64) % np.uint64(4) == 3


def least_marks(marks: DataFrame, most: int) -> int:
    """The greatest number up to which at most ``most`` of the unsigned marks lie; -1 stands for none.  The bucket of leading
    bits that would overflow is refined by the next ``DIGIT`` bits, down to single marks."""
    prefix, shift = 0, 64
    while shift and most > 0:
        shift -= DIGIT
        here = marks if shift + DIGIT == 64 else marks.where(F.shiftrightunsigned("mark", shift + DIGIT) == prefix)
        digit = F.shiftrightunsigned("mark", shift).bitwiseAND((1 << DIGIT) - 1).cast("int").alias("digit")
        n = np.zeros(1 << DIGIT, np.int64)
        for r in here.groupBy(digit).count().collect():
            n[r["digit"]] = r["count"]
        fit = int(np.searchsorted(np.cumsum(n), most, "right"))
        prefix, most = (prefix << DIGIT) + fit, most - int(n[:fit].sum())
        if fit == len(n):
            break
    return (prefix << shift) - 1


def draw(docs: DataFrame, max_each: int = MAX_EACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, labels, hashes) of at most ``max_each`` findings and others, by hash over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, label, mark in _labelled(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(mark)], names=["label", "mark"])

    marks = stored(docs.select("text").mapInArrow(count, "label int, mark long").distinct(), "marks")
    last = {label: least_marks(marks.where(F.col("label") == label), max_each) for label in (0, 1)}

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, off, read, start, end, label, mark in _labelled(batch.column("text")):
                keep = np.flatnonzero(mark.view(np.uint64) <= np.where(label > 0, np.uint64(last[1]), np.uint64(last[0]))) if len(mark) else np.empty(0, np.int64)
                codes, owner = windows(raw, off, start[keep], end[keep], read)
                first, pieces = np.searchsorted(owner, np.arange(len(keep))), np.bincount(owner, minlength=len(keep))
                codes = codes[first + (mark[keep].view(np.uint64) // np.uint64(4) % np.maximum(1, pieces).astype(np.uint64)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(label[keep]), pa.array(mark[keep])], names=["codes", "label", "mark"])

    got = docs.select("text").mapInArrow(take, "codes binary, label int, mark long").distinct().toPandas()
    got = got.sort_values(["codes", "label", "mark"]).sample(frac=1, random_state=3)
    codes = np.frombuffer(b"".join(map(bytes, got["codes"])), np.uint8).reshape(-1, WIDTH)
    return codes, got["label"].to_numpy(np.float64), got["mark"].to_numpy(np.int64)


def learn(docs: DataFrame, max_each: int = MAX_EACH, recall: float = RECALL) -> Network:
    """Train on ``max_each`` findings and others at most; calibration and threshold are of all that are held back."""
    codes, y, mark = draw(docs, max_each)
    net = train(codes, y, recall, held=_held(mark))
    if not 0 < y[~_held(mark)].sum() < (~_held(mark)).sum():
        return net
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for raw, off, read, start, end, label, mark in _labelled(batch.column("text")):
                keep = _held(mark)
                codes, owner = windows(raw, off, start[keep], end[keep], read)
                like = (best_piece(net.first.takes(alone(codes)).astype(np.float64), owner) > 0) & (label[keep] == 0)
                z = np.clip(best_piece(net.logits(codes), owner), -REACH, REACH)
                at = np.minimum((z + REACH) * (BINS / (2 * REACH)), BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(like, 2, label[keep]).astype(np.int32)), pa.array(mark[keep]), pa.array(at)], names=["label", "mark", "bin"])

    held = docs.select("text").mapInArrow(score, "label int, mark long, bin int").dropDuplicates(["label", "mark"]).groupBy("label", "bin").count().collect()
    count = np.zeros((3, BINS))  # findings look 1, others 0, others that look like findings 2
    for r in held:
        count[r["label"], r["bin"]] = r["count"]
    some = np.flatnonzero(count[:2].any(axis=0))
    return net.calibrate((some + 0.5) * (2 * REACH / BINS) - REACH, count[1, some], count[0, some], recall)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def scan(docs: DataFrame, network: Network, redact: str | None = None) -> DataFrame:
    """``docs`` (text and any columns) with ``findings``: kind, start, end (code points, end exclusive) and score of each, by
    start and kind; a base finding's score is that of the candidate it overlaps first, null where there is none.  With ``redact``, each stretch of found text becomes that string.  A column named findings is
    replaced."""
    docs = docs.drop("findings")
    shared = docs.sparkSession.sparkContext.broadcast(network)
    place = docs.columns.index("text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            texts: dict[int, str] = {}
            for row, _, raw, off in chunks(batch.column("text")):
                base, short, read = findings(raw, off)
                start, end, hit = candidates(raw, off, base, short, rest=True)
                score = np.full(len(start), np.nan)
                if net.threshold <= 1 and len(start):
                    score = net.calibrated(best_piece(net.logits((w := windows(raw, off, start, end, read))[0]), w[1]))
                known, found = np.flatnonzero(hit), np.flatnonzero(~hit & (score >= net.threshold))
                scored = []
                for text, lo, hi, kind in base:
                    k = known[np.searchsorted(end[known], lo, "right") :][:1]
                    scored.append((text, lo, hi, kind, float(score[k[0]]) if len(k) and start[k[0]] < hi and net.threshold <= 1 else None))
                scored += zip((np.searchsorted(off, start[found], "right") - 1).tolist(), start[found].tolist(), end[found].tolist(), [3] * len(found), score[found].tolist(), strict=True)
                by_text: dict[int, list] = {}
                for text, *span in sorted(scored, key=lambda s: (s[0], s[1], s[3])):
                    by_text.setdefault(text, []).append(span)
                for text, spans in by_text.items():
                    lo, hi = int(off[text]), int(off[text + 1])
                    points = np.concatenate([[0], np.cumsum((raw[lo:hi] & 0xC0) != 0x80)])
                    out[row + text] = [{"kind": KINDS[k], "start": int(points[a - lo]), "end": int(points[b - lo]), "score": p} for a, b, k, p in spans]
                    if redact is not None:
                        data, parts, at = raw[lo:hi].tobytes(), [], lo
                        for a, b, *_ in spans:
                            if a >= at:
                                parts += [data[at - lo : a - lo], redact.encode()]
                            at = max(at, b)
                        texts[row + text] = b"".join([*parts, data[at - lo :]]).decode()
            columns = list(batch.columns)
            if texts:
                columns[place] = pa.array([texts.get(i, x) for i, x in enumerate(columns[place].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _SPANS)], names=[*batch.schema.names, "findings"])

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField("findings", SPANS)]))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of base findings, SHA-256 of their list and the list of all, as kind:start:end joined by commas."""
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.sha2(listed(F.filter("findings", lambda s: s["kind"] != "cnn")).cast("binary"), 256)
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), count("assign"), count("access"), count("hex"), base.alias("base_sha256"), listed(F.col("findings")).alias("spans"))
