"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Words are counted exactly over all documents, by 64-bit hashes, in a stored table.  They fall into ``CLASSES`` classes
of about equal mass: at most ``KNOWN`` of the commonest, which tasks hold, by count, the most frequent alone; all others
by hash, in as many classes as their mass takes.  The network reads the classes of the ``SIDE`` words on each side of a
masked one and gives the class; the word within it has its own share of the class's count, joined from the table:

    log p(word | both sides) = log p(class | both sides) + log p(word | class)

A document's score is the sum over its words.  Every partition trains on its own windows, in each round on one of
``EVERY`` parts of all positions, dealt by the hash of text and position and not by the words there; the partitions'
networks are averaged by their windows, and that is repeated.  In ``ROUNDS`` = ``EVERY`` rounds every position of every
document is a target once.

Nulls: a null text has no words and the score 0; beyond a document's ends stands a class of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered, parts, renamed, stored
from .textkit import chunks, mix, span_hashes, words

VOCAB_BITS = 18
KNOWN = 1 << 18
CLASSES = 128
SIDE = 2
HIDDEN = 32
EVERY = 2
ROUNDS = 2
_SHARD = 1 << 12


def hashed(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text and the end)."""
    w = words(raw, off)
    return span_hashes(raw, w.start, w.end).view(np.int64), w.first


def _token(word: np.ndarray, bits: int) -> np.ndarray:
    return (mix(word.view(np.uint64), 41) >> np.uint64(64 - bits)).astype(np.int64)


def tokens(raw: np.ndarray, off: np.ndarray, bits: int = VOCAB_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(token of each word, first word of each text and the end); words of a token are not told apart."""
    word, first = hashed(raw, off)
    return _token(word, bits), first


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word (its hash) occurs in all texts, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(raw, off)[0] for _, _, raw, off in chunks(batch.column("text"))]
            if found:
                word, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    return stored(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


@dataclass
class Vocabulary:
    """Classes of words: ``known`` (sorted hashes) have theirs in ``of``, others one of the last ``rest`` by hash."""

    known: np.ndarray
    n: np.ndarray
    of: np.ndarray
    rest: int
    total: np.ndarray  # words of each class

    def at(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the known, whether it is one)."""
        if not len(self.known):
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        place = np.minimum(np.searchsorted(self.known, word), len(self.known) - 1)
        return place, self.known[place] == word

    def kinds(self, word: np.ndarray) -> np.ndarray:
        return self.kinds_and_shares(word)[0]

    def kinds_and_shares(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class of each word, log of its share in the class, of words that are not known without the log of their own
        count)."""
        place, known = self.at(word)
        kinds = np.where(known, self.of[place], len(self.total) - self.rest + word % max(1, self.rest)) if len(self.known) else len(self.total) - self.rest + word % max(1, self.rest)
        shares = -np.log(self.total)[kinds]
        return kinds, shares + np.where(known, np.log(self.n)[place], 0.0) if len(self.known) else shares


def vocabulary(counts: DataFrame, classes: int = CLASSES, known: int = KNOWN) -> Vocabulary:
    """The known words are all that occur at least as often as some number, the least that leaves at most ``known``."""
    often = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    least, left, kept = 1 << 62, known, 0
    for n, words in often:
        if words > left:
            break
        least, left, kept = n, left - words, kept + n * words
    others = sum(n * words for n, words in often) - kept
    rest = min(classes - 1, max(1, round(classes * others / (others + kept)))) if others else 0
    got = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    word, n = got["word"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    of, _ = word_classes(n, classes - rest)
    total = np.zeros(classes)
    total[: classes - rest] = np.bincount(of, n, classes - rest)
    if rest:
        for r in counts.where(F.col("n") < least).groupBy(F.pmod("word", F.lit(rest)).alias("k")).agg(F.sum("n").alias("n")).collect():
            total[classes - rest + r["k"]] = r["n"]
    order = np.argsort(word)
    return Vocabulary(word[order], n[order], of[order].astype(np.int64), rest, total)


def token_counts(docs: DataFrame, bits: int = VOCAB_BITS) -> np.ndarray:
    """How often each token occurs in all texts, for models of hashed tokens: one partial count per partition and shard,
    summed by shard."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, raw, off in chunks(batch.column("text")):
                total += np.bincount(tokens(raw, off, bits)[0], minlength=1 << bits)
        if total.any():
            yield from pieces(total.reshape(-1, _SHARD), range((1 << bits) // _SHARD))

    def pieces(rows: np.ndarray, shards) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(shards), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["shard", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("counts"), strict=True):
                sums[shard] = sums.get(shard, 0) + np.frombuffer(blob.as_py(), np.int64)
        if sums:
            yield from pieces(np.array(list(sums.values())), sums)

    schema = "shard int, counts binary"
    out = np.zeros(((1 << bits) // _SHARD, _SHARD), np.int64)
    for row in docs.select("text").mapInArrow(partial, schema).repartition(parts(docs.sparkSession), "shard").mapInArrow(add, schema).toLocalIterator():
        out[row["shard"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def word_classes(counts: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, log of its smoothed share of the class)."""
    order = np.argsort(-counts, kind="stable")
    of = np.empty(len(counts), np.int64)
    at, k, left = 0, 0, float(counts.sum()) + 0.5 * len(counts)
    mass = np.cumsum(counts[order] + 0.5)
    while at < len(counts):
        before = mass[at - 1] if at else 0.0
        to = len(counts) if k == classes - 1 else max(at + 1, int(np.searchsorted(mass, before + (left - before) / (classes - k), "right")))
        of[order[at:to]] = k
        at, k = to, k + 1
    total = np.bincount(of, counts + 0.5, classes)
    return of, np.log((counts + 0.5) / total[of])


@dataclass
class Network:
    """Per place a row for each class, summed; tanh; one output per class."""

    tables: np.ndarray  # places x (classes + 1) x hidden
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(classes: int = CLASSES, hidden: int = HIDDEN, side: int = SIDE) -> Network:
        r = np.random.default_rng(9)
        return Network(*(x.astype(np.float32) for x in (r.normal(0, 0.3, (2 * side, classes + 1, hidden)), np.zeros(hidden), r.normal(0, 0.1, (hidden, classes)), np.zeros(classes))))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.tables, self.bias, self.out, self.out_bias)]).astype(np.float32)

    def like(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for x in (self.tables, self.bias, self.out, self.out_bias):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.bias + self.tables[0][context[:, 0]]
        for place in range(1, len(self.tables)):
            h += self.tables[place][context[:, place]]
        return np.tanh(h)

    def may_overflow(self) -> bool:
        """Whether some output can be so far from 0 that its exponential needs care; hidden values are within 1."""
        return bool((np.abs(self.out).sum(axis=0) + np.abs(self.out_bias)).max() > 60)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target class between its context's."""
        out = np.empty(len(target), np.float64)
        rows, large = np.arange(512), self.may_overflow()
        for i in range(0, len(target), 512):  # as many as stay in a core's cache
            z = self.hidden(context[i : i + 512]) @ self.out
            z += self.out_bias
            if large:
                z -= z.max(axis=1, keepdims=True)
            mine = z[rows[: len(z)], target[i : i + 512]]
            np.exp(z, out=z)
            out[i : i + 512] = mine - np.log(z.sum(axis=1))
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean negative log probability."""
        h = self.hidden(context)
        p = h @ self.out
        p += self.out_bias
        if self.may_overflow():
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (rate / len(p)) / p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), target] -= rate / len(p)
        back = (p @ self.out.T) * (1 - h * h)
        self.out -= h.T @ p
        self.out_bias -= p.sum(axis=0)
        self.bias -= back.sum(axis=0)
        width = self.tables.shape[2]
        for place in range(len(self.tables)):
            cells = (context[:, place] * width)[:, None] + np.arange(width)
            np.subtract.at(self.tables[place].reshape(-1), cells.ravel(), back.ravel())


def contexts(kinds: np.ndarray, first: np.ndarray, classes: int, side: int = SIDE) -> np.ndarray:
    """Classes of the words before and behind each word, ``classes`` beyond its text."""
    n = len(kinds)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, 2 * side), classes, np.int64)
    for place, shift in enumerate([*range(-side, 0), *range(1, side + 1)]):
        at = np.arange(max(0, -shift), min(n, n - shift))
        at = at[text[at] == text[at + shift]]
        out[at, place] = kinds[at + shift]
    return out


def deal(key: np.ndarray, first: np.ndarray, every: int, number: int) -> np.ndarray:
    """Positions that round ``number`` trains on, in a random order: one of ``every`` parts, by the hash of text and position."""
    at = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    spot = mix(np.repeat(mix(key, 50), np.diff(first)) + at.astype(np.uint64), 51)
    pick = np.flatnonzero(spot % np.uint64(every) == number % every)
    return pick[np.argsort(mix(spot[pick], 60 + number), kind="stable")]


def train(docs: DataFrame, of: Vocabulary | np.ndarray, classes: int = CLASSES, every: int = EVERY, rounds: int = ROUNDS, bits: int = VOCAB_BITS) -> Network:
    """Average of the partitions' networks, each trained on its share of windows, ``rounds`` times.
    ``of`` gives the classes of words, or is the class of each hashed token."""
    spark = docs.sparkSession
    shared_of = spark.sparkContext.broadcast(of)
    network = Network.start(classes)
    schema = "n double, flat binary"

    for number in range(rounds):
        begun = spark.sparkContext.broadcast(network)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = begun.value.like(begun.value.flat())  # noqa: B023
            n = 0
            for batch in batches:
                keys = batch.column("key").to_numpy().view(np.uint64)
                for row, rows, raw, off in chunks(batch.column("text")):
                    word, first = hashed(raw, off)
                    of = shared_of.value
                    kinds = of.kinds(word) if isinstance(of, Vocabulary) else of[_token(word, bits)]
                    context = contexts(kinds, first, classes)
                    pick = deal(keys[row : row + rows], first, every, number)  # noqa: B023
                    at = 0
                    while at < len(pick):  # larger steps as the rate falls
                        mine = pick[at : at + (64 << min(3, n // 50_000))]
                        net.step(context[mine], kinds[mine], 2.0 / (1 + n / 100_000) ** 0.5)
                        at, n = at + len(mine), n + len(mine)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([net.flat().tobytes()], pa.binary())], names=["n", "flat"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = 0.0, 0.0
            for batch in batches:
                for n, flat in zip(batch.column("n").to_pylist(), batch.column("flat"), strict=True):
                    total, weight = total + n * np.frombuffer(flat.as_py(), np.float32).astype(np.float64), weight + n
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["n", "flat"])

        total, weight = 0.0, 0.0
        for row in docs.select("text", F.xxhash64("text").alias("key")).mapInArrow(learn, schema).repartition(min(16, parts(spark))).mapInArrow(average, schema).toLocalIterator():
            total, weight = total + row["n"] * np.frombuffer(row["flat"], np.float32).astype(np.float64), weight + row["n"]
        if weight:
            network = network.like(total / weight)
    return network


def score(docs: DataFrame, classes: int = CLASSES, every: int = EVERY, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """``docs`` (text and any columns) with n_tokens, log_likelihood (sum over the words) and mean_log_likelihood (null
    without words); columns of these names are replaced."""
    plain, names = numbered(docs, "n_tokens", "log_likelihood", "mean_log_likelihood")
    body = f"c{[c.lower() for c in names].index('text')}"
    docs = plain.withColumn("text", F.col(body))
    counts = word_counts(docs)
    words = vocabulary(counts, classes, known)
    model = docs.sparkSession.sparkContext.broadcast((train(docs, words, classes, every, rounds), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, words = model.value
        for batch in batches:
            n, total = [np.empty(0, np.int64)], [np.empty(0)]
            for _, _, raw, off in chunks(batch.column(body)):
                word, first = hashed(raw, off)
                kinds, shares = words.kinds_and_shares(word)
                p = network.log_probability(contexts(kinds, first, classes), kinds) + shares
                count = np.diff(first)
                sums = np.zeros(len(count))
                if len(p):  # each document by itself, so that its sum does not depend on what is beside it
                    sums[count > 0] = np.add.reduceat(p, first[:-1][count > 0])
                n.append(count)
                total.append(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n)), pa.array(np.concatenate(total))], names=[*batch.schema.names, "n_tokens", "log_likelihood"])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())]
    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added]))
    if words.rest:
        digest, total = F.sha2(F.col(body).cast("binary"), 256), F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0))
        halves = [F.conv(F.substring(digest, i, 15), 16, 10).cast("long") for i in (1, 16)]  # 120 bits as two numbers, not 64 letters
        rare = rare_shares(docs.select("text", *(h.alias(n) for h, n in zip(halves, ("key", "key2"), strict=True))), counts, model)
        out = out.withColumns({"text_key": halves[0], "text_key2": halves[1]}).join(rare, (F.col("text_key") == F.col("key")) & (F.col("text_key2") == F.col("key2")), "left")
        out = out.withColumn("log_likelihood", total)
    return renamed(out, names, "n_tokens", "log_likelihood").withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def rare_shares(rows: DataFrame, counts: DataFrame, model) -> DataFrame:
    """Per text (key, key2: of its SHA-256) the sum of the logs of the counts of its words that are not known (rest)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.value[1]
        for batch in batches:
            keys = [batch.column(c) for c in ("key", "key2")]
            for row, n, raw, off in chunks(batch.column("text")):
                word, first = hashed(raw, off)
                other = ~words.at(word)[1]
                of = np.repeat(np.arange(row, row + n), np.diff(first))[other]
                yield pa.RecordBatch.from_arrays([*(k.take(pa.array(of)) for k in keys), pa.array(word[other])], names=["key", "key2", "word"])

    joined = rows.mapInArrow(find, "key long, key2 long, word long").join(counts, "word").select("key", "key2", F.log("n").alias("s"), F.lit(0).alias("copies"))
    # Rows of the same text are found once each, so their sum is divided by their number.
    both = joined.unionAll(rows.select("key", "key2", F.lit(0.0).alias("s"), F.lit(1).alias("copies")))
    return both.groupBy("key", "key2").agg((F.sum("s") / F.sum("copies")).alias("rest")).where("rest <> 0")


def scored(docs: DataFrame) -> DataFrame:
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
