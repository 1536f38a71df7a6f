"""Repair of conversations by the cheapest edits, streamed in the order of turns.

Rows are repartitioned by conversation and sorted by turn; a task sees each conversation as a run of rows, however many
batches it takes.  What it carries from row to row is the state of a shortest path over four places (nothing yet, behind
a system, a user, an assistant message): the places' costs relative to the least, and the order of their audits so far.
Only a few dozen such states exist (``automaton``), so a row is one look-up and its backpointers are one 16-bit code.

A conversation that ends within ``block`` rows is traced back at once.  A longer one spills its codes block by block as
rows of a stored table in the shared folder; a second stream over these, last block first, carries the place and gives
each block its edits.  A third stream sorts edits and messages together, so edits come before their rows, and writes the
repaired conversation as it goes: no conversation is held, but for its audit of one letter an edit.

Equal audits so far mean equal places, and of two audits over the same rows none begins with the other, as each ends
with a row's own letter; so comparing the places by audit and then the new letters is comparing the whole audits.

Duplicates are found before, by an aggregate over (conversation, digest of role and text) that is joined back where a
digest occurs more than once.

Nulls: a null role or text is one space, a null conversation is one of its own, null turns come first and count for no
gap.  Rows of one turn are in the order of their digests, equal ones side by side.  A conversation without rows left has
zeros, an empty audit and the digest of an empty string; an empty table has no rows.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import parts, stored

BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
PLAIN, CUT, BLANK, AGAIN = range(4)  # what a row is; the last two must go
FORCED = BLANK
INITIALS = "sua"
ROLES = {USER: "user", ASSISTANT: "assistant"}
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # where an inserted or renamed message leads
_KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
_ILLEGAL = [[(a, b) not in ((0, 1), (1, 2), (2, 1)) for b in range(4)] for a in range(4)]
_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_EDITS = "conv string, has_turn boolean, turn long, tie binary, block long, codes binary, letters string, place int, last boolean, " + ", ".join(f"`{c}` long" for c in _STATS)


class Automaton(NamedTuple):
    """By code (state * 12 + symbol): the next state, what the least cost rises by, and for each place where it comes from and
    by which letters.  By state: cost, place and letters of the cheapest end."""

    next: list[int]
    rise: list[int]
    back: list[dict[int, tuple[int, str]]]
    end: list[tuple[int, int, str]]


def _moves(place: int, symbol: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letters, place after) of a row with at most two messages inserted before it."""
    kind, initial = divmod(symbol, 4)
    for n in range(3):
        yield n * INSERT + DELETE, "I" * n + "D", place
        if kind != FORCED:
            if (place, initial) in _KEEP:
                yield n * INSERT + TRUNCATED * (kind == CUT), "I" * n + "K", _KEEP[place, initial]
            yield n * INSERT + RENAME + TRUNCATED * (kind == CUT), "I" * n + "R", _NEXT[place]
        place = _NEXT[place]


@cache
def automaton() -> Automaton:
    """All states that any conversation can reach.  A state lists its places by audit, least first, with their costs.

    Two kinds of places are left out, as they can win no more: behind a system message if it costs more than behind an
    assistant's (which may go on in the same ways, and end), and nothing yet if it costs over ``DELETE`` more than that."""
    start = ((START, 0),)
    ids, todo, out = {start: 0}, deque([start]), Automaton([], [], [], [])
    while todo:
        state = todo.popleft()
        for symbol in range(12):
            best: dict[int, tuple[int, int, str, int]] = {}
            for rank, (place, cost) in enumerate(state):
                for more, letters, to in _moves(place, symbol):
                    best[to] = min(best.get(to, (1 << 30,)), (cost + more, rank, letters, place))
            least = min(x[0] for x in best.values())
            behind = best[ASSISTANT][0] if ASSISTANT in best else 1 << 30
            best = {p: x for p, x in best.items() if not (p == SYSTEM and x[0] > behind) and not (p == START and x[0] > behind + DELETE)}
            after = tuple((p, x[0] - least) for p, x in sorted(best.items(), key=lambda i: i[1][1:3]))
            if after not in ids:
                ids[after] = len(ids)
                todo.append(after)
            out.next.append(ids[after])
            out.rise.append(least)
            out.back.append({p: (x[3], x[2]) for p, x in best.items()})
        ends = []
        for rank, (place, cost) in enumerate(state):
            to = place
            for n in range(3):
                if to in (START, ASSISTANT):
                    ends.append((cost + n * INSERT, rank, "I" * n, place))
                to = _NEXT[to]
        cost, _, letters, place = min(ends)
        out.end.append((cost, place, letters))
    return out


def traced(codes: np.ndarray, place: int) -> tuple[int, list[str]]:
    """The letters of each row, from the place behind the last one back to the place before the first."""
    back, letters = automaton().back, []
    for code in codes[::-1].tolist():
        place, some = back[code][place]
        letters.append(some)
    return place, letters[::-1]


def messages(rows: DataFrame, dropped: Column | None = None) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with what they are sorted and told apart by; null roles and texts are spaces."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    tie = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    has, turn = F.col("turn").isNotNull(), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))
    return rows.select(F.col("conv_id").cast("string").alias("conv"), has.alias("has_turn"), turn.alias("turn"), tie.alias("tie"), role.alias("role"), text.alias("text"), (F.lit(False) if dropped is None else dropped).alias("dropped"))


def _judged(rows: DataFrame) -> DataFrame:
    """Rows of ``messages`` without texts, with initial, blank, cut (no sentence end) and later (seen at an earlier turn)."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, F.lit(i)) for i, c in enumerate(INITIALS)), F.lit(3)).cast("int")
    cut = ~F.substring(trimmed, -1, 1).isin(".", "!", "?")
    key = ["conv", "has_turn", "turn", "tie", "dropped"]
    narrow = stored(rows.select(*key, initial.alias("initial"), (trimmed == "").alias("blank"), cut.alias("cut")), "messages")
    first = F.min(F.struct("has_turn", "turn")).alias("first")
    seen = narrow.where("NOT dropped").groupBy(F.col("conv").alias("s_conv"), F.col("tie").alias("s_tie")).agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    joined = narrow.join(seen, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("tie") == F.col("s_tie")), "left")
    later = F.coalesce(F.struct("has_turn", "turn") > F.col("first"), F.lit(False))
    return joined.select(*key, "initial", "blank", "cut", later.alias("later"))


def _in_order(rows: DataFrame, *last: str | Column) -> DataFrame:
    return rows.repartition(parts(rows.sparkSession), "conv").sortWithinPartitions("conv", *last)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of runs of equal values."""
    if not len(values):
        return []
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


class _Scan:
    """A conversation as far as it was read."""

    def __init__(self, conv: str | None, block: int):
        self.conv, self.block, self.spilled = conv, block, 0
        self.state = self.cost = self.illegal = self.turns = 0
        self.faults = [0] * 4
        self.first = self.last = self.initial = self.tie = None
        self.codes: list[int] = []
        self.key: tuple = (False, 0, None)

    def add(self, rows: Iterator[tuple[bool, int, bytes, int, int]]) -> Iterator[tuple]:
        """Rows (has turn, turn, tie, kind, initial) in order; the blocks that they fill."""
        auto = automaton()
        for has, turn, tie, kind, initial in rows:
            if kind != BLANK and self.tie == (has, turn, tie):
                kind = AGAIN
            self.tie = (has, turn, tie)
            self.faults[kind] += 1
            self.illegal += self.initial is not None and _ILLEGAL[self.initial][initial]
            self.initial = initial
            if has and turn != self.last:
                self.turns, self.last = self.turns + 1, turn
                self.first = turn if self.first is None else self.first
            if len(self.codes) == self.block:
                yield self.row(codes=True)
                self.codes, self.spilled = [], self.spilled + 1
            if not self.codes:
                self.key = (has, turn, tie)
            code = self.state * 12 + min(kind, FORCED) * 4 + initial
            self.codes.append(code)
            self.cost += auto.rise[code]
            self.state = auto.next[code]

    def row(self, codes: bool) -> tuple:
        return (self.conv, *self.key, self.spilled, np.array(self.codes, np.uint16).tobytes() if codes else None, None, None, False, *[None] * len(_STATS))

    def end(self) -> tuple:
        """The last block: with its letters if it is the only one."""
        cost, place, letters = automaton().end[self.state]
        gaps = min((1 << 63) - 1, self.last - self.first + 1 - self.turns) if self.turns else 0
        done = None if self.spilled else "".join(traced(np.array(self.codes, np.uint16), place)[1]) + letters
        return (*self.row(codes=bool(self.spilled))[:6], done, place, True, gaps, self.faults[BLANK], self.faults[AGAIN], self.faults[CUT], self.illegal, self.cost + cost)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def edits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edits of ``messages`` in blocks of rows: letters, with the place in the order of the block's first row, and what was
    counted beside the last block."""
    names = [x.split()[0].strip("`") for x in _EDITS.split(", ")]

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Scan | None = None
        for batch in batches:
            out: list[tuple] = []
            conv, keep = batch["conv"].to_numpy(dtype=object), ~batch["dropped"].to_numpy(dtype=bool)
            upto = np.concatenate([[0], np.cumsum(keep)]).tolist()
            blank, later, cut = (batch[c].to_numpy(dtype=bool)[keep] for c in ("blank", "later", "cut"))
            kind = np.where(blank, BLANK, np.where(later, AGAIN, np.where(cut, CUT, PLAIN)))
            columns = [*(batch[c].to_numpy()[keep].tolist() for c in ("has_turn", "turn", "tie")), kind.tolist(), batch["initial"].to_numpy()[keep].tolist()]
            for lo, hi in _runs(conv):
                if now is None or now.conv != conv[lo]:
                    if now is not None:
                        out.append(now.end())
                    now = _Scan(conv[lo], block)
                out.extend(now.add(zip(*(c[upto[lo] : upto[hi]] for c in columns), strict=True)))
            yield _frame(out, names)
        if now is not None:
            yield _frame([now.end()], names)

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, letters = START, ""
        for batch in batches:
            done = []
            for row in batch[names].itertuples(index=False):
                row = list(row)
                if row[8]:
                    place = int(row[7])
                    letters = "I" * next(n for n, x in enumerate((place, _NEXT[place], _NEXT[_NEXT[place]])) if x in (START, ASSISTANT))
                place, some = traced(np.frombuffer(row[5], np.uint16), place)
                row[5], row[6], letters = None, "".join(some) + letters, ""
                done.append(tuple(row))
            yield _frame(done, names).where(lambda d: d.notna(), None)

    order = [F.col("has_turn"), F.col("turn"), F.col("tie")]
    scanned = stored(_in_order(_judged(rows), *order).mapInPandas(forward, _EDITS), "edits")
    spilled = _in_order(scanned.where("codes IS NOT NULL"), F.col("block").desc()).mapInPandas(backward, _EDITS)
    return scanned.where("codes IS NULL").unionByName(spilled).drop("codes", "place")


class _Repair:
    """A conversation being written: what its edits make of its messages, in order."""

    def __init__(self, conv: str | None):
        self.conv, self.place, self.waiting, self.at = conv, START, "", 0
        self.audit: list[str] = []
        self.stats: tuple | None = None

    def message(self, role: str | None, text: str | None) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of the messages that come of a row, or of the end."""
        while self.at < len(self.waiting):
            letter = self.waiting[self.at]
            if letter != "I" and role is None:
                break
            self.at += 1
            if letter == "D":
                return
            to = _NEXT[self.place] if letter in "IR" else _KEEP[self.place, (INITIALS + role[:1]).index(role[:1])]
            self.place = to
            yield letter, role if letter == "K" else ROLES[to], "" if letter == "I" else text
            if letter != "I":
                return


def _written(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Messages and blocks of edits in one order, each block before its rows."""
    none = [F.lit(None).cast("long").alias(c) for c in _STATS]
    key = ["conv", "has_turn", "turn", "tie"]
    left = rows.where("NOT dropped").select(*key, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), "role", "text", F.lit(None).cast("string").alias("letters"), *none)
    blocks = found.select(*key, F.lit(0).alias("kind"), "block", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "letters", *_STATS)
    return _in_order(left.unionByName(blocks), "has_turn", "turn", "tie", "kind", "block")


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[_Repair, list[tuple[str, str, str]], bool]]:
    """(conversation, messages written, whether it has ended)."""
    now: _Repair | None = None
    for batch in batches:
        stats = batch[_STATS].to_numpy()
        for i, (conv, kind, role, text, letters) in enumerate(zip(*(batch[c].to_numpy(dtype=object) for c in ("conv", "kind", "role", "text", "letters")), strict=True)):
            if now is None or now.conv != conv:
                if now is not None:
                    yield now, list(now.message(None, None)), True
                now = _Repair(conv)
            if kind == 0:
                now.waiting, now.at = now.waiting[now.at :] + letters, 0
                now.audit.append(letters)
                if not pd.isna(stats[i, 0]):
                    now.stats = tuple(batch[c].iloc[i] for c in _STATS)
            else:
                yield now, list(now.message(role, text)), False
    if now is not None:
        yield now, list(now.message(None, None)), True


def summary(rows: DataFrame, block: int = BLOCK, dropped: Column | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): counts of faults, cost, audit and the SHA-256 of the
    repaired ``role:text`` lines.  Rows that are ``dropped`` only name their conversation."""
    every = messages(rows, dropped)
    names = ["conv", *_STATS, "audit", "repaired_sha256"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, digest, any_yet = [], hashlib.sha256(), False
        for conversation, made, ended in _stream(batches):
            for _, role, text in made:
                digest.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
                any_yet = True
            if ended:
                out.append((conversation.conv, *(int(x) for x in conversation.stats), "".join(conversation.audit), digest.hexdigest()))
                digest, any_yet = hashlib.sha256(), False
                if len(out) == 1000:
                    yield _frame(out, names)
                    out = []
        yield _frame(out, names)

    schema = "conv string, " + ", ".join(f"`{c}` long" for c in _STATS) + ", audit string, repaired_sha256 string"
    done = _written(every, edits(every, block)).mapInPandas(write, schema)
    return done.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *_STATS, "audit", "repaired_sha256")


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, role, text and the edit that made the message (K, R or I)."""
    every = messages(rows)
    names = ["conv", "position", "role", "text", "edit"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at = [], 0
        for conversation, made, ended in _stream(batches):
            for letter, role, text in made:
                out.append((conversation.conv, at, role, text, letter))
                at += 1
            at = 0 if ended else at
            if len(out) > 1000:
                yield _frame(out, names)
                out = []
        yield _frame(out, names)

    done = _written(every, edits(every, block)).mapInPandas(write, "conv string, position long, role string, text string, edit string")
    return done.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), "position", "role", "text", "edit")


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` after the stated damage by crc32(``conv_id:turn``) % 20, and which of them are dropped: 0 drops a row, 1 empties
    its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role ``user``.  Nulls are one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    picked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).cast("int").alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("damage") == 3, 1).otherwise(0)))
    return picked.select("conv_id", "turn", role.alias("role"), text.alias("text"), "damage", copies.alias("copy")), F.col("damage") == 0
