import hashlib
import random
import re
import zlib

import pytest

from pixelquarry.llm import conversation_repair as c

SOLID = re.compile(r"[^\x20\x09-\x0D]")
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
MAY_KEEP = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def best(messages, faults):
    """All edit sequences, but for those that some other over the same rows beats at the same place."""
    paths = {"": [(0, "", ())]}

    def inserted(place, path):
        for _ in range(3):
            yield place, path
            place = AFTER[place]
            path = (path[0] + 2, path[1] + "I", (*path[2], NAMES[place] + ":"))

    for (role, text), fault in zip(messages, faults, strict=True):
        after = {}
        for start, some in paths.items():
            for before in some:
                for place, (cost, audit, made) in inserted(start, before):
                    after.setdefault(place, set()).add((cost + 3, audit + "D", made))
                    if fault not in ("blank", "duplicate"):
                        more, to = fault == "truncated", AFTER[place]
                        if (place, role[:1]) in MAY_KEEP:
                            after.setdefault(role[:1], set()).add((cost + more, audit + "K", (*made, f"{role}:{text}")))
                        after.setdefault(to, set()).add((cost + 2 + more, audit + "R", (*made, f"{NAMES[to]}:{text}")))
        paths = {k: sorted(v)[:8] for k, v in after.items()}
    return min(path for start, some in paths.items() for before in some for place, path in inserted(start, before) if place in ("", "a"))


def brute(rows, damage=True):
    named = {}
    for conv, *_ in rows:
        named.setdefault(conv, [])
    for conv, *message in hurt(rows) if damage else rows:
        named[conv].append(tuple(" " if x is None and i else x for i, x in enumerate(message)))
    out = []
    for conv, messages in named.items():
        messages.sort(key=lambda m: (m[0] is not None, m[0] or 0, hashlib.sha256(f"{len(m[1].encode())}:{m[1]}{m[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in messages:
            solid = SOLID.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(messages, messages[1:], strict=False)]
        turns = [m[0] for m in messages if m[0] is not None]
        cost, audit, made = best([m[1:] for m in messages], faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn int, role string, text string, kind string, cost int"
ROLES = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
TEXTS = ["a.", "b", "", None, " \t", "Hi!", "long text", "q?", "ö", *(f"t{i}." for i in range(10))]


def made_up(seed, n, convs):
    pick = random.Random(seed)
    return [(pick.choice(convs), pick.choice([None, 1, 2, 3, 4, 5, 9, 12]), pick.choice(ROLES), pick.choice(TEXTS), "k", 0) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_brute_force(spark, block):
    rows = made_up(3, 900, [None, *range(90)])
    data = spark.createDataFrame(rows, SCHEMA).repartition(5)
    damaged, dropped = c.damaged(data)
    got = sorted((tuple(r) for r in c.summary(damaged, block, dropped).collect()), key=str)
    assert got == brute([r[:4] for r in rows])


def test_a_long_conversation_spills_and_is_carried_over_batches(spark):
    rows = [(1, i // 3, ROLES[i * 7 % 8], TEXTS[i * 5 % 19] if i % 4 else f"n{i}", "k", 0) for i in range(1500)] + made_up(4, 60, [2, 3])
    data = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        damaged, dropped = c.damaged(data)
        got = sorted((tuple(r) for r in c.summary(damaged, 100, dropped).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute([r[:4] for r in rows])


def test_repaired_messages(spark):
    data = spark.createDataFrame([(1, 1, "system", "Be brief."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Why"), (1, 4, "user", "Why"), (2, 1, "user", "")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in c.repaired(data).orderBy("conv_id", "position").collect()]
    made = brute([tuple(r) for r in data.collect()], damage=False)[0]
    assert [e for *_, e in got] == [x for x in made[7] if x != "D"]
    assert hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text, _ in got).encode()).hexdigest() == made[8]
    assert {r[0] for r in got} == {1}


def test_all_rows_dropped_and_an_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    data = spark.createDataFrame([(gone, 0, "user", "x.", "k", 0)], SCHEMA)
    damaged, dropped = c.damaged(data)
    assert tuple(c.summary(damaged, dropped=dropped).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    damaged, dropped = c.damaged(data.limit(0))
    assert c.summary(damaged, dropped=dropped).collect() == []


def test_the_automaton_is_small():
    assert len(c.automaton().next) < 1 << 16
