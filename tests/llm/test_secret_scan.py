import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from pixelquarry.llm import secret_scan as ss
from pixelquarry.llm.textkit import chunks


def plain(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def texts(n=300):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgéßñ漢") for _ in range(r.randrange(1, 12)))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    out = [None, "", "a", "password=" + "x" * 11, "api_key: 'abcdefghijkl", 'APIKEY"  =  "ABCDEFGHIJKL.=', "token=token=aaaaaaaaaaaaaaaa", "ſecret=abcdefghijklmn toKen=abcdefghijklmn", "AKIA" + "Z" * 13, "AKIAAKIA" + "9" * 12, "0" * 15, "f" * 16 + "G" + "0" * 40, "secret = AKIA" + "7" * 20, "\U0001f600 password:0123456789abcdef0"]
    for _ in range(n):
        w = [word() for _ in range(r.randrange(3, 40))]
        if r.random() < 0.5:
            w.insert(r.randrange(len(w)), r.choice([f"password={hexa(18)}", f'token = "{hexa(40)}"', hexa(r.randrange(10, 40)), "AKIA" + "".join(r.choice("ABCDEF0123456789") for _ in range(r.randrange(10, 20)))]))
        if r.random() < 0.4:
            w.insert(r.randrange(len(w)), f"img-{r.randrange(10**4)}-{word()}-page{r.randrange(10**6)}-foo-bar")
        out.append(" ".join(w))
    return out


def test_base_findings_stay(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS findings", "1 AS start")
    net = ss.learn(docs)
    got = {x["doc_id"]: x for x in ss.digest(ss.scan(docs, net)).collect()}
    assert len(got) == len(rows) and net.recall >= 0.98
    for i, t in rows:
        want, x = plain(t), got[i]
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, x)
        assert [s for s in x["spans"].split(",") if s and not s.startswith("cnn")] == want
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
        for s in x["spans"].split(","):
            if s.startswith("cnn"):
                a, b = map(int, s.split(":")[1:])
                assert re.fullmatch("[A-Za-z0-9+/_=-]{6,}", t[a:b])


def test_network_tells_findings_from_others():
    r = random.Random(8)
    rows, labels = [], []
    for _ in range(600):
        secret = r.random() < 0.5
        rows.append("some words " + ("".join(r.choice("0123456789abcdefXYZ") for _ in range(30)) if secret else f"chapter-{r.randrange(10, 99)}-section-verse") + " and more")
        labels.append(secret)
    for _, _, raw, off in chunks(pa.array(rows)):
        start, end, _ = ss.candidates(raw, off, [], [])
        codes, owner = ss.windows(raw, off, start, end)
    assert len(codes) == len(rows) == owner[-1] + 1
    net = ss.train(codes, np.array(labels, float))
    assert net.recall >= 0.98
    assert np.mean((net.calibrated(net.logits(codes)) >= net.threshold) == labels) > 0.97


def test_gradients():
    r = np.random.default_rng(0)
    net = ss.train(np.empty((0, ss.WIDTH), np.uint8), np.empty(0))
    codes, y = r.integers(0, ss.CODES, (5, ss.WIDTH)).astype(np.uint8), np.array([0, 1, 1, 0, 1.0])

    def loss():
        z = net._forward(codes)[0]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grad = net.step(codes, y, np.ones(5))
    for k, at in (("embed", (codes[0, 30], 2)), ("conv", (7, 3)), ("conv_b", (2,)), ("out", (20,)), ("out_b", (0,))):
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-6, k


def test_redaction_and_empty(spark):
    docs = spark.createDataFrame([(1, "é password=0123456789abcdef01 ok"), (2, None)], "doc_id long, text string")
    net = ss.learn(docs)
    got = {x["doc_id"]: x["text"] for x in ss.scan(docs, net, redact="[SECRET]").collect()}
    assert got == {1: "é [SECRET] ok", 2: None}
    assert ss.digest(ss.scan(docs.limit(0), ss.learn(docs.limit(0)))).count() == 0


def test_rare_findings_are_sought_in_all_texts(spark):
    """Findings are drawn apart from the others, from any text and any place in it."""
    r = random.Random(4)
    plain_ones = lambda n: " ".join(f"page-{r.randrange(10**6)}-of-{r.randrange(10**6)}" for _ in range(n))
    rows = [(i, plain_ones(5)) for i in range(3000)]
    rows += [(5000 + i, plain_ones(60) + " password=" + "".join(r.choice("0123456789abcdefXYZ") for _ in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    codes, y, mark = ss.draw(docs, 500)
    assert y.sum() == 40 and 300 < len(y) - 40 <= 500 and len(set(mark)) == len(y)
    net = ss.learn(docs, 500)
    assert net.threshold <= 1 and net.recall >= 0.98


def test_no_more_than_the_bound_is_drawn_from_one_bucket(spark):
    """However the marks lie: all in one bucket of leading bits, at both ends, or fewer than the bound."""
    marks = lambda x: spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in x], "mark long")
    near = [(5 << 48) + 3 * i for i in range(1000)]
    for found in (near, [i for i in range(1000)], [*near, *((1 << 64) - 1 - i for i in range(50))], [(i << 48) + 7 for i in range(1000)]):
        last = ss.least_marks(marks(found), 300)
        assert sum(m <= last for m in found) == 300
    assert all(m <= ss.least_marks(marks(near), 1000) for m in near)


def test_stretches_beside_base_findings_are_scored(spark):
    net = ss.train(np.empty((0, ss.WIDTH), np.uint8), np.empty(0))
    net.threshold = 0.0  # every candidate that is scored becomes a finding
    rows = ["é AKIA" + "Q" * 16 + "/wJalrXUtnFEMI7K8 ok", "1234567890123456-app-key9x8y7z", "AKIA" + "Q" * 16 + "/short"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in ss.scan(docs, net, redact="*").collect()}
    assert [got[i]["text"] for i in range(3)] == ["é ** ok", "**", "*/short"]
    assert [[s["kind"] for s in got[i]["findings"]] for i in range(3)] == [["access", "cnn"], ["hex", "cnn"], ["access"]]


def test_whole_candidates_are_seen():
    """What sets a long candidate off may be anywhere in it."""
    rows = ["x " + "a" * 300, "x " + "a" * 250 + "QZQZQ" + "a" * 45, "x " + "a" * 52, "b" * 12]
    ((_, _, raw, off),) = chunks(pa.array(rows))
    start, end, _ = ss.candidates(raw, off, [], [])
    codes, owner = ss.windows(raw, off, start, end)
    assert np.bincount(owner).tolist() == [7, 7, 2, 1]
    want = ss._CODE[np.frombuffer(b"QZQZQ", np.uint8)]
    assert any((row[ss.LEFT + i : ss.LEFT + i + 5] == want).all() for row in codes[owner == 1] for i in range(ss.INSIDE - 4))
    for k in range(4):  # every five neighbouring bytes of a candidate are in one of its pieces
        mine = codes[owner == k]
        text = ss._CODE[raw[start[k] : end[k]]]
        have = {tuple(row[ss.LEFT + i : ss.LEFT + i + 5]) for row in mine for i in range(ss.INSIDE - 4)}
        assert all(tuple(text[i : i + 5]) in have for i in range(len(text) - 4))
    assert ss.best_piece(np.arange(len(owner), dtype=float), owner).tolist() == [6, 13, 15, 16]


def test_candidates():
    rows = ["short words only", "ab12cd x1y2", "password: hunter token=abcdef, secret=abc", "characteristics", "AKIA" + "Q" * 16 + "/tail99"]
    ((_, _, raw, off),) = chunks(pa.array(rows))
    base, short, read = ss.findings(raw, off)
    assert raw[~read].tobytes() == b"password: token=secret="
    start, end, hit = ss.candidates(raw, off, base, short, rest=True)
    got = [(raw[a:b].tobytes().decode(), bool(h)) for a, b, h in zip(start, end, hit, strict=True)]
    assert got == [("ab12cd", False), ("hunter", False), ("token=abcdef", False), ("secret=abc", False), ("characteristics", False), ("AKIA" + "Q" * 16 + "/tail99", True), ("/tail99", False)]


def test_network_on_a_table_with_both_labels(spark):
    """Against brute force over a table: secrets that no pattern names are found, words, numbers and identifiers are not."""
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters[:12]) for _ in range(r.randrange(3, 18)))
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows, hidden = [], {}
    for i in range(1500):
        w = [word() for _ in range(30)]
        if i % 3 == 0:
            w[7] = r.choice(["token = ", "api_key: ", "password="]) + key(r.randrange(20, 40))
        if i % 5 == 0:
            w[12] = r.choice([f"2024-{r.randrange(10, 99)}-11", f"figure{r.randrange(99)}", f"555-{r.randrange(1000, 9999)}"])
        if i % 30 == 1:
            w[20] = "bearer " + key(32)
            hidden[i] = w[20].split()[1]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    net = ss.learn(docs)
    assert net.threshold <= 1 and net.recall >= 0.98 and net.precision > 0.9
    found = wrong = 0
    for x in ss.scan(docs, net).collect():
        for s in x["findings"]:
            if s["kind"] == "cnn":
                assert s["score"] >= net.threshold
                hit = x["text"][s["start"] : s["end"]] == hidden.get(x["doc_id"])
                found, wrong = found + hit, wrong + (not hit)
            elif s["kind"] == "assign":
                assert s["score"] is not None
    assert found >= 0.9 * len(hidden) and wrong <= 0.1 * len(hidden)


def test_a_flood_of_short_values_is_no_quadratic_work():
    ((_, _, raw, off),) = chunks(pa.array(["token=abcdef " * 60_000]))
    base, short, read = ss.findings(raw, off)
    assert not base and len(ss.candidates(raw, off, base, short)[0]) == 60_000
