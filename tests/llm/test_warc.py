import base64
import gzip
import hashlib

from pixelquarry.llm import warc

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- gone <p> -->
<p>One <b>two</b>  three<br>four</p><script>var t="</p>";</script><a href="/x?a=1&amp;b=2" title="a > b">link</a>
<ul><li>ä&nbsp;ö<li>&lt;tag&gt;</ul><a href='http://other.org/'>o</a><a href=/x?a=1&b=2>again</a><footer>&copy; me</footer></body></html>"""


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_text_and_links():
    assert warc.visible_text(PAGE) == "One two three\nfour\nlink\nä ö\n<tag>\noagain\n© me"
    assert warc.page_links(PAGE, "http://h.org/d/e") == ["http://h.org/x?a=1&b=2", "http://other.org/"]
    assert warc.visible_text("<p>open <script>x") == "open" and warc.visible_text("a < b <p") == "a < b <p"


def test_records_link_and_round_trip(spark):
    rows = [(1, "http://h.org/d/e", PAGE), (2, None, None), (3, "http://h.org/", ""), (None, "u", "x"), (1, "http://h.org/d/e", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record_id", "'d' AS date", "2 AS payload")
    got = warc.derivatives(warc.responses_from_pages(pages)).collect()
    assert len(got) == 2 * len(rows)
    for source, url, page in rows:
        mine = [x for x in got if x["source_id"] == source]
        meta, text = (next(x for x in mine if x["warc_type"] == k) for k in ("metadata", "conversion"))
        data = (page or "").encode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
        assert meta["refers_to"] == text["refers_to"] == text["headers"]["WARC-Refers-To"]
        assert text["headers"]["WARC-Concurrent-To"] == meta["record_id"] != text["record_id"]
        assert meta["source_payload_digest"] == sha(data) and meta["source_block_digest"] == sha(http + data)
        assert f"source-header-content-length: {len(data)}\r\n" in meta["content"] and "source-status: HTTP/1.1 200 OK\r\n" in meta["content"]
        for x in (meta, text):
            assert x["block_digest"] == sha(x["content"].encode()) == x["headers"]["WARC-Block-Digest"]
            assert int(x["headers"]["Content-Length"]) == x["content_length"] == len(x["content"].encode())
            assert x["headers"].get("WARC-Target-URI", "") == (url or "")
    assert "title: A & B\r\n" in next(x for x in got if x["source_id"] == 1 and x["warc_type"] == "metadata")["content"]
    records = warc.written(warc.derivatives(warc.responses_from_pages(pages))).collect()
    parsed = list(warc.parse_records(b"".join(bytes(r["record"]) for r in records)))
    assert [(h, c.decode()) for h, c in parsed] == [(dict(x["headers"]), x["content"]) for x in got]


def test_from_files(spark, tmp_path):
    block = b"HTTP/1.1 404 Gone\r\nX-A: b\r\n\r\n<p>hi \xff</p>"
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block))}
    data = warc.record_bytes({"WARC-Type": "warcinfo", "Content-Length": "0"}, b"") + warc.record_bytes(head, block)
    (tmp_path / "a.warc").write_bytes(data + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.derivatives(warc.responses_from_files(spark.read.format("binaryFile").load(str(tmp_path)))).collect()
    assert len(got) == 4
    for x in got:
        assert x["refers_to"] == "<urn:uuid:1>" and x["source_block_digest"] == sha(block) and x["source_payload_digest"] == sha(b"<p>hi \xff</p>")
        assert x["content"] == "hi �" if x["warc_type"] == "conversion" else "source-header-x-a: b\r\n" in x["content"]
    assert warc.derivatives(warc.responses_from_files(spark.createDataFrame([], "content binary"))).count() == 0


def test_source_headers_and_digests_are_kept(spark):
    """Odd header bytes never change a digest; what the source declares stands, and is compared with its bytes."""
    http, page = b"HTTP/1.1 200 OK\r\nX-Odd: \xff\xfe\r\n\r\n", b"<p>hi"
    hexed = "SHA-256:" + hashlib.sha256(page).hexdigest()
    head = {"WARC-Type": "response", "warc-record-id": "<urn:uuid:9>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-IP-Address": "1.2.3.4"}
    files, want = [], []
    for declared, ok in (({}, None), ({"WARC-Block-Digest": sha(http + page), "WARC-Payload-Digest": hexed}, True), ({"WARC-Block-Digest": sha(b"else")}, False), ({"WARC-Payload-Digest": "crc:1"}, None)):
        files.append((f"f{len(files)}", warc.record_bytes(head | declared | {"Content-Length": str(len(http + page))}, http + page)))
        want.append((declared.get("WARC-Block-Digest", sha(http + page)), declared.get("WARC-Payload-Digest", sha(page)), ok))
    for f, w in zip(files, want, strict=True):
        got = warc.derivatives(warc.responses_from_files(spark.createDataFrame([f], "path string, content binary"))).collect()
        assert len(got) == 2 and len({x["source_id"] for x in got}) == 1 and got[0]["source_id"] is not None
        for x in got:
            assert (x["source_block_digest"], x["source_payload_digest"], x["source_digest_ok"]) == w
            assert x["refers_to"] == "<urn:uuid:9>" and x["headers"]["WARC-IP-Address"] == "1.2.3.4"
            if x["warc_type"] == "metadata":
                assert f"source-block-digest: {w[0]}\r\n" in x["content"] and f"computed-block-digest: {sha(http + page)}\r\n" in x["content"]
                assert "source-warc-ip-address: 1.2.3.4\r\n" in x["content"] and "source-header-x-odd: \ufffd\ufffd\r\n" in x["content"]


def record(name, content=b"x", length=None):
    return warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": name, "Content-Length": str(len(content) if length is None else length)}, content)


def test_damaged_files(spark):
    good = [record("a", b"one"), record("b", b"two" * 100), record("c")]
    names = lambda data: [h["WARC-Record-ID"] for h, _ in warc.parse_records(data)]
    assert names(b"".join(good)) == ["a", "b", "c"]
    assert names(good[0] + record("bad", b"y" * 30, "no") + good[2]) == ["a", "c"]
    assert names(good[0] + record("bad", b"y" * 30, 10**6) + good[2]) == ["a", "c"]
    assert names(good[0] + record("bad", b"y" * 30, 3) + good[2]) == ["a", "c"]
    assert names(good[0] + good[1][:-50]) == ["a"] and names(good[0] + b"WARC/1.1\r\nContent-") == ["a"]
    assert names(b"") == [] and names(b"junk") == []
    members = [gzip.compress(x) for x in good]
    assert names(b"".join(members)) == ["a", "b", "c"] and names(gzip.compress(b"".join(good))) == ["a", "b", "c"]
    assert names(b"".join(members)[:-12]) == ["a", "b"]  # a cut member
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    assert names(members[0] + bytes(broken) + members[2])[0] == "a" and names(members[0] + bytes(broken) + members[2])[-1] == "c"
    big = record("big", bytes(range(256)) * 20_000)
    assert names(gzip.compress(big) + members[0]) == ["big", "a"]
    files = spark.createDataFrame([("p", good[0] + record("bad", b"", "no") + good[2])], "path string, content binary")
    assert [tuple(x) for x in warc.damaged_records(files).collect()] == [("p", len(good[0]), "no length")]


def test_text_by_a_plain_parser(spark):
    """Against html.parser on the pages table."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden, self.links = [], [], {}

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "noscript", "template", "head"):
                self.hidden.append(tag)
            if tag == "a" and dict(attrs).get("href") is not None:
                self.links.setdefault(dict(attrs)["href"].strip())
            if tag not in warc._INLINE:
                self.out.append("\n")

        def handle_endtag(self, tag):
            if self.hidden and tag == self.hidden[-1]:
                self.hidden.pop()
            if tag not in warc._INLINE:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert pages
    for page in pages:
        plain = Plain()
        plain.feed(page or "")
        plain.close()
        lines = (" ".join(x.split()) for x in "".join(plain.out).split("\n"))
        text, links, _ = warc.page_parts(page or "", "http://h.org/")
        assert text == "\n".join(x for x in lines if x)
        assert links == list(dict.fromkeys(warc.urljoin("http://h.org/", x) for x in plain.links))


def test_long_broken_pages_take_linear_time():
    import time

    for bit in ("<head ", "<head>", "<script", "<script>", "<title>", "<!", "<?", "<!--", "<a ", '<a "', "<a '\"", "</script ", "<p a='>", "<a href=\"x\" "):
        times = []
        for n in (20_000, 160_000):
            begin = time.process_time()
            warc.page_parts(bit * n)
            times.append(time.process_time() - begin)
        assert times[1] < 20 * times[0] + 0.3, (bit, times)
