"""WARC derivatives: for each response record a linked metadata record and a plain-text conversion record.

Both name the response (``WARC-Refers-To``, its target URI and date) and keep its ``WARC-IP-Address``; the conversion also
names the metadata record (``WARC-Concurrent-To``).  The metadata record keeps what the source said of itself: every WARC
header of its record, its HTTP status line and headers, its digests, its title and links.  A digest that the source
declares is kept as it stands, next to one computed here; one that it does not declare is the computed one, and
``source_digest_ok`` tells whether those declared agree with the bytes (null: none to compare).  The conversion record
is the visible text.  New digests are SHA-1 in base 32; record ids are UUIDs made from the response's id, so a rerun
gives the same records.

Nulls: a response without a payload is one with an empty payload; one without a record id gets one from its URI and
payload; without a URI its relative links stay relative.  Repeated responses give repeated records.  Headers and payload
are bytes: what is no UTF-8 becomes U+FFFD in text, never in digests.

Archives are read record by record, a gzip member after the other.  A record whose length is missing or wrong, or that
is cut off, is no response; reading goes on at the next record, and ``damaged_records`` lists it.  One archive is one
task (Spark's ``binaryFile`` source takes files below 2 GB).
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
_RESPONSE = "record_id string, target_uri string, date string, warc_headers map<string,string>, http_headers binary, payload binary"
_DERIVED = (
    "source_id long, warc_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, block_digest string, "
    "source_block_digest string, source_payload_digest string, source_digest_ok boolean, content_length long, content string"
)

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile(r"""[<>"']""")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "noscript", "template", "head", "title")}
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements that run on in a line; all others break it.
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var wbr".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def _tag_end(page: str, at: int) -> int:
    """Where a tag whose name ends at ``at`` ends, -1 if it does not; quoted values may hold anything."""
    while m := _STOP.search(page, at):
        at = m.start()
        if page[at] == ">":
            return at + 1
        if page[at] == "<" or (at := page.find(page[at], at + 1)) < 0:
            return -1
        at += 1
    return -1


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag in order; what shows nothing (comments,
    declarations, scripts and the like) comes with the name "".  One pass: what is not found behind some place is not
    sought again behind a later one."""
    n, at, missing = len(page), 0, set()

    def behind(key: str, search, start: int) -> int:
        if key in missing:
            return -1
        end = search(start)
        if end < 0:
            missing.add(key)
        return end

    def found(needle: str):
        return lambda start: (lambda i: i + len(needle) if i >= 0 else -1)(page.find(needle, start))

    def closed(name: str):
        return lambda start: (lambda m: m.end() if m else -1)(_CLOSE[name].search(page, start))

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = behind("-->", found("-->"), at + 4)
            end = n if end < 0 else end
            yield at, end, "", False, ""
        elif page.startswith(("<!", "<?"), at):
            end = behind(">", found(">"), at + 2)
            if end > 0:
                yield at, end, "", False, ""
        elif m := _NAME.match(page, at):
            end = -1 if ">" in missing else _tag_end(page, m.end())
            name, closing = m[1].lower(), page[at + 1] == "/"
            if end > 0 and name in _HIDDEN and not closing:
                end = behind(name, closed(name), end)
                end = n if end < 0 else end
                yield at, end, "", False, ""
            elif end > 0:
                yield at, end, name, closing, page[m.end() : end - 1]
        else:
            end = -1
        at = end if end > 0 else at + 1


def page_parts(page: str, base: str = "") -> tuple[str, list[str], str | None]:
    """(visible text, targets of anchors in order, each once, title).  The text has a line per block and white space in a
    line as one space; a head that is closed shows nothing."""
    shown, links, title, at, head, heads = [], {}, None, 0, 0, True
    for start, end, name, closing, rest in markup(page):
        if at >= head:
            shown.append(page[at:start])
        at = end
        if name == "a" and not closing and (h := _HREF.search(rest)):
            link = html.unescape(next(x for x in h.groups() if x is not None)).strip()
            try:
                links.setdefault(urljoin(base, link))
            except ValueError:
                links.setdefault(link)
        elif name == "title" and not closing and title is None:
            title = html.unescape(page[end : m.start()]) if (m := _CLOSE["title"].search(page, end)) else ""
        elif name == "head" and not closing and end > head and heads:
            m = _CLOSE["head"].search(page, end)
            head, heads = (m.end(), True) if m else (head, False)
        if name and name not in _INLINE and end > head:
            shown.append("\n")
    if at >= head:
        shown.append(page[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(shown).replace("\r", "\n")).split("\n"))
    return "\n".join(line for line in lines if line), list(links), title or None


def visible_text(page: str) -> str:
    return page_parts(page)[0]


def page_links(page: str, base: str) -> list[str]:
    return page_parts(page, base)[1]


def agrees(declared: str, data: bytes) -> bool | None:
    """Whether a declared digest (algorithm:value, in base 32 or hexadecimal) is that of ``data``; null if unknown."""
    name, _, value = declared.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    own = hashlib.new(name, data).digest()
    return value.strip().lower() in (own.hex(), base64.b32encode(own).decode().lower(), base64.b32encode(own).decode().lower().rstrip("="))


def one_line(value: str) -> str:
    return " ".join(value.split())


def derive_one(source: int | None, record_id: str | None, uri: str | None, date: str | None, warc: list[tuple[str, str]] | None, http: bytes | None, payload: bytes | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    payload, http, uri, date = payload or b"", http or b"", one_line(uri or ""), date or DATE
    record_id = record_id or record_uuid(uri, digest(payload))
    warc = [(k, v or "") for k, v in warc or []]
    said = {k.lower(): v for k, v in warc}
    own, block = digest(payload), digest(http + payload)
    source_own, source_block = said.get("warc-payload-digest") or own, said.get("warc-block-digest") or block
    checks = [ok for k, data in (("warc-payload-digest", payload), ("warc-block-digest", http + payload)) if said.get(k) and (ok := agrees(said[k], data)) is not None]
    text, links, title = page_parts(payload.decode("utf-8", "replace"), uri)
    lines = http.decode("utf-8", "replace").split("\r\n")
    fields = [(f"source-warc-{k.lower().removeprefix('warc-')}", v) for k, v in warc]
    fields += [("source-status", lines[0])] if http else []
    fields += [(f"source-header-{k.strip().lower()}", v.strip()) for k, _, v in (line.partition(":") for line in lines[1:] if ":" in line)]
    fields += [("source-block-digest", source_block), ("source-payload-digest", source_own), ("computed-block-digest", block), ("computed-payload-digest", own)]
    fields += [("title", title)] if title else []
    fields += [("outlink", link) for link in links]
    metadata = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields)
    ids = {kind: record_uuid(record_id, kind) for kind in ("metadata", "conversion")}
    out = []
    for kind, content, media in (("metadata", metadata, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        data = content.encode("utf-8", "replace")
        headers = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Date": date, "WARC-Target-URI": uri, "WARC-IP-Address": said.get("warc-ip-address", ""), "WARC-Refers-To": record_id, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date}
        if kind == "conversion":
            headers["WARC-Concurrent-To"] = ids["metadata"]
        headers |= {"WARC-Block-Digest": digest(data), "Content-Type": media, "Content-Length": str(len(data))}
        headers = {k: v for k, v in headers.items() if v}
        out.append((source, kind, ids[kind], record_id, uri, list(headers.items()), digest(data), source_block, source_own, all(checks) if checks else None, len(data), data.decode()))
    return out


_MAP = pa.map_(pa.string(), pa.string())
_TYPES = [pa.int64(), *[pa.string()] * 4, _MAP, *[pa.string()] * 3, pa.bool_(), pa.int64(), pa.string()]
_FIELDS = [f.split()[0] for f in _DERIVED.split(", ")]


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per row of ``responses`` (source_id, record_id, target_uri, date, warc_headers, http_headers, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = [r for x in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True) for r in derive_one(*x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_FIELDS)

    blob = lambda c: F.col(c).cast("binary").alias(c)
    return responses.select(F.col("source_id").cast("long"), "record_id", "target_uri", "date", "warc_headers", blob("http_headers"), blob("payload")).mapInArrow(run, _DERIVED)


def responses_from_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``pages`` (page_id, url, html) as response records."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    name = F.sha2(F.concat_ws(" ", F.col("page_id").cast("string"), "url"), 256)
    dashed = F.concat_ws("-", F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("8"), F.substring(name, 14, 3)), F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12))
    record = F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))
    return pages.select(F.col("page_id").cast("long").alias("source_id"), record.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit(None).cast("map<string,string>").alias("warc_headers"), http.cast("binary").alias("http_headers"), F.col("html").cast("binary").alias("payload"))


def record_bytes(headers: dict[str, str], content: bytes) -> bytes:
    """One record as it stands in a file."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"{VERSION}\r\n{head}\r\n".encode() + content + b"\r\n\r\n"


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes, gzip members inflated one after the other; where one is broken, from the next on."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        member, begin = zlib.decompressobj(31), at
        try:
            while not member.eof and at < len(data):
                part = member.decompress(view[at : at + step])
                at += min(step, len(data) - at) - len(member.unused_data)
                yield part
        except zlib.error:
            at = begin + 2
        at = data.find(b"\x1f\x8b\x08", at)


_START = re.compile(rb"(?:\A|\n)(WARC/\d)")


def parse_records(data: bytes, problems: list[tuple[int, str]] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of the records of a file, plain or gzipped.  What is wrong with others is added to ``problems``
    with its place (in the inflated file)."""
    for _, headers, content in placed_records(data, [] if problems is None else problems):
        yield headers, content


def placed_records(data: bytes, problems: list[tuple[int, str]]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The same with the place of each record."""
    held, base, at = bytearray(), 0, 0
    for part in _then_none(inflated(data)):
        final = part is None
        if not final:
            del held[:at]
            base, at = base + at, 0
            held += part
        while m := _START.search(held, at):
            begin = m.start(1)
            body = held.find(b"\r\n\r\n", begin)
            if body < 0:
                if final:
                    problems.append((base + begin, "cut in its headers"))
                    return
                at = begin
                break
            pairs = (line.partition(":") for line in held[begin:body].decode("utf-8", "replace").split("\r\n")[1:])
            headers = {k.strip(): v.strip() for k, _, v in pairs if k.strip()}
            size = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
            end = body + 4 + int(size) if size.isdigit() and len(size) < 19 else -1
            if end > len(held) and not final:
                at = begin
                break
            if end < 0 or end > len(held):
                problems.append((base + begin, "no length" if end < 0 else "cut in its content"))
                at = body + 2
                continue
            if held[end : end + 4] != b"\r\n\r\n"[: len(held) - end] and held[end : end + 1] not in (b"", b"\r"):
                problems.append((base + begin, "wrong length"))
                at = body + 2
                continue
            yield base + begin, headers, bytes(held[body + 4 : end])
            at = end
        else:
            at = max(at, len(held) - 8)


def _then_none(parts: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from parts
    yield None


def responses_from_files(files: DataFrame) -> DataFrame:
    """Response records in ``files`` (path, content), as Spark's ``binaryFile`` source reads them; ``source_id`` is a hash
    of the path and the record's place in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for place, h, block in placed_records(blob.as_py() or b"", []):
                    said = {k.lower(): v for k, v in h.items()}
                    if said.get("warc-type") == "response":
                        head, mark, payload = block.partition(b"\r\n\r\n")
                        held.append((path.as_py(), place, said.get("warc-record-id"), said.get("warc-target-uri"), said.get("warc-date"), list(h.items()), head + mark, payload))
                        size += len(block)
                    if size > 1 << 24:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), *[pa.string()] * 3, _MAP, pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "place", *(f.split()[0] for f in _RESPONSE.split(", "))])

    named = files if "path" in files.columns else files.withColumn("path", F.lit(None).cast("string"))
    found = named.select("path", "content").mapInArrow(run, f"path string, place long, {_RESPONSE}")
    return found.withColumn("source_id", F.xxhash64("path", "place")).drop("path", "place")


def damaged_records(files: DataFrame) -> DataFrame:
    """(path, place, problem) of the records of ``files`` that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                problems: list[tuple[int, str]] = []
                for _ in placed_records(blob.as_py() or b"", problems):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(problems), pa.string()), pa.array([p for p, _ in problems], pa.int64()), pa.array([t for _, t in problems], pa.string())], names=["path", "place", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, place long, problem string")


def written(records: DataFrame) -> DataFrame:
    """Each derivative as the bytes of its record (``record``), for a binary or text sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [record_bytes(dict(h), c.encode()) for h, c in zip(batch.column("headers").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(out, pa.binary())], names=["record_id", "record"])

    return records.select("record_id", "headers", "content").mapInArrow(run, "record_id string, record binary")
