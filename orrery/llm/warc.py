"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response keeps its identifier, and both derivatives refer to it: WARC-Refers-To, and the target
URI and date of the source. The metadata record (application/warc-fields) holds the source's HTTP
status and headers, its payload digest and the outgoing links; the conversion record holds the plain
text of the page, block by block, scripts and styles left out. Digests are SHA-1 in base 32, the
sources' own are carried over, and computed where a source has none.

Identifiers are UUIDs of version 5 from the source's identifier and the record type, so a job that
runs again writes the same records.

Defined results: a response without payload, or of another content type than HTML or plain text,
has a metadata record and an empty conversion record. Null URIs and dates are left out of the
headers. Responses without identifier get one from their URI and payload digest. Repeated
responses give repeated records. Chunked, gzip, deflate and zstd payloads are decoded; one that can't be
keeps its bytes, and its metadata record has a payloadError. A record of a file that is cut off or
isn't one ends that file: the records before it count, and read_errors() names it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .html import blocks

LENIENT_DATE = "1970-01-01T00:00:00Z"
RESPONSE = "key long, record_id string, target_uri string, date string, status string, http_headers array<struct<name:string,value:string>>, payload binary, payload_digest string"
DERIVED = "key long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_status string, source_headers array<struct<name:string,value:string>>, source_digest string, block_digest string, content_length long, block string"
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(p or '' for p in parts))}>"


def dechunked(data: bytes) -> bytes:
    """The body of a chunked message, as far as it goes."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = int(data[at:end].split(b";")[0].strip() or b"0", 16)
        if size == 0:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def inflated(data: bytes, wbits: int) -> bytes:
    """The content of a compressed body, as far as it goes."""
    unpacker = zlib.decompressobj(wbits)
    return unpacker.decompress(data) + unpacker.flush()


def decoded(payload: bytes, headers: list[dict]) -> tuple[bytes, str | None]:
    """The content without transfer and content codings, and what is wrong with it; a coding that can't be undone leaves the bytes of before."""
    codings = [c.strip().lower() for name in ("content-encoding", "transfer-encoding") for h in headers if (h["name"] or "").lower() == name for c in (h["value"] or "").split(",")]
    wrong = None
    for coding in reversed([c for c in codings if c not in ("", "identity")]):
        try:
            if coding == "chunked":
                payload = dechunked(payload)
            elif coding in ("gzip", "x-gzip"):
                payload = inflated(payload, 31)
            elif coding == "deflate":
                try:
                    payload = inflated(payload, 15)
                except zlib.error:  # many servers send it without its header
                    payload = inflated(payload, -15)
            elif coding == "zstd":
                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
            else:
                wrong = f"unknown coding {coding}"
        except (ValueError, zlib.error, zstandard.ZstdError) as e:
            wrong = f"{coding}: {e}"
    return payload, wrong


def derived(row: dict) -> Iterator[dict]:
    """The metadata and the conversion record of one response."""
    payload, headers = row["payload"] or b"", row["http_headers"] or []
    source = row["payload_digest"] or digest(payload)
    payload, wrong = decoded(payload, headers)
    origin = row["record_id"] or identifier("response", row["target_uri"], source)
    kind = next((h["value"] or "" for h in headers if (h["name"] or "").lower() == "content-type"), "text/html").lower()
    charset = m[1] if (m := re.search(r"charset=\"?([\w.-]+)", kind)) else "utf-8"
    try:
        text = payload.decode(charset, "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    is_html = "html" in kind
    plain = "\n".join(b.text for b in blocks(text)) if is_html else text if kind.startswith("text/plain") else ""
    fields = [("fetchStatus", row["status"]), ("payloadDigest", source), *([("payloadError", wrong)] if wrong else []), *((f"header-{h['name']}", h["value"]) for h in headers)]
    fields += [("outlink", next(x for x in (*m.groups(), "") if x is not None)) for m in _LINK.finditer(text)] if is_html else []
    meta = "".join(f"{k}: {' '.join((v or '').split())}\r\n" for k, v in fields)
    for kind, content_type, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", plain)):
        data = block.encode()
        yield {
            "key": row["key"], "record_type": kind, "record_id": identifier(kind, origin), "refers_to": origin, "target_uri": row["target_uri"], "date": row["date"], "content_type": content_type,
            "source_status": row["status"], "source_headers": headers, "source_digest": source, "block_digest": digest(data), "content_length": len(data), "block": block,
        }


def _derivatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), *((k, pa.string()) for k in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_status")), ("source_headers", _PAIRS), ("source_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("block", pa.string())])
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            yield pa.RecordBatch.from_pylist([d for row in batch.slice(a, 1000).to_pylist() for d in derived(row)], schema=schema)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response, of the columns in DERIVED. responses: the columns in RESPONSE."""
    return responses.mapInArrow(_derivatives, DERIVED)


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = LENIENT_DATE) -> DataFrame:
    """Pages as response records: status 200, HTML in UTF-8; their identifiers come from the row's id and URL."""
    html = F.coalesce(pages[html_col], F.lit(""))
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    uid = F.md5(F.concat_ws("\x00", F.lit("response"), pages[id_col].cast("string"), pages[url_col]))
    return pages.select(
        pages[id_col].cast("long").alias("key"),
        F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * bool(k) + [F.substring(uid, a, n)])), F.lit(">")).alias("record_id"),
        pages[url_col].alias("target_uri"), F.lit(date).alias("date"), F.lit("HTTP/1.1 200 OK").alias("status"),
        F.array(pair("Content-Type", F.lit("text/html; charset=utf-8")), pair("Content-Length", F.octet_length(html).cast("string"))).alias("http_headers"),
        html.cast("binary").alias("payload"), F.lit(None).cast("string").alias("payload_digest"),
    )


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record of a WARC file, as a gzip member of its own; headers of null value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def serialised(records: DataFrame) -> DataFrame:
    """key, data: derivative records as gzip members; members one after the other are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for r in batch.to_pylist():
                names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"))
                data.append(record_bytes([(k, r[c]) for k, c in names], (r["block"] or "").encode()))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "data": pa.array(data, pa.binary())})

    return records.mapInArrow(run, "key long, data binary")


class _Members(io.RawIOBase):
    """The content of gzip members one after the other; damage ends it, so that what came before can be read, and is kept as error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.rest, self.unpacker, self.begun, self.error = data, 0, b"", zlib.decompressobj(31), False, None

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while self.error is None:
            if not self.rest:
                self.rest = self.data[self.at : self.at + 65536]
                self.at += len(self.rest)
            last = not self.rest
            if last and not self.begun:
                return 0
            try:
                out, self.begun = self.unpacker.decompress(self.rest, len(room)), True
            except zlib.error as e:
                self.error = str(e)
                return 0
            if self.unpacker.eof:
                self.rest, self.unpacker, self.begun = self.unpacker.unused_data, zlib.decompressobj(31), False
            else:
                self.rest = self.unpacker.unconsumed_tail
                if last and not out:
                    self.error = "a compressed record is cut off"
            if out:
                room[: len(out)] = out
                return len(out)
        return 0


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file, gzip or plain; a record that is cut off raises ValueError."""
    members = _Members(data) if data[:2] == b"\x1f\x8b" else None
    yield from _records(io.BufferedReader(members or io.BytesIO(data)))
    if members and members.error:
        raise ValueError(members.error)


def _records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers, name = {}, ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and name:
                headers[name] += " " + line.strip().decode()
            else:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        if not line:
            raise ValueError("the headers of a WARC record are cut off")
        length = headers.get("content-length", "0")
        if not length.isdecimal():
            raise ValueError(f"no length of a WARC record: {length!r}")
        block = stream.read(int(length))
        if len(block) != int(length):
            raise ValueError("a WARC record is cut off")
        yield headers, block


def _response(key: int, h: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    pairs = [{"name": a.strip(), "value": b.strip()} for a, _, b in (x.partition(":") for x in lines if x)]
    return {"key": key, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "status": status, "http_headers": pairs, "payload": payload, "payload_digest": h.get("warc-payload-digest")}


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("file"), "content")


def read_responses(spark, path: str) -> DataFrame:
    """The response records of WARC files, each file whole in one task (files of the usual gigabyte fit).

    key: the hash of the file's path in the upper 40 bits, the record's place in the file in the lower 24.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), *((c, pa.string()) for c in ("record_id", "target_uri", "date", "status")), ("http_headers", _PAIRS), ("payload", pa.binary()), ("payload_digest", pa.string())])
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    for k, (h, block) in enumerate(parsed(data)):
                        if h.get("warc-type") == "response":
                            yield pa.RecordBatch.from_pylist([_response((file >> 24 << 24) + k, h, block)], schema=schema)
                except ValueError:  # read_errors() names it
                    continue

    return _files(spark, path).mapInArrow(run, RESPONSE)


def read_errors(spark, path: str) -> DataFrame:
    """path, n_records (whole ones before), error: the WARC files that end in a bad record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"path": [], "n_records": [], "error": []}
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                n = 0
                try:
                    for _ in parsed(data):
                        n += 1
                except ValueError as e:
                    for k, v in zip(out, (name, n, str(e)), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({"path": pa.array(out["path"], pa.string()), "n_records": pa.array(out["n_records"], pa.int64()), "error": pa.array(out["error"], pa.string())})

    return _files(spark, path).mapInArrow(run, "path string, n_records long, error string")
