"""WARC archives of pages with a two-level capture index.

Index lines, sorted by reversed-host URL key, lie in compressed blocks; a
sparse directory keeps each block's first key. A lookup searches the part
table, then that part's directory, then the lines of one block, each by
bisection, before one range read in the archive.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm import files
from weekloom.llm.tables import arrow_map, discard, materialize, new_path

BLOCK_LINES = 300
_BREAKS = re.compile(r"[\x00-\x20\x7f]")
#: Bytes of one archive file before the next is begun.
FILE_BYTES = 256 << 20


def url_key(url: str | None) -> str:
    """Reversed-host form of a URL: ``com,example,m)/path?query``, lower-cased host, sorted query, without scheme, ``www.`` and fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return "-" + _escaped(url)
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    if parts.query:
        key += "?" + "&".join(sorted(parts.query.split("&")))
    return _escaped(key).lower()


def _escaped(key: str) -> str:
    """White space and control characters, which would break a line of the index, as %XX."""
    return _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", key)


def capture_key(url: str | None, page_id: int | None) -> bytes:
    """Key of one capture: URL key and page id, in byte order."""
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id + 2**63:020d}'}".encode()


def _target(url: str | None) -> str:
    return _escaped((url or "").strip())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, *, record_id: str | None = None, refers_to_url: str | None = None) -> bytes:
    head = [f"WARC-Record-ID: {record_id or f'<urn:page:{page_id}>'}", f"WARC-Date: {date}", f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        kind, block = "response", http + payload
    else:
        kind, block = "revisit", http
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_target(refers_to_url)}", f"WARC-Refers-To-Date: {date}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *head, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _gzip(raw: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


CAPTURES = "key binary, line string"


def _archiver(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at = "", None, 0
        for batch in batches:
            keys, lines = [], []
            for page_id, url, html, sha1, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    uri, out = files.create(folder, "pages.warc.gz")
                    at = 0
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                payload = (html or "").encode()
                # The response that others refer to has its page's name, all other records that of their place.
                named = first is not None and first == page_id and first_url == url
                record_id = None if named else f"<urn:page:{page_id}:{uri.rpartition('/')[2]}:{at}>"
                packed = _gzip(record(page_id, url, payload, digest, first if first != page_id else None, date, record_id=record_id, refers_to_url=first_url))
                out.write(packed)
                keys.append(capture_key(url, page_id))
                lines.append(json.dumps({"url": url, "digest": digest, "length": len(packed), "offset": at, "filename": uri}))
                at += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lines)], ["key", "line"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, *, folder: str | None = None, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a WARC record for each row of ``pages`` (page_id, url, html); returns the captures (key, line).

    The payload is html in UTF-8 (null: empty). Of equal payloads of at least
    ``min_revisit_bytes``, the record with the smallest page_id is a response
    and the others are revisits of it; smaller ones are all responses, and so
    are rows with a null page_id. Repeated rows are archived each. Record ids
    are unique, but that rows equal in all three columns may share one. Null URLs
    have the key ``-``. Other columns are ignored; an empty table writes nothing.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    source = source.withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    bytes_ = F.octet_length(F.coalesce("html", F.lit("")))
    firsts = source.where(F.col("page_id").isNotNull() & (bytes_ >= min_revisit_bytes)).groupBy("sha1").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("sha1", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "firsts")
    joined = source.join(firsts, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(F.col("page_id").isNotNull(), F.col("first")).alias("first"), "first_url")
    return discard(materialize(arrow_map(joined, _archiver(folder, date), CAPTURES), "captures"), firsts)


def _indexer(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, first, last, at = None, [], b"", b"", 0
        block: list[bytes] = []

        def flush() -> None:
            nonlocal at
            packed = _gzip(b"".join(block), 6)
            out.write(packed)
            directory.append(b"%s\t%d\t%d\n" % (block[0].partition(b"\t")[0], at, len(packed)))
            at += len(packed)
            block.clear()

        uri = ""
        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    uri, out = files.create(folder, "captures.cdx.gz")
                    first = key
                last = key
                block.append(key + b"\t" + line.encode() + b"\n")
                if len(block) == block_lines:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        index, sink = files.create(folder, "captures.idx")
        sink.write(b"".join(directory))
        sink.close()
        yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "blocks": [uri], "directory": [index]})

    return run


def write_index(captures: DataFrame, *, folder: str | None = None, block_lines: int = BLOCK_LINES) -> list[tuple[bytes, bytes, str, str]]:
    """Sort the captures by key into compressed blocks with a sparse directory for each part; returns the part table."""
    spark = captures.sparkSession
    folder = folder or new_path(spark, "index")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = arrow_map(captures.repartitionByRange(n, "key").sortWithinPartitions("key"), _indexer(folder, block_lines), "first binary, last binary, blocks string, directory string")
    return sorted((bytes(r.first), bytes(r.last), r.blocks, r.directory) for r in materialize(parts, "parts").collect())


class CaptureIndex:
    """Bisection in the part table, a part's directory, and a block's lines."""

    def __init__(self, parts: list[tuple[bytes, bytes, str, str]], keep: int = 16):
        self.parts, self.firsts, self.keep = parts, [p[0] for p in parts], keep
        self.held: OrderedDict[str, object] = OrderedDict()

    def _hold(self, name: str, make):
        if name not in self.held:
            while len(self.held) >= self.keep:
                old = self.held.popitem(last=False)[1]
                if hasattr(old, "close"):
                    old.close()
            self.held[name] = make()
        self.held.move_to_end(name)
        return self.held[name]

    def _directory(self, uri: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        with files.open_range(uri) as f:
            rows = [x.split(b"\t") for x in f.read().splitlines()]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _block(self, uri: str, offset: int, length: int) -> tuple[list[bytes], list[bytes]]:
        raw = self._hold(uri, lambda: files.open_range(uri)).read_at(length, offset)
        rows = [x.split(b"\t", 1) for x in zlib.decompress(raw, 31).split(b"\n")[:-1]]
        return [r[0] for r in rows], [r[1] for r in rows]

    def find_all(self, key: bytes) -> list[dict]:
        """The index lines of all captures with a key; equal keys lie in one part, maybe in several of its blocks."""
        k = bisect_right(self.firsts, key) - 1
        if k < 0 or key > self.parts[k][1]:
            return []
        _, _, blocks, directory = self.parts[k]
        firsts, places = self._hold(directory, lambda: self._directory(directory))
        out = []
        for j in range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key)):
            keys, lines = self._hold(f"{blocks}#{j}", lambda j=j: self._block(blocks, *places[j]))
            out += lines[bisect_left(keys, key) : bisect_right(keys, key)]
        return [json.loads(x) for x in out]

    def find(self, key: bytes) -> dict | None:
        """The index line of a capture, the last one of equal keys; None if there is none."""
        found = self.find_all(key)
        return found[-1] if found else None

    def fetch(self, line: dict) -> tuple[dict[str, str], dict[str, str], bytes]:
        """Range-read one record of an archive and parse it."""
        archive = self._hold(line["filename"], lambda: files.open_range(line["filename"]))
        return parse_record(zlib.decompress(archive.read_at(line["length"], line["offset"]), 31))


def _reader(parts: list[tuple[bytes, bytes, str, str]], strict: bool):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = CaptureIndex(parts), None
        for batch in batches:
            out = {"page_id": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": []}
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == last:  # requests come sorted, and one of a key gives all its captures
                    continue
                last = key
                lines = index.find_all(key)
                if strict and not lines:
                    raise ValueError(f"no capture of {key!r}")
                for line in lines:
                    fields, http, payload = index.fetch(line)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{line['filename']} at {line['offset']}: the payload doesn't have its digest")
                    refers = fields.get("WARC-Refers-To")
                    for name, value in zip(out, (page_id, int(http["Content-Length"]), digest, fields["WARC-Type"], int(refers[len("<urn:page:") : -1]) if refers else None), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [capture_key(u, p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], ["key", "page_id"])


def read_back(wanted: DataFrame, parts: list[tuple[bytes, bytes, str, str]], *, strict: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the captures of ``wanted`` (page_id, url).

    Requests are sorted by key, so that a task meets few blocks. Each capture of
    a requested page and URL gives one row, however often it is requested or
    archived. A request without a capture gives no row, or an error if ``strict``.
    """
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = arrow_map(wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), _keys, "key binary, page_id long")
    return arrow_map(keyed.repartitionByRange(n, "key").sortWithinPartitions("key"), _reader(parts, strict), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
