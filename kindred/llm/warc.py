"""WARC archives: a writer with revisit records and a salvaging reader.

Writer: each task writes archives of gzip members, one record a member, and reports them in a manifest table; a record
of a task that was lost is in no manifest.  Archives are closed at ``ARCHIVE_BYTES``, so a reader's memory is bounded by
that and the largest record.  Files are written through ``pyarrow.fs`` to the shared folder.

Reader: members (or plain records) are read one after the other.  A record is checked for its version line, headers,
declared length, closing blank lines and digests.  Where a check fails, the reader searches for the next gzip member that
inflates to a version line, or the next plain version line, goes on there, and logs the bytes between as a
quarantined gap; whatever follows a damaged record is recovered.  A declared length is checked against the bytes at its end before
the record is read, and a member is inflated no further than the length that it declares, so damage doesn't fill the memory.

Defined cases: a null payload is empty; a null url is written as an empty target; payloads below ``least`` bytes are
always responses; among equal payloads the largest page_id is the response, and all rows that carry it are responses;
a null page_id is written as an empty one and never is the largest unless all are null.  An empty table writes nothing
and reads nothing.  A payload may have any length that fits into a string.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm.workspace import Workspace, filesystem

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 1000
_VERSION = b"WARC/1.1"
_GZIP = b"\x1f\x8b\x08"
_STEP, _WINDOW, _MOST_HEADERS = 1 << 16, 1 << 18, 1 << 24
#: Payloads that are so frequent that no more than this many can be are sent to all tasks, as one may be that of a third of all pages.
HOT = 65_536
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: object) -> str:
    """A header value: on one line, whatever the table held."""
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value))


def build_record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, payload_digest: str | None = None) -> bytes:
    """One record; a revisit carries the HTTP head and the digest of the payload, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", _clean(uri)), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", payload_digest or _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http;msgtype=response"),
    ]
    if kind == "revisit":
        lines += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    lines.append(("Content-Length", str(len(block))))
    return _VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 4) -> bytes:
    """A record as a gzip member of its own."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


class _Bad(Exception):
    pass


class _Source:
    """A seekable file, of which a window is held."""

    def __init__(self, file) -> None:
        self.file, self.base, self.data = file, 0, b""
        file.seek(0, 2)
        self.end = file.tell()

    def some(self, at: int) -> bytes:
        """One step of bytes from ``at`` on, or what the window has of it; none only at the end."""
        if not self.base <= at < self.base + len(self.data):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(_WINDOW)
        start = at - self.base
        return self.data[start : start + _STEP]

    def exactly(self, at: int, size: int) -> bytes:
        """Bytes that the file is known to have."""
        if self.base <= at and at + size <= self.base + len(self.data):
            return self.data[at - self.base : at - self.base + size]
        self.file.seek(at)
        return self.file.read(size)


def _headers(data: bytes) -> tuple[dict[str, str], int, int] | None:
    """Headers of the record that begins here, their size and the declared length of the block; None if more bytes are needed."""
    line = data.find(b"\r\n")
    if not re.match(rb"WARC/1\.[0-9]", data[:8]) and len(data) >= 8 or (line < 0 and len(data) > 64):
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        if len(data) > _MOST_HEADERS:
            raise _Bad("headers do not end")
        return None
    headers: dict[str, str] = {}
    for row in data[line + 2 : end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            raise _Bad("malformed header")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        raise _Bad("no length")
    if not headers.get("warc-type") or not headers.get("warc-record-id"):
        raise _Bad("mandatory header missing")
    return headers, end + 4, int(headers["content-length"])


def _checked(headers: dict[str, str], block: bytes) -> bytes:
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and _hex(want) != _hex(_digest(block)):
        raise _Bad("block digest differs")
    return block


def _plain_record(source: _Source, at: int) -> Record:
    head = b""
    while (found := _headers(head)) is None:
        more = source.some(at + len(head))
        if not more:
            raise _Bad("record is cut off")
        head += more
    headers, size, length = found
    stop = at + size + length
    if stop + 4 > source.end:
        raise _Bad("record is cut off")
    if source.exactly(stop, 4) != b"\r\n\r\n":
        raise _Bad("length does not fit")
    return Record(at, size + length + 4, headers, _checked(headers, source.exactly(at + size, length)))


def _member_record(source: _Source, at: int) -> Record:
    inflate, plain, fed, found = zlib.decompressobj(31), bytearray(), at, None
    tail = b""
    while not inflate.eof:
        if not tail:
            tail = source.some(fed)
            fed += len(tail)
            if not tail:
                raise _Bad("member is cut off")
        try:
            plain += inflate.decompress(tail, 1 << 20)
        except zlib.error as e:
            raise _Bad("member does not inflate") from e
        tail = inflate.unconsumed_tail
        if found is None:
            found = _headers(bytes(plain[: _MOST_HEADERS + 1]))
        if found is not None and len(plain) > found[1] + found[2] + 4:
            raise _Bad("member is not one record")
    if found is None or len(plain) != found[1] + found[2] + 4 or not plain.endswith(b"\r\n\r\n"):
        raise _Bad("member is not one record")
    used = fed - len(inflate.unused_data) - at
    return Record(at, used, found[0], _checked(found[0], bytes(plain[found[1] : found[1] + found[2]])))


def _next_mark(source: _Source, at: int) -> int:
    """The next place where a record may begin, or the file's end."""
    while data := source.some(at):
        if len(data) < 7 and at + len(data) < source.end:  # the window ends within a mark
            data = source.exactly(at, min(_STEP, source.end - at))
        spots = [p for m in (_GZIP, b"WARC/1.") if (p := data.find(m)) >= 0]
        if spots:
            return at + min(spots)
        at += max(1, len(data) - 6)
    return source.end


def read_records(file) -> Iterator[Record | Gap]:
    """Records of an open archive that can be sought in, and the gaps between them, in file order."""
    source = _Source(file)
    at, lost, reason = 0, None, ""
    while at < source.end:
        try:
            gzip = source.exactly(at, min(3, source.end - at)) == _GZIP
            record = _member_record(source, at) if gzip else _plain_record(source, at)
        except _Bad as e:
            if lost is None:
                lost, reason = at, str(e)
            at = _next_mark(source, at + 1)
            continue
        if lost is not None:
            yield Gap(lost, at - lost, reason)
            lost = None
        at += record.length
        yield record
    if lost is not None:
        yield Gap(lost, source.end - lost, reason)


def _hex(digest: str | None) -> str | None:
    """The bare hexadecimal form of a ``sha1:`` digest, which archives write in base 32."""
    value = (digest or "").removeprefix("sha1:")
    if re.fullmatch(r"[A-Z2-7]{32}", value):
        return base64.b32decode(value).hex()
    return value.lower() or None


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """Body of an HTTP message, and the length that its head states."""
    head, _, body = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head.replace(b"\r", b""))
    return body, int(stated[1]) if stated else None


def plan_revisits(pages: DataFrame, ws: Workspace, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, digest, original``: ``original`` is the page that a revisit refers to, else null.

    Payloads that several pages have are counted first, and pages are joined to that narrow table; pages with a short payload find
    nothing there, and each of them has a key of its own.  The most frequent payloads, of which there are ``HOT`` at most, are sent to all tasks, so a key of
    the shuffled join has no more rows than the ``HOT``-th part of all copies.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    big = F.octet_length("html") >= least
    copies = pages.where(big).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = ws.save(copies.select(F.col("digest").alias("_key"), "first", "k"), "copies")
    limit = (copies.agg(F.sum("k")).first()[0] or 0) // HOT
    hot = F.broadcast(copies.where(F.col("k") > limit).select(F.col("_key").alias("digest"), F.col("first").alias("_hot")))
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    pages = pages.join(hot, "digest", "left").withColumn("_key", F.when(big & F.col("_hot").isNull(), F.col("digest")).otherwise(alone))
    joined = pages.join(copies.where(F.col("k") <= limit).select("_key", "first"), "_key", "left").withColumn("first", F.coalesce("_hot", "first"))
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("original"))


def _urn(page: object) -> str:
    return f"urn:page:{'' if page is None else quote(str(page), safe='')}"


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of :func:`plan_revisits` when run; rows of the result are the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, html, original, digest in zip(*[batch.column(c) for c in ("page_id", "url", "html", "original", "digest")]):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                refers = original.as_py()
                shown = "sha1:" + base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                data = member(build_record("response" if refers is None else "revisit", _urn(page.as_py()), url.as_py(), payload, None if refers is None else _urn(refers), shown))
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (name, size, count)], None
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "bytes", "records"])

    return planned.mapInArrow(run, "name string, bytes long, records long")


RECORD_SCHEMA = "archive string, offset long, length long, gap string, kind string, record_id string, uri string, refers_to string, payload_sha1 string, payload_bytes long, payload binary"


def read_archives(names: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``gap`` holds the reason) of the archives ``names(name)`` in ``folder``.

    A response whose payload doesn't have the digest that it states is a gap as well.
    """
    columns = [c.split() for c in RECORD_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def rows(name: str, file) -> Iterable[tuple]:
        for x in read_records(file):
            if isinstance(x, Gap):
                yield (name, x.offset, x.length, x.reason, *[None] * 7)
                continue
            h = x.headers
            body, stated = http_payload(x.block)
            kind = h.get("warc-type")
            if kind == "response" and "warc-payload-digest" in h and _hex(h["warc-payload-digest"]) != _hex(_digest(body)):
                yield (name, x.offset, x.length, "payload digest differs", *[None] * 7)
                continue
            size = stated if kind == "revisit" and stated is not None else len(body)
            yield name, x.offset, x.length, None, kind, h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, _hex(h.get("warc-payload-digest")), size, body if payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*held)) if held else [()] * len(columns)
            return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, columns)], names=[c for c, _ in columns])

        for batch in batches:
            for name in batch.column("name").to_pylist():
                held, size = [], 0
                with store.open_input_file(f"{root}/{name}") as file:
                    for row in rows(name, file):
                        held.append(row)
                        size += 500 + len(row[-1] or b"")
                        if size > 4 << 20:
                            yield batch_of(held)
                            held, size = [], 0
                yield batch_of(held)

    return names.select("name").mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives and reads those back: one row a record.

    All that was read is written as a table, the gaps among it as the table ``quarantine``.  It is an error if there is any gap, or if other than
    the manifest's number of records came back.
    """
    spark: SparkSession = pages.sparkSession
    ws = Workspace(spark, "warc")
    manifest = ws.save(write_archives(plan_revisits(pages, ws), ws.path("archives")), "manifest")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = pages.schema["page_id"].dataType
    found = ws.save(read_archives(manifest.repartition(n, "name"), ws.path("archives"), payloads=False), "found")
    written = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    read, gaps = found.agg(F.count(F.when(F.col("gap").isNull(), 1)), F.count("gap")).first()
    if gaps or read != written:
        ws.save(found.where("gap IS NOT NULL").select("archive", "offset", "length", "gap"), "quarantine")
        raise RuntimeError(f"{written} records were written, {read} were read and {gaps} gaps found; see {ws.path('quarantine')}")
    ws.drop("archives", "copies")
    page = lambda c: F.url_decode(F.substr(c, F.lit(10))).try_cast(kind)
    return found.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("kind").alias("record_type"), page(F.col("refers_to")).alias("refers_to"))
