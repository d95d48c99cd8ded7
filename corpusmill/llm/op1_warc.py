"""WARC: writing archives, normalising monolithic gzip files, and reading by offset.

Some writers compress a whole WARC file as one gzip stream, which makes it unreadable from
the middle. ``normalise`` inflates such a stream once, in pieces of fixed size, finds the
record boundaries, rewrites every record as a gzip member of its own and gives a sidecar
index (offset, length, record id, page, type). ``read_member`` then reads any record alone.

In Spark an archive is one row (archive, content): pages are written to archives of about
``archive_bytes``, kept as a table in the shared folder, normalised by one task each and
read back record by record. No task holds more than one archive and one record; an archive
is closed by the record that brings it over its size, so it is larger by one record at most.
``read_files`` takes ``.warc.gz`` files of any gzip layout from a path that Spark can read,
``write_files`` puts normalised archives and their indexes (``.cdx``) into a folder of a
shared file system.

Records are WARC/1.1: a response holds an HTTP head and the payload, a revisit the head
only. Record ids are unique, made of the place of writing, so a retried task gives the same
ones; ``date`` stands for the time of capture, which pages don't have.

Payloads that repeat are stored once: of equal payloads of at least ``least`` bytes the
one with the smallest page id is a response, the others are revisit records that refer to
it and carry digest and length of the full payload but no body.

Defined results: a null payload is empty. A null page id is never referred to while
another page has the payload; pages that share payload and smallest id are all responses.
Repeated rows are written as often as they occur. Payloads of any length are stored whole. An
empty table gives no archives. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small_batches

CRLF = b"\r\n"
INDEX = "array<struct<offset:bigint,length:bigint,record_id:string,page_id:bigint,record_type:string>>"
PIECE = 1 << 16
#: pages carry no time of capture
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("8a0f0e0c-6a51-5c0f-9d0a-3f1f4f1f5b10")


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, kind: str, refers_to: int | None, record_id: str = "", date: str = UNKNOWN_DATE
) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that has its head only."""
    name = "null" if page_id is None else str(page_id)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n"
    block = head + payload if kind == "response" else head
    # a header value holds no line break
    uri = (url or "").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(_NAMESPACE, record_id or f"{name}:{digest}")).encode() + b">",
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + (uri or b"urn:page:" + name.encode()),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"Content-Type: application/http;msgtype=response",
        b"X-Page-ID: " + name.encode(),
        b"X-Payload-Length: " + str(length).encode(),
    ]
    if not uri:
        lines.append(b"X-No-URL: 1")
    if kind == "revisit":
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"X-Refers-To-Page: " + str(refers_to).encode()]
    lines.append(b"Content-Length: " + str(len(block)).encode())
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def parse_headers(head: bytes) -> dict[str, str]:
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    lines = text.split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _page(value: str | None) -> int | None:
    name = value or ""
    return int(name) if name.lstrip("-").isdigit() else None


def inflate(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """Pieces of an inflated gzip stream of one member or many; zeros behind a member are padding."""
    d, data = zlib.decompressobj(31), stream.read(PIECE)
    started = bool(data)
    while data:
        yield d.decompress(data)
        if d.eof:
            data = d.unused_data.lstrip(b"\0")
            while not data and (piece := stream.read(PIECE)):
                data = piece.lstrip(b"\0")
            if data:
                d = zlib.decompressobj(31)
        else:
            data = stream.read(PIECE)
    if started and not d.eof:
        raise ValueError("truncated gzip stream")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """(bytes, headers) of each record of an inflated stream."""
    buffer, at = bytearray(), 0
    pieces = iter(pieces)

    def more() -> bool:
        nonlocal buffer, at
        piece = next(pieces, None)
        if piece is None:
            return False
        if at > 1 << 20:
            del buffer[:at]
            at = 0
        buffer += piece
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(buffer) > at:
                    raise ValueError("truncated WARC record")
                return
        headers = parse_headers(bytes(buffer[at:end]))
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a WARC record without a length")
        size = end - at + 4 + int(headers["content-length"]) + 4
        while len(buffer) - at < size:
            if not more():
                raise ValueError("truncated WARC record")
        yield bytes(buffer[at : at + size]), headers
        at += size


#: record types that hold a page
PAGES = ("response", "resource", "conversion")


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def normalise(stream: io.BufferedIOBase, sink: io.BufferedIOBase, index: list[tuple] | None = None) -> list[tuple]:
    """Rewrite a gzip WARC with one member per record; the rows of its sidecar index, which ``index`` has so far when it breaks."""
    index, offset = [] if index is None else index, 0
    for data, headers in records(inflate(stream)):
        packed = member(data)
        sink.write(packed)
        index.append((offset, len(packed), headers.get("warc-record-id", ""), _page(headers.get("x-page-id")), headers.get("warc-type", "")))
        offset += len(packed)
    return index


def read_member(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers of the record at an offset of a normalised archive, and its payload: the block after the HTTP head."""
    data = zlib.decompress(content[offset : offset + length], 31)
    end = data.index(b"\r\n\r\n")
    headers = parse_headers(data[:end])
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    if headers.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return headers, block


def _write(archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        out, packer, size, records = [], zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0

        def close():
            name = f"part-{part:06d}-{number:06d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([*out, packer.flush()])], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, length, kind, refers = (batch.column(c)[i] for c in range(7))
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                records += 1
                data = record_bytes(page.as_py(), url.as_py(), payload, digest.as_py(), length.as_py(), kind.as_py(), refers.as_py(), f"{part}:{records}:{digest.as_py()}", date)
                out.append(packer.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield close()
                    out, packer, size, number = [], zlib.compressobj(1, zlib.DEFLATED, 31), 0, number + 1
        if size:
            yield close()

    return run


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            sink = io.BytesIO()
            index: list[tuple] = []
            error = None
            try:
                normalise(io.BytesIO(batch.column(1)[i].as_buffer() or b""), sink, index)
            except (ValueError, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
            rows = [dict(zip(("offset", "length", "record_id", "page_id", "record_type"), r, strict=True)) for r in index]
            kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([sink.getvalue()], pa.binary()), pa.array([rows], kind), pa.array([error], pa.string())], names=["archive", "content", "index", "error"])


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_buffer()
                rows = []
                for x in batch.column(2)[i].as_py():
                    headers, body = read_member(content, x["offset"], x["length"])
                    kind = headers.get("warc-type", "")
                    if kind == "revisit":
                        algorithm, _, digest = headers.get("warc-payload-digest", "").rpartition(":")
                        digest, length = digest if algorithm == "sha256" else None, _page(headers.get("x-payload-length"))
                    elif kind in PAGES:
                        digest, length = hashlib.sha256(body).hexdigest(), len(body)
                    else:
                        continue
                    url = "" if "x-no-url" in headers else headers.get("warc-target-uri", "").strip("<>")
                    rows.append((_page(headers.get("x-page-id")), length, digest, kind, _page(headers.get("x-refers-to-page")), url, body if with_payload else None))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 7 if with_payload else 6]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names[: len(types)])

    return run


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, archive_bytes: int = 4 << 20,
    date: str = UNKNOWN_DATE, salts: int = 16,
) -> DataFrame:
    """Monolithic gzip archives of all pages: rows (archive, content) in the shared folder.

    Pages meet the decision on their payload in ``salts`` shares of each digest, so one
    popular payload isn't one task's.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    # only payloads that repeat are joined: their digests, not the pages, are grouped
    firsts = rows.where(f"size >= {least}").groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count("*").alias("c")).where("c > 1 and keeper is not null").select(F.col("digest").alias("d"), "keeper")
    firsts = materialize(firsts, "repeated").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    linked = rows.join(firsts, (rows.digest == firsts.d) & (salt == firsts.salt) & (rows["size"] >= least), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    ready = linked.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("keeper")).alias("refers_to"))
    return materialize(ready.mapInArrow(_write(archive_bytes, date), "archive string, content binary"), "archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(archive, content) of any gzip layout to (archive, content, index, error), one member per record.

    A damaged archive keeps the records before the damage and says in ``error`` what it was.
    """
    return materialize(archives.select("archive", "content").mapInArrow(_normalise, f"archive string, content binary, index {INDEX}, error string"), "normalised")


def read_archives(normalised: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every page of normalised archives, read through the sidecar index.

    Of archives from elsewhere these are the records of type response, resource, conversion and
    revisit; others (warcinfo, request, metadata) are passed over. Their page_id and what a
    revisit doesn't say of its payload (a SHA-256, a length) are null.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return normalised.select("archive", "content", "index").mapInArrow(_read(with_payload), schema + (", payload binary" if with_payload else ""))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, content) of the ``.warc.gz`` files at or below a path, for ``normalise_archives``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def _put(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                lines = ["offset length record_id record_type\n"] + [f"{x['offset']} {x['length']} {x['record_id']} {x['record_type']}\n" for x in rows]
                for end, data in ((".cdx", "".join(lines).encode()), ("", batch.column(1)[i].as_buffer())):
                    # a retried task writes the same bytes under the same name
                    with system.open_output_stream(f"{root}/.{name}{end}.tmp") as f:
                        f.write(data)
                    system.move(f"{root}/.{name}{end}.tmp", f"{root}/{name}{end}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], names=["archive", "records"])

    return run


def write_files(normalised: DataFrame, folder: str) -> DataFrame:
    """Write archives and sidecar indexes as files below ``folder``, a URI that every executor reaches; (archive, records)."""
    return materialize(normalised.select("archive", "content", "index").mapInArrow(_put(folder), "archive string, records long"), "files")
