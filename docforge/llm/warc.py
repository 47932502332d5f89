"""WARC archives: writing, and the normaliser that makes every record of a whole-file gzip stream seekable."""

from __future__ import annotations

import base64
import hashlib
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm.common import barrier, frugal, open_store, read_file, remove, scratch, write_file, write_pieces

#: An archive is closed when it holds this many bytes of records; bounds a task's memory and a file's size.
ARCHIVE_BYTES = 16_000_000
LEAST_REVISIT = 1000
CHUNK = 1 << 20
GZIP = 31  # zlib's window bits for a gzip stream

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[bytes, bytes]
    block: bytes

    @property
    def http(self) -> dict[bytes, bytes]:
        return _headers(self.block.partition(END)[0])

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]


def _headers(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines if line)}


def record_id(page) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page is None else str(page).encode())


def page_of(identifier: bytes) -> int | None:
    found = identifier.removeprefix(b"<urn:page:").removesuffix(b">")
    return None if found == b"null" else int(found)


def format_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit without payload if ``refers_to`` is given.

    Both keep the HTTP head with the payload's length, and the digest of the full payload.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    revisit = refers_to is not None
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    lines = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + record_id(page)]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~").encode())
    lines += [b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha1:" + digest]
    if revisit:
        lines += [b"WARC-Refers-To: " + record_id(refers_to), b"WARC-Profile: " + PROFILE]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block + END


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(END)
    headers = _headers(head)
    return Record(headers, rest[: int(headers[b"content-length"])])


def records_of(chunks):
    """Raw records of an inflated stream, one at a time; what is held is one record and one chunk."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (head := held.find(END, at)) >= 0:
            size = int(_headers(bytes(held[at:head]))[b"content-length"])
            stop = head + len(END) + size + len(END)
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(path: str):
    """The bytes of a gzip file of one or more members, chunk by chunk."""
    store, place = open_store(path)
    machine = zlib.decompressobj(GZIP)
    with store.open_input_stream(place, compression=None) as source:
        while data := source.read(CHUNK):
            while data:
                yield machine.decompress(data, 8 * CHUNK)
                data = machine.unconsumed_tail
                if machine.eof:
                    data, machine = machine.unused_data, zlib.decompressobj(GZIP)
    yield machine.flush()


def deflate(data: bytes, level: int) -> bytes:
    machine = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return machine.compress(data) + machine.flush()


# ---------------------------------------------------------------- jobs


#: Equal payloads are dealt to this many groups by page, so that copies of one payload never meet in a task.
SALTS = 4096


def with_roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, refers_to`` (null for responses).

    Of equal payloads of at least ``least`` bytes the largest ``page_id`` is the response. Rows that
    share that id are responses too. Digests alone are grouped, combined before the shuffle: by digest and page salt first, then
    a digest's salts, ``SALTS`` at most. Payloads are joined to their response by digest and salt, those under ``least`` bytes among
    them by the same even spread, so the copies of a hot payload go to as many tasks as others do.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = ["digest", "salt"]
    marked = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    large = marked.where(F.length("payload") >= least)
    salted = large.groupBy(*key).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    alike = Window.partitionBy("digest")
    groups = salted.withColumns({"keeper": F.max("last").over(alike), "copies": F.sum("n").over(alike)}).where("copies > 1").select(*key, "keeper")
    refers = F.when((F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return marked.join(groups, key, "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", level: int = 1, least: int = LEAST_REVISIT) -> DataFrame:
    """Each archive is one gzip stream over all its records; returns ``path, records`` of each.

    Null html is an empty payload. No pages give no archives. A task that is run again writes the same names.
    """

    def write(batches):
        part, number = TaskContext.get().partitionId(), 0
        machine, parts, records, size = None, [], 0, 0
        for batch in batches:
            for row in rows_of(batch):
                if machine is None:
                    machine, parts, records, size = zlib.compressobj(level, zlib.DEFLATED, GZIP), [], 0, 0
                data = format_record(*row, date)
                parts.append(machine.compress(data))
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close(part, number, machine, parts, records)
                    machine, number = None, number + 1
        if machine is not None:
            yield close(part, number, machine, parts, records)

    def close(part, number, machine, parts, records):
        path = f"{folder}/whole-{part:06d}-{number:05d}.warc.gz"
        write_file(path, b"".join([*parts, machine.flush()]))
        return pa.RecordBatch.from_pylist([{"path": path, "records": records}])

    return barrier(with_roles(pages, least).mapInArrow(frugal(write), "path string, records long"), "archives")[0]


def rows_of(batch: pa.RecordBatch, size: int = 256):
    """The rows of a batch as tuples, a few at a time, so that large payloads aren't held twice."""
    for at in range(0, batch.num_rows, size):
        yield from zip(*(column.to_pylist() for column in batch.slice(at, size).columns), strict=True)


def _spread(files: DataFrame) -> DataFrame:
    """One task for each file, up to 10,000."""
    return files.repartition(min(max(files.count(), 1), 10_000))


def members_of(path: str, level: int, lines: list[bytes]):
    """A gzip member for each record of an archive, one at a time; its line of the index is appended to ``lines``."""
    offset = 0
    for raw in records_of(inflate(path)):
        member = deflate(raw, level)
        headers = _headers(raw.partition(END)[0])
        lines.append(b"%d\t%d\t%s\t%s\n" % (offset, len(member), headers[b"warc-type"], headers[b"warc-record-id"]))
        offset += len(member)
        yield member


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites each archive of ``path``: every record becomes a gzip member of its own.

    Each file is inflated once and written as a stream: a task holds one record and the index, whatever the archive's size. Beside it stands a sidecar index with a line
    ``offset, length, type, record id`` for each record. Returns ``path, index, records``.
    """

    def rewrite(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                base = f"{folder}/{path.rpartition('/')[2].removeprefix('whole-').removesuffix('.warc.gz')}"
                lines: list[bytes] = []
                write_pieces(f"{base}.warc.gz", members_of(path, level, lines))
                write_file(f"{base}.idx", b"".join(lines))
                yield pa.RecordBatch.from_pylist([{"path": f"{base}.warc.gz", "index": f"{base}.idx", "records": len(lines)}])

    return barrier(_spread(archives).mapInArrow(frugal(rewrite), "path string, index string, records long"), "normalised")[0]


def read_member(source, offset: int, length: int) -> Record:
    """One record by its place in the index; nothing else of the file is read."""
    return parse_record(zlib.decompress(source.read_at(length, offset), GZIP))


def read_archives(files: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, offset, path`` of every record, through the index.

    A response's digest is computed from its payload and must equal its header.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, path string"
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("path", pa.string())])

    def read(batches):
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                store, place = open_store(path)
                rows = []
                with store.open_input_file(place) as source:
                    for line in read_file(index).splitlines():
                        offset, length = map(int, line.split(b"\t")[:2])
                        rows.append((*describe(read_member(source, offset, length)), offset, path))
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return _spread(files).mapInArrow(frugal(read), schema)


def describe(record: Record) -> tuple:
    headers = record.headers
    kind = headers[b"warc-type"].decode()
    digest = base64.b32decode(headers[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
    size = int(record.http[b"content-length"])
    if kind == "response" and (len(record.payload) != size or hashlib.sha1(record.payload).hexdigest() != digest):
        raise ValueError(f"{headers[b'warc-record-id']!r} doesn't have the payload that its header names")
    refers = headers.get(b"warc-refers-to")
    return page_of(headers[b"warc-record-id"]), size, digest, kind, page_of(refers) if refers else None


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes, normalises and drops the whole-file archives; returns the normalised files."""
    spark = pages.sparkSession
    whole = scratch(spark, "warc-whole")
    files = normalise(write_archives(pages, whole, least=least), folder or scratch(spark, "warc"))
    remove(spark, whole)
    return files
