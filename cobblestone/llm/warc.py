"""WARC archives as a Spark data source (``format("warc")``), written and read in parallel.

Files hold one gzip member per record, as the format asks, and each member states its compressed length in the ``sl`` extra
field, so that a reader can leap over a record. Reading plans partitions of whole files by size, takes predicates on the
record type and on header columns before any payload is touched, inflates a record's headers first, and decodes the payload
only of records that pass and only if the payload is asked for (``option("payload", "false")`` leaves it out). Members
without the field, and files without compression, are read through.

Writing gives every task files of its own under a temporary folder; they are moved into place when the job commits, and
only those of successful attempts, so lost executors and repeated tasks leave nothing behind. Paths are URIs that every
executor can open (``pyarrow.fs``).

Columns: record_type, record_id, target_uri, refers_to, date, payload_digest, payload_length, payload. A null payload is an
empty one; null header columns are left out of the record and read back as null; an empty table gives no records. Line
breaks in header values are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from cobblestone.llm.common import stored
from cobblestone.session import scratch_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, date string, payload_digest string,"
    " payload_length bigint, payload binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Header of each column; values that the WARC standard fixes.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest",
}
_COLUMN_OF = {v.lower(): k for k, v in HEADERS.items()}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
_HEAD = 4096
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int) -> bytes:
    """A gzip member with its lengths in the ``sl`` extra field (zero where they do not fit 32 bits)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    known = size if size < 1 << 32 and len(record) < 1 << 32 else 0
    extra = b"sl" + struct.pack("<HII", 8, known, len(record) if known else 0)
    return b"".join([
        b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H", len(extra)), extra, body,
        struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF),
    ])


def record(row: dict) -> bytes:
    """A WARC/1.1 record; revisits keep the HTTP header of their payload but not the payload."""
    payload, kind = row["payload"] or b"", row["record_type"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    values = {**row, "payload_digest": f"sha1:{digest(payload)}", "date": row.get("date") or EPOCH}
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if values.get(column) is not None:
            lines.append(f"{header}: {values[column]}".replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.level, self.file_bytes = int(options.get("level", 6)), int(options.get("file_bytes", FILE_BYTES))
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = pafs.FileSystem.from_uri(self.temporary)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                data = member(record(batch.slice(i, 1).to_pylist()[0]), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(tuple(files))

    def commit(self, messages) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        temporary = pafs.FileSystem.from_uri(self.temporary)[1]
        old = [f.path for f in _files(store, root)] if self.overwrite else []
        for message in messages:
            for name in message.files if message else ():
                store.move(f"{temporary}/{name}", f"{root}/{name}")
        for path in old:
            store.delete_file(path)
        self._clear(store, temporary)

    def abort(self, messages) -> None:
        store, temporary = pafs.FileSystem.from_uri(self.temporary)
        self._clear(store, temporary)

    @staticmethod
    def _clear(store, folder: str) -> None:
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


def _files(store, root: str) -> list:
    found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    inside = lambda f: not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/"))
    return sorted((f for f in found if f.type == pafs.FileType.File and inside(f)), key=lambda f: f.path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class _Source:
    """Bytes of one record: inflated from a gzip member, or as they stand in an uncompressed file."""

    def __init__(self, file: io.BufferedReader, packed: bool):
        self.file, self.buffer = file, b""
        self.inflate = zlib.decompressobj(31) if packed else None
        self.done = False

    def _more(self) -> bool:
        if self.done:
            return False
        if self.inflate is None:
            data = self.file.read(_HEAD)
            self.done = not data
            self.buffer += data
            return bool(data)
        data = self.file.read(_HEAD)
        out = self.inflate.decompress(data)
        if self.inflate.eof:
            self.file.seek(-len(self.inflate.unused_data), io.SEEK_CUR)
            self.done = True
        elif not data:
            raise ValueError("a record ends before its member does")
        self.buffer += out
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record without an end of its headers")
        head, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return head

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise ValueError("a record shorter than its length")
            parts.append(self.buffer)
            have += len(self.buffer)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def drop(self, n: int) -> None:
        """Leave ``n`` bytes out without keeping them."""
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if self.inflate is None:
                self.file.seek(n, io.SEEK_CUR)
                return
            if not self._more():
                return
        self.buffer = self.buffer[n:]

    def finish(self) -> None:
        if self.inflate is None:
            self.file.seek(-len(self.buffer), io.SEEK_CUR)
        while self.inflate is not None and not self.done:
            self.buffer = b""
            self._more()


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_digest" and isinstance(f, (EqualTo, In, IsNotNull)):
                self.wanted.append((column, None if isinstance(f, IsNotNull) else frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = pafs.FileSystem.from_uri(self.path)
        out, held, size = [], [], 0
        for file in _files(store, root):
            if held and size + file.size > self.partition_bytes:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(file.path)
            size += file.size
        return out + [Files(tuple(held))] if held else out

    def _passes(self, fields: dict[str, str]) -> bool:
        for column, values in self.wanted:
            value = fields.get(HEADERS[column].lower())
            if value is None or values is not None and value not in values:
                return False
        return True

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where no partition is planned
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                for row in self._records(io.BufferedReader(raw, 1 << 20), raw.size()):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 1000 or size >= 16 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = [pa.int64() if c == "payload_length" else pa.binary() if c == "payload" else pa.string() for c in COLUMNS]
        return pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(COLUMNS, kinds))))

    def _records(self, file: io.BufferedReader, size: int) -> Iterator[dict]:
        at = 0
        while at < size:
            file.seek(at)
            start = file.peek(24)[:24]
            packed = start[:2] == b"\x1f\x8b"
            leap = 0
            if packed and len(start) == 24 and start[3] & 4 and start[12:14] == b"sl":
                leap = struct.unpack("<I", start[16:20])[0]
            elif not packed and start[:4] in (b"\r\n\r\n", b"\r\n"):
                at += len(start[:4])
                continue
            source = _Source(file, packed)
            fields = _fields(source.until(b"\r\n\r\n"))
            length = int(fields["content-length"])
            if self._passes(fields):
                yield self._row(source, fields, length)
            elif not leap:
                source.drop(length)
            if leap:
                at += leap
                continue
            if packed:
                source.finish()
                at = file.tell()
            else:
                source.drop(4)
                source.finish()
                at = file.tell()

    def _row(self, source: _Source, fields: dict[str, str], length: int) -> dict:
        row: dict = dict.fromkeys(COLUMNS)
        for header, column in _COLUMN_OF.items():
            row[column] = fields.get(header)
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].partition(":")[2]
        if fields.get("content-type", "").startswith("application/http"):
            head = source.until(b"\r\n\r\n")
            http = _fields(head)
            row["payload_length"] = int(http["content-length"]) if "content-length" in http else None
            length -= len(head) + 4
        else:
            row["payload_length"] = length
        if fields.get("warc-type") == "revisit" or not self.payload:
            source.drop(length)
            return row
        row["payload"] = source.take(length)
        if self.verify and row["payload_digest"] and digest(row["payload"]) != row["payload_digest"]:
            raise ValueError(f"the payload of {row['record_id']} does not have its digest")
        return row


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known and let Spark hand filters to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set(_PUSHDOWN, "true")


def archive(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> None:
    """Write a record per page: of equal payloads of at least ``least`` bytes the largest ``ident`` is the response, the
    others revisit it (rows that repeat that ``ident`` are responses too); shorter payloads are all responses.

    Only digests that occur twice are joined back, so texts are not shuffled where those are few; a hot one is one row.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(ident).alias("ident"), F.col(url).alias("target_uri"), payload.alias("payload"))
    known = rows.where(F.octet_length("payload") >= least).groupBy(F.sha1("payload").alias("_digest")).agg(
        F.max("ident").alias("_first"), F.count("*").alias("_n")
    ).where("_n > 1").select("_digest", "_first")
    joined = rows.join(stored(known, "digests"), F.sha1("payload") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("ident").eqNullSafe(F.col("_first"))

    def urn(column: str):
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))

    joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("ident").alias("record_id"), "target_uri",
        F.when(revisit, urn("_first")).alias("refers_to"), F.lit(EPOCH).alias("date"), F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("bigint").alias("payload_length"), "payload",
    ).write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``pages``, read back from archives."""
    path = scratch_path(pages.sparkSession, "warc")
    archive(pages, path)
    number = r"<urn:x-page:(-?\d+)>"

    def ident(column: str):
        return F.nullif(F.regexp_extract(column, number, 1), F.lit("")).cast("bigint")

    return read(pages.sparkSession, path).select(
        ident("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        ident("refers_to").alias("refers_to"),
    )
