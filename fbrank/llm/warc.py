"""WARC archives, one Zstandard frame per record.

An archive starts with a skippable frame that holds the dictionary (magic ``0x184D2A5D``, the
dictionary plain or itself compressed); then each record is one frame.  The reader loads the
dictionary, decodes frame after frame with bounded memory, and validates the version line, the
headers, the block length and the digests.

Archives are written by the tasks that hold the pages, to the shared folder, under names that no
two attempts share; the table of archives that Spark returns names those of the attempts that
counted.  Reading them is a second Spark job over that table.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fbrank.llm.frames import column, settled
from fbrank.session import scratch_path

#: fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

LEVEL = 3
DICTIONARY_BYTES = 32_768
DICTIONARY_PAGES = 256
ARCHIVE_BYTES = 64_000_000
READ = 1 << 16
_BAD = re.compile(r"[\x00-\x20\x7f]")


class WarcError(ValueError):
    """An archive or record that breaks its format."""


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page ``refers_to``: then the block ends with the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = digest_of(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{digest}")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest)]
    block = http + payload
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))]
        block = http
    return _record([*headers, ("WARC-Block-Digest", "sha1:" + digest_of(block))], block)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of exactly one record, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError("not a WARC/1.1 record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"no {need}")
    datetime.strptime(headers["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    if not re.fullmatch(r"\d+", headers["content-length"]) or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("block length differs from Content-Length")
    block = rest[:-4]
    if headers.get("warc-block-digest", "sha1:" + digest_of(block)) != "sha1:" + digest_of(block):
        raise WarcError("block digest differs")
    return headers, block


def parse_http(block: bytes) -> tuple[int, bytes]:
    """Content-Length that the HTTP headers state, and what follows them."""
    head, gap, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"\r\nContent-Length: *(\d+)", head)
    if not gap or not m or not head.startswith(b"HTTP/"):
        raise WarcError("no HTTP response in the block")
    return int(m[1]), body


class ArchiveWriter:
    """Buffers the first pages to train the dictionary, then writes frame after frame."""

    def __init__(self, out) -> None:
        self.out, self.waiting, self.compressor, self.size, self.records = out, [], None, 0, 0

    def _start(self) -> None:
        samples, params = [r[:65_536] for r in self.waiting], {}
        try:
            d = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too few or too small samples: an archive without a dictionary
            d = None
        if d is not None:
            raw = zstandard.ZstdCompressor(level=19).compress(d.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            params = {"dict_data": d}
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **params)
        for r in self.waiting:
            self._put(self.compressor.compress(r))
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.waiting.append(record)
            if len(self.waiting) >= DICTIONARY_PAGES or sum(map(len, self.waiting)) > 16_000_000:
                self._start()
        else:
            self._put(self.compressor.compress(record))

    def close(self) -> None:
        if self.compressor is None:
            self._start()
        self.out.close()


def read_records(stream) -> Iterator[bytes]:
    """Each record of an archive, one frame at a time."""
    held = b""

    def fill(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = stream.read(max(READ, n - len(held)))
            if not more:
                return False
            held += more
        return True

    first, options = True, {}
    while fill(1):
        if not fill(8):
            raise WarcError("the archive ends inside a frame's header")
        magic, size = struct.unpack("<II", held[:8])
        if magic in SKIPPABLE:
            if not fill(8 + size):
                raise WarcError("the archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC and first:
                raw = held[8 : 8 + size]
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                options = {"dict_data": zstandard.ZstdCompressionDict(raw)}
            held = held[8 + size:]
        elif magic == FRAME_MAGIC:
            d, out = zstandard.ZstdDecompressor(**options).decompressobj(), io.BytesIO()
            data = held
            while True:
                out.write(d.decompress(data))
                if d.eof:
                    held = d.unused_data
                    break
                data = stream.read(READ)
                if not data:
                    raise WarcError("the archive ends inside a frame")
            yield out.getvalue()
        else:
            raise WarcError(f"neither a Zstandard nor a skippable frame: {magic:#x}")
        first = False


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        done: list[tuple[str, int, int]] = []
        writer, name = None, ""
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if writer is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(f"{base}/{name}"))
                writer.add(build_record(page, url, payload or b"", refers))
                if writer.size >= ARCHIVE_BYTES:
                    writer.close()
                    done.append((name, writer.records, writer.size))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, writer.records, writer.size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records", "bytes"])

    return write


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                n = 0
                with fs.open_input_stream(f"{base}/{name}") as stream:
                    for data in read_records(stream):
                        headers, block = parse_record(data)
                        length, body = parse_http(block)
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if headers["warc-type"] == "response" and (len(body) != length or digest_of(body) != digest):
                            raise WarcError(f"payload of {headers['warc-record-id']} differs from its length or digest")
                        page, refers = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
                        out.append((page and int(page), headers.get("warc-target-uri"), length, digest, headers["warc-type"], refers and int(refers)))
                        n += 1
                        if len(out) >= 5000:
                            yield _rows(out)
                            out = []
                if n != records:
                    raise WarcError(f"{name} has {n} records; {records} were written")
                if out:
                    yield _rows(out)

    return read


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0) -> DataFrame:
    """Write a record per page; returns ``archive, records, bytes``, already written and fixed.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is a response and the
    others revisit it; rows repeated under that id are responses all.  A null page is an empty
    payload.  Rows without an id are responses and nothing refers to them."""
    payload = F.coalesce(column(pages, html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    first = settled(rows.filter(_can_repeat(min_bytes)).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                    .filter("n > 1").select("sha", "first"))
    marked = rows.join(first, "sha", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    spark = pages.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return settled(marked.mapInArrow(_writer(folder), "archive string, records long, bytes long"))


def _can_repeat(min_bytes: int) -> Column:
    return F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_bytes)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record: ``page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to``."""
    n = max(1, archives.count())
    return archives.select("archive", "records").repartition(n).mapInArrow(
        _reader(folder), "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_folder(spark: SparkSession) -> str:
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else "file://" + path


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archives into a new shared folder and read them back."""
    folder = archive_folder(pages.sparkSession)
    return read_archives(write_archives(pages, folder, **options), folder)
