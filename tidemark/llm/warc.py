"""WARC archives compressed with Zstandard: writer and validating reader.

An archive starts with a skippable frame that holds the dictionary of the rest, always;
each record is one frame of its own. Every task writes its rows to archives of bounded
size and reports them in a manifest table; only files that a committed manifest row
names are read, so what a lost or repeated attempt has left behind is never seen.
The reader decodes one frame at a time and checks version, headers, lengths and
digests; a fault raises.

Defined results: a null payload is empty; a null url is written as ``urn:none``; rows
with equal payloads of at least ``min_bytes`` bytes point to the one with the largest
page_id, and rows that repeat that page_id are responses too; a null page_id is never
referred to; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
#: Records are cut into parts of this size to train from, up to so many bytes of each.
SAMPLE_PART = 4 << 10
SAMPLE_HEAD = 128 << 10
LEVEL = 3
#: A reading task gets about so many bytes of archives, and a page's digest is dealt to so many parts.
READ_BYTES = 64 << 20
SALTS = 16

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; raises ValueError on a malformed record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError(f"not a {VERSION.decode()} record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {line[:80]!r}")
        headers[name.lower()] = value.strip()
    missing = [name for name in REQUIRED if name not in headers]
    if missing:
        raise ValueError(f"headers missing: {missing}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, but the block has {len(rest) - 4} bytes")
    block = rest[:n]
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind, said = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (size != len(payload) or digest(payload) != said):
        raise ValueError("payload length or digest differs")
    if kind == "revisit" and ("warc-refers-to" not in headers or size is None or payload):
        raise ValueError("malformed revisit")
    url = headers.get("warc-target-uri")
    return {
        "page_id": _page_id(headers["warc-record-id"]),
        "url": None if url == "urn:none" else url,
        "payload_bytes": size,
        "payload_digest": said,
        "record_type": kind,
        "refers_to": _page_id(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _filesystem(path: str):
    """The store of a path and the path within it; any scheme that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _train(samples: list[bytes]) -> bytes:
    """A dictionary for the records to come: trained, or the beginnings themselves where they are too few or too alike."""
    import zstandard

    parts = [x[at : at + SAMPLE_PART] for x in samples for at in range(0, min(len(x), SAMPLE_HEAD), SAMPLE_PART)]
    if len(parts) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(x[:SAMPLE_PART] for x in samples)[:DICTIONARY_BYTES]


class _Archive:
    """An open archive; its first records wait until the dictionary is trained."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.waiting: list[bytes] = []
        self.held = self.records = self.bytes = 0
        self.out = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.out is not None:
            return self._put(data)
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._open()
        return None

    def _open(self) -> None:
        import zstandard

        store, path = _filesystem(self.path)
        store.create_dir(os.path.dirname(path), recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        trained = _train(self.waiting)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
        self._write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained))
        for data in self.waiting:
            self._put(data)
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self._write(self.compressor.compress(data))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._open()
        self.out.close()
        return self.path, self.records, self.bytes


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of page_id, url, payload, refers_to and revisit; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        archive = None
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
                archive = archive or _Archive(part)
                archive.add(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py()))
                if archive.bytes >= ARCHIVE_BYTES:
                    yield _manifest(archive.close())
                    archive = None
        if archive:
            yield _manifest(archive.close())

    return rows.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(write, MANIFEST)


def _manifest(row: tuple[str, int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["path", "records", "bytes"])


def frames(source) -> Iterator[bytes]:
    """Decoded frames of an open archive, one at a time."""
    import zstandard

    head = source.read(8)
    trained = b""
    if not head:
        return
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        trained = source.read(struct.unpack("<I", head[4:])[0])
        if not trained.startswith(ZSTD_DICTIONARY_MAGIC):
            trained = zstandard.ZstdDecompressor().decompress(trained)
        head = b""
    make = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}))
    pending = head
    while True:
        if not pending and not (pending := source.read(1 << 20)):
            return
        frame, out = make.decompressobj(), []
        while True:
            out.append(frame.decompress(pending))
            if frame.eof:
                pending = frame.unused_data
                break
            if not (pending := source.read(1 << 20)):
                raise ValueError("the archive ends within a frame")
        yield b"".join(out)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest names, validated."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = _filesystem(path)
                rows, held, seen = [], 0, 0
                with store.open_input_stream(inner, compression=None) as source:
                    for data in frames(source):
                        row = parse(data)
                        seen += 1
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{path} has {seen} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path", "records").mapInArrow(read, RECORDS)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to and revisit of every row.

    Keepers are found from digests and ids alone, pre-aggregated. Each keeper of a
    repeated payload then meets the pages in ``SALTS`` parts, so one payload that a
    third of the pages share is spread over as many tasks.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    salt = F.pmod(F.xxhash64(F.col(page_id), F.col(url)), F.lit(SALTS))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), salt.alias("salt"))
    large = rows.where(F.octet_length("payload") >= min_bytes) if min_bytes > 0 else rows
    repeated = large.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha1", "keeper")
    keepers = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    revisit = F.coalesce(F.col("keeper") != F.col("page_id"), F.col("keeper").isNotNull())
    return rows.join(keepers, ["sha1", "salt"], "left").withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("keeper")))


def dealt(manifest: DataFrame) -> DataFrame:
    """The archives of a written manifest, dealt to a number of reading tasks that grows with their bytes."""
    size = manifest.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = max(min(size.n, manifest.sparkSession.sparkContext.defaultParallelism), -(-(size.bytes or 0) // READ_BYTES), 1)
    return manifest.repartition(tasks, "path")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_revisits(table(spark, sf_dir, "pages"))
    manifest = stored(write_archives(rows, scratch(spark, "warc")), "warc-manifest")
    return read_archives(dealt(manifest), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(8), lambda g: list_reduce(list_transform(range(4), lambda c:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (g * 5 + 1)::INT, 5))::BIGINT >> ((3 - c) * 5)::INT) & 31)::INT + 1, 1)),
         lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d
"""
