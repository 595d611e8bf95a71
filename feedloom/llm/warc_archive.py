"""WARC records in ZIP-packaged archives: a writer, and a reader of ranges that extracts nothing.

An archive is a ZIP whose members are stored, not deflated: ``archive/data.warc.gz`` (a gzip member for each record) and
``indexes/index.cdxj`` (sort key and JSON for each record). The reader finds the central directory from the file's end,
through the ZIP64 records where there are any, locates both members, and reads records by offset and length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, parts, salted_join, shared_dir, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of compressed records after which a task starts another archive, and index bytes in one reading task's slice.
ARCHIVE_BYTES, SLICE_RECORDS = 256 << 20, 2_000
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, for any store that Arrow knows."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record with its HTTP block. A revisit has the headers of the response, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in url if c not in chr(13) + chr(10))}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Page-ID: {'' if page_id is None else page_id}",
        f"Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower case) and payload of one uncompressed record; raises where digests or lengths don't hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if not version.startswith("WARC/1.") or digest(block) != headers["warc-block-digest"][5:]:
        raise ValueError("broken WARC record")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and digest(payload) != headers["warc-payload-digest"][5:]:
        raise ValueError("payload and digest differ")
    return headers, payload


class Archive:
    """Writes one archive; memory holds the index lines and one record."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.part-{uuid.uuid4().hex}"  # attempts of one task that run at once don't meet
        self.file = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.lines = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, raw: bytes, key: str, **more) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        got = z.compress(raw) + z.flush()
        self.data.write(got)
        self.lines.append(f"{key} {json.dumps(more | {'offset': self.at, 'length': len(got)})}\n")
        self.at += len(got)

    def close(self) -> tuple[int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.lines).encode())
        self.zip.close()
        self.file.close()
        self.fs.move(self.part, self.path)  # a repeated task replaces the file by an equal one
        return len(self.lines), self.at


class Reader:
    """Members of a ZIP file by range reads: end record, ZIP64 records, central directory, local headers."""

    def __init__(self, uri: str):
        filesystem, path = open_fs(uri)
        self.file = filesystem.open_input_file(path)
        self.size = self.file.size()
        self.members = self.directory()

    def read(self, at: int, n: int) -> bytes:
        got = self.file.read_at(n, at)
        if len(got) != n:
            raise ValueError(f"{n} bytes at {at} are not there")
        return got

    def directory(self) -> dict[str, tuple[int, int, int]]:
        """name: (offset of the local header, stored size, method)."""
        n = min(self.size, 22 + 65_535)
        tail = self.read(self.size - n, n)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no ZIP end record")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # the ZIP64 locator stands right before the end record
            (far,) = struct.unpack_from("<Q", tail, end - 12)
            record64 = self.read(far, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, size, at = struct.unpack_from("<QQQ", record64, 32)
        raw, out, k = self.read(at, size), {}, 0
        for _ in range(count):
            if raw[k : k + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, stored, plain = struct.unpack_from("<H8xII", raw, k + 10)
            of_name, of_extra, of_comment = struct.unpack_from("<HHH", raw, k + 28)
            (local,) = struct.unpack_from("<I", raw, k + 42)
            name, extra = raw[k + 46 : k + 46 + of_name].decode(), raw[k + 46 + of_name : k + 46 + of_name + of_extra]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:  # 64-bit values for the fields that are all ones, in this order
                    values = [v for (v,) in struct.iter_unpack("<Q", extra[4 : 4 + length // 8 * 8])]
                    plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                    stored = values.pop(0) if stored == 0xFFFFFFFF else stored
                    local = values.pop(0) if local == 0xFFFFFFFF else local
                extra = extra[4 + length :]
            out[name] = (local, stored, method)
            k += 46 + of_name + of_extra + of_comment
        return out

    def start(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's bytes in the archive."""
        local, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; ranges can be read from stored members only")
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        return local + 30 + sum(struct.unpack_from("<HH", head, 26)), size

    def index(self) -> list[dict]:
        at, size = self.start(INDEX)
        return [json.loads(line.split(b" ", 1)[1]) for line in self.read(at, size).splitlines()]

    def records(self, entries: list[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
        at, size = self.start(DATA)
        for e in entries:
            if e["offset"] + e["length"] > size:
                raise ValueError("an index entry lies outside the member")
            yield parse_record(zlib.decompress(self.read(at + e["offset"], e["length"]), 31))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row into archives in folder; returns (path, records, bytes), already computed.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest id is a response and the
    others revisit it. Payload hashes are counted with partial aggregation; only ids and hashes are joined before the
    pages are dealt to archives by id, so that one payload with a third of the rows burdens no task. Null html is an
    empty payload. Rows with a null id are written last (as responses, or revisits of an equal payload with an id); rows
    that repeat an id repeat its record.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    hashed = checkpoint(rows.select("id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n")))
    groups = checkpoint(hashed.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("id").alias("last"), F.count("*").alias("times")).where("times > 1"))
    revisits = salted_join(hashed, groups, ["sha1"], "times").where("not id <=> last and last is not null").select(F.coalesce("id", F.lit(-(1 << 62))).alias("key"), "sha1", "last").distinct()
    revisits = revisits.withColumnsRenamed({"key": "of_key", "sha1": "of_sha1"})
    dealt = rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 62)))).withColumn("own_sha1", F.sha1("payload"))
    dealt = dealt.join(revisits, (F.col("key") == F.col("of_key")) & (F.col("own_sha1") == F.col("of_sha1")), "left")
    dealt = dealt.sortWithinPartitions("key").select("id", "url", "payload", "last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, archive, done = TaskContext.get().partitionId(), None, []
        for b in parts(batches):
            for page_id, url, payload, last in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if archive is None:
                    path = f"{folder}/part-{part:05d}-{len(done):04d}.wacz"
                    archive = Archive(path)
                sha1 = digest(payload)
                archive.add(record(page_id, url, payload, sha1, last, last is not None), f"{0 if page_id is None else page_id:020d}", page=page_id, url=url, digest=sha1)
                if archive.at >= ARCHIVE_BYTES:
                    done, archive = [*done, (path, *archive.close())], None
        if archive is not None:
            done.append((path, *archive.close()))
        columns = [*zip(*done, strict=True)] or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    filesystem, path = open_fs(folder)
    filesystem.create_dir(path, recursive=True)
    return checkpoint(dealt.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records of the archives (path, records).

    Each archive is read in slices of some thousand index entries, dealt over the cluster; a revisit has a null payload.
    The slices are a few bytes each, so their number, not their size, sets how many tasks read (ten thousand at most).
    """
    n = manifest.agg(F.sum(F.ceil(F.col("records") / SLICE_RECORDS))).first()[0] or 1
    slices = manifest.select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("records") - 1) / SLICE_RECORDS))).alias("slice"))
    slices = slices.repartition(min(int(n), 10_000), "path", "slice")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for path, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = Reader(path), []
                for h, payload in reader.records(reader.index()[part * SLICE_RECORDS : (part + 1) * SLICE_RECORDS]):
                    revisit = h["warc-type"] == "revisit"
                    number = lambda k, h=h: int(h[k]) if h.get(k) else None
                    rows.append((number("page-id"), h["warc-target-uri"], None if revisit else payload, number("payload-length"), h["warc-payload-digest"][5:], h["warc-type"], number("refers-to-page")))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip([*zip(*rows, strict=True)] or [()] * len(kinds), kinds, strict=True)], [n for n, _ in kinds])

    return slices.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A hexadecimal SHA-1 holds eight groups of five digits; each gives four base32 characters.
ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(h, 1 + CAST(i // 4 AS INTEGER) * 5, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest
    FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
