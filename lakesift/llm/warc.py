"""WARC records in ZIP packages: writing, and reading by ranges through the central directory."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.common import materialise, small_batches, text_of, work_dir
from lakesift.llm.vocabulary import slices

# Fixed values of the ZIP format (APPNOTE 6.3): signatures.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ZIP64_EXTRA, MAX16, MAX32 = 0x0001, 0xFFFF, 0xFFFFFFFF
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
#: Kinds of records that are pages; others (warcinfo, request, metadata) are passed over.
PAGES = ("response", "revisit", "resource")
#: A package is closed at this many bytes of records: a reading task's memory and a lost task's work.
PACKAGE_BYTES = 16 << 20
#: Neighbouring records are fetched together up to this many bytes.
FETCH_BYTES = 1 << 20
PACKAGES_A_TASK = 32


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored: int
    header_at: int
    crc: int


# ------------------------------------------------------------------------------- ZIP
def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """An archive of stored (not compressed) members; ``zip64`` writes the 64-bit directory even where it isn't needed."""
    out, directory = io.BytesIO(), []
    for name, data in members:
        raw, at, crc = name.encode(), out.tell(), zlib.crc32(data)
        big = zip64 or len(data) >= MAX32
        extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, len(data), len(data)) if big else b""
        size = MAX32 if big else len(data)
        out.write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        far = big or at >= MAX32
        extra = struct.pack("<HHQQQ", ZIP64_EXTRA, 24, len(data), len(data), at) if far else b""
        size = MAX32 if far else len(data)
        directory.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if far else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, MAX32 if far else at) + raw + extra)
    at, body = out.tell(), b"".join(directory)
    out.write(body)
    n, big = len(members), zip64 or at + len(body) >= MAX32 or len(members) >= MAX16
    if big:
        end64 = out.tell()
        out.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(body), at) + LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
    out.write(END + struct.pack("<HHHHIIH", 0, 0, MAX16 if big else n, MAX16 if big else n, MAX32 if big else len(body), MAX32 if big else at, 0))
    return out.getvalue()


def zip_members(read, size: int) -> list[Member]:
    """The central directory of an archive of ``size`` bytes; ``read(offset, length)`` fetches a range."""
    tail_at = max(0, size - 22 - MAX16)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(END)
    while k >= 0 and k + 22 + int.from_bytes(tail[k + 20:k + 22], "little") != len(tail):  # a signature inside the comment
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, k + 10)
    if MAX16 == count or MAX32 in (length, at):
        locator = read(tail_at + k - 20, 20)
        if locator[:4] == LOCATOR64:
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, at = struct.unpack_from("<QQQ", end64, 32)
    directory, out, p = read(at, length), [], 0
    for _ in range(count):
        if directory[p:p + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, crc, stored, full, n_name, n_extra, n_comment, header = *struct.unpack_from("<H", directory, p + 10), *struct.unpack_from("<IIIHHH", directory, p + 16), *struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46:p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == ZIP64_EXTRA:  # holds those of the three values that don't fit, in this order
                own = q + 4
                if full == MAX32:
                    full, own = struct.unpack_from("<Q", extra, own)[0], own + 8
                if stored == MAX32:
                    stored, own = struct.unpack_from("<Q", extra, own)[0], own + 8
                if header == MAX32:
                    header = struct.unpack_from("<Q", extra, own)[0]
            q += 4 + n
        out.append(Member(name, method, full, stored, header, crc))
        p += 46 + n_name + n_extra + n_comment
    return out


def data_at(read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed: its records can't be read by range")
    head = read(member.header_at, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


# ------------------------------------------------------------------------------- WARC
def sha1_base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, url: str | None = None, digest: str = "") -> str:
    name = f"page:{page_id}" if page_id is not None else f"page::{digest}:{url or ''}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, payload_size: int, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record; a revisit has no payload block. A page without an id gets no header of it."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_size}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    """Headers of a record, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record: the body of an HTTP message, or the block where it is none."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = headers_of(head)
    block = rest[:int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


class _Package:
    def __init__(self):
        self.records, self.index, self.size = [], [], 0

    def add(self, url: str | None, digest: str, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        entry = {"url": url or "", "digest": f"sha1:{digest}", "offset": str(self.size), "length": str(len(packed)), "filename": WARC_MEMBER.rsplit("/", 1)[1]}
        self.index.append(f"{''.join((url or '-').split()) or '-'} 20240101000000 {json.dumps(entry)}\n")
        self.records.append(packed)
        self.size += len(packed)

    def bytes(self) -> bytes:
        return write_zip([(INDEX_MEMBER, "".join(self.index).encode()), (WARC_MEMBER, b"".join(self.records)), ("datapackage.json", b'{"profile": "data-package"}\n')], zip64=self.size >= MAX32)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system: one without a scheme lies where Spark's default is, not on a task's own disk."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path in it, in a task. Hadoop's names of S3 are read as s3."""
    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else f"file://{rest}" if scheme == "file" and not rest.startswith("//") else uri)


def _publish(folder: str, name: str, data: bytes) -> str:
    """Write a file by renaming, so that no half file is seen. Its name is its own: what a lost or doubled attempt leaves is listed nowhere."""
    where, root = file_system(folder)
    where.create_dir(root, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}.wacz"
    with where.open_output_stream(f"{root}/.{own}") as f:
        f.write(data)
    where.move(f"{root}/.{own}", f"{root}/{own}")
    return f"{folder.rstrip('/')}/{own}"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, package = TaskContext.get().partitionId(), 0, _Package()

        def close():
            path = _publish(folder, f"part-{part:06d}-{n:04d}", package.bytes())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(package.records)], pa.int64())], ["path", "records"])

        for part_of in (p for batch in batches for p in slices(batch, "html")):
            for page, url, html, digest, size, first in zip(*(part_of.column(i).to_pylist() for i in range(6)), strict=True):
                package.add(url, sha1_base32(digest), write_record(page, url, (html or "").encode(), size, sha1_base32(digest), first))
                if package.size >= PACKAGE_BYTES:
                    yield close()
                    package, n = _Package(), n + 1
        if package.records:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Write a record for each row into ZIP packages below ``folder``; returns path and records of each package that counts.

    Of pages with equal payloads of at least ``min_payload`` bytes the one with the smallest
    page_id is a response, the others are revisits that refer to it. The folder must be one that
    driver and executors share. Null html: an empty payload. Null url: empty. Null page_id: a record without an id, a
    revisit where a page with an id has its payload, else a response. Rows that repeat a page_id: each becomes a record.
    Packages of attempts that were lost or done twice aren't in the list. Other columns aren't read.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or work_dir(spark, "warc"))
    own = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    own = own.withColumns({"digest": F.sha1("html"), "check": F.xxhash64("html"), "size": F.octet_length("html").cast("long")})
    firsts = own.where((F.col("size") >= min_payload) & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("of"), F.col("check").alias("also")).agg(F.min("page_id").alias("first"))
    # most payloads occur once: only ids and digests meet the pages again
    marked = own.join(firsts, (own.digest == firsts.of) & (own.check == firsts.also), "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return materialise(marked.select("page_id", "url", "html", "digest", "size", refers.alias("first")).mapInArrow(_write(folder), "path string, records long"), "warc-list")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"


def index_entries(name: str, raw: bytes) -> list[tuple[str, int, int]]:
    """File name, offset and length of each record in an index member: a key, a time and JSON on each line."""
    text = (gzip.decompress(raw) if name.endswith(".gz") else raw).decode()
    found = [json.loads(line[line.index("{"):]) for line in text.splitlines() if "{" in line and not line.startswith("!")]
    return sorted((x["filename"], int(x["offset"]), int(x["length"])) for x in found if "offset" in x)


def _ranges(read, begin: int, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each place (sorted offset, length) from ``begin`` on; neighbours are fetched together."""
    k = 0
    while k < len(places):
        first, j = places[k][0], k
        while j < len(places) and (j == k or places[j][0] + places[j][1] - first <= FETCH_BYTES):
            j += 1
        data = read(begin + first, max(at + n for at, n in places[k:j]) - first)
        for at, n in places[k:j]:
            yield data[at - first:at - first + n]
        k = j


class _Part(io.RawIOBase):
    """A member's bytes as a file that is read from front to back."""

    def __init__(self, read, begin: int, size: int):
        self.fetch, self.at, self.end = read, begin, begin + size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.fetch(self.at, min(len(buffer), self.end - self.at)) if self.at < self.end else b""
        buffer[:len(data)] = data
        self.at += len(data)
        return len(data)


def _in_order(stream: BinaryIO) -> Iterator[bytes]:
    """Records one after the other, where no index tells their places."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        head = line
        while line not in (b"\r\n", b""):
            line = stream.readline()
            head += line
        yield head + stream.read(int(headers_of(head[:-4])["content-length"]))


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The page records of one package: each stored .warc or .warc.gz member below ``archive/``, by ranges of the package's
    index, or from front to back where no index names the member."""
    where, own = file_system(path)
    with where.open_input_file(own) as f:
        read = lambda at, n: f.read_at(n, at)
        members = {m.name: m for m in zip_members(read, f.size())}
        places: dict[str, list[tuple[int, int]]] = {}
        for name, m in members.items():
            if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
                for file, at, n in index_entries(name, read(data_at(read, m), m.size)):
                    places.setdefault(f"archive/{file}", []).append((at, n))
        for name, m in members.items():
            if not name.startswith("archive/") or not name.endswith((".warc", ".warc.gz")):
                continue
            begin, packed = data_at(read, m), name.endswith(".gz")
            if name in places:
                each = (gzip.decompress(x) if packed else x for x in _ranges(read, begin, places[name]))
            else:
                part = io.BufferedReader(_Part(read, begin, m.size), FETCH_BYTES)
                each = _in_order(gzip.GzipFile(fileobj=part) if packed else part)
            for raw in each:
                headers, payload = read_record(raw)
                if headers["warc-type"] in PAGES:
                    yield headers, payload


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for h, payload in records(path):
                    kind, refers, page = h["warc-type"], h.get("x-refers-to-page-id"), h.get("x-page-id")
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    digest, size = h.get("warc-payload-digest", f"sha1:{own}").removeprefix("sha1:"), int(h.get("x-payload-length", len(payload)))
                    if kind != "revisit" and "x-payload-length" in h and (len(payload), own) != (size, digest):
                        raise ValueError(f"{path}: the payload of page {page} differs from its digest")
                    rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, h.get("warc-target-uri"), *([payload] if with_payload else [])))
                    if len(rows) >= 2000:
                        yield _batch(rows, with_payload)
                        rows = []
                if rows:
                    yield _batch(rows, with_payload)

    return run


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if with_payload else []))
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def read_archives(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, uri [, payload] of each page record of the packages at ``path``.

    Packages made elsewhere are read too: their records have a null page_id, and the digest that they name. Each response
    that was written here is checked against its digest; a damaged package raises. No packages: empty result.
    """
    spark = packages.sparkSession
    n = packages.count()
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // PACKAGES_A_TASK)))
    return packages.select("path").repartition(tasks).mapInArrow(_read(with_payload), RECORD + ", payload binary" * with_payload)
