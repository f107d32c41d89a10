"""WARC records in ZIP packages: a writer, and a reader by ranges.

A package is a ZIP file whose members are stored, not deflated: an archive of
gzip members, one to a WARC record, and an index of their places. The reader finds
the central directory from the end of the file (ZIP64 too), locates the stored
members, and reads single records by their byte ranges; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvanta.llm.columns import byte_count
from corvanta.llm.files import located, write_whole
from corvanta.workspace import Workspace

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"

# Fixed values of the ZIP format.
END = b"PK\x05\x06"
END64_LOCATOR = b"PK\x06\x07"
END64 = b"PK\x06\x06"
CENTRAL = b"PK\x01\x02"
LOCAL = b"PK\x03\x04"
ALL_ONES_16 = 0xFFFF
ALL_ONES_32 = 0xFFFFFFFF
ZIP64_EXTRA = 0x0001
MAX_COMMENT = 65535

# Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


class Member(NamedTuple):
    """A member of a package: where its header starts, and its sizes."""

    name: str
    method: int
    packed: int
    size: int
    header: int


class BadPackage(ValueError):
    """Bytes that are not a ZIP package, or not one this reader can read by ranges."""


def _read(file: BinaryIO, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise BadPackage(f"{length} bytes expected at {start}, {len(data)} found")
    return data


def central_directory(file: BinaryIO, size: int) -> list[Member]:
    """The members of a package of ``size`` bytes, read from its end."""
    tail_at = max(0, size - MAX_COMMENT - 22 - 20)
    tail = _read(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadPackage("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == END64_LOCATOR:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = _read(file, where, 56)
        if record[:4] != END64:
            raise BadPackage("no ZIP64 end of central directory where its locator points")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    elif ALL_ONES_16 == count or ALL_ONES_32 in (length, start):
        raise BadPackage("ZIP64 values without their record")
    return list(_members(_read(file, start, length), count))


def _members(directory: bytes, count: int) -> Iterator[Member]:
    at = 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise BadPackage(f"no central header at {at} of the directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, size, name_len, extra_len, note_len = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_len]
        extra = directory[at + 46 + name_len : at + 46 + name_len + extra_len]
        if ALL_ONES_32 in (packed, size, header):
            packed, size, header = _wide(extra, packed, size, header)
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, size, header)
        at += 46 + name_len + extra_len + note_len


def _wide(extra: bytes, packed: int, size: int, header: int) -> tuple[int, int, int]:
    """The 64-bit values that stand in the extra field for those of all ones."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_EXTRA:
            values = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            size = next(values) if size == ALL_ONES_32 else size
            packed = next(values) if packed == ALL_ONES_32 else packed
            header = next(values) if header == ALL_ONES_32 else header
            return packed, size, header
        at += 4 + length
    raise BadPackage("a ZIP64 value without its extra field")


def stored_at(file: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes start."""
    if member.method != 0:
        raise BadPackage(f"{member.name} is compressed as a whole and has no byte ranges")
    head = _read(file, member.header, 30)
    if head[:4] != LOCAL:
        raise BadPackage(f"no local header of {member.name}")
    name_len, extra_len = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name_len + extra_len


def build_package(records: list[tuple[dict, bytes]]) -> bytes:
    """A package of gzip records with an index line for each."""
    archive, index = io.BytesIO(), []
    for entry, record in records:
        index.append(json.dumps(entry | {"offset": archive.tell(), "length": len(record)}))
        archive.write(record)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        for name, data in ((ARCHIVE, archive.getvalue()), (INDEX, "\n".join(index).encode())):
            with package.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                member.write(data)
    return out.getvalue()


def warc_record(kind: str, url: str | None, page: int | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """A response or revisit record. Its HTTP header keeps the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page is None else page}",
    ]
    if kind == "revisit":
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    whole = "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parse_record(packed: bytes) -> dict:
    """The fields and payload of one gzip record. Raises BadPackage if they disagree."""
    whole = zlib.decompress(packed, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != sha1):
        raise BadPackage(f"the payload of page {fields['X-Page-ID']} does not have its digest")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": sha1.hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _writer(folder: str, package_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, bytes]] = []
        size = 0

        def packaged() -> pa.RecordBatch:
            # A name for each attempt: only those of finished tasks reach the list of packages.
            uri = f"{folder}/{uuid.uuid4().hex}.zip"
            data = build_package(held)
            write_whole(uri, data)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(data)], pa.int64()), pa.array([len(held)], pa.int64())], ["package", "bytes", "records"])

        for batch in batches:
            for page, url, html, kind, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "record_type", "refers_to")), strict=True):
                payload = (html.as_py() or "").encode()
                page, refers_to = page.as_py(), refers_to.as_py()
                record = warc_record(kind.as_py(), url.as_py(), page, payload, hashlib.sha1(payload).digest(), refers_to)
                held.append(({"page": page, "type": kind.as_py()}, record))
                size += len(record)
                if size >= package_bytes:
                    yield packaged()
                    held, size = [], 0
        if held:
            yield packaged()

    return write


def write_packages(pages: DataFrame, folder: str, package_bytes: int = 32 << 20, digest_from: int = 1000) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a record; return (package, bytes, records).

    The payload is the html in UTF-8; a null is an empty one. Of records with equal
    payloads of at least ``digest_from`` bytes, those with the largest page_id are
    responses, and the others revisits of it. Null page_ids are revisits if another
    row has the payload and an id; rows that repeat the largest page_id are all
    responses. An empty table writes nothing. Other columns are not read.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(html.cast("binary")).alias("digest"), byte_count(html).alias("size"))
    long = rows.where(F.col("size") >= digest_from)
    repeated = ws.save(
        long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("digest", "last"), "repeated"
    )
    # A payload may have very many rows: its one row here is spread over salts.
    salts = 64
    spread = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(F.col("digest").alias("r_digest"), "last", "salt")
    key = F.when(F.col("size") >= digest_from, F.col("digest"))
    marked = rows.withColumn("r_salt", F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(salts)).cast("int")).withColumn(
        "r_key", F.coalesce(key, F.concat(F.lit("-"), F.col("digest"), F.col("page_id").cast("string")))
    )
    joined = marked.join(spread, (F.col("r_key") == F.col("r_digest")) & (F.col("r_salt") == F.col("salt")), "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    records = joined.select(
        "page_id", "url", "html", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to")
    )
    return ws.save(records.mapInArrow(_writer(folder, package_bytes), "package string, bytes long, records long"), "packages")


FIELDS = "package string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(payloads: bool):
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column("package").to_pylist():
                yield from _package(package)

    def _package(package: str) -> Iterator[pa.RecordBatch]:
        fs, path = located(package)
        with fs.open_input_file(path) as file:
            members = {m.name: m for m in central_directory(file, file.size())}
            archive, index = members[ARCHIVE], members[INDEX]
            base = stored_at(file, archive)
            lines = _read(file, stored_at(file, index), index.size).decode().splitlines()
            found, held = [], 0
            for entry in map(json.loads, lines):
                if entry["offset"] + entry["length"] > archive.size:
                    raise BadPackage(f"a record of {package} ends beyond its archive")
                record = parse_record(_read(file, base + entry["offset"], entry["length"])) | {"package": package}
                if not payloads:
                    record["payload"] = None
                held += len(record["payload"] or b"") + 200
                found.append(record)
                if held > 16 << 20:
                    yield batch_of(found)
                    found, held = [], 0
            if found:
                yield batch_of(found)

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    return read


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages named in column ``package``, read by ranges.

    Returns package, page_id, url, payload_bytes, payload_digest (hex SHA-1; both of
    the full payload, for revisits too), record_type, refers_to, and payload (null
    for revisits, or where ``payloads`` is false). No package gives no record; a file
    that is not a package, or a record without its digest, raises BadPackage.
    """
    n = max(1, packages.sparkSession.sparkContext.defaultParallelism)
    return packages.select("package").repartition(n).mapInArrow(_reader(payloads), FIELDS)
