"""Web archives inside ZIP packages: written by tasks, read back record by record without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member a record), its index ``indexes/index.cdxj``
and a description, all stored, that is uncompressed by the package. The reader looks up a package's
central directory (ZIP64 where its numbers ask for it), finds the stored archive members and the
lines of their indexes, and turns them into byte ranges of the package. Ranges are ordinary rows, so
Spark spreads them over the cluster, and a task reads just the bytes of its records. Archive members
without index lines are walked once to find where their records begin.

Packages lie in the shared checkpoint folder and are opened through ``pyarrow.fs`` (local and shared
mounts, object stores, HDFS). Their names are new for every attempt of a task, and only the stored
list of packages is read, so repeated and lost tasks leave no record twice or unread.

Payloads of at least 100 bytes that occur again are written once: the row of smallest ``page_id``
becomes the response, the others revisits that refer to it. Which rows those are is decided on
digests; payloads are not shuffled unless repeated payloads are too many to broadcast.

Defined results: a null ``html`` is an empty payload, a null ``url`` leaves the header out. A null
``page_id`` comes after all others; where a payload has no other, all its rows are responses. Rows
that repeat the smallest ``page_id`` of a payload are all responses. Very long payloads are one
record. An empty table writes no package and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import map_batches, stored, table
from pairlens.session import ensure_checkpoint_dir

LEAST_REVISITED = 100
#: A package ends at so many bytes of archive.
PACKAGE_BYTES = 256 << 20
#: Neighbouring records are read together up to so many bytes; tasks get ranges of about so many.
RANGE_BYTES, TASK_BYTES = 1 << 20, 32 << 20
#: Up to this many repeated payloads are broadcast (under 20 MB); beyond, rows are shuffled by digest
#: except those of payloads with over a thousandth of the rows each, which are fewer than a thousand.
BROADCAST_PAYLOADS, HOT_SHARE = 200_000, 1000
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the ZIP format: signatures, sizes of the fixed parts, and the marks for "see ZIP64".
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR64_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE, LONGEST_COMMENT = 22, 20, 56, 46, 30, 0xFFFF
FULL16, FULL32, EXTRA64, STORED = 0xFFFF, 0xFFFFFFFF, 1, 0


class Member(NamedTuple):
    name: str
    method: int
    header: int
    size: int


def open_file(path: str, mode: str = "r"):
    """A file of any store that pyarrow knows, for reading at any place or for writing."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    if mode == "r":
        return store.open_input_file(inner)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)


# ---------------------------------------------------------------- directories of packages


def members(f) -> Iterator[Member]:
    """The members that a package's central directory names, in its order.

    The directory is read a piece at a time. Bytes in front of the package are allowed for.
    """
    size = f.size()
    tail_at = max(0, size - END_SIZE - LONGEST_COMMENT)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") > len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = tail_at + at
    if count == FULL16 or FULL32 in (length, start):
        locator = f.read_at(LOCATOR64_SIZE, end - LOCATOR64_SIZE) if end >= LOCATOR64_SIZE else b""
        if locator[:4] == LOCATOR64:
            (named,) = struct.unpack("<Q", locator[8:16])
            # Where bytes stand in front, the record is still next to its locator.
            for place in (named, end - LOCATOR64_SIZE - END64_SIZE):
                record = f.read_at(END64_SIZE, place)
                if record[:4] == END64:
                    break
            else:
                raise ValueError("ZIP64 locator without its directory record")
            count, length, start = struct.unpack("<QQQ", record[32:56])
            end = place
    shift = end - length - start
    if shift < 0:
        raise ValueError("central directory lies beyond the package")
    at, stop, held = start + shift, end, b""
    for _ in range(count):
        while len(held) < ENTRY_SIZE or len(held) < ENTRY_SIZE + sum(struct.unpack("<HHH", held[28:34])):
            more = f.read_at(min(RANGE_BYTES, stop - at), at)
            if not more:
                raise ValueError("central directory ends early")
            held, at = held + more, at + len(more)
        if held[:4] != ENTRY:
            raise ValueError("central directory entry expected")
        flags, method = struct.unpack("<HH", held[8:12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", held[20:34])
        (header,) = struct.unpack("<I", held[42:46])
        name = held[ENTRY_SIZE : ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = held[ENTRY_SIZE + n_name : ENTRY_SIZE + n_name + n_extra]
        held = held[ENTRY_SIZE + n_name + n_extra + n_comment :]
        wide = _extra64(extra)
        if full == FULL32:
            full, wide = wide[0], wide[1:]
        if packed == FULL32:
            packed, wide = wide[0], wide[1:]
        if header == FULL32:
            header = wide[0]
        yield Member(name, method, header + shift, packed)


def _extra64(extra: bytes) -> tuple[int, ...]:
    """The 64-bit numbers of an entry, in the order of the fields they stand for."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == EXTRA64:
            body = extra[at + 4 : at + 4 + n // 8 * 8]
            return struct.unpack(f"<{len(body) // 8}Q", body)
        at += 4 + n
    return ()


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin, which its own header tells."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed by the package and cannot be read by range")
    header = f.read_at(LOCAL_SIZE, member.header)
    if header[:4] != LOCAL:
        raise ValueError(f"{member.name}: no local header where the directory says")
    return member.header + LOCAL_SIZE + sum(struct.unpack("<HH", header[26:30]))


# ---------------------------------------------------------------- records and their ranges


class _Window(io.RawIOBase):
    """Some bytes of a file as a stream, read piece by piece."""

    def __init__(self, f, start: int, size: int):
        self._f, self._at, self._end = f, start, start + size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self._f.read_at(min(len(into), self._end - self._at), self._at)
        into[: len(got)] = got
        self._at += len(got)
        return len(got)


def _index_lines(f, member: Member) -> Iterator[tuple[str, int, int]]:
    """(archive's file name, offset, length) of every line of an index member."""
    stream = io.BufferedReader(_Window(f, data_start(f, member), member.size), RANGE_BYTES)
    if member.name.endswith(".gz"):
        import gzip

        stream = gzip.open(stream)
    for line in stream:
        at = line.find(b"{")
        if at >= 0:
            entry = json.loads(line[at:])
            yield entry["filename"], int(entry["offset"]), int(entry["length"])


def _walked(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members of an archive, found by unpacking it once."""
    stream, at, begin = _Window(f, start, size), 0, 0
    unpack, rest = zlib.decompressobj(31), b""
    while rest or (rest := stream.read(RANGE_BYTES)):
        unpack.decompress(rest)
        at += len(rest) - len(unpack.unused_data)
        rest = unpack.unused_data
        if unpack.eof:
            yield begin, at - begin
            begin, unpack = at, zlib.decompressobj(31)
    if at > begin:
        raise ValueError("the archive's last record is cut short")


def _ranges(path: str) -> Iterator[tuple[int, list[int]]]:
    """(place in the package, lengths of the records from there) for runs of neighbouring records."""
    with open_file(path) as f:
        archives, indexes = {}, []
        for m in members(f):
            if re.fullmatch(r"archive/.+\.warc\.gz", m.name):
                archives[m.name.removeprefix("archive/")] = m
            elif re.fullmatch(r"indexes/.+\.cdxj?(\.gz)?", m.name):
                indexes.append(m)
        found: dict[str, list[tuple[int, int]]] = {name: [] for name in archives}
        for index in indexes:
            for name, offset, length in _index_lines(f, index):
                found[name.removeprefix("archive/")].append((offset, length))
        for name, member in archives.items():
            start = data_start(f, member)
            records = found.pop(name) or list(_walked(f, start, member.size))
            places = np.array(records, np.int64).reshape(-1, 2)
            places = places[np.argsort(places[:, 0], kind="stable")]
            run: list[int] = []
            for offset, length in places.tolist():
                if run and (offset != begin + sum_ or sum_ + length > RANGE_BYTES):
                    yield start + begin, run
                    run = []
                if not run:
                    begin, sum_ = offset, 0
                run.append(length)
                sum_ += length
            if run:
                yield start + begin, run


def _head(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """(first line, fields by lower-case name, what follows the empty line)."""
    head, _, rest = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


class Record(NamedTuple):
    record_id: str
    record_type: str
    target_uri: str | None
    refers_to: str | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def parse_record(packed: bytes) -> Record:
    """One gzip member of an archive; a response's payload must match its digest."""
    version, fields, rest = _head(zlib.decompress(packed, 31))
    if not version.startswith("WARC/"):
        raise ValueError("WARC record expected")
    block = rest[: int(fields["content-length"])]
    _, http, payload = _head(block)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"{fields['warc-record-id']}: payload does not match its digest")
    else:
        size, payload = int(http["content-length"]), None
    return Record(
        fields["warc-record-id"].strip("<>"),
        kind,
        fields.get("warc-target-uri"),
        fields.get("warc-refers-to", "").strip("<>") or None,
        size,
        digest,
        payload,
    )


def read_packages(packages: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the packages named in column ``path``, with their payloads if wanted."""

    def ranges(batch: pa.RecordBatch) -> Iterator[dict]:
        for path in batch.column("path").to_pylist():
            found = list(_ranges(path))
            if found:
                at, lengths = zip(*found)
                yield {"path": [path] * len(at), "at": at, "lengths": lengths}

    def records(batch: pa.RecordBatch) -> Iterator[dict]:
        path, f = None, None
        for row in batch.to_pylist():
            if row["path"] != path:
                if f is not None:
                    f.close()
                path, f = row["path"], open_file(row["path"])
            held, at, out = f.read_at(sum(row["lengths"]), row["at"]), 0, []
            for n in row["lengths"]:
                out.append(parse_record(held[at : at + n]))
                at += n
            yield {k: list(v) for k, v in zip(Record._fields, zip(*out))}

    spread = stored(map_batches(packages.select("path"), ranges, "path string, at long, lengths array<long>"))
    total = spread.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()[0].n
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"
    schema += ", payload binary" if payload else ""
    return map_batches(spread.repartition(max(1, math.ceil((total or 0) / TASK_BYTES))), records, schema)


# ---------------------------------------------------------------- writing


def _surt(url: str) -> str:
    """The url with its host's labels reversed, as indexes are sorted."""
    host, slash, path = url.partition("://")[2].partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + path.replace(" ", "%20")


class _Package:
    """A package that is being written, record by record."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        self._out = open_file(self.path, "w")
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._archive = self._zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.bytes, self._index = 0, []

    def add(self, record: bytes, url: str, fields: dict) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = pack.compress(record) + pack.flush()
        self._archive.write(packed)
        entry = fields | {"url": url, "filename": "data.warc.gz", "offset": self.bytes, "length": len(packed)}
        self._index.append(f"{_surt(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}\n")
        self.bytes += len(packed)

    def close(self) -> dict:
        self._archive.close()
        self._zip.writestr("indexes/index.cdxj", "".join(sorted(self._index)))
        about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": "archive/data.warc.gz", "bytes": self.bytes}]}
        self._zip.writestr("datapackage.json", json.dumps(about))
        self._zip.close()
        self._out.close()
        return {"path": [self.path], "bytes": [self.bytes], "records": [len(self._index)]}


def _record_id(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _record(page_id, url, html: bytes, digest: str, first, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if revisit else http + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_record_id(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{_record_id(first)}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_first(rows: DataFrame) -> DataFrame:
    """Adds ``first``: the smallest ``page_id`` of a payload that occurs again, else null."""
    groups = stored(
        rows.where(F.col("payload_bytes") >= LEAST_REVISITED)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    if groups.count() <= BROADCAST_PAYLOADS:
        return rows.join(F.broadcast(groups.drop("n")), "payload_digest", "left")
    least = groups.agg(F.sum("n")).collect()[0][0] // HOT_SHARE
    hot = groups.where(F.col("n") > least).select("payload_digest", F.col("first").alias("hot"), F.lit(True).alias("is_hot"))
    rest = groups.where(F.col("n") <= least).select(F.col("payload_digest").alias("key"), "first")
    rows = rows.join(F.broadcast(hot), "payload_digest", "left")
    spread = F.when(F.col("is_hot"), F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    return (
        rows.withColumn("key", F.coalesce(spread, "payload_digest"))
        .join(rest, "key", "left")
        .withColumn("first", F.coalesce("hot", "first"))
        .drop("key", "hot", "is_hot")
    )


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``page_id, url, html`` rows; the stored list of packages (path, bytes, records)."""
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    rows = pages.select(
        F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html")
    )
    rows = with_first(rows.withColumn("payload_bytes", F.length("html")).withColumn("payload_digest", F.sha2("html", 256)))

    def write(batches):
        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        package = None
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, digest, first = (
                    batch.column(c)[k].as_py() for c in ("page_id", "url", "html", "payload_digest", "first")
                )
                package = package or _Package(folder)
                revisit = first is not None and page != first
                url = url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                about = {"digest": f"sha256:{digest}", "mime": "warc/revisit" if revisit else "text/html"}
                package.add(_record(page, url, html, digest, first, revisit), url or "", about)
                if package.bytes >= PACKAGE_BYTES:
                    yield pa.RecordBatch.from_pydict(package.close(), schema)
                    package = None
        if package:
            yield pa.RecordBatch.from_pydict(package.close(), schema)

    return stored(rows.mapInArrow(write, "path string, bytes long, records long"))


def op12_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read_packages(packages, payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


ORACLE = f"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISITED} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
