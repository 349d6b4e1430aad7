from __future__ import annotations

import gzip
import hashlib
import io
import random
import zipfile

import duckdb
import pytest

from pairlens.llm import zip_archives as z
from tests.oracle_check import compare

SCHEMA = "page_id long, url string, html string, first long"


def odd_rows():
    rng = random.Random(4)
    big = ["x" * 100, "ü" * 50, "y" * 99, "é" * 49 + "z", "<p>\r\n\r\nbody</p>" * 20, "WARC/1.1\r\n\r\n" * 30, "long " * 300_000]
    rows = [(k, f"http://h{k % 5}.org/a?b={k}", rng.choice([*big, None, "", f"only {k} " * 30]), 7) for k in range(200)]
    rows += [(0, "u\r\nX: y z", big[0], 7), (0, None, big[0], 7), (None, "", big[0], 7), (None, "ж://п/ü", "w" * 200, 7), (None, None, "w" * 200, 7)]
    return rows


def brute(rows):
    first = {}
    for page, _, html, _ in rows:
        if page is not None:
            first[html] = min(first.get(html, page), page)
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        to = first.get(html) if len(raw) >= 100 else None
        to = None if to == page else to
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return out


def plain(rows):
    return sorted(tuple(r) for r in rows) if all(r[0] is not None for r in rows) else sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("broadcast,package", [(200_000, 256 << 20), (1, 4000)])
def test_round_trip_equals_brute_force(spark, tmp_path, monkeypatch, broadcast, package):
    monkeypatch.setattr(z, "BROADCAST_PAYLOADS", broadcast)
    monkeypatch.setattr(z, "HOT_SHARE", 10)
    monkeypatch.setattr(z, "PACKAGE_BYTES", package)
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    out = z.op12_zip_archives(spark, str(tmp_path))
    assert plain(out.collect()) == plain(brute(rows))
    known = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    con = duckdb.connect()
    known.write.parquet(f"{tmp_path}/known/pages.parquet")
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/known/pages.parquet/*.parquet')")
    assert compare(z.op12_zip_archives(spark, f"{tmp_path}/known"), con, z.ORACLE) is None


def test_payloads_and_urls_come_back(spark, tmp_path):
    rows = odd_rows()
    packages = z.write_packages(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/p")
    got = z.read_packages(packages).where("record_type = 'response'").collect()
    html = {(f"urn:page:{'none' if p is None else p}", h or "") for p, _, h, _ in rows}
    assert all((r.record_id, bytes(r.payload).decode()) in html for r in got)
    assert {r.target_uri for r in got if r.record_id == "urn:page:0"} <= {"http://h0.org/a?b=0", "u%0D%0AX:%20y%20z", None}
    # Other tools read the same packages.
    for path in [r.path for r in packages.collect()]:
        with zipfile.ZipFile(path.removeprefix("file:")) as f:
            assert f.testzip() is None
            assert {i.compress_type for i in f.infolist()} == {zipfile.ZIP_STORED}
            data = gzip.decompress(f.read("archive/data.warc.gz"))
            assert data.count(b"WARC-Record-ID: ") == len(f.read("indexes/index.cdxj").splitlines())


def package(path, members, comment=b"", front=b"", zip64=False, compress=zipfile.ZIP_STORED):
    """A package by another writer; ``zip64`` rewrites its end so that all numbers stand in the ZIP64 record."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", compress) as f:
        for name, data in members:
            f.writestr(name, data)
    raw = held.getvalue()
    at = raw.rfind(z.END)
    count, length, start = (int.from_bytes(raw[at + a : at + b], "little") for a, b in ((10, 12), (12, 16), (16, 20)))
    body, end = raw[:at], raw[at : at + 20]
    if zip64:
        import struct

        entries, place, wide = body[start:], 0, b""
        while place < len(entries):
            e = bytearray(entries[place : place + 46])
            n, x, c = struct.unpack("<HHH", e[28:34])
            name = entries[place + 46 : place + 46 + n]
            numbers = struct.unpack("<II", e[20:28])
            (header,) = struct.unpack("<I", e[42:46])
            extra = struct.pack("<HHB", 0x7777, 1, 0) + struct.pack("<HHQQQ", 1, 24, numbers[1], numbers[0], header)
            e[20:28], e[42:46], e[30:32] = b"\xff" * 8, b"\xff" * 4, struct.pack("<H", len(extra))
            wide += bytes(e) + name + extra
            place += 46 + n + x + c
        body = body[:start] + wide
        record = z.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(wide), start)
        locator = z.LOCATOR64 + struct.pack("<IQI", 0, len(body), 1)
        body += record + locator
        end = z.END + b"\0\0\0\0" + b"\xff" * 12
    with open(path, "wb") as f:
        f.write(front + body + end + len(comment).to_bytes(2, "little") + comment)
    return str(path)


def records(n):
    return [gzip.compress(z._record(k, f"http://a/{k}", b"p%d" % k * k, hashlib.sha256(b"p%d" % k * k).hexdigest(), None, False)) for k in range(n)]


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("front", [b"", b"#!/bin/sh\n" * 9])
def test_foreign_packages(spark, tmp_path, monkeypatch, zip64, front):
    monkeypatch.setattr(z, "RANGE_BYTES", 700)
    parts = records(40)
    members = [(f"pages/p{k}.txt", "t" * k) for k in range(30)] + [("archive/sub/one.warc.gz", b"".join(parts))]
    path = package(tmp_path / "a.wacz", members, b"PK\x05\x06 in a comment", front, zip64)
    with z.open_file(path) as f:
        assert [(m.name, m.size) for m in z.members(f)] == [(n, len(d)) for n, d in members]
    found = z.read_packages(spark.createDataFrame([(path,)], "path string"))
    assert sorted(int(r.record_id[9:]) for r in found.collect()) == list(range(40))


def test_broken_packages(tmp_path):
    parts = records(3)
    cases = {
        "no end": b"PK\x03\x04" + b"x" * 50,
        "empty": b"",
    }
    for name, raw in cases.items():
        (tmp_path / name).write_bytes(raw)
        with z.open_file(str(tmp_path / name)) as f, pytest.raises(ValueError):
            list(z.members(f))
    cut = package(tmp_path / "cut", [("archive/a.warc.gz", b"".join(parts)[:-5])])
    with pytest.raises(ValueError, match="cut short"):
        list(z._ranges(cut))
    packed = package(tmp_path / "packed", [("archive/a.warc.gz", b"".join(parts))], compress=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        list(z._ranges(packed))
    bad = gzip.compress(gzip.decompress(parts[2]).replace(b"p2p2", b"p2p3"))
    with pytest.raises(ValueError, match="digest"):
        z.parse_record(bad)


def test_empty_table(spark, tmp_path):
    packages = z.write_packages(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert packages.count() == 0 and z.read_packages(packages).count() == 0
