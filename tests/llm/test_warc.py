"""WARC archives: round trips, digests and revisits against plain versions."""

import base64
import gzip
import hashlib
import random
import uuid

import pytest

from spotweave.llm import warc

B32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def plain(rows, least=0):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    for k in order:
        i, body = rows[k][0], (rows[k][2] or "").encode()
        old = len(body) >= least and body in first
        out.append((i, len(body), B32(body), "revisit" if old else "response", first[body] if old else None))
        first.setdefault(body, i)
    return sorted(out, key=repr)


def some_rows():
    rng = random.Random(4)
    long = "".join(rng.choice(["é", "x", "\r\n", "\r", "\n", "WARC/1.1\r\n", "0\r\n\r\n", "€ "]) for _ in range(30_000))
    rows = [
        (7, "http://a.example/1", "<p>one</p>"), (3, "http://a.example/2", "<p>one</p>"), (5, None, None), (4, "x y\r\nz", ""), (9, "u", long), (2, "u", long), (11, "u", long[:-1]),
        (12, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (13, "u", "ends in a return\r"), (14, "u", "a\r\r\n\r\n\r"), (15, "u", "\r\n"), (16, "u", "﻿mark"),
        (None, "u", "<p>one</p>"), (None, "u", "no id"), (None, "u", "no id"), (20, "u", "twice"), (20, "u", "twice"), (21, "u", "nul \x00 inside"), (22, "u", "y" * 16384), (23, "u", "y" * 16385), (24, "u", "y" * 32768),
    ]
    return rows + [(100 + k, "u", "a very common page") for k in range(40)]


@pytest.fixture
def path(spark):
    return f"{warc.shared_dir(spark)}/archives-{uuid.uuid4().hex}"


@pytest.mark.parametrize("least,chunk", [(0, 1 << 14), (0, 7), (11, 1000), (10**9, 1 << 14)])
def test_round_trip(spark, path, least, chunk):
    rows = some_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record int").repartition(3)
    df = warc.stored(df, "pages")
    warc.write_archives(df, path, least_bytes=least, chunk_bytes=chunk)
    got = warc.records(spark, path)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = sorted(((r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got.select(*names).collect()), key=repr)
    assert got == plain(rows, least)


def test_chunked_table(spark, path):
    rows = some_rows()
    df = warc.stored(spark.createDataFrame(rows, "page_id long, url string, html string"), "pages")
    warc.write_archives(df, path, chunk_bytes=1000)
    got = warc.read_archives(spark, path, chunk_bytes=300).where("record_type = 'response'").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.chunk_no):
        assert len(r.chunk) <= 300 and r.chunk_no == len(by.setdefault(r.record_id, []))
        by[r.record_id].append(r)
    bodies = []
    for pieces in by.values():
        body = b""
        for k, r in enumerate(pieces):
            body += bytes(r.chunk)
            assert (r.n_bytes, r.digest, r.last) == (len(body), B32(body), k == len(pieces) - 1)
        bodies.append(body)
    assert sorted(bodies) == sorted({(r[2] or "").encode() for r in rows})


def test_archives_are_plain_warc(spark, path):
    """Read with a loop over whole bytes, apart from the operator's own reader."""
    df = warc.stored(spark.createDataFrame(some_rows(), "page_id long, url string, html string"), "pages")
    warc.write_archives(df, path, date="2020-01-02T03:04:05Z")
    files = [f.removeprefix("file:") for f in spark.read.format("binaryFile").load(path).inputFiles()]
    kinds = []
    for f in files:
        data, at = gzip.decompress(open(f.replace("//", "/"), "rb").read()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *fields = data[at:end].decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in fields)
            length = int(fields["Content-Length"])
            assert version == "WARC/1.1" and fields["WARC-Date"] == "2020-01-02T03:04:05Z"
            at = end + 4 + length + 4
            assert data[at - 4 : at] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
    want = [x[3] for x in plain(some_rows())]
    assert (kinds.count("response"), kinds.count("revisit")) == (want.count("response"), want.count("revisit")) and kinds.count("warcinfo") <= len(files)


def test_binary_payloads(spark, path):
    body = bytes(range(256)) * 300
    df = warc.stored(spark.createDataFrame([(1, "u", bytearray(body))], "page_id long, url string, html binary"), "pages")
    warc.write_archives(df, path)
    assert [(r.payload_bytes, r.payload_digest) for r in warc.records(spark, path).collect()] == [(len(body), B32(body))]


def test_empty_table(spark, path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.records(spark, path).count() == 0


def test_damage_is_found():
    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    one = warc._fields(("WARC-Type", "response"), ("Content-Type", "application/http"), ("Content-Length", len(body))) + body + b"\r\n\r\n"
    reader = warc.Reader()
    assert [p for _, p in reader.feed(one)] == [None, b"abc", b""]
    reader.close()
    reader = warc.Reader()
    list(reader.feed(one[:-8]))
    with pytest.raises(ValueError):
        reader.close()
    with pytest.raises(ValueError):
        list(warc.Reader().feed(b"no record\r\n\r\n"))
    for cut in range(1, len(one)):
        reader = warc.Reader()
        got = [p for part in (one[:cut], one[cut:]) for _, p in reader.feed(part)]
        assert b"".join(p or b"" for p in got) == b"abc"


def test_query_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    pages = duckdb.read_parquet(f"{sf}/pages.parquet")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = duckdb.query(f"SELECT {names} FROM ({warc.OP11_SQL})").fetchall() if pages is not None else None
    got = [tuple(r) for r in warc.op11_warc(spark, sf).select(*names.split(", ")).collect()]
    assert len(got) == 250 and sorted(got) == sorted(want)
