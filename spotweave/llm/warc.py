"""WARC archives through a chunked record table.

A payload is cut, where it is read, into rows of a record number, a chunk number and at most
CHUNK_BYTES bytes; from there on no task holds a whole payload. A first pass carries the digests
of each record from chunk to chunk and keeps one small row of it. Records of equal payload are
decided on those rows. For writing, each record's head (what kind it is, its digest, its length) is a row
with chunk number -1 of the same table; dealt by record and sorted by chunk number, the table streams into
archives, where the digest is carried once more and must come out as in the head. Payloads of more than a chunk are
written in HTTP's chunked transfer coding, a chunk a piece. Archives are gzip-compressed text files of
lines that end with CR LF, so Spark's own writers and readers reach any store. Reading parses the lines of a file as
they arrive, record by record by their Content-Length, and gives the chunked table back, with the digest so far in each row.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, forget, shared_dir, stored

CHUNK_BYTES = 1 << 14
#: Payload bytes of an archive, about; there are as many archives as shuffle partitions at least.
ARCHIVE_BYTES = 1 << 28
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
CRLF = b"\r\n"
#: Fixed names of the WARC and HTTP formats.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
#: The field of a record that holds the id of the row it was made of.
ROW_FIELD = "Source-Row-Id"


def chunk_table(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record, page_id, url, chunk_no, chunk): payloads (text as UTF-8, or binary; null as empty) in pieces, in order within a partition. An empty payload has one empty piece."""
    own = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    )
    pieces = f"transform(sequence(0, cast(greatest(0, (octet_length(payload) - 1) div {chunk_bytes}) as int)), i -> substring(payload, i * {chunk_bytes} + 1, {chunk_bytes}))"
    return own.select("record", "page_id", "url", F.posexplode(F.expr(pieces)).alias("chunk_no", "chunk"))


_DIGEST = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("sha256", pa.binary())])
_DIGEST_SQL = "record long, page_id long, url string, n_bytes long, sha1 string, sha256 binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _digests(batches):
    """One row for each record; a record's pieces follow each other, over batches too."""
    head, size, short, long = None, 0, None, None
    for batch in batches:
        out = []
        for record, page_id, url, no, piece in zip(*(batch.column(c).to_pylist() for c in ("record", "page_id", "url", "chunk_no", "chunk")), strict=True):
            if not no:
                if head:
                    out.append((*head, size, base32(short.digest()), long.digest()))
                head, size, short, long = (record, page_id, url), 0, hashlib.sha1(), hashlib.sha256()
            size += len(piece)
            short.update(piece)
            long.update(piece)
        if out:
            yield batch_of(_DIGEST, *zip(*out, strict=True))
    if head:
        yield batch_of(_DIGEST, *([x] for x in (*head, size, base32(short.digest()), long.digest())))


def heads(digests: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The digest rows with what each record is: first (the record it revisits, null for responses).

    Of equal payloads the row of smallest page_id is the response; rows without an id come after all others.
    """
    same = digests.where(F.col("n_bytes") >= least_bytes).groupBy("sha256", "n_bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record")).alias("f"), F.count(F.lit(1)).alias("_c"))
    same = stored(same.where("_c > 1").select("sha256", "n_bytes", F.col("f.record").alias("first")), "equal-payloads")
    out = digests.join(same, ["sha256", "n_bytes"], "left").withColumn("first", F.when(F.col("first") != F.col("record"), F.col("first")))
    out = out.select("record", "page_id", "url", "n_bytes", "sha1", "first")
    kept = stored(out, "heads")
    forget(same)
    return kept


def _record_id(run: bytes, record: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=run + record.to_bytes(8, 'big'), version=4)}>"  # numbers of records leave the two highest bits free


def _fields(*pairs) -> bytes:
    return VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None) + CRLF


def _escaped(url: str | None) -> str | None:
    """Without blanks and control characters, which would end a field."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def coded_length(size: int, chunk_bytes: int) -> int:
    """Bytes of a payload in the chunked transfer coding."""
    full, rest = divmod(size, chunk_bytes)
    of = lambda n: len(f"{n:x}") + 4 + n
    return full * of(chunk_bytes) + (of(rest) if rest else 0) + 5


class _Lines:
    """Turns sorted rows of the record table into the lines of an archive; a line's own CR LF is left to the sink."""

    def __init__(self, run: bytes, date: str, chunk_bytes: int):
        self.run, self.date, self.chunk_bytes = run, date, chunk_bytes
        self.head = None

    def start(self):
        block = b"software: spotweave\r\nformat: WARC File Format 1.1\r\n"
        yield _fields(("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))) + block + CRLF

    def open(self, record, page_id, url, n_bytes, sha1, first):
        self.head, self.revisit, self.coded = (record, n_bytes, sha1), first is not None, n_bytes > self.chunk_bytes
        self.seen, self.carried = 0, hashlib.sha1()
        http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *([] if self.revisit else ["Transfer-Encoding: chunked"] if self.coded else [f"Content-Length: {n_bytes}"])]
        block = "\r\n".join([*http, "", ""]).encode()
        length = len(block) + (0 if self.revisit else coded_length(n_bytes, self.chunk_bytes) if self.coded else n_bytes)
        yield _fields(
            ("WARC-Type", "revisit" if self.revisit else "response"), ("WARC-Record-ID", _record_id(self.run, record)), ("WARC-Date", self.date), ("WARC-Target-URI", _escaped(url)),
            ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Profile", PROFILE if self.revisit else None), ("WARC-Refers-To", _record_id(self.run, first) if self.revisit else None), (ROW_FIELD, page_id),
            ("Content-Type", HTTP), ("Content-Length", length),
        ) + block[:-2]

    def add(self, record, piece: bytes):
        if self.head is None or record != self.head[0]:
            raise RuntimeError("the pages changed between the passes")
        self.seen += len(piece)
        self.carried.update(piece)
        if not self.revisit:
            yield f"{len(piece):x}\r\n".encode() + piece if self.coded else piece + CRLF

    def close(self):
        if self.head:
            if (self.seen, base32(self.carried.digest())) != self.head[1:]:
                raise RuntimeError("the pages changed between the passes")
            if self.revisit:
                yield CRLF
            elif self.coded:
                yield b"0\r\n\r\n\r\n"
        self.head = None


def write_archives(
    pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None,
) -> None:
    """Write one record per row into gzip-compressed archives under `path` (which must not exist), each with a warcinfo record first.

    Of rows with equal payloads of least_bytes bytes or more, the one of smallest id is a response and the others
    are revisits that refer to it; all other rows are responses. Null payloads are empty. Rows with a null id come after all
    others; of rows that repeat an id and a payload, one is the response. A null url leaves its field out; blanks and control characters
    in one are percent-encoded. Other columns are ignored. An empty table gives no archive. The pages are read twice and must
    give the same rows in the same partitions, as stored tables do; else RuntimeError. A payload goes into one archive whole.
    """
    spark = pages.sparkSession
    chunks = chunk_table(pages, id_column, url, payload, chunk_bytes)
    digests = stored(chunks.mapInArrow(_digests, _DIGEST_SQL), "digests")
    head = heads(digests, least_bytes)
    total = digests.agg(F.sum("n_bytes")).first()[0] or 0
    forget(digests)
    archives = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // archive_bytes))
    first = head.select("record", F.lit(-1).alias("chunk_no"), F.lit(None).cast("binary").alias("chunk"), "page_id", "url", "n_bytes", "sha1", "first")
    table = first.unionByName(chunks.select("record", "chunk_no", "chunk"), allowMissingColumns=True)
    table = table.repartition(archives, "record").sortWithinPartitions("record", "chunk_no")
    run, date = uuid.uuid4().bytes[:8], date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    names, schema = ("record", "chunk_no", "chunk", "page_id", "url", "n_bytes", "sha1", "first"), pa.schema([("value", pa.binary())])

    def write(batches):
        lines = None
        for batch in batches:
            out: list[bytes] = []
            for record, no, piece, *about in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if lines is None:
                    lines = _Lines(run, date, chunk_bytes)
                    out += lines.start()
                if no < 0:
                    out += lines.close()
                    out += lines.open(record, *about)
                else:
                    out += lines.add(record, piece)
            yield batch_of(schema, out)
        if lines:
            yield batch_of(schema, list(lines.close()))

    table.mapInArrow(write, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    forget(head)


class _Payload:
    """The payload of a block that arrives in pieces: without the HTTP head, and without the chunked transfer coding."""

    def __init__(self, http: bool):
        self.state, self.held, self.left = "head" if http else "plain", bytearray(), 0

    def feed(self, data: bytes):
        if self.state == "plain":
            if data:
                yield data
            return
        self.held += data
        while self.held:
            if self.state == "plain":
                yield bytes(self.held)
                self.held.clear()
            elif self.state == "data":
                piece = bytes(self.held[: self.left])
                del self.held[: len(piece)]
                self.left -= len(piece)
                self.state = "data" if self.left else "after"
                yield piece
            else:
                end = self.held.find(CRLF + CRLF if self.state == "head" else CRLF)
                if end < 0:
                    return
                line = bytes(self.held[:end])
                del self.held[: end + (4 if self.state == "head" else 2)]
                if self.state == "head":
                    self.state = "size" if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", line) else "plain"
                elif self.state == "after":
                    if line:
                        raise ValueError("a piece of a chunked payload is longer than it says")
                    self.state = "size"
                elif self.state == "size":
                    self.left = int(line.split(b";")[0], 16)
                    self.state = "data" if self.left else "trailer"
                elif not line:
                    self.state = "done"

    def close(self) -> None:
        if self.state in ("size", "data", "after"):
            raise ValueError("a chunked payload ends early")


class Reader:
    """Records of an archive whose bytes arrive in pieces. `feed` gives (fields, None) where a record begins, (fields, piece) and (fields, b"") at its end."""

    def __init__(self):
        self.held, self.fields, self.left = bytearray(), None, 0

    def feed(self, data: bytes):
        self.held += data
        while self.held:
            if self.fields is None:
                while self.held.startswith(CRLF):
                    del self.held[:2]
                end = self.held.find(CRLF + CRLF)
                if end < 0:
                    return
                first, *lines = bytes(self.held[:end]).split(CRLF)
                del self.held[: end + 4]
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"no record begins with {first[:40]!r}")
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}
                self.left = int(self.fields["content-length"])
                self.payload = _Payload(self.fields.get("content-type", "").startswith("application/http"))
                yield self.fields, None
            piece = bytes(self.held[: self.left])
            del self.held[: len(piece)]
            self.left -= len(piece)
            for x in self.payload.feed(piece):
                yield self.fields, x
            if self.left:
                return
            self.payload.close()
            done, self.fields = self.fields, None
            yield done, b""

    def close(self) -> None:
        if self.fields is not None or self.held.strip(CRLF):
            raise ValueError("an archive ends inside a record")


_CHUNK = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.string()), ("refers_to_record", pa.string()), ("named_digest", pa.string()),
    ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()),
])
_CHUNK_SQL = "record_id string, record_type string, target_uri string, page_id string, refers_to_record string, named_digest string, chunk_no long, chunk binary, n_bytes long, digest string, last boolean"


def read_archives(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of gzip-compressed archives: a row for each piece of each record, with the bytes and the SHA-1 so far.

    A record without a payload has one row with an empty piece. With with_chunks false there is one row a record, its last,
    without the piece. A payload that does not have the digest its record names, and an archive that
    is damaged or ends early, raise ValueError. Files that Spark would cut (not gzip) are refused.
    """
    lines = spark.read.option("lineSep", "\r\n").text(path)
    if any(not f.endswith(".gz") for f in lines.inputFiles()):
        raise ValueError("archives are read as gzip files only")

    def read(batches):
        reader = Reader()
        names = ("warc-record-id", "warc-type", "warc-target-uri", ROW_FIELD.lower(), "warc-refers-to", "warc-payload-digest")
        held, no, size, carried = bytearray(), 0, 0, None
        for batch in batches:
            out = []

            def put(fields, piece, last, out=out):
                nonlocal no, size
                size += len(piece)
                carried.update(piece)
                if with_chunks or last:
                    out.append((*(fields.get(x) for x in names), no, piece if with_chunks else None, size, base32(carried.digest()), last))
                no += 1

            for line in batch.column("value").to_pylist():
                for fields, piece in reader.feed(line + CRLF):
                    if piece is None:
                        no, size, carried = 0, 0, hashlib.sha1()
                        held.clear()
                    elif piece:
                        held += piece
                        while len(held) > chunk_bytes:
                            put(fields, bytes(held[:chunk_bytes]), False)
                            del held[:chunk_bytes]
                    else:
                        put(fields, bytes(held), True)
                        named = fields.get("warc-payload-digest")
                        if fields["warc-type"] != "revisit" and named and named.startswith("sha1:") and named[5:] != base32(carried.digest()):
                            raise ValueError(f"the payload of {fields.get('warc-record-id')} is not the one its digest names")
            if out:
                yield batch_of(_CHUNK, *zip(*out, strict=True))
        reader.close()

    return lines.select(F.col("value").cast("binary")).mapInArrow(read, _CHUNK_SQL)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit of the archives: record_id, page_id (string), target_uri, record_type, payload_bytes, payload_digest, refers_to.

    A revisit has the bytes of the response it refers to (null if no archive under `path` holds that); refers_to is that response's page_id.
    """
    found = stored(read_archives(spark, path, with_chunks=False).where(F.col("record_type").isin("response", "revisit")).drop("chunk"), "records")
    bare = F.regexp_replace("named_digest", "^sha1:", "")
    whole = found.where("record_type = 'response'")
    own = whole.select("record_id", "page_id", "target_uri", "record_type", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"))
    other = whole.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("_d"))
    again = found.where("record_type = 'revisit'").drop("n_bytes", "digest").join(other, "refers_to_record", "left")
    same = F.when(F.coalesce(F.col("_d"), bare) == bare, bare).otherwise(F.raise_error(F.lit("a revisit refers to another payload")).cast("string"))
    return own.unionByName(again.select("record_id", "page_id", "target_uri", "record_type", "payload_bytes", same.alias("payload_digest"), "refers_to"))


def op11_warc(spark, sf_dir) -> DataFrame:
    """All pages written as WARC records and read back: sizes, digests, kinds and references."""
    path = f"{shared_dir(spark)}/spotweave-archives-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path, least_bytes=LEAST_BYTES)
    found = records(spark, path)
    return found.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


OP11_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, row_number() OVER () AS row FROM pages
), d AS (
  SELECT page_id, strlen(body) AS n, sha1(body) AS h,
         first_value(page_id) OVER same AS first_id, row_number() OVER same AS place
  FROM p WINDOW same AS (PARTITION BY body ORDER BY page_id NULLS LAST, row)
), quads AS (
  SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::INT) AS q FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[i // 4 + 1] >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN n >= 0 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 0 AND place > 1 THEN first_id END AS refers_to
FROM quads
"""
