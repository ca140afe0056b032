"""Substring deduplication over a compacted de Bruijn graph of word k-mers.

Every window of `k` words is an edge. Edges travel as packed byte planes (7 hash bytes and
a position), dealt by hash in one or more radix levels, so that a bucket is bounded at every size;
inside a block of documents equal edges are merged first, so a very common passage costs one edge per
block, not per document. Where an edge occurs again, it is labelled by its source coordinates: the
smallest document that holds it, and the place there. Back at the document (a join on the document),
consecutive edges whose source coordinates are consecutive form one nonbranching path and are compacted
to one span, cut at every GRID-th source place, so that the distinct spans that name a source are bounded
by its length. A last join takes the distinct spans to their source document and compares a 128-bit digest
of the words there. A span that fails (a hash collision) is not removed; the documents that have one
are judged again under another hash, until each of its windows has been judged by one without failure.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, as_bytes, batch_of, blocks, ragged, stored

WORDS = 13
#: Text bytes of a block in which equal edges are merged before they are sent.
EDGE_BLOCK = 8 << 20
#: Edges that one bucket should hold; the number of buckets follows from the table's size.
BUCKET_EDGES = 1 << 20
#: Buckets that one radix level deals to; more buckets take more levels.
FAN_OUT = 1 << 14
#: Paths are cut at source places that are multiples of this.
GRID = 64
#: Groups of documents for every bucket: a group's occurrences meet in one task.
DOCUMENT_GROUPS = 4

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _letters(seed: int) -> np.ndarray:
    """Random odd numbers for the bytes, one set for each hash."""
    return np.random.default_rng([20240229, seed]).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(p: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), p, np.uint64))


def word_hashes(texts: list[bytes], seed: int = 0, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, in order, and the number of words of each text."""
    hashes, counts, part, size, letters = [], [], [], 0, _letters(seed)
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= chunk or k == len(texts) - 1:
            h, c = _hash_chunk(part, letters)
            hashes.append(h)
            counts.append(c)
            part, size = [], 0
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(counts or [np.zeros(0, np.int64)])


def _hash_chunk(texts: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if len(starts):
        inside = np.flatnonzero(~space)
        value = letters[data[inside]]
        inside -= np.repeat(starts, sizes)
        value *= _powers(_P, int(sizes.max()))[inside]
        out = _mixed(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    last = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return out, np.diff(np.concatenate([[0], last]))


def window_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and place of every window of k words that lies in one text."""
    windows = np.maximum(counts - k + 1, 0)
    total = len(words) - k + 1
    if total <= 0 or not windows.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled = np.zeros(total, np.uint64)
    for p, j in zip(_powers(_Q, k), range(k), strict=True):
        rolled += words[j : j + total] * p
    owner = np.repeat(np.arange(len(counts)), windows)
    at = ragged(np.cumsum(counts) - counts, windows)
    return _mixed(rolled[at]), owner, at - (np.cumsum(counts) - counts)[owner]


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of integers, one byte plane after another: equal planes compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


_EDGES = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("ths", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary()), ("sources", pa.binary())])
_EDGES_SQL = "bucket long, ids binary, ths binary, counts binary, hashes binary, places binary, sources binary"
_SOURCES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("places", pa.binary()), ("owners", pa.binary()), ("sources", pa.binary())])
_SOURCES_SQL = "doc_id long, th long, places binary, owners binary, sources binary"
#: Occurrences of many documents in one row: all columns are packed.
_GROUPS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("ths", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("owners", pa.binary()), ("sources", pa.binary())])
_GROUPS_SQL = "part int, ids binary, ths binary, counts binary, places binary, owners binary, sources binary"


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The group of documents that an id belongs to."""
    return (_mixed(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _grouped(ids, ths, doc, place, owner, source, parts):
    """Occurrences (doc: index into ids and ths) to one packed row per group of documents."""
    if not len(doc):
        return batch_of(_GROUPS, *[[]] * 7)
    part = _part_of(ids, parts)[doc]
    order = np.lexsort((place, doc, part))
    part, doc, place, owner, source = part[order], doc[order], place[order], owner[order], source[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        d = doc[a:b]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        count = np.diff(np.append(first, len(d)))
        own = d[first]
        rows.append((int(part[a]), ids[own].tobytes(), ths[own].tobytes(), planes(count, 4), planes(place[a:b], 4), planes(owner[a:b].view(np.uint64), 8), planes(source[a:b], 4)))
    return batch_of(_GROUPS, *zip(*rows, strict=True))


def _by_document(table: pa.Table) -> pa.Table:
    """The packed rows of a group of documents to one row per document."""
    ids, ths, doc, place, owner, source, base = [], [], [], [], [], [], 0
    for row in table.to_pylist():
        own = np.frombuffer(row["ids"], np.int64)
        ids.append(own)
        ths.append(np.frombuffer(row["ths"], np.int64))
        doc.append(np.repeat(np.arange(len(own)) + base, unplanes(row["counts"], 4).astype(np.int64)))
        place.append(unplanes(row["places"], 4))
        owner.append(unplanes(row["owners"], 8))
        source.append(unplanes(row["sources"], 4))
        base += len(own)
    ids, ths, doc, place, owner, source = (np.concatenate(x) for x in (ids, ths, doc, place, owner, source))
    order = np.lexsort((place, ths[doc], ids[doc]))
    a, b = ids[doc[order]], ths[doc[order]]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    rows = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        o = order[lo:hi]
        rows.append((planes(place[o], 4), planes(owner[o], 8), planes(source[o], 4)))
    return pa.Table.from_batches([batch_of(_SOURCES, pa.array(a[first]), pa.array(b[first]), *zip(*rows, strict=True))])


def _first_of(hashes, ids, doc, place):
    """Entries by (hash, id, document row, place), the first of each hash and row, and each entry's owner and source."""
    order = np.lexsort((place, doc, ids[doc], hashes))
    h, d = hashes[order], doc[order]
    head = np.ones(len(order), bool)
    head[1:] = h[1:] != h[:-1]
    row = head.copy()
    row[1:] |= d[1:] != d[:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return order, row, ids[doc[lead]], place[lead]


def edge_rows(docs: DataFrame, buckets: int, parts: int, k: int = WORDS, seed: int = 0) -> DataFrame:
    """Packed edges by bucket of the first level, and (bucket below 0: a group of documents) what a block finds repeated among its own documents."""
    bits = buckets.bit_length() - 1

    def run(batches):
        for batch in blocks(batches, "text", EDGE_BLOCK):
            ids, ths = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            hashes, doc, place = window_hashes(*word_hashes([t or b"" for t in as_bytes(batch.column("text"))], seed), k)
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            h = hashes[order]
            same = h[1:] == h[:-1]
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            send = order[~many]
            if many.any():
                part = order[many]
                o, row, owner, source = _first_of(hashes[part], ids, doc[part], place[part])
                entry = part[o]
                later = ids[doc[entry]] > owner  # settled here: only the block's smallest id is sent on
                send = np.concatenate([send, entry[row & ~later]])
                settled = _grouped(ids, ths, doc[entry][later], place[entry][later], owner[later], source[later], parts)
                if settled.num_rows:
                    yield batch_of(_EDGES, pa.array(-1 - settled.column(0).to_numpy().astype(np.int64)), *[settled.column(c) for c in (1, 2, 3, 5, 4)], settled.column(6))
            yield from _dealt(hashes[send], ids, ths, doc[send], place[send], 0, bits, 0)

    rows = docs.where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, _EDGES_SQL)


def _dealt(hashes, ids, ths, doc, place, above: int, bits: int, bucket: int):
    """Edges (doc: index into ids and ths) to a packed row for each bucket: `bits` bits of the hash below the first `above`."""
    deal = (hashes >> np.uint64(64 - above - bits)).astype(np.int64) & ((1 << bits) - 1) if bits else np.zeros(len(hashes), np.int64)
    order = np.lexsort((place, doc, deal))
    hashes, doc, place, deal = hashes[order], doc[order], place[order], deal[order]
    cuts = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1], [True]])) if len(deal) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        d, own = doc[lo:hi], place[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        count = np.diff(np.append(first, len(d)))
        step = np.diff(own, prepend=0)
        step[first] = own[first]
        row = ((bucket << bits) | int(deal[lo]), ids[d[first]].tobytes(), ths[d[first]].tobytes(), planes(count, 4), planes(hashes[lo:hi], 7), planes(step, 4), None)
        yield batch_of(_EDGES, *([x] for x in row))


def _unpacked(rows: list):
    """ids, ths, and for each edge document (index into them), hash (low 7 bytes) and place, of packed rows."""
    ids, ths, doc, hashes, place, base = [], [], [], [], [], 0
    for row in rows:
        own = np.frombuffer(row["ids"], np.int64)
        count = unplanes(row["counts"], 4).astype(np.int64)
        step = unplanes(row["places"], 4).astype(np.int64)
        total = np.cumsum(step)
        first = np.cumsum(count) - count
        place.append(total - np.repeat(total[first] - step[first], count))
        doc.append(np.repeat(np.arange(len(own)) + base, count))
        hashes.append(unplanes(row["hashes"], 7))
        ids.append(own)
        ths.append(np.frombuffer(row["ths"], np.int64))
        base += len(own)
    return [np.concatenate(x) for x in (ids, ths, doc, hashes, place)]


def _resolve(table: pa.Table, parts: int):
    """All edges of a bucket: each repeated one to its source coordinates."""
    ids, ths, doc, hashes, place = _unpacked(table.to_pylist())
    order = np.argsort(hashes)
    h = hashes[order]
    same = h[1:] == h[:-1]
    part = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    o, _, owner, source = _first_of(hashes[part], ids, doc[part], place[part])
    entry = part[o]
    later = ids[doc[entry]] > owner
    return pa.Table.from_batches([_grouped(ids, ths, doc[entry][later], place[entry][later], owner[later], source[later], parts)])


def _levels(bits: int) -> list[int]:
    """Bits of the hash that each radix level deals by; 56 bits travel, so the first 8 belong to the first level."""
    most, out = FAN_OUT.bit_length() - 1, []
    while bits > 0:
        out.append(min(bits, most))
        bits -= out[-1]
    return out or [0]


def _deeper(edges: DataFrame, above: int, bits: int, hold: int = BUCKET_EDGES) -> DataFrame:
    """Edges of the buckets of one level dealt to those of the next, at most about `hold` of them at once. Settled ones pass."""

    def run(batches):
        held, size, now = [], 0, None

        def flush():
            if held:
                ids, ths, doc, hashes, place = _unpacked(held)
                if above < 8:  # the top byte does not travel: of it the levels above know the first bits, and this one none
                    raise ValueError("the first level deals by 8 bits at least")
                yield from _dealt(hashes, ids, ths, doc, place, above, bits, now)

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    yield batch_of(_EDGES, *([row[c]] for c in _EDGES.names))
                    continue
                if row["bucket"] != now or size >= hold:
                    yield from flush()
                    held, size, now = [], 0, row["bucket"]
                held.append(row)
                size += len(row["hashes"]) // 7
        yield from flush()

    count = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << min(above, 12))
    return edges.repartition(count, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _EDGES_SQL)


def repeated_edges(docs: DataFrame, k: int = WORDS, buckets: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, th, places, owners, sources): packed places of repeated windows and their source coordinates, stored."""
    if buckets is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >> 50:  # no figure is known for this plan
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = 1 << (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()  # a file's size may tell little of its text's
        while buckets * BUCKET_EDGES < size // 2:
            buckets *= 2
    levels = _levels(buckets.bit_length() - 1)
    parts = min(buckets, 1 << 24) * DOCUMENT_GROUPS
    edges = edge_rows(docs, 1 << levels[0], parts, k, seed)
    for n, bits in enumerate(levels[1:], 1):
        edges = _deeper(edges, sum(levels[:n]), bits)

    def both(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= 0:
            return _resolve(table, parts)
        part = pa.array(-1 - table.column("bucket").to_numpy(), pa.int32())
        return pa.table([part, *[table.column(c) for c in ("ids", "ths", "counts", "places", "hashes", "sources")]], schema=_GROUPS)

    found = edges.groupBy("bucket").applyInArrow(both, _GROUPS_SQL)
    return stored(found.groupBy("part").applyInArrow(_by_document, _SOURCES_SQL), "repeated-edges")


def _flagged(sources, hashes: np.ndarray):
    """Places, owners and source places of a document's repeated windows, in order; repeats inside it included."""
    place = np.concatenate([unplanes(s["places"], 4) for s in sources]).astype(np.int64)
    owner = np.concatenate([unplanes(s["owners"], 8) for s in sources]).view(np.int64)
    source = np.concatenate([unplanes(s["sources"], 4) for s in sources]).astype(np.int64)
    # a window settled in a block may also be known elsewhere by a smaller owner: take the smallest
    order = np.lexsort((source, owner, hashes[place]))
    key = hashes[place][order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    key, owner, source = key[head], owner[order][head], source[order][head]
    at = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
    every = np.flatnonzero(key[at] == hashes)
    return every, owner[at[every]], source[at[every]]


def _paths(place, owner, source):
    """Maximal runs of consecutive places with consecutive source coordinates: start, windows, owner, source."""
    cut = np.ones(len(place), bool)
    cut[1:] = (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1]) | (source[1:] != source[:-1] + 1)
    first = np.flatnonzero(cut)
    return place[first], np.diff(np.append(first, len(place))), owner[first], source[first]


def _on_grid(start: int, windows: int, source: int) -> list[tuple[int, int, int]]:
    """A path in pieces (start, windows, source) that end where the source place is a multiple of GRID."""
    out = []
    while windows:
        n = min(windows, GRID - source % GRID)
        out.append((start, n, source))
        start, windows, source = start + n, windows - n, source + n
    return out


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _squeezed(docs: DataFrame) -> DataFrame:
    """Documents with their text compressed, for a shuffle: doc_id, th, z."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("z", pa.binary())])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in blocks(batches, "text"):
            yield batch_of(schema, batch.column("doc_id"), batch.column("th"), [None if t is None else squeeze(t) for t in as_bytes(batch.column("text"))])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, z binary")


def _texts(column: pa.Array) -> list[bytes]:
    """The texts of squeezed documents; null is empty."""
    restore = zstandard.ZstdDecompressor().decompress
    return [b"" if z is None else restore(z) for z in column.to_pylist()]


def _compact(rows: DataFrame, k: int, with_text: bool) -> DataFrame:
    """Documents with their repeated edges to one result row each, and one row per piece of a compacted path.

    doc rows: n_words, n_removed, kept_sha256; path rows: seed, start, words, owner, source, digest.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
        + [("seed", pa.int32()), ("start", pa.int64()), ("words", pa.int64()), ("owner", pa.int64()), ("source", pa.int64()), ("digest", pa.binary())]
    )

    def run(batches):
        for batch in blocks(batches, "z", BLOCK_BYTES // 2):
            out = []
            for doc_id, th, text, sources, failed in zip(
                batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), _texts(batch.column("z")), batch.column("found").to_pylist(), batch.column("failed").to_pylist(), strict=True
            ):
                words = text.split()
                keep = words
                if sources:
                    gone = np.zeros(len(words) + 1, np.int64)
                    wrong = {(f["seed"], f["start"], f["owner"], f["source"]) for f in failed or ()}
                    for seed in sorted({s["seed"] for s in sources}):
                        hashes, _, _ = window_hashes(*word_hashes([text], seed), k)
                        found = _flagged([s for s in sources if s["seed"] == seed], hashes)
                        for path in zip(*(x.tolist() for x in _paths(*found)), strict=True):
                            for a, n, source in _on_grid(path[0], path[1], path[3]):
                                if (seed, a, path[2], source) in wrong:
                                    continue
                                gone[a] += 1
                                gone[a + n + k - 1] -= 1
                                out.append((doc_id, th, None, None, None, None, seed, a, n + k - 1, path[2], source, _digest(words[a : a + n + k - 1])))
                    covered = np.cumsum(gone[:-1]) > 0
                    keep = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                kept = b" ".join(keep)
                out.append((doc_id, th, len(words), len(words) - len(keep), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text and len(keep) < len(words) else None, *[None] * 6))
            yield batch_of(schema, *zip(*out, strict=True))

    spec = "doc_id long, th long, n_words long, n_removed long, kept_sha256 string, kept_text string, seed int, start long, words long, owner long, source long, digest binary"
    return rows.mapInArrow(run, spec)


def _failures(paths: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct paths whose words are not those at their source coordinates."""
    asked = paths.groupBy("owner", "source", "words", "digest").agg(F.lit(1).alias("one"))
    asked = asked.groupBy("owner").agg(F.collect_list(F.struct("source", "words", "digest")).alias("asked"))  # the grid bounds it by the owner's length
    schema = pa.schema([("owner", pa.int64()), ("source", pa.int64()), ("words", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        for batch in blocks(batches, "z", BLOCK_BYTES // 2):
            out = []
            for owner, text, asked in zip(batch.column("doc_id").to_pylist(), _texts(batch.column("z")), batch.column("asked").to_pylist(), strict=True):
                words = text.split()
                out += [(owner, a["source"], a["words"], a["digest"]) for a in asked if _digest(words[a["source"] : a["source"] + a["words"]]) != a["digest"]]
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    # a document id may stand in several rows: a path fails if it fails in all of them
    pairs = _squeezed(docs).join(asked, F.col("doc_id") == F.col("owner")).select("doc_id", "z", "asked")
    bad = pairs.mapInArrow(run, "owner long, source long, words long, digest binary")
    rows = docs.groupBy("doc_id").count().where("count > 1").withColumnRenamed("doc_id", "owner")
    counted = bad.groupBy("owner", "source", "words", "digest").count().withColumnRenamed("count", "n")
    return counted.join(rows, "owner", "left").where("n >= coalesce(count, 1)").select("owner", "source", "words", "digest")


def dedup_substrings(docs: DataFrame, k: int = WORDS, buckets: int | None = None, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing goes, or unasked for).

    Removes each word covered by a window of k words that also starts in a document of smaller
    id. docs needs doc_id and text; other columns are ignored. Null and empty texts have no
    words; documents with fewer than k words lose none; a text of any length is taken whole. Rows that repeat an id do not remove
    each other's words. A null doc_id is neither source nor loses words. An empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    found = failed = left = None
    for seed in range(8):
        edges = repeated_edges(docs, k, buckets, seed).select("doc_id", "th", F.struct(F.lit(seed).alias("seed"), "places", "owners", "sources").alias("edge"))
        found = edges if found is None else found.unionByName(edges)
        gathered = found.groupBy("doc_id", "th").agg(F.collect_list("edge").alias("found")) if seed else edges.select("doc_id", "th", F.array("edge").alias("found"))  # a row per hash
        rows = _squeezed(docs).join(gathered, ["doc_id", "th"], "left")
        if failed is None:
            rows = rows.withColumn("failed", F.lit(None).cast("array<struct<seed:int,start:bigint,owner:bigint,source:bigint>>"))
        else:
            rows = rows.join(failed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("seed", "start", "owner", "source")).alias("failed")), ["doc_id", "th"], "left")
        out = stored(_compact(rows.select("doc_id", "th", "z", "found", "failed"), k, with_text), "paths")
        paths = out.where(F.col("seed") == seed)
        bad = _failures(paths, docs)
        wrong = stored(paths.join(bad, ["owner", "source", "words", "digest"], "left_semi").select("doc_id", "th", "seed", "start", "owner", "source"), "failed-paths")
        here = wrong.select("doc_id", "th").distinct()
        left = here if left is None else left.join(here, ["doc_id", "th"], "left_semi")
        if wrong.isEmpty():
            break
        failed = wrong if failed is None else failed.unionByName(wrong)
        if seed and left.isEmpty():  # each document was judged by some hash without failure; a last pass leaves the failed paths out
            rows = _squeezed(docs).join(gathered, ["doc_id", "th"], "left").join(failed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("seed", "start", "owner", "source")).alias("failed")), ["doc_id", "th"], "left")
            out = stored(_compact(rows.select("doc_id", "th", "z", "found", "failed"), k, with_text), "paths")
            break
    else:
        raise RuntimeError("windows collide under every hash")
    return out.where("n_words is not null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")


def op7_substring_dedup(spark, sf_dir) -> DataFrame:
    """Word counts, removed words and the digest of what stays, for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, with_text=False).drop("kept_text")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, row, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), g AS (
  SELECT doc_id, row, pos, word, lead(word, 12) OVER win IS NOT NULL AS whole, concat_ws(' ', word, {leads}) AS gram
  FROM t WINDOW win AS (PARTITION BY row ORDER BY pos)
), o AS (
  SELECT gram, min(doc_id) AS owner FROM g WHERE whole GROUP BY gram
), j AS (
  SELECT g.row, g.pos, g.word, CASE WHEN whole AND owner < g.doc_id THEN g.pos END AS hit FROM g LEFT JOIN o USING (gram)
), c AS (
  SELECT row, pos, word, max(hit) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM j
), k AS (
  SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY row
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)
""".replace("{leads}", ", ".join(f"lead(word, {k}) OVER win" for k in range(1, WORDS)))
