"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is a
token as a whole; all distinct pre-tokens of a block are hashed and compared at once in
numpy. Tier two: the others are merged by a heap of (rank, position) over linked bytes.
The tables are built once on the driver from the rank file and travel with the task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, blocks, factorized, ragged

#: Odd multipliers of the two polynomial hashes.
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Segments, and merged pre-tokens, that a worker remembers; the memory is emptied when full.
CACHE_ROWS = 300_000
#: The pattern whose matches begin with one space at most, unless they are white space only.
WORDS_WITH_SPACE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def flatten(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and each piece's start and length."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every piece; no piece is empty."""
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    width = int(sizes.max(initial=1))
    value = data.astype(np.uint64) + np.uint64(1)
    out = []
    for p in (_P1, _P2):
        powers = np.cumprod(np.full(width, p, np.uint64))
        out.append(_mixed(np.add.reduceat(value * powers[place], starts) + sizes.astype(np.uint64)))
    return out[0], out[1]


class PerfectHash:
    """Minimal perfect hash: n byte strings to 0..n-1, by one displacement per bucket of about four keys."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.data, self.starts, self.sizes = flatten(keys)
        h1, h2 = _hashes(self.data, self.starts, self.sizes)
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (h1 % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(count) - count
        self.shift = np.zeros(self.buckets, np.uint64)
        self.slot_key = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        tries = np.arange(1 << 10, dtype=np.uint64)
        for b in np.argsort(-count, kind="stable"):
            c = count[b]
            if not c:
                break
            own = order[first[b] : first[b] + c]
            base, at = h2[own], np.uint64(0)
            while True:
                slots = (_mixed(base[None, :] + (tries + at)[:, None] * _P1) % np.uint64(n)).astype(np.int64)
                good = ~taken[slots].any(axis=1)
                if c > 1:
                    ranked = np.sort(slots, axis=1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                found = np.flatnonzero(good)
                if len(found):
                    self.shift[b] = tries[found[0]] + at
                    taken[slots[found[0]]] = True
                    self.slot_key[slots[found[0]]] = own
                    break
                at += np.uint64(len(tries))
                if at > np.uint64(1 << 24):
                    raise ValueError("keys repeat")

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The index of each piece among the keys, or -1. Hits are compared byte by byte."""
        out = np.full(len(pieces), -1, np.int64)
        data, starts, sizes = flatten(pieces)
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        starts, sizes = starts[some], sizes[some]
        h1, h2 = _hashes(data, starts, sizes)
        slot = _mixed(h2 + self.shift[(h1 % np.uint64(self.buckets)).astype(np.int64)] * _P1) % np.uint64(self.n)
        key = self.slot_key[slot.astype(np.int64)]
        maybe = np.flatnonzero(self.sizes[key] == sizes)
        if len(maybe):
            wide = sizes[maybe]
            same = data[ragged(starts[maybe], wide)] == self.data[ragged(self.starts[key[maybe]], wide)]
            maybe = maybe[np.logical_and.reduceat(same, np.cumsum(wide) - wide)]
            out[some[maybe]] = key[maybe]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: the lowest rank first, the leftmost of equals.

    Symbols are linked through their end and the start of the one before; a heap entry packs
    rank, start and end in one integer and is stale unless both still hold.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    get, push, pop = ranks.get, heappush, heappop
    w = max(16, n.bit_length())
    mask = (1 << w) - 1
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append(((r << w | i) << w) | (i + 2))
    heapify(heap)
    while heap:
        entry = pop(heap)
        stop, i = entry & mask, entry >> w & mask
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i] = stop
        end[j] = 0
        before[stop] = i
        if stop < n:
            far = end[stop]
            r = get(piece[i:far])
            if r is not None:
                push(heap, ((r << w | i) << w) | far)
        k = before[i]
        if k >= 0:
            r = get(piece[k:stop])
            if r is not None:
                push(heap, ((r << w | k) << w) | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


#: Where cutting at single spaces could part a match of the pattern: white space beside a space, or at an end.
_CLUMP = re.compile(r"\s |[ ]\s|\A\s|\s\Z")
#: Marks a text's first segment, which has no space before it; texts that hold it are split as a whole.
_FIRST = "\ue000"


class ByteBPE:
    """Encoder and decoder for a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.ids = np.array([self.ranks[t] for t in tokens], np.int64)
        self.whole = PerfectHash(tokens)
        self.pattern = pattern
        self.cache: dict[str, tuple] = {}
        self.merged: dict[bytes, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.merged_older: dict[bytes, tuple] = {}
        self._split = None
        self.cuttable = pattern == WORDS_WITH_SPACE
        by_id = np.zeros(int(self.ids.max()) + 1, np.int64)
        by_id[self.ids] = np.arange(len(tokens))
        self.place = by_id

    def __getstate__(self):
        return self.__dict__ | {"_split": None, "cache": {}, "merged": {}, "older": {}, "merged_older": {}}

    def _segments(self, text: str) -> list[str]:
        """The text cut so that no match of the pattern lies across a cut; the first piece is marked.

        A match takes one space at most before a word, so a text without clumps of white space is
        cut at its spaces, each of which goes with what follows it.
        """
        if self.cuttable and _FIRST not in text and not _CLUMP.search(text):
            out = text.split(" ")
            out[0] = _FIRST + out[0]
            return out
        return [_FIRST + text]

    def _fill(self, missed: list[str]) -> None:
        """Ids of segments that are not in the cache."""
        words, counts = [], []
        for s in missed:
            found = self._split.findall(s[1:] if s[:1] == _FIRST else " " + s)
            words += found
            counts.append(len(found))
        distinct = list(dict.fromkeys(words))
        pieces = [w.encode() for w in distinct]
        key = self.whole.find(pieces)
        known, merged, ranks = {}, self.merged, self.ranks
        for w, piece, k in zip(distinct, pieces, key.tolist(), strict=True):
            if k >= 0:
                known[w] = (int(self.ids[k]),)
                continue
            ids = merged.get(piece)
            if ids is None:
                ids = self.merged_older.get(piece) or tuple(merge(piece, ranks))
                if len(piece) <= 64:
                    if len(merged) >= CACHE_ROWS:  # the memory of before stays until the next time
                        self.merged_older = merged
                        self.merged = merged = {}
                    merged[piece] = ids
            known[w] = ids
        at = 0
        for s, n in zip(missed, counts, strict=True):
            self.cache[s] = known[words[at]] if n == 1 else tuple(chain.from_iterable(map(known.__getitem__, words[at : at + n])))
            at += n

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if self._split is None:
            self._split = regex.compile(self.pattern)
        words, counts = [], []
        for t in texts:
            found = self._segments(t)
            words += found
            counts.append(len(found))
        if not words:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        code, distinct = factorized(words, texts)
        if len(self.cache) > CACHE_ROWS:  # the memory of before stays until the next time; what is still used moves on
            self.older, self.cache = self.cache, {}
        cache, older, missed = self.cache, self.older, []
        for w in distinct:
            if w not in cache:
                ids = older.get(w)
                if ids is None:
                    missed.append(w)
                else:
                    cache[w] = ids
        self._fill(missed)
        parts = [cache[w] for w in distinct]
        for w in missed:
            if len(w) > 64:
                del cache[w]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()))
        wide = sizes[code]
        ids = flat[ragged((np.cumsum(sizes) - sizes)[code], wide)]
        total = np.concatenate([[0], np.cumsum(wide)])
        last = np.cumsum(counts)
        return ids, total[last] - total[last - counts]

    def decode(self, ids: np.ndarray) -> bytes:
        key = self.place[ids]
        return self.whole.data[ragged(self.whole.starts[key], self.whole.sizes[key])].tobytes()


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, where asked for).

    docs needs doc_id and text; other columns are ignored. Null text is empty: no ids, and the
    digests of nothing. Repeated rows and null ids give a row each; an empty table gives none.
    decoded_sha256 is of the bytes that the ids decode to.
    """
    bpe = ByteBPE(path, pattern)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    shared = docs.sparkSession.sparkContext.broadcast(bpe)  # the vocabulary's size bounds it

    def run(batches):
        bpe = shared.value
        for batch in blocks(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, counts = bpe.encode_batch(texts)
            stops = np.cumsum(counts)
            raw = ids.astype("<u4")
            key = bpe.place[ids]
            size = bpe.whole.sizes[key]
            data = bpe.whole.data[ragged(bpe.whole.starts[key], size)].tobytes()
            bounds = np.concatenate([[0], np.cumsum(size)])
            a, b, c = [], [], []
            for lo, hi in zip((stops - counts).tolist(), stops.tolist(), strict=True):
                a.append(hashlib.sha256(raw[lo:hi]).hexdigest())
                b.append(hashlib.sha256(data[bounds[lo] : bounds[hi]]).hexdigest())
            if with_ids:
                c = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids.astype(np.int32)))]
            yield batch_of(schema, batch.column("doc_id"), pa.array(counts, pa.int64()), a, b, *c)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def op6_byte_bpe(spark, sf_dir) -> DataFrame:
    """Ids of all documents by the 50k byte-level ranks, and their decoding."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
