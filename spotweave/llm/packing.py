"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the
sequence length as fit, then the binary digits of the rest. Every piece is a sequence of
its own in the bucket of its length, so no sequence crosses documents and none is padded.
Sequences of one bucket are equally long and make uniform batches.
"""

from __future__ import annotations

import json
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, blocks, ragged
from .wordbpe import plain_words

SEQUENCE = 4096
END = 2
#: Words and pre-tokens whose ids a worker remembers, over all its tasks.
MEMORY = 500_000
#: Text bytes that are encoded at once.
BLOCK = 2 << 20


def piece_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """The powers of two, none above `most`, that n is cut into, largest first."""
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length is a power of two")
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def all_pieces(counts: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """piece_lengths of every count in a row, and how many each count has."""
    powers = 1 << np.arange(most.bit_length() - 1, -1, -1)
    times = (counts[:, None] % most & powers) // powers
    times[:, 0] = counts // most
    return np.repeat(np.tile(powers, len(counts)), times.ravel()), times.sum(axis=1)


class _Codes(dict):
    """Words to codes, numbered as they come; the ones that were new are listed in `missed`."""

    missed: list[str]

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.missed.append(word)
        return code


class Encoder:
    """Ids by the tokenizers library, which sees each distinct pre-token once and remembers it.

    The library merges every pre-token by itself and no pre-token holds white space, so a text's
    ids are those of its pre-tokens in a row. Words that are not known yet are split into pre-tokens,
    and those not known go to the library many to a text, with spaces between; each ends with the
    one token that bears the end-of-word suffix, which tells them apart again. Special strings are
    cut out first, as the library does. A table holds the ids of all known words in a row; when it is
    full, the half that occurs in the most blocks stays.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        self.memory, self._tools = memory, None
        self._empty()

    def _empty(self):
        self.codes, self.flat = _Codes(), np.zeros(0, np.uint32)
        self.start, self.size, self.used, self.chars = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def __getstate__(self):
        return {"text": self.text, "memory": self.memory}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_tools": None}
        self._empty()

    def tools(self):
        """The library's tokenizer, the pre-token pattern, the pattern and the ids of special strings, and which ids end a pre-token."""
        if self._tools is None:
            from tokenizers import Tokenizer

            spec = json.loads(self.text)
            pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
            suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
            last = np.zeros(max(vocab.values()) + 1 + len(special), bool)
            last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            self._tools = Tokenizer.from_str(self.text), pattern, cut, special, last
        return self._tools

    def _encoded(self, pieces: list[str], together: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens in a row, and where each ends."""
        library, *_, last = self.tools()
        found, ends, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for lo in range(0, len(pieces), together):
            part = pieces[lo : lo + together]
            ids = np.array(library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(last[ids]) + 1
            if len(stop) != len(part):  # a symbol that the vocabulary lacks: one by one
                own = [library.encode(p, add_special_tokens=False).ids for p in part]
                ids, stop = np.array([i for x in own for i in x], np.uint32), np.cumsum([len(x) for x in own])
            found.append(ids)
            ends.append(stop + at)
            at += len(ids)
        return np.concatenate(found), np.concatenate(ends)

    def _room(self, n: int) -> None:
        if n > len(self.start):
            n = max(n, 2 * len(self.start))
            self.start, self.size, self.used = (np.resize(x, n) if len(x) else np.zeros(n, x.dtype) for x in (self.start, self.size, self.used))

    def _append(self, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.start[codes] = np.cumsum(sizes) - sizes + len(self.flat)
        self.size[codes], self.used[codes] = sizes, 0
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self, missed: list[str]) -> None:
        """Ids of words that have a code and no ids yet."""
        _, pattern, _, special, _ = self.tools()
        code, alone, made, cuts = self.codes.__getitem__, [], [], []
        self.codes.missed = fresh = []
        for w in missed:
            found = [w] if w.isalpha() or w in special else pattern.findall(w)  # letters alone are one pre-token
            if found == [w]:
                alone.append(w)
            else:
                made.append(w)
                cuts.append(found)
        parts = np.fromiter(map(code, chain.from_iterable(cuts)), np.int64)
        alone += fresh
        self.chars += sum(map(len, missed)) + sum(map(len, fresh))
        self._room(len(self.codes))
        plain = [w for w in alone if w not in special]
        ids, ends = self._encoded(plain)
        self._append(np.fromiter(map(code, plain), np.int64, len(plain)), ids, np.diff(ends, prepend=0))
        named = [w for w in alone if w in special]
        self._append(np.fromiter(map(code, named), np.int64, len(named)), np.array([special[w] for w in named], np.uint32), np.ones(len(named), np.int64))
        if made:  # of several pre-tokens, all known by now
            size = self.size[parts].astype(np.int64)
            last = np.cumsum([len(c) for c in cuts])
            total = np.concatenate([[0], np.cumsum(size)])[last]
            self._append(np.fromiter(map(code, made), np.int64, len(made)), self.flat[ragged(self.start[parts], size)], np.diff(total, prepend=0))

    def _trim(self) -> None:
        """Keep the half of the words, none of them long, that occurred in the most blocks."""
        words = list(self.codes)
        short = np.fromiter(map(len, words), np.int64, len(words)) <= 64
        rank = np.argsort(np.where(short, -self.used[: len(words)], 1), kind="stable")[: self.memory // 2]
        keep = np.sort(rank[short[rank]])
        size, used = self.size[keep].astype(np.int64), self.used[keep]
        ids = self.flat[ragged(self.start[keep], size)]
        self._empty()
        self.codes.update((words[k], i) for i, k in enumerate(keep.tolist()))
        self.chars = sum(map(len, self.codes))
        self._room(len(keep))
        at = np.arange(len(keep))
        self._append(at, ids, size)
        self.used[at] = used // 2

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        library, pattern, cut, special, _ = self.tools()
        normal = library.normalizer.normalize_str
        words, counts = [], []
        for t in texts:
            found = plain_words(t)
            if found is None:
                found = []
                for p in cut.split(t):
                    found += [p] if p in special else pattern.findall(normal(p)) if p else []
            words += found
            counts.append(len(found))
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.codes) > self.memory or self.chars > 16 * self.memory:
            self._trim()
        self.codes.missed = missed = []
        code = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        del words
        if missed:
            self._learn(missed)
        self.used[code] += 1
        wide = self.size[code].astype(np.int64)
        ids = self.flat[ragged(self.start[code], wide)]
        total = np.concatenate([[0], np.cumsum(wide)])
        last = np.cumsum(counts)
        return ids, total[last] - total[last - np.array(counts)]


_kept: Encoder | None = None


def _lasting(sent: Encoder) -> Encoder:
    """The one encoder that a worker holds over its tasks: the one sent, unless it has its like already."""
    global _kept
    if _kept is None or (_kept.text, _kept.memory) != (sent.text, sent.memory):
        _kept = sent
    return _kept


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0), bucket (and ids).

    docs needs doc_id and text; other columns are ignored. Null text is empty: the end id
    alone. Every row is cut by itself, repeated rows and null ids included; an empty table
    gives no piece. A text of any length is encoded whole, in one piece of work of its own once it
    exceeds BLOCK bytes. bucket is the length's power of two. sequence_id is unique in a result: the
    task's number, then a running number; over other partitions it differs, and (doc_id, start) names
    a sequence for good.
    """
    piece_lengths(0, sequence)
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(path))  # the vocabulary's size bounds it; its memory lasts as long as a worker
    fields = [("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("bucket", pa.int32())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        encoder = _lasting(shared.value)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in blocks(batches, "text", BLOCK):
            ids, counts = encoder.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            raw = np.insert(ids.astype("<u4", copy=False), np.cumsum(counts), np.uint32(end))  # every document with its end
            size, pieces = all_pieces(counts + 1, sequence)
            row, stops = np.repeat(np.arange(len(pieces)), pieces), np.cumsum(size)
            data = memoryview(raw).cast("B")
            crcs = [crc32(data[lo:hi]) for lo, hi in zip((4 * (stops - size)).tolist(), (4 * stops).tolist(), strict=True)]
            at = stops - size - (np.cumsum(counts + 1) - counts - 1)[row]
            made = [pa.array(at), pa.array(size), pa.array(crcs, pa.int64()), pa.array((counts + 1)[row]), pa.array(np.arange(len(size)) + number)]
            number += len(size)
            held = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(raw.astype(np.int32)))] * with_ids
            yield batch_of(schema, batch.column("doc_id").take(pa.array(row)), *made, pa.array(np.zeros(len(size), np.int64)), pa.array(np.log2(size).astype(np.int32)), *held)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def op10_packing(spark, sf_dir) -> DataFrame:
    """All documents cut into power-of-two sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
