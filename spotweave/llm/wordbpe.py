"""Token counts by a BPE with word ends: rank-synchronous merging of ragged numpy arrays.

The library's own normaliser prepares each text. The distinct pre-tokens of a block are
held as one ragged array of symbols; in each step every pre-token finds its lowest-ranked
pair and all of them merge it at once, left to right, until no pair has a rank. A
pre-token's tokens are its surviving symbols.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, blocks, factorized, ragged

OVER = 2048
_NONE = np.int64(1) << 40
#: Words whose count a worker remembers; the memory is emptied when full.
CACHE_ROWS = 300_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes for
    themselves, the rest for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


#: Characters for which the normaliser only lower-cases: Latin letters up to U+017F without the dotted capital I,
#: printable ASCII and plain white space. No composition and no context rule applies to them.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u017f]")


def plain_words(text: str) -> list[str] | None:
    """The lower-cased words between white space, where that is all the normaliser and the splitting do
    across them; else None. A pre-token never holds white space, so each word stands by itself."""
    if "<|" in text or _UNUSUAL.search(text):
        return None
    return text.lower().split()


class WordBPE:
    """Counts (and ids) for a vocabulary file with a Split pre-tokeniser and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        from tokenizers import Tokenizer

        self.normal = Tokenizer.from_file(path).normalizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        size = max(self.vocab.values()) + 2
        #: Byte to symbol, inside a pre-token and at its end; -1: the library drops the symbol.
        self.inner = np.array([self.vocab.get(letters[b], -1) for b in range(256)], np.int64)
        self.final = np.array([self.vocab.get(letters[b] + self.suffix, -1) for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([self.vocab[a] * size + self.vocab[b] for a, b in pairs], np.int64)
        self.size, order = size, np.argsort(key, kind="stable")
        self.pair, self.rank = key[order], order
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.cache: dict[str, int] = {}
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None, "cache": {}}

    def tools(self):
        """The library's normaliser, the pre-token pattern, and the pattern of special strings."""
        if self._tools is None:
            special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
            self._tools = self.normal, regex.compile(self.pattern), special
        return self._tools

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of every pre-token (none empty): all in a row, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[data]
        symbols[np.cumsum(sizes) - 1] = self.final[data[np.cumsum(sizes) - 1]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        known = symbols >= 0
        symbols, owner = symbols[known], owner[known]
        done_s, done_o = [], []
        while len(symbols):
            pair = np.full(len(symbols), _NONE)
            inside = owner[1:] == owner[:-1]
            pair[:-1][inside] = self.ranks(symbols[:-1][inside], symbols[1:][inside])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(owner)))
            low = np.repeat(np.minimum.reduceat(pair, first), size)
            going = low < _NONE
            if not going.all():  # finished pre-tokens leave the array
                done_s.append(symbols[~going])
                done_o.append(owner[~going])
                symbols, owner, pair, low = symbols[going], owner[going], pair[going], low[going]
                if not len(symbols):
                    break
            hit = pair == low
            # in a run of overlapping pairs (a a a) every second one counts, from the left
            run = np.flatnonzero(hit)
            fresh = np.ones(len(run), bool)
            fresh[1:] = run[1:] != run[:-1] + 1
            begin = np.maximum.accumulate(np.where(fresh, run, 0))
            run = run[(run - begin) % 2 == 0]
            symbols[run] = self.made[low[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_s or [symbols]), np.concatenate(done_o or [owner])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(pieces))

    def split(self, text: str) -> tuple[list[str], int]:
        """Words or pre-tokens of the normalised text, and the special strings in it."""
        words = plain_words(text)
        if words is not None:
            return words, 0
        normal, pattern, special = self.tools()
        parts = special.split(text) if special else [text]
        out = []
        for p in parts:
            if p:
                out += pattern.findall(normal.normalize_str(p))
        return out, len(parts) - 1

    def _fill(self, missed: list[str]) -> None:
        """Counts of words that are not in the cache."""
        pattern = self.tools()[1]
        pieces, counts = [], []
        for w in missed:
            found = [w] if w.isalpha() else pattern.findall(w)
            pieces += found
            counts.append(len(found))
        if pieces:
            code, distinct = factorized(pieces, missed)
            _, size = self.merge([w.encode() for w in distinct])
            total = np.concatenate([[0], np.cumsum(size[code])])
        else:
            total = np.zeros(1, np.int64)
        last = np.cumsum(counts)
        self.cache.update(zip(missed, (total[last] - total[last - np.array(counts)]).tolist(), strict=True))

    def count_batch(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        words, counts, extra = [], [], []
        for t in texts:
            found, n = self.split(t)
            words += found
            counts.append(len(found))
            extra.append(n)
        extra = np.array(extra, np.int64)
        if not words:
            return extra
        code, distinct = factorized(words, texts)
        cache = self.cache
        if len(cache) > CACHE_ROWS:
            cache.clear()
        missed = [w for w in distinct if w not in cache]
        if missed:
            self._fill(missed)
        known = np.array([cache[w] for w in distinct], np.int64)
        for w in missed:
            if len(w) > 64:
                del cache[w]
        total = np.concatenate([[0], np.cumsum(known[code])])
        last = np.cumsum(counts)
        return total[last] - total[last - np.array(counts)] + extra


def count_tokens(docs: DataFrame, path: str, limit: int = OVER) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    docs needs doc_id and text; other columns are ignored. Null text is empty: 0 bytes, 0
    tokens. Special strings of the vocabulary inside a text count as one token each. Repeated
    rows and null ids give a row each; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordBPE(path))  # the vocabulary's size bounds it
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        import pyarrow.compute as pc

        bpe = shared.value
        for batch in blocks(batches, "text"):
            n = bpe.count_batch([t or "" for t in batch.column("text").to_pylist()])
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield batch_of(schema, batch.column("doc_id"), size, pa.array(n), pa.array(n > limit))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir) -> DataFrame:
    """Token counts of all documents by the word-end vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
