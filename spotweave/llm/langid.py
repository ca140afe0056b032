"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes (the last one is filled with zeros). Filters of
several widths run over byte embeddings; each filter's maximum over the window goes through
a ReLU into a softmax over the languages. A document's probabilities are the mean of its
windows', weighted by their bytes. Because a convolution of embeddings is linear, the
trained filters are folded into one table row per byte pair and position, and applied by
table lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, blocks

WINDOW = 256
WIDTHS = (2, 4)
FILTERS = 12
DIM = 8
#: Labelled rows that training reads at most: of each language, and of all (but one row of every language always).
SAMPLE_ROWS, SAMPLE_TOTAL = 400, 20_000
#: Windows that an epoch draws of each training text, and windows of a text that training reads at most.
DRAWS, SAMPLE_WINDOWS = 8, 48
SPLITS, HELD_OUT = 4, 2
EPOCHS = 12

_LETTER = regex.compile(r"\p{L}")
#: ASCII capitals to small letters.
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW + widest - 1) bytes with zero fill, the text of each window, and its real bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    pad = max(WIDTHS) - 1
    out = np.zeros((int(count.sum()), WINDOW + pad), np.uint8)
    at = 0
    for t, n, k in zip(texts, sizes.tolist(), count.tolist(), strict=True):
        if k:
            room = np.zeros(k * WINDOW, np.uint8)
            room[:n] = np.frombuffer(t, np.uint8)
            out[at : at + k, :WINDOW] = room.reshape(k, WINDOW)
            at += k
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return _SMALL[out], owner, np.minimum(WINDOW, sizes[owner] - place * WINDOW)


class ByteCNN:
    """The network. labels: the languages in the order of the softmax."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.last = np.zeros(len(labels), np.float32)
        self.tables = None

    def fit(self, x: np.ndarray, y: np.ndarray, owner: np.ndarray | None = None, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3, seed: int = 1) -> ByteCNN:
        """Adam on the mean cross-entropy, classes weighted alike. owner: the text of each window; every epoch draws DRAWS windows of each.

        Half of the windows are cut to a random length, filled with zeros, so that short texts are learned too.
        """
        rng = np.random.default_rng(seed)
        held = np.minimum(1, DRAWS / np.bincount(owner)[owner]) if owner is not None else np.ones(len(y))  # how often a window is drawn
        weight = (held.sum() / len(self.labels) / np.maximum(1e-9, np.bincount(y, held, minlength=len(self.labels)))).astype(np.float32)
        params = [self.embed, *self.filters, self.bias, self.out, self.last]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            if owner is not None:
                drawn = order[np.argsort(owner[order], kind="stable")]
                begin = np.flatnonzero(np.diff(owner[drawn], prepend=-1))
                place = np.arange(len(drawn)) - np.repeat(begin, np.diff(np.append(begin, len(drawn))))
                order = rng.permutation(drawn[place < DRAWS])
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                step += 1
                long = np.where(rng.random(len(rows)) < 0.5, WINDOW, rng.integers(8, WINDOW, len(rows)))
                part = np.where(np.arange(x.shape[1]) < long[:, None], x[rows], 0)
                for p, g, m, v in zip(params, self._gradients(part, y[rows], weight), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        return self.fold()

    def _gradients(self, x, y, weight):
        n = len(x)
        e = self.embed[x]
        pooled, where, cols = [], [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            c = np.concatenate([e[:, o : o + WINDOW] for o in range(w)], axis=2)
            z = c @ f
            at = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            where.append(at)
            cols.append(c)
        h = np.concatenate(pooled, axis=1) + self.bias
        a = np.maximum(h, 0)
        s = a @ self.out + self.last
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = p.copy()
        d[np.arange(n), y] -= 1
        d *= (weight[y] / n)[:, None]
        g_out, g_last = a.T @ d, d.sum(axis=0)
        dh = (d @ self.out.T) * (h > 0)
        g_embed, g_filters = np.zeros_like(self.embed), []
        rows = np.arange(n)[:, None]
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = dh[:, k * FILTERS : (k + 1) * FILTERS]
            picked = cols[k][rows, where[k]]  # n, FILTERS, w * DIM
            g_filters.append(np.einsum("nf,nfd->df", part, picked))
            back = (part[:, :, None] * f.T[None]).reshape(n, FILTERS, w, DIM)
            for o in range(w):
                np.add.at(g_embed, x[rows, where[k] + o], back[:, :, o])
        return [g_embed, *g_filters, dh.sum(axis=0), g_out, g_last]

    def fold(self) -> ByteCNN:
        """For every width, one table per pair of positions: byte pair to the filters' sums."""
        self.tables = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            one = [self.embed @ f[o * DIM : (o + 1) * DIM] for o in range(w)]
            self.tables.append([(one[o][:, None] + one[o + 1][None]).reshape(65536, FILTERS) for o in range(0, w, 2)])
        return self

    def predict(self, x: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Softmax of every window."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for lo in range(0, len(x), chunk):
            part = x[lo : lo + chunk].astype(np.uint16)
            pair = (part[:, :-1] << 8) | part[:, 1:]
            h = []
            for w, tables in zip(WIDTHS, self.tables, strict=True):
                z = tables[0].take(pair[:, :WINDOW], axis=0)
                for k, t in enumerate(tables[1:], 1):
                    z += t.take(pair[:, 2 * k : 2 * k + WINDOW], axis=0)
                h.append(z.max(axis=1))
            s = np.maximum(np.concatenate(h, axis=1) + self.bias, 0) @ self.out + self.last
            p = np.exp(s - s.max(axis=1, keepdims=True))
            out[lo : lo + chunk] = p / p.sum(axis=1, keepdims=True)
        return out


def held_out() -> F.Column:
    """True where crc32 of the id as text leaves the held-out remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(SPLITS)) == HELD_OUT, F.lit(False))


_TAKEN = pa.schema([("lang", pa.string()), ("mark", pa.int64()), ("x", pa.binary()), ("size", pa.binary())])


def _windows_of(most: int):
    """At most `most` windows of every training text, drawn from the whole text by a generator seeded with its hash."""

    def run(batches):
        for batch in batches:
            for lang, mark, text in zip(batch.column("lang").to_pylist(), batch.column("mark").to_pylist(), as_bytes(batch.column("text")), strict=True):
                starts = np.arange(0, len(text), WINDOW)
                if len(starts) > most:
                    starts = np.sort(np.random.default_rng(mark & 0xFFFFFFFF).choice(starts, most, replace=False))
                parts = [windows([text[at : at + WINDOW]]) for at in starts.tolist()]
                yield batch_of(_TAKEN, [lang], [mark], [b"".join(p[0].tobytes() for p in parts)], [np.concatenate([p[2] for p in parts]).astype(np.int64).tobytes()])

    return run


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL, seed: int = 0, most_windows: int = SAMPLE_WINDOWS) -> ByteCNN:
    """Fit on at most sample_rows labelled rows of each language and `total` of all (one row of every language at least), none held out.

    Which rows are taken goes by a hash of id and text, the smallest first; rows of one id and text count once, and rows without an id, or
    with a shared one, are told apart by their texts. A language is never left out: the smallest of its hashes is always taken. Of
    each text at most most_windows windows, drawn from all of it, come to the driver: total * most_windows * (WINDOW + 3)
    bytes at most. Without labelled text the network has no language.
    """
    from pyspark.sql import Window

    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("mark"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n"), F.min("mark").alias("least")).collect()  # a row per language
    if not sizes:
        return ByteCNN([], seed)
    each = max(1, min(sample_rows, total // len(sizes)))
    # the smallest hashes of a language lie in a slice of the hash's range; no language's rows meet in one task beyond that slice
    slices = [(r["lang"], max(r["least"], -(1 << 63) + min((1 << 64) - 1, int((8 + 4 * each) / max(1, r["n"]) * 2**64)))) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(slices, "lang string, most long")
    part = usable.join(F.broadcast(bounds), "lang").where("mark <= most").dropDuplicates(["lang", "mark"])
    taken = part.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).where(F.col("n") <= each)
    drawn = taken.select("lang", "mark", "text").mapInArrow(_windows_of(most_windows), "lang string, mark long, x binary, size binary")
    rows = sorted(drawn.collect(), key=lambda r: (r["lang"], r["mark"]))  # bounded by the three parameters
    labels = sorted({r["lang"] for r in rows})
    net = ByteCNN(labels, seed)
    size = [np.frombuffer(r["size"], np.int64) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in size])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(len(owner), -1)
    size, y = np.concatenate(size), np.array([labels.index(r["lang"]) for r in rows])[owner]
    real = (size >= WINDOW // 8) | (np.bincount(owner)[owner] == 1)
    return net.fit(x[real], y[real], owner[real], seed=seed + 1)


def identify(docs: DataFrame, net: ByteCNN, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: doc_id) plus lang_pred and score (0 to 1) for every row.

    Text that is null, or has no letter, is `und` with score 0, as is everything for a network
    without languages. The whole text is used: all windows. lang, source and ids are no
    inputs. Of equally likely languages the first by name wins. Repeated rows give repeated results;
    an empty table gives none.
    """
    keep = keep or ["doc_id"]
    names = [f"_{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    found = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])
    labels = np.array(net.labels + ["und"], dtype=object)

    def run(batches):
        for batch in blocks(batches, "_text", 1 << 20):
            strings = batch.column("_text").to_pylist()
            data = [t if s and _LETTER.search(s) else b"" for s, t in zip(strings, as_bytes(batch.column("_text")), strict=True)]
            best, score = np.full(len(data), len(labels) - 1), np.zeros(len(data))
            if len(labels) > 1:
                x, owner, size = windows(data)
                if len(x):
                    total = np.zeros((len(data), len(labels) - 1))
                    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    some = owner[first]
                    total[some] = np.add.reduceat(net.predict(x) * size[:, None], first, axis=0, dtype=np.float64)
                    total[some] /= np.add.reduceat(size, first)[:, None]
                    best[some] = total[some].argmax(axis=1)
                    score[some] = np.clip(total[some].max(axis=1), 0, 1)
            made = batch_of(found, pa.array(labels[best].tolist(), pa.string()), pa.array(score))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.columns], names=[*names, "lang_pred", "score"])

    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], F.col("text").cast("string").alias("_text"))
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score")


def op9_language_id(spark, sf_dir) -> DataFrame:
    """Predicted language of all documents, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
