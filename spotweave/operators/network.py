"""Networks trained where the rows lie: every task sends the summed gradients of its rows, the driver takes the step.

Rows are written once, parted in batches by a hash of the key, and a step reads the files of its batch alone. Losses are
sums over rows, so gradients add up over tasks and a step equals the same step on one machine. What reaches the driver is as large as the
parameters, whatever the rows. The optimiser is AdamW with a cosine schedule; the weights of least validation loss are kept.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.keys import digest_number
from spotweave.functions.lineage import shared_dir
from spotweave.operators.linalg import cross_moments, summed_arrays

#: Steepness of the rise of the reversal's strength over training.
RISE = 10.0


def _normal(h: np.ndarray):
    m, s = h.mean(axis=1, keepdims=True), np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
    return (h - m) / s, s


def _normal_back(d, z, s):
    return (d - d.mean(axis=1, keepdims=True) - z * (d * z).mean(axis=1, keepdims=True)) / s


class Guided:
    """Source vector to target vector through a normalised latent layer; the loss is the squared error, a mean over the target's components."""

    def __init__(self, latent: int, hidden: int):
        self.latent, self.hidden = latent, hidden

    def start(self, dx: int, dy: int, domains: int, contexts: int, rng) -> list[np.ndarray]:
        sizes = [(dx, self.hidden), (self.hidden, self.latent), (self.latent, self.hidden), (self.hidden, dy)]
        return [w for i, o in sizes for w in (rng.normal(0, i**-0.5, (i, o)), np.zeros(o))]

    def encode(self, p, x):
        a = np.maximum(x @ p[0] + p[1], 0)
        z, s = _normal(a @ p[2] + p[3])
        return a, z, s

    def sums(self, p, x, y, domain, context, strength: float, train: bool):
        """(loss of each row, gradients summed over rows)."""
        a, z, s = self.encode(p, x)
        b = np.maximum(z @ p[4] + p[5], 0)
        error = b @ p[6] + p[7] - y
        loss = (error**2).mean(axis=1)
        if not train:
            return loss, None
        d = 2 * error / y.shape[1]
        db = (d @ p[6].T) * (b > 0)
        return loss, self._back(p, x, a, z, s, db @ p[4].T, [z.T @ db, db.sum(axis=0), b.T @ d, d.sum(axis=0)])

    def _back(self, p, x, a, z, s, dz, rest):
        dh = _normal_back(dz, z, s)
        da = (dh @ p[2].T) * (a > 0)
        return [x.T @ da, da.sum(axis=0), a.T @ dh, dh.sum(axis=0), *rest]


class Adversarial(Guided):
    """Guided, with a discriminator of domains (slides) behind a reversed gradient: the latent layer loses what tells domains apart.

    The discriminator knows the context (tissue) and is asked only about domains that occur in it, with smoothed labels; else it could do well
    by telling contexts apart. Its own weights descend; the encoder gets its gradient times minus the strength.
    """

    def __init__(self, latent: int, hidden: int, judge: int, valid: np.ndarray, smoothing: float = 0.1, most: float = 0.5):
        super().__init__(latent, hidden)
        self.judge, self.valid, self.smoothing, self.most = judge, np.asarray(valid, bool), smoothing, most

    def start(self, dx, dy, domains, contexts, rng):
        p = super().start(dx, dy, domains, contexts, rng)
        for i, o in ((self.latent + contexts, self.judge), (self.judge, domains)):
            p += [rng.normal(0, i**-0.5, (i, o)), np.zeros(o)]
        return p

    def strength(self, step: int, steps: int) -> float:
        return (2 / (1 + math.exp(-RISE * step / max(1, steps))) - 1) * self.most

    def sums(self, p, x, y, domain, context, strength, train):
        loss, grads = super().sums(p[:8], x, y, domain, context, strength, train)
        if not train:
            return loss, None
        a, z, s = self.encode(p, x)
        n, known = len(x), self.valid[context]
        u = np.concatenate([z, np.eye(self.valid.shape[0])[context]], axis=1)
        h = np.maximum(u @ p[8] + p[9], 0)
        score = np.where(known, h @ p[10] + p[11], -np.inf)
        q = np.exp(score - score.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        goal = known * (self.smoothing / known.sum(axis=1, keepdims=True))
        goal[np.arange(n), domain] += 1 - self.smoothing
        d = q - goal
        dh = (d @ p[10].T) * (h > 0)
        back = self._back(p, x, a, z, s, -strength * (dh @ p[8].T)[:, : z.shape[1]], [0, 0, 0, 0])
        own = [g + b for g, b in zip(grads, back, strict=True)]
        return loss, [*own, u.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]


class AdamW:
    """Decoupled weight decay on matrices, a cosine from `rate` to 0 over `steps`."""

    def __init__(self, params, rate: float, decay: float, steps: int):
        self.m, self.v = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params]
        self.rate, self.decay, self.steps, self.t = rate, decay, steps, 0

    def step(self, params, grads) -> None:
        rate = self.rate * 0.5 * (1 + math.cos(math.pi * min(1.0, self.t / max(1, self.steps))))
        self.t += 1
        for w, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            if w.ndim > 1:
                w *= 1 - rate * self.decay
            w -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Trainer:
    """Fits a network on all rows of a frame, a job a step."""

    def __init__(self, net, batches: int = 8, epochs: int = 20, rate: float = 3e-3, decay: float = 1e-2, patience: int = 5, held: float = 0.1, seed: int = 42):
        self.net, self.batches, self.epochs, self.rate, self.decay, self.patience, self.held, self.seed = net, batches, epochs, rate, decay, patience, held, seed

    def _parted(self, df, source, target, key, domain, context) -> DataFrame:
        """The rows with their part (val for a share by digest) and batch, written once."""
        val = digest_number(self.seed, "network", key) < int(self.held * 2**32)
        code = lambda c: (F.col(c) if c else F.lit(0)).cast("int")
        x = df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(
            F.col(source).cast("array<double>").alias("x"), F.col(target).cast("array<double>").alias("y"), code(domain).alias("domain"), code(context).alias("context"),
            F.when(val, "val").otherwise("train").alias("part"), F.pmod(F.xxhash64(key), F.lit(self.batches)).cast("int").alias("batch"),
        )
        self._place = f"{shared_dir(df.sparkSession)}/spotweave-batches-{uuid.uuid4().hex}"
        x.write.partitionBy("part", "batch").parquet(self._place)
        return df.sparkSession.read.schema("x array<double>, y array<double>, domain int, context int, part string, batch int").parquet(self._place)

    def _pass(self, rows: DataFrame, strength: float, train: bool) -> tuple[float, int, list[np.ndarray]]:
        """(mean loss, rows, mean gradients) of some rows, by one job."""
        net, params, scaler = self.net, self.p, (self.mx, self.sx, self.my, self.sy)

        def run(batches):
            total, n, sums = 0.0, 0, None
            mx, sx, my, sy = scaler
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in "xy")
                loss, grads = net.sums(params, (x - mx) / sx, (y - my) / sy, batch.column("domain").to_numpy(), batch.column("context").to_numpy(), strength, train)
                total, n = total + loss.sum(), n + len(loss)
                if train:
                    sums = grads if sums is None else [s + g for s, g in zip(sums, grads, strict=True)]
            flat = np.concatenate([g.ravel() for g in sums]) if sums is not None else np.zeros(sum(p.size for p in params) if train else 0)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[total, n], flat]).tobytes()], pa.binary())], names=["sums"])

        (found,) = summed_arrays(rows.select("x", "y", "domain", "context").mapInArrow(run, "sums binary")) or (np.zeros(2),)
        loss, n, flat = found[0], int(found[1]), found[2:]
        grads, at = [], 0
        for p in params if train and n else ():
            grads.append(flat[at : at + p.size].reshape(p.shape) / n)
            at += p.size
        return (loss / n if n else math.nan), n, grads

    def fit(self, df: DataFrame, source: str, target: str, key: str, domain: str | None = None, context: str | None = None, domains: int = 1, contexts: int = 1) -> Trainer:
        """domain, context: columns of numbers from 0. Rows without a vector are left out; no rows is an error. `history` has the validation loss of every epoch."""
        rows = self._parted(df, source, target, key, domain, context)
        m = cross_moments(rows.where("part = 'train'"), "x", "y").collect()  # one row
        if not m:
            raise ValueError("no rows to train on")
        n, (sx, sy) = m[0]["n"], (np.frombuffer(m[0][c], np.float64) for c in ("sx", "sy"))
        square = lambda c, s: np.diag(np.frombuffer(m[0][c], np.float64).reshape(len(s), len(s)))
        scale = lambda q, s: np.where((sd := np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))) < 1e-8, 1, sd)
        self.mx, self.my, self.sx, self.sy = sx / n, sy / n, scale(square("xx", sx), sx), scale(square("yy", sy), sy)
        self.p = self.net.start(len(sx), len(sy), domains, contexts, np.random.default_rng(self.seed))
        steps = self.epochs * self.batches
        optimiser, best, kept, waited, step = AdamW(self.p, self.rate, self.decay, steps), math.inf, None, 0, 0
        self.history = []
        for epoch in range(self.epochs):
            for b in np.random.default_rng([self.seed, epoch]).permutation(self.batches).tolist():
                strength = self.net.strength(step, steps) if hasattr(self.net, "strength") else 0.0
                _, seen, grads = self._pass(rows.where((F.col("part") == "train") & (F.col("batch") == b)), strength, True)
                step += 1
                if seen:
                    optimiser.step(self.p, grads)
            loss, seen, _ = self._pass(rows.where("part = 'val'"), 0.0, False)
            self.history.append(loss)
            if not seen or loss < best:
                best, kept, waited = loss if seen else best, [w.copy() for w in self.p], 0
            elif (waited := waited + 1) >= self.patience:
                break
        self.p = kept if kept is not None else self.p
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(self._place)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        return self

    def transform(self, df: DataFrame, source: str, key: str) -> DataFrame:
        """(key, z): the latent layer of every row."""
        kind, net, p, mx, sx = df.schema[key].dataType.simpleString(), self.net, self.p, self.mx, self.sx

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    z = net.encode(p, (x - mx) / sx)[1]
                    yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(z), pa.list_(pa.float64()))], names=["key", "z"])

        return df.select(F.col(key).alias("key"), F.col(source).cast("array<double>").alias("x")).mapInArrow(run, f"key {kind}, z array<double>")
