"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk, with an estimated class prior.

Positives are trusted rows (labels.quality = 1), the unlabelled set is the web text itself; no negative label is used.
The prior is the smallest ratio of the unlabelled to the positive share above a score (mixture proportion), of a first
classifier's scores on rows kept out of its fit. The model is a small network on counts of neighbouring character
classes and on repetition figures of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back_driver, map_texts, slices

FOLDS, HELD_OUT = 5, 0
FIT_ROWS, FIT_CHARS = 4000, 30_000
HIDDEN = 16
PART = 512
COLUMNS = 128
SLICE = 2 << 20
THRESHOLD = 0.3


def byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, line end, space, other control, beyond ASCII, and each ASCII mark alone."""
    out = np.zeros(256, np.int64)
    out[65:91], out[48:58], out[10], out[[9, 32]], out[128:] = 1, 2, 3, 4, 6
    out[[x for x in range(32) if x not in (9, 10)] + [127]] = 5
    marks = [x for x in range(33, 127) if not chr(x).isalnum()]
    out[marks] = 7 + np.arange(len(marks))
    return out


CLASSES = byte_classes()
N = int(CLASSES.max()) + 1
EXTRA = 6


def features(text: str) -> np.ndarray:
    """log of 1 + per-mille frequencies of class pairs, then word, line and repetition figures. Any text, also empty."""
    raw = np.frombuffer(text.encode(), np.uint8)
    c = CLASSES[raw]
    out = np.zeros(N * N + EXTRA, np.float32)
    if len(c) > 1:
        out[: N * N] = np.bincount(c[:-1] * N + c[1:], minlength=N * N)
        out[: N * N] = np.log1p(out[: N * N] * (1000 / len(c)))
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    out[N * N :] = (np.log1p(len(words)), len(set(words)) / n, len(raw) / n / 10, np.log1p(len(lines)), len(set(lines)) / len(lines), float(not words))
    return out


def features_of(texts: list) -> np.ndarray:
    out = np.zeros((len(texts), N * N + EXTRA), np.float32)
    for i, t in enumerate(texts):
        out[i] = features(t or "")
    return out


def by_parts(f: Callable, texts: list) -> np.ndarray:
    """f of the features of texts, PART at a time: short texts take much more room as features."""
    return np.concatenate([f(features_of(texts[a : a + PART])) for a in range(0, len(texts), PART)] or [np.zeros(0)])


class Net:
    """One hidden layer of ReLUs and a sigmoid, on standardised features."""

    def __init__(self, x: np.ndarray | list[np.ndarray], seed: int):
        """x: features, or several arrays of them that count as one; a block of columns at a time is copied."""
        r, parts = np.random.default_rng(seed), x if isinstance(x, list) else [x]
        columns = parts[0].shape[1]
        moments = [(b.mean(0), b.std(0)) for b in (np.concatenate([y[:, a : a + COLUMNS] for y in parts]) for a in range(0, columns, COLUMNS))]
        self.mean, self.scale = (np.concatenate(m) for m in zip(*moments))
        self.scale = np.where(self.scale < 1e-3, 1, self.scale)
        self.p = [r.normal(0, 1 / np.sqrt(columns), (columns, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32), np.zeros(1, np.float32)]

    def ready(self, x):
        return np.clip((x - self.mean) / self.scale, -5, 5).astype(np.float32)

    def ready_all(self, x: np.ndarray, own: bool) -> np.ndarray:
        """ready(x), PART rows at a time; own: written over x."""
        out = x if own else np.empty(x.shape, np.float32)
        for a in range(0, len(x), PART):
            out[a : a + PART] = self.ready(x[a : a + PART])
        return out

    def logits(self, z):
        h = np.maximum(z @ self.p[0] + self.p[1], 0)
        return h, h @ self.p[2] + self.p[3][0]

    def grads(self, z, h, d):
        dh = d[:, None] * self.p[2] * (h > 0)
        return [z.T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True)]

    shift = 0.0

    def score(self, x):
        return sigmoid(self.logits(self.ready(x))[1] + self.shift)


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 0, steps: int = 1500, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, own: bool = False) -> Net:
    """Minimises prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)), logistic loss, by Adam. own: pos and unl, of
    float32, may be written over.

    Where the negative part of a batch falls below zero, its gradient is reversed, as the non-negative estimator asks.
    """
    net = Net([pos, unl], seed)
    zp, zu = net.ready_all(pos, own), net.ready_all(unl, own)
    r = np.random.default_rng(seed + 1)
    m, v, t = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p], 0
    while t < steps:
        order = r.permutation(len(zu))
        for a in range(0, len(zu), batch):
            step = rate * max(0.02, 1 - t / steps)
            u = zu[order[a : a + batch]]
            p = zp[r.integers(0, len(zp), min(batch, len(zp)))]
            hp, lp = net.logits(p)
            hu, lu = net.logits(u)
            negative = np.logaddexp(0, lu).mean() - prior * np.logaddexp(0, lp).mean()
            dp, du = sigmoid(lp) / len(p), sigmoid(lu) / len(u)
            if negative >= 0:
                gp, gu = prior * (sigmoid(lp) - 1) / len(p) - prior * dp, du
            else:
                gp, gu = prior * dp, -du
            g = [x + y + decay * w for x, y, w in zip(net.grads(p, hp, gp), net.grads(u, hu, gu), net.p)]
            t += 1
            for i, x in enumerate(g):
                m[i] = 0.9 * m[i] + 0.1 * x
                v[i] = 0.999 * v[i] + 0.001 * x * x
                net.p[i] = (net.p[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


BINS, REACH = 4096, 8.0


def bin_of(logits: np.ndarray) -> np.ndarray:
    """Number of the bin, of BINS equal ones over [-REACH, REACH], that holds each logit; the end bins hold the rest."""
    return np.clip(((logits + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)


def middle(bins: np.ndarray) -> np.ndarray:
    return (bins + 0.5) * (2 * REACH / BINS) - REACH


def estimate_prior(pos_bins: np.ndarray, counts: np.ndarray) -> float:
    """Smallest share-above ratio unlabelled / positive, over scores that at least half of the positives reach;
    within [0.05, 0.99]. pos_bins: the positives' bins; counts: unlabelled rows by bin."""
    best, above = 0.99, np.cumsum(counts[::-1])[::-1] / max(1, counts.sum())
    for t in np.quantile(pos_bins, np.linspace(0.01, 0.5, 50), method="lower").astype(np.int64):
        best = min(best, above[t] / max((pos_bins >= t).mean(), 1e-9))
    return float(np.clip(best, 0.05, 0.99))


def widest_split(counts: np.ndarray) -> float:
    """Cut of the logits with the largest variance between its two sides."""
    v = middle(np.arange(BINS))
    low, total = np.cumsum(counts), counts.sum()
    some = np.flatnonzero((low > 0) & (low < total))
    if not len(some):
        return float(v[np.argmax(counts)])
    k, s = low[some], np.cumsum(counts * v)
    means = (s[-1] - s[some]) / (total - k) - s[some] / k
    # Bins between two bunches are equally good: the middle one of them.
    gain = k * (total - k) * means**2
    best = some[gain >= gain.max() * (1 - 1e-12)]
    return float(v[best[len(best) // 2]])


def threshold_shift(counts: np.ndarray, prior: float) -> float:
    """What to add to logits so that THRESHOLD stands where the unlabelled scores part: at the share 1 - prior of them,
    or at their widest split if that is lower (a sharp split rejects no more than it must)."""
    share = middle(np.searchsorted(np.cumsum(counts), (1 - prior) * counts.sum()))
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - min(float(share), widest_split(counts)))


def fit(pos: tuple[np.ndarray, np.ndarray], unl: tuple[np.ndarray, np.ndarray], spread: Callable, seed: int = 0, own: bool = False) -> tuple[Net, float]:
    """(model, prior). pos, unl: (features, side 0 or 1) of the rows to fit on; spread(net, side): counts by bin of the
    logits of all unlabelled rows of a side (None: both). A first fit at prior 0.5 on side 0 ranks side 1, which gives
    the prior. own: the features, of float32, may be written over."""
    (xp, sp), (xu, su) = pos, unl
    if min((sp == 0).sum(), (sp == 1).sum(), (su == 0).sum(), (su == 1).sum()) < 2:  # too little to learn from: everything scores the trivial prior
        net = Net(np.zeros((2, N * N + EXTRA), np.float32), seed)
        net.p = [np.zeros_like(p) for p in net.p]
        return net, 0.5
    half = fit_nnpu(xp[sp == 0], xu[su == 0], 0.5, seed, steps=400, own=True)
    prior = estimate_prior(bin_of(half.logits(half.ready_all(xp[sp == 1], True))[1]), spread(half, 1))
    net = fit_nnpu(xp, xu, prior, seed, own=own)
    net.shift = threshold_shift(spread(net, None), prior)
    return net, prior


def open_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, text, side) of the rows that fitting may see: no held-out ones. side is a hash of doc_id, mod 2."""
    side = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(2)).cast("int").alias("side")
    return documents.where(crc_mod("doc_id", FOLDS) != HELD_OUT).select("doc_id", "text", side)


def spread_of(documents: DataFrame) -> Callable:
    """spread for fit: every open row of documents counts, with its whole text. At most BINS numbers come back."""
    rows = open_rows(documents).where(F.col("text").isNotNull())

    def spread(net: Net, side: int | None) -> np.ndarray:
        def count(batch: pa.RecordBatch) -> dict:
            bins, n = np.unique(by_parts(lambda x: bin_of(net.logits(net.ready(x))[1]), batch.column("text").to_pylist()), return_counts=True)
            return {"bin": bins, "n": n}

        own = rows if side is None else rows.where(F.col("side") == side)
        out = np.zeros(BINS)
        for r in map_texts(own, count, "bin long,n long", ["text"], max_bytes=SLICE).groupBy("bin").agg(F.sum("n").alias("n")).collect():
            out[r["bin"]] = r["n"]
        return out

    return spread


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Iterator[list]:
    """Trusted positives, then unlabelled rows, as (text, side), at most rows of at most chars characters each, chosen by a hash
    of doc_id. The second are read when they are asked for, so that one side's texts are held at a time.

    The bounds hold for the rows that gradients are taken of; the prior and the threshold come from all rows.
    """
    docs = open_rows(documents).where(F.col("text").isNotNull() & (F.length("text") <= chars))
    good = labels.where("quality = 1").select("doc_id").where(crc_mod("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").count().select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    # The ids are chosen first (two longs a row), then their texts are read.
    pick = lambda ids: ids.select("doc_id").withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(rows).select("doc_id")
    take = lambda ids: [(r.text, r.side) for r in docs.join(F.broadcast(pick(ids)), "doc_id").orderBy("doc_id").limit(rows).collect()]
    yield take(good)
    yield take(docs)


def score_quality(documents: DataFrame, net: Net) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, of the whole text. Null and empty texts score alike.

    The score is monotone in the model's probability but shifted so that 0.3 stands where the corpus's scores part; it
    isn't itself a probability.

    A null doc_id is not held out. One map over the table; the model (some 20 k numbers) travels with the task.
    """

    def score(batch: pa.RecordBatch) -> dict:
        s = by_parts(net.score, batch.column("text").to_pylist()).astype(np.float64)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    ready = documents.withColumn("held_out", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)))
    return map_texts(ready, score, "doc_id long,held_out boolean,score double,predicted int", ["doc_id", "text", "held_out"], max_bytes=SLICE)


def train(documents: DataFrame, labels: DataFrame) -> Net:
    sides = lambda rows: (features_of([t for t, _ in rows]), np.array([s for _, s in rows], np.int64))
    net = fit(*map(sides, training_rows(documents, labels)), spread_of(documents), own=True)[0]
    give_back_driver(documents.sparkSession)
    return net


def keep_good(documents: DataFrame, net: Net) -> DataFrame:
    """Rows of documents, all columns, whose predicted is 1. Filters in the map itself, so texts aren't shuffled."""

    # Numbered names: a map takes columns by name, and names may hold dots.
    numbered = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    text = f"c{documents.columns.index('text')}"

    def keep(batches):
        for part in slices(batches, text, SLICE):
            yield part.filter(pa.array(by_parts(net.score, part.column(text).to_pylist()) >= THRESHOLD, pa.bool_()))

    return numbered.mapInArrow(keep, numbered.schema).toDF(*documents.columns)
