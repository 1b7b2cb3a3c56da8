"""Toxicity: a bidirectional gated recurrent network with attention pooling, on character and word inputs, in numpy.

A word's input is the sum of its own embedding and of the embeddings of its beginnings and character 4-grams, all
hashed. A word beyond UNIT bytes is several overlapping ones, so that each of its characters counts, in scripts without
blanks too. Windows of WINDOW words overlap by half; the network runs over every window of a text in both directions, and
attention pools the states into a window's score. The text's score is that of its highest window, in training too, so
that a short insult in a long text counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts

FOLDS, HELD_OUT = 4, 2
FIT_ROWS, FIT_CHARS = 2500, 12_000
WINDOW, STRIDE = 16, 8
SIZE, HIDDEN = 12, 8
BUCKETS = 1 << 14
GRAMS = 12
UNIT, UNIT_STEP = 12, 8
THRESHOLD = 0.3
LONG = 1 << 20
SLICE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case byte, whether it is part of a word): ASCII letters and digits, and all bytes beyond ASCII."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return low, word


LOW, WORD = letters()


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def word_inputs(texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids (distinct, 1 + GRAMS) of word and character inputs, index of each word's row, words of each text).

    Words of more than UNIT bytes are cut into units of UNIT bytes every UNIT_STEP, each of which counts as a word; the
    units' 4-grams are all those of the word. Column 0 is the unit, for a word's first unit the whole word; the others
    are beginnings of 3, 4, 5 and 6 bytes and the 4-grams from the second byte on, 0 where it is too short. Row 0
    stands for no word.
    """
    data = [(t if isinstance(t, bytes) else t.encode()) + b" " for t in texts]
    b = LOW[np.frombuffer(b"".join(data), np.uint8)]
    inside = WORD[b]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(d) for d in data])
    count = np.maximum(1, -(-(end - start - UNIT) // UNIT_STEP) + 1)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin, stop = np.repeat(start, count) + UNIT_STEP * nth, np.repeat(end, count)
    per = np.diff(np.concatenate([[0], np.searchsorted(begin, ends)]))
    if not len(start):
        return np.zeros((1, 1 + GRAMS), np.int64), np.zeros(0, np.int64), per
    n = np.minimum(stop - begin, UNIT)
    # Polynomial prefix hash over all bytes, in 64-bit words: a stretch's hash is a difference of two prefixes.
    k = np.cumprod(np.full(len(b) + 1, MIX | np.uint64(1), np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * k[:-1])])
    inv = np.uint64(pow(int(MIX | np.uint64(1)), -1, 1 << 64))
    back = np.cumprod(np.full(len(b) + 1, inv, np.uint64))
    stretch = lambda a, z: stir((total[z] - total[a]) * back[a] + (z - a).astype(np.uint64))
    whole = stretch(begin, np.where(nth == 0, stop, begin + n))
    _, first, row = np.unique(whole, return_index=True, return_inverse=True)
    s, m = begin[first], n[first]
    ids = np.zeros((len(first) + 1, 1 + GRAMS), np.int64)
    half = np.uint64(BUCKETS // 2 - 1)
    ids[1:, 0] = 1 + (whole[first] & half).astype(np.int64)
    for j in range(4):
        ok = m >= 3 + j
        ids[1:, 1 + j][ok] = BUCKETS // 2 + (stretch(s[ok], s[ok] + 3 + j) + np.uint64(j) & half).astype(np.int64)
    for j in range(GRAMS - 4):
        ok = m >= 5 + j
        ids[1:, 5 + j][ok] = BUCKETS // 2 + (stretch(s[ok] + 1 + j, s[ok] + 5 + j) + np.uint64(99) & half).astype(np.int64)
    return ids, row + 1, per


def word_inputs_in_parts(texts: list[str], part: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_inputs of many texts in bounded memory; a word that stands in two parts has two rows."""
    ids, rows, pers, n = [np.zeros((1, 1 + GRAMS), np.int32)], [], [], 0
    for a in range(0, len(texts), part):
        i, r, p = word_inputs(texts[a : a + part])
        ids.append(i[1:].astype(np.int32))
        rows.append((r + n).astype(np.int32))
        pers.append(p)
        n += len(i) - 1
    return np.concatenate(ids), np.concatenate(rows), np.concatenate(pers)


def windows(row: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((windows, WINDOW) rows of word_inputs, text of each window). A text has a window every STRIDE words until one
    reaches its end; a text without words has one empty window."""
    count = np.maximum(1, -(-(per - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(per)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(per) - per)[text]
    at = k[:, None] * STRIDE + np.arange(WINDOW)
    ok = at < per[text][:, None]
    out = np.zeros(at.shape, row.dtype)
    out[ok] = row[(first[:, None] + at)[ok]]
    return out, text


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def stretches(text: str):
    """The text's bytes in pieces of at most LONG that end between words. (A word of more than LONG bytes is several.)"""
    data, at = text.encode(), 0
    while len(data) - at > LONG:
        gaps = np.flatnonzero(~WORD[LOW[np.frombuffer(data, np.uint8, LONG, at)]])
        end = at + (int(gaps[-1]) + 1 if len(gaps) else LONG)
        yield data[at:end]
        at = end
    yield data[at:]


class Network:
    """emb (BUCKETS, SIZE); per direction Wx (SIZE, 3H), Wh (H, 3H), b (3H); attention Wa (2H, H), va; output wo, bo."""

    def __init__(self, seed: int = 0):
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"emb": r.normal(0, 0.1, (BUCKETS + 1, SIZE)).astype(np.float32), "wa": f(2 * h, h), "va": f(h), "wo": f(2 * h), "bo": np.full(1, -2, np.float32)}
        self.p["emb"][0] = 0
        for d in "fb":
            self.p |= {f"wx{d}": f(SIZE, 3 * h), f"wh{d}": f(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word."""
        out = self.p["emb"][ids[:, 0]]
        for j in range(1, ids.shape[1]):
            out = out + self.p["emb"][ids[:, j]]
        return out

    def direction(self, d: str, proj: np.ndarray, win: np.ndarray, keep: bool):
        """States (WINDOW, windows, H) in text order; gates too if kept. Places without a word leave the state as it is."""
        h = HIDDEN
        wh = self.p[f"wh{d}"]
        state = np.zeros((len(win), h), np.float32)
        states = np.empty((WINDOW, len(win), h), np.float32)
        held = []
        for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
            x = proj[win[:, t]]
            real = (win[:, t] > 0)[:, None]
            zr = sigmoid(x[:, : 2 * h] + state @ wh[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + (r * state) @ wh[:, 2 * h :])
            new = np.where(real, z * state + (1 - z) * c, state)
            if keep:
                held.append((t, state, z, r, c, real))
            states[t] = state = new
        return states, held

    def forward(self, vec: np.ndarray, win: np.ndarray, keep: bool = False):
        sides = {d: self.direction(d, vec @ self.p[f"wx{d}"] + self.p[f"b{d}"], win, keep) for d in "fb"}
        s = np.concatenate([sides["f"][0], sides["b"][0]], 2)
        u = np.tanh(s @ self.p["wa"])
        e = u @ self.p["va"]
        real = (win > 0).T
        e = np.where(real, e, -1e9)
        a = np.exp(e - e.max(0))
        a = np.where(real, a, 0)
        a = a / np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * s).sum(0)
        return pooled @ self.p["wo"] + self.p["bo"][0], (sides, s, u, a, pooled)

    def backward(self, ids, vec, win, kept, dlogit):
        """Gradients of all parameters for d loss / d logit of each window."""
        sides, s, u, a, pooled = kept
        h, g = HIDDEN, {}
        g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dp = dlogit[:, None] * self.p["wo"]
        ds = a[:, :, None] * dp
        da = (s * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["va"] = (u * de[:, :, None]).sum((0, 1))
        du = de[:, :, None] * self.p["va"] * (1 - u * u)
        g["wa"] = s.reshape(-1, 2 * h).T @ du.reshape(-1, h)
        ds = ds + du @ self.p["wa"].T
        dvec = np.zeros_like(vec)
        for k, d in enumerate("fb"):
            wh, dproj = self.p[f"wh{d}"], np.zeros((len(vec), 3 * h), np.float32)
            g[f"wh{d}"] = np.zeros_like(wh)
            dstate = np.zeros((len(win), h), np.float32)
            place, parts = [], []
            for t, prev, z, r, c, real in reversed(sides[d][1]):
                dh = ds[t][:, k * h : (k + 1) * h] + dstate
                own = np.where(real, dh, 0)
                dz, dc = own * (prev - c) * z * (1 - z), own * (1 - z) * (1 - c * c)
                drs = dc @ wh[:, 2 * h :].T
                dr = drs * prev * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], 1)
                g[f"wh{d}"][:, : 2 * h] += prev.T @ gates[:, : 2 * h]
                g[f"wh{d}"][:, 2 * h :] += (r * prev).T @ dc
                place.append(win[:, t])
                parts.append(gates)
                dstate = np.where(real, own * z + drs * r + gates[:, : 2 * h] @ wh[:, : 2 * h].T, dh)
            place, parts = np.concatenate(place), np.concatenate(parts)
            by = np.argsort(place, kind="stable")
            at, first = np.unique(place[by], return_index=True)
            dproj[at] = np.add.reduceat(parts[by], first)
            dproj[0] = 0
            g[f"wx{d}"], g[f"b{d}"] = vec.T @ dproj, dproj.sum(0)
            dvec += dproj @ self.p[f"wx{d}"].T
        g["emb"] = np.zeros_like(self.p["emb"])
        for j in range(ids.shape[1]):
            np.add.at(g["emb"], ids[:, j], dvec)
        g["emb"][0] = 0
        return g

    def logits(self, texts: list[str], part: int = 1 << 14) -> np.ndarray:
        """Highest window's logit of each text, over all windows."""
        ids, row, per = word_inputs(texts)
        vec = self.inputs(ids)
        win, text = windows(row, per)
        out = np.full(len(texts), -np.inf)
        for a in range(0, len(win), part):
            logit, own = self.forward(vec, win[a : a + part])[0], text[a : a + part]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[first]] = np.maximum(out[own[first]], np.maximum.reduceat(logit, first))
        return out

    def long_logit(self, text: str) -> float:
        """Highest window's logit of a text that is read in pieces. Windows are those of the whole text: what follows the
        last window that surely has a next one is carried over to the next piece."""
        best, held = -np.inf, np.zeros((0, 1 + GRAMS), np.int64)
        for piece in stretches(text):
            ids, row, _ = word_inputs([piece])
            held = np.concatenate([held, ids[row]])
            whole = max(0, -(-(len(held) - WINDOW) // STRIDE))
            if whole:
                best = max(best, self.highest(held, STRIDE * (whole - 1) + WINDOW))
                held = held[STRIDE * whole :]
        return max(best, self.highest(held, len(held)))

    def highest(self, units: np.ndarray, n: int, part: int = 1 << 14) -> float:
        """Highest window's logit of the first n units."""
        vec = self.inputs(np.concatenate([np.zeros((1, 1 + GRAMS), np.int64), units[:n]]))
        win, _ = windows(np.arange(1, n + 1), np.array([n]))
        return max(float(self.forward(vec, win[a : a + part])[0].max()) for a in range(0, len(win), part))

    def score(self, texts: list[str]) -> np.ndarray:
        """Texts beyond LONG characters are read in pieces, so memory stays bounded. Rounded to 6 places: the sums of one
        text may end in other bits beside other texts."""
        out, at, held = np.full(len(texts), -np.inf), 0, 0
        for k, t in enumerate(texts):
            if len(t) > LONG:
                if at < k:
                    out[at:k] = self.logits(texts[at:k])
                out[k], at, held = self.long_logit(t), k + 1, 0
                continue
            held += len(t)
            if held >= LONG or k == len(texts) - 1:
                out[at : k + 1], at, held = self.logits(texts[at : k + 1]), k + 1, 0
        if at < len(texts):
            out[at:] = self.logits(texts[at:])
        return np.round(sigmoid(np.clip(out, -30, 30)), 6)


def marked_features(ids: np.ndarray, row: np.ndarray, per: np.ndarray, y: np.ndarray) -> np.ndarray:
    """z-score of each input's presence in texts of class 1 against class 0, over 4 and clipped to [-2, 2]."""
    text = np.repeat(np.arange(len(per)), per)
    pair = np.unique(text * len(ids) + row)
    text, row = pair // len(ids), pair % len(ids)
    seen = np.zeros((2, BUCKETS + 1))
    for a in range(0, len(row), 1 << 18):
        f = ids[row[a : a + (1 << 18)]]
        pair = np.unique(np.repeat(text[a : a + (1 << 18)], f.shape[1]) * (BUCKETS + 1) + f.reshape(-1))
        for c in (0, 1):
            own = pair[y[pair // (BUCKETS + 1)] == c]
            seen[c] += np.bincount(own % (BUCKETS + 1), minlength=BUCKETS + 1)
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    p1, p0 = seen[1] / n1, seen[0] / n0
    q = np.clip((seen.sum(0) + 1) / (n1 + n0 + 2), 1e-6, 1 - 1e-3)
    z = (p1 - p0) / np.sqrt(q * (1 - q) * (1 / n1 + 1 / n0))
    z[0] = 0
    return np.clip(z / 4, -2, 2).astype(np.float32)


def fit(texts: list[str], marks: list[int], epochs: int = 10, batch: int = 128, rate: float = 5e-3, seed: int = 0) -> Network:
    """Adam on the logistic loss of chosen windows, both classes weighing half.

    An epoch scores all windows and takes each text's highest one, and for class 0 a random one too. The embeddings'
    first component starts as the inputs' z-scores, which also choose the first epoch's windows.
    """
    net, r = Network(seed), np.random.default_rng(seed)
    y = np.asarray(marks, np.int64)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the initial network, which scores low
        return net
    texts, y = [*texts, *[""] * 8], np.concatenate([y, np.zeros(8, np.int64)])  # no words: class 0
    ids, row, per = word_inputs_in_parts(texts)
    net.p["emb"] *= 0.1
    net.p["emb"][:, 0] = marked_features(ids, row, per, y)
    win, text = windows(row, per)
    count = np.bincount(text, minlength=len(y))
    begin = np.cumsum(count) - count
    m, v, t = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for epoch in range(epochs):
        vec = net.inputs(ids)
        if epoch:
            every = np.concatenate([net.forward(vec, win[a : a + (1 << 14)])[0] for a in range(0, len(win), 1 << 14)])
        else:
            every = vec[:, 0][win].max(1)
        by = np.lexsort((-every, text))
        top = by[begin]
        other = begin[y == 0] + r.integers(0, 1 << 30, (y == 0).sum()) % count[y == 0]
        chosen = np.concatenate([top, other])
        mark = np.concatenate([y, np.zeros(len(other), np.int64)])
        weight = np.where(mark == 1, 0.5 / mark.mean(), 0.5 / (1 - mark.mean())).astype(np.float32)
        order = r.permutation(len(chosen))
        steps = max(1, -(-400 // max(1, len(order) // batch))) if len(order) < 400 * batch // epochs else 1
        for own in (order[a : a + batch] for _ in range(min(steps, 12)) for a in range(0, len(order), batch)):
            words, local = np.unique(np.concatenate([[0], win[chosen[own]].reshape(-1)]), return_inverse=True)
            local = local[1:].reshape(len(own), WINDOW)
            f = ids[words]
            vec = net.inputs(f)
            logit, kept = net.forward(vec, local, keep=True)
            d = (sigmoid(np.clip(logit, -30, 30)) - mark[own]) * weight[own] / len(own)
            g = net.backward(f, vec, local, kept, d.astype(np.float32))
            t += 1
            touched = np.unique(f)
            for k, x in g.items():
                at = touched if k == "emb" else slice(None)
                m[k][at] += 0.1 * (x[at] - m[k][at])
                v[k][at] += 0.001 * (x[at] * x[at] - v[k][at])
                step = rate * (1 - 0.9 * epoch / epochs) * (0.3 if k == "emb" else 1)
                net.p[k][at] -= (step * (m[k][at] / (1 - 0.9**t)) / (np.sqrt(v[k][at] / (1 - 0.999**t)) + 1e-6)).astype(np.float32)
    return net


def training_texts(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[list, list]:
    """(texts, marks): at most rows of each class, of at most chars characters, chosen by a hash; no held-out row.

    The bounds hold for fitting only.
    """
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars))
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64("doc_id"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    some = known.where("toxic = 1").orderBy("_h", "doc_id").limit(rows).unionByName(known.where("toxic = 0").orderBy("_h", "doc_id").limit(rows))
    got = docs.join(F.broadcast(some), "doc_id").orderBy("_h", "doc_id").limit(2 * rows).select("text", "toxic").collect()
    return [r.text for r in got], [r.toxic for r in got]


def score_toxicity(documents: DataFrame, net: Network) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, from all overlapping windows of the whole text.

    Null and empty texts are one empty window, which has the bias's score. A null doc_id is not held out. Equal texts
    score equally up to the sixth place. One map over the table; memory is bounded by a slice of texts, and a long text is
    read in pieces with the same windows.
    """

    def score(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        s = net.score(texts).astype(np.float64)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    ready = documents.withColumn("held_out", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)))
    return map_texts(ready, score, "doc_id long,held_out boolean,score double,predicted int", ["doc_id", "text", "held_out"], max_bytes=SLICE)


def train(documents: DataFrame, labels: DataFrame) -> Network:
    return fit(*training_texts(documents, labels))
