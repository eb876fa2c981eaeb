"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is cut into words (ASCII punctuation and white space separate); a word's input is its embedding, if
the training documents know it well enough, plus the mean embedding of its hashed byte 3-grams and 5-grams
(word ends included).  Windows of ``LENGTH`` words start
every ``STRIDE`` words, so neighbours overlap and every word of every text is scored.  Two gated recurrent
passes run over a window, attention pools their states, and a linear layer scores the window; a document
has the mean score of its two highest windows, Platt-scaled.

Training learns from windows of labelled documents: first every window has its document's label, then in
positive documents only windows that score high keep it (multiple-instance relabelling).  The sample
is bounded by rows only: ``TRAIN_ROWS`` labelled documents (smallest key hash), each with all its windows; the
Platt scale and the floor are fitted on the scores of whole texts.  One task trains, and the driver receives the
parameters alone.  Scoring is not bounded: whole texts, in Arrow batches, with memory in proportion to a chunk of about a megabyte.

Defined cases: null, empty and word-less texts get the lowest score seen in training; without labels of both
kinds every score is 0; equal texts get equal scores; null labels and keys are ignored in training; repeated
rows each give their row; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _text as X
from ._session import tune
from .decontaminate import GAP
from .quality import learned, platt

LENGTH, STRIDE, HIDDEN, INPUT, ATTEND = 32, 24, 8, 12, 8
#: Buckets of the byte grams; a word has its own embedding if this many training documents hold it.
CHAR_BITS, MIN_DOCS = 18, 4
TRAIN_ROWS, EPOCHS, BATCH, NEGATIVES = 4000, 12, 512, 6000
THRESHOLD, WORDS_AT_ONCE = 0.3, 1 << 14
_F = np.float32


def held_out(key: Column) -> Column:
    """Rows that training must not see: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


@dataclass
class Vocabulary:
    """Distinct words of a chunk: word hash, char buckets back to back with their bounds, and each word's index."""

    word: np.ndarray
    chars: np.ndarray
    bounds: np.ndarray
    index: np.ndarray
    rows: np.ndarray  # first word of each row, and the end


def vocabulary(chunk: X.Chunk) -> Vocabulary:
    w = X.words(chunk, GAP)
    hashes = X.word_hashes(chunk, w)
    distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    # bytes with a separator around every row, everything that is no word blanked
    sizes = np.diff(chunk.offsets)
    shift = np.repeat(np.arange(1, chunk.rows + 1), sizes) + 1
    d = np.full(len(chunk.data) + chunk.rows + 8, 32, np.uint64)
    at = np.arange(len(chunk.data)) + shift
    d[at] = np.where(GAP[chunk.data], 32, X.LOWER[chunk.data])
    start = w.start[first] + w.row[first] + 2
    size = w.end[first] - w.start[first]
    tri = d[:-4] | (d[1:-3] << np.uint64(8)) | (d[2:-2] << np.uint64(16))
    five = tri | (d[3:-1] << np.uint64(24)) | (d[4:] << np.uint64(32))
    with np.errstate(over="ignore"):
        tri = ((tri + np.uint64(1 << 50)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHAR_BITS)
        five = (five * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - CHAR_BITS)
    n5 = np.maximum(1, size - 2)
    bounds = np.concatenate([[0], np.cumsum(size + n5)])
    chars = np.empty(bounds[-1], np.int32)
    for grams, count, skip in ((tri, size, np.zeros_like(size)), (five, n5, size)):
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        chars[np.repeat(bounds[:-1] + skip, count) + inner] = grams[np.repeat(start - 1, count) + inner]
    return Vocabulary(distinct, chars, bounds, index.astype(np.int64), w.bounds)


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of each window; rows without words have none."""
    n = np.diff(rows)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - LENGTH) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return rows[row] + k * STRIDE, row


def window_index(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word of each place of each window, row of each window); ``len(v.word)`` marks padding."""
    first, row = windows(v.rows)
    place = first[:, None] + np.arange(LENGTH)
    inside = place < v.rows[1:][row][:, None]
    if not len(first):
        return np.zeros((0, LENGTH), np.int64), row
    return np.where(inside, v.index[np.minimum(place, len(v.index) - 1)], len(v.word)), row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _init(known: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *shape, s: r.normal(0, s, shape).astype(_F)
    p = {"known": known, "word": np.zeros((len(known) + 1, INPUT), _F), "char": g(1 << CHAR_BITS, INPUT, s=0.05)}
    for side in "fb":
        p[f"W{side}"], p[f"U{side}"], p[f"c{side}"] = g(INPUT, 3 * HIDDEN, s=0.3), g(HIDDEN, 3 * HIDDEN, s=0.3), np.zeros(3 * HIDDEN, _F)
    return p | {"A": g(2 * HIDDEN, ATTEND, s=0.3), "a": np.zeros(ATTEND, _F), "v": g(ATTEND, s=0.3), "o": g(2 * HIDDEN, s=0.3), "q": np.zeros(1, _F)}


def embedding_rows(known: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Row of each word's own embedding; 0 for a word that training does not know."""
    if not len(known):
        return np.zeros(len(word), np.int64)
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    return np.where(known[at] == word, at + 1, 0)


def inputs(p: dict[str, np.ndarray], v: Vocabulary, own: np.ndarray | None = None) -> np.ndarray:
    """Input vector of each distinct word."""
    if not len(v.word):
        return np.zeros((0, INPUT), _F)
    out = p["word"][embedding_rows(p["known"], v.word) if own is None else own]
    for a in range(0, len(out), WORDS_AT_ONCE):
        bounds = v.bounds[a : a + WORDS_AT_ONCE + 1]
        grams = p["char"][v.chars[bounds[0] : bounds[-1]]]
        out[a : a + WORDS_AT_ONCE] += np.add.reduceat(grams, bounds[:-1] - bounds[0], axis=0) / np.diff(bounds)[:, None].astype(_F)
    return out


def _gates(p: dict[str, np.ndarray], x: np.ndarray, side: str) -> np.ndarray:
    """Input part of the gates of each distinct word; the last row pads: its update gate keeps the state."""
    g = np.zeros((len(x) + 1, 3 * HIDDEN), _F)
    g[:-1] = x @ p[f"W{side}"] + p[f"c{side}"]
    g[-1, :HIDDEN] = 30
    return g


def forward(p: dict[str, np.ndarray], gates: dict[str, np.ndarray], idx: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window; ``keep`` receives what the backward pass needs."""
    n, h = len(idx), HIDDEN
    states = np.empty((LENGTH, n, 2 * h), _F)
    for s, side in enumerate("fb"):
        g, U = gates[side], p[f"U{side}"]
        H = np.zeros((n, h), _F)
        for t in range(LENGTH) if side == "f" else range(LENGTH - 1, -1, -1):
            x, u = g[idx[:, t]], H @ U
            zr = x[:, : 2 * h] + u[:, : 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            if keep is not None:
                keep[side, t] = (H, z, r, new, u[:, 2 * h :])
            H = new + z * (H - new)
            states[t, :, s * h : (s + 1) * h] = H
    e = np.tanh(states @ p["A"] + p["a"])
    score = (e @ p["v"]).T  # (n, LENGTH)
    score = np.where(idx == len(gates["f"]) - 1, _F(-1e9), score)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    alpha = score / score.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,tnh->nh", alpha, states)
    if keep is not None:
        keep["top"] = (states, e, alpha, pooled)
    return pooled @ p["o"] + p["q"][0]


def _scatter(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values at each index."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    order = np.argsort(at, kind="stable")
    first = X.runs(at[order])
    out[at[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def backward(p: dict[str, np.ndarray], x: np.ndarray, idx: np.ndarray, keep: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the parameters, and of the distinct words' inputs as ``x``."""
    h = HIDDEN
    states, e, alpha, pooled = keep["top"]
    g = {"o": pooled.T @ dlogit, "q": np.array([dlogit.sum()], _F)}
    dpool = dlogit[:, None] * p["o"]
    dalpha = np.einsum("nh,tnh->nt", dpool, states)
    dstates = alpha.T[:, :, None] * dpool[None]
    dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("nt,tna->a", dscore, e)
    de = dscore.T[:, :, None] * p["v"] * (1 - e * e)
    g["A"] = np.einsum("tnh,tna->ha", states, de)
    g["a"] = de.sum(axis=(0, 1))
    dstates = dstates + de @ p["A"].T
    dx = np.zeros((len(x) + 1, INPUT), _F)
    for s, side in enumerate("fb"):
        U, W = p[f"U{side}"], p[f"W{side}"]
        dU = np.zeros_like(U)
        all_d = np.empty((LENGTH, len(idx), 3 * h), _F)
        dH = np.zeros((len(idx), h), _F)
        for t in range(LENGTH - 1, -1, -1) if side == "f" else range(LENGTH):
            H, z, r, new, un = keep[side, t]
            d = dH + dstates[t, :, s * h : (s + 1) * h]
            dnew = d * (1 - z) * (1 - new * new)
            dz = d * (H - new) * z * (1 - z)
            dr = dnew * un * r * (1 - r)
            du = np.concatenate([dz, dr, dnew * r], axis=1)
            dU += H.T @ du
            all_d[t] = np.concatenate([dz, dr, dnew], axis=1)
            dH = d * z + du @ U.T
        dgate = _scatter(idx.T.ravel(), all_d.reshape(-1, 3 * h), len(x) + 1)
        dgate[-1] = 0
        g[f"U{side}"], g[f"c{side}"] = dU, dgate.sum(axis=0)
        g[f"W{side}"] = x.T @ dgate[:-1]
        dx += dgate @ W.T
    return g | {"x": dx[:-1]}


def pool(score: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Mean of the two highest window logits of each row (one counts twice); NaN without windows."""
    out = np.full(rows, np.nan)
    if len(row):
        order = np.lexsort((-score, row))
        first = X.runs(row[order])
        second = np.minimum(first + 1, len(row) - 1)
        second = np.where(row[order][second] == row[order][first], second, first)
        out[row[order][first]] = (score[order][first].astype(np.float64) + score[order][second]) / 2
    return out


@dataclass
class ToxicityModel:
    params: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    floor: float = 0.0

    def logits(self, chunk: X.Chunk) -> np.ndarray:
        """The document logit of each row; NaN without words."""
        v = vocabulary(chunk)
        idx, row = window_index(v)
        return pool(_scores(self.params, v, idx), row, chunk.rows)

    def scores(self, chunk: X.Chunk) -> np.ndarray:
        if not self.params:
            return np.zeros(chunk.rows)
        z = self.logits(chunk)
        return sigmoid(self.slope * np.where(np.isnan(z), self.floor, z) + self.shift)


def _known(v: Vocabulary, idx: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words that the windows of at least ``MIN_DOCS`` training documents hold, sorted by hash."""
    docs = int(row.max()) + 1 if len(row) else 1
    pairs = np.unique(idx.astype(np.int64) * docs + row[:, None])
    word, count = np.unique(pairs // docs, return_counts=True)
    word = word[(count >= MIN_DOCS) & (word < len(v.word))]
    return np.sort(v.word[word])


def _merge(texts: list[str]) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """One vocabulary over all training texts, their windows and the document of each window."""
    words, chars, sizes, parts, base = [], [], [], [], 0
    seen: dict[int, int] = {}
    for chunk in X.chunks(pa.array(texts, pa.string())):
        v = vocabulary(chunk)
        i, r = window_index(v)
        fresh = np.array([w not in seen for w in v.word.tolist()], bool)
        seen.update(zip(v.word[fresh].tolist(), range(base, base + int(fresh.sum()))))
        base += int(fresh.sum())
        at = np.array([*map(seen.__getitem__, v.word.tolist()), -1], np.int64)
        parts.append((at[i].astype(np.int32), (r + chunk.first).astype(np.int32)))
        size = np.diff(v.bounds)
        words.append(v.word[fresh])
        chars.append(v.chars[np.repeat(fresh, size)])
        sizes.append(size[fresh])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    idx = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, LENGTH), np.int32)
    row = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
    idx[idx < 0] = base
    return Vocabulary(np.concatenate(words), np.concatenate(chars), bounds, np.zeros(0, np.int64), np.zeros(1, np.int64)), idx, row


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> ToxicityModel:
    y = np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        return ToxicityModel()
    v, idx, row = _merge(texts)
    r = np.random.default_rng(seed)
    p = _init(_known(v, idx, row), seed)
    m, s = ({k: np.zeros_like(a) for k, a in p.items() if k != "known"} for _ in range(2))
    check = np.arange(len(y)) % 5 == 4  # documents for the Platt scale
    label = y[row]
    usable = ~check[row]
    own = embedding_rows(p["known"], v.word)
    all_negative = np.flatnonzero(usable & (label == 0))
    step = 0
    for epoch in range(epochs):
        positive = np.flatnonzero(usable & (label == 1))
        negative = r.choice(all_negative, min(len(all_negative), 2 * NEGATIVES if epoch < 2 else NEGATIVES), replace=False)
        if epoch >= 2:  # keep the windows that look positive, and the best one of each document; add the hardest negatives
            z = _scores(p, v, idx[positive])
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, row[positive], z)
            positive = positive[(z > 0) | (z >= best[row[positive]])]
            z = _scores(p, v, idx[all_negative])
            negative = np.unique(np.concatenate([negative, all_negative[np.argsort(-z, kind="stable")[:NEGATIVES]]]))
        order = r.permutation(np.concatenate([positive, negative]))
        weight = np.where(label == 1, 0.4 / max(1, len(positive)), 0.6 / max(1, len(negative))) * len(order)
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            part, local, used = _part(v, idx[pick])
            size = np.diff(part.bounds)
            mine = np.where(r.random(len(used)) < 0.3, 0, own[used])  # so that the grams learn too
            x = inputs(p, part, mine)
            gates, keep = {side: _gates(p, x, side) for side in "fb"}, {}
            z = forward(p, gates, local, keep)
            dlogit = ((sigmoid(z) - label[pick]) * weight[pick] / len(pick)).astype(_F)
            g = backward(p, x, local, keep, dlogit)
            dx = g.pop("x")
            step += 1
            rate = 0.01 * min(1, step / 20) * (0.3 if epoch > epochs * 2 // 3 else 1)
            tables = {"word": (mine, dx), "char": (part.chars, np.repeat(dx / size[:, None].astype(_F), size, axis=0))}
            for name, grad in [*g.items(), *tables.items()]:
                if name in tables:  # only the rows in use
                    touched, inverse = np.unique(grad[0], return_inverse=True)
                    grad = _scatter(inverse, grad[1], len(touched))
                    if name == "word":
                        grad[touched == 0] = 0
                else:
                    touched = ...
                old = p[name][touched]
                grad = grad + _F(1e-5) * old
                first = _F(0.9) * m[name][touched] + _F(0.1) * grad
                second = _F(0.999) * s[name][touched] + _F(0.001) * grad * grad
                m[name][touched], s[name][touched] = first, second
                p[name][touched] = old - _F(rate) * (first / _F(1 - 0.9**step)) / (np.sqrt(second / _F(1 - 0.999**step)) + _F(1e-6))
    p["char"][~s["char"].any(axis=1)] = 0  # grams that no step has met say nothing
    z = _scores(p, v, idx)
    top = pool(z, row, len(y))
    known = ~np.isnan(top)
    fold = known & check if len(set(y[known & check].tolist())) == 2 else known
    slope, shift = platt(top[fold], y[fold]) if fold.any() else (1.0, 0.0)
    return ToxicityModel(p, slope, shift, float(np.nanmin(top)) if known.any() else 0.0)


def _scores(p: dict[str, np.ndarray], v: Vocabulary, idx: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Logit of each window; only the words of ``at_once`` windows are held at a time."""
    out = [np.zeros(0, _F)]
    for k in range(0, len(idx), at_once):
        part, local, _ = _part(v, idx[k : k + at_once])
        x = inputs(p, part)
        out.append(forward(p, {side: _gates(p, x, side) for side in "fb"}, local))
    return np.concatenate(out)


def _part(v: Vocabulary, idx: np.ndarray) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The words of some windows as a vocabulary of their own, the windows in its terms, and the words' old indexes."""
    used, local = np.unique(idx, return_inverse=True)
    used = used[used < len(v.word)]
    local = np.minimum(local.reshape(idx.shape), len(used))
    size = np.diff(v.bounds)[used]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(v.bounds[used], size)
    return Vocabulary(v.word[used], v.chars[at], np.concatenate([[0], np.cumsum(size)]), local, local), local, used


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", where=None) -> ToxicityModel:
    """Train on labelled rows outside the held-out fold (``where`` replaces that condition)."""
    return learned(docs, labels, "toxic", train, key, text, TRAIN_ROWS, where or (lambda k: ~held_out(k)))


def toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) of each row."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in X.chunks(batch.column(1)):
                score = shared.value.scores(chunk).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in one pass and without a shuffle."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(chunk) for chunk in X.chunks(batch.column(at).cast(pa.string()))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("documents", "labels"))
    out = toxicity(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
