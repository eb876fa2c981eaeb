"""Quality rules: base counts of a text plus a calibrated hashed n-gram logistic regression.

The model sees hashed words, pairs of neighbouring words and character n-grams (runs of four code points), each
family as its mean weight over the text.  It is trained in numpy, in one task, on whole labelled rows (at most
``TRAIN_ROWS``, the ones with the smallest key hash, a documented bound), and a Platt scale is fitted on held-out
labelled rows.  Texts are scored whole, in Arrow batches, against fixed thresholds.

Defined cases: null and empty texts have no words, so they fail the base rules and are not kept; equal
texts get equal verdicts; an empty label table gives a model that keeps whatever passes the base rules;
labels of null are ignored, and a key with clashing labels counts once for each; rows that share or lack a key are
scored one by one, by their own texts; very long texts are scored whole, one at a time; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text as X
from ._session import in_one_task, sampled, tune

#: Bound of the labelled training sample.
TRAIN_ROWS = 4000
#: Hash buckets of each feature family, code points of a character n-gram, and the families (words, word pairs, characters).
BITS, CHARS, FAMILIES = 15, 4, 3
#: Fixed limits.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_PROBABILITY = 10, 20, 0.5
REPEAT_WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCALE = 8.0


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bi" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(chunk: X.Chunk, w: X.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of a chunk."""
    data, rows = chunk.data, chunk.rows
    out = {"n_words": np.diff(w.bounds)}
    out["word_chars"] = _per_row(~X.SPACE[data] & ((data & 0xC0) != 0x80), chunk.offsets)
    out["n_symbols"] = _per_row(_SYMBOL[data], chunk.offsets)
    prefix = X.prefix_hash(data)
    # lines: the ends are newlines and row ends
    newline = np.flatnonzero(data == 10)
    stops = np.concatenate([newline, chunk.offsets[1:]])
    of = np.concatenate([np.searchsorted(chunk.offsets, newline, "right") - 1, np.arange(rows)])
    order = np.lexsort((stops, of))
    stops, of = stops[order], of[order]
    starts = np.empty_like(stops)
    if len(stops):
        starts[1:] = stops[:-1] + 1
        first = X.runs(of)
        starts[first] = chunk.offsets[of[first]]
    full = np.searchsorted(w.start, stops) > np.searchsorted(w.start, starts)
    starts, stops, of = starts[full], stops[full], of[full]
    h = X.span_hash(prefix, starts, stops)
    order = np.lexsort((h, of))
    distinct = X.runs(of[order], h[order])
    out["n_dup_lines"] = np.bincount(of, minlength=rows) - np.bincount(of[order][distinct], minlength=rows)
    # words within windows of five that occur twice or more
    hashes = X.span_hash(prefix, w.start, w.end)
    s, row, at = X.shingles(hashes, w, REPEAT_WINDOW)
    whole = out["n_words"][row] >= REPEAT_WINDOW
    s, row, at = s[whole], row[whole], at[whole]
    order = np.lexsort((s, row))
    begin = X.runs(row[order], s[order])
    size = np.diff(np.append(begin, len(s)))
    again = at[order][np.repeat(size > 1, size)]
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(cover[:-1]) > 0, w.bounds)
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def features(chunk: X.Chunk, w: X.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, bounds of the rows) for words, word pairs and runs of ``CHARS`` code points, A-Z lower-cased."""
    prefix = X.prefix_hash(X.LOWER[chunk.data])
    hashes = X.span_hash(prefix, w.start, w.end)
    pair, row, _ = X.shingles(hashes, w, 2)
    first = np.flatnonzero((chunk.data & 0xC0) != 0x80)  # where code points start
    bounds = np.searchsorted(first, chunk.offsets)
    count = np.maximum(0, np.diff(bounds) - CHARS + 1)
    kept = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(kept[-1]) - np.repeat(kept[:-1], count) + np.repeat(bounds[:-1], count)
    ends = np.append(first, len(chunk.data))
    gram = X.span_hash(prefix, first[at], ends[at + CHARS])
    shift = np.uint64(64 - BITS)
    return [((hashes >> shift).astype(np.int32), w.bounds), ((pair >> shift).astype(np.int32), np.searchsorted(row, np.arange(chunk.rows + 1))), ((gram >> shift).astype(np.int32), kept)]


@dataclass
class QualityModel:
    weights: np.ndarray  # (FAMILIES, 2**BITS) float32
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    empty: bool = False

    def logits(self, chunk: X.Chunk, w: X.Words) -> np.ndarray:
        z = np.full(chunk.rows, self.bias)
        for weight, (idx, bounds) in zip(self.weights, features(chunk, w)):
            z += _SCALE * _per_row(weight[idx].astype(np.float64), bounds) / np.maximum(1, np.diff(bounds))
        return z

    def probability(self, chunk: X.Chunk, w: X.Words) -> np.ndarray:
        if self.empty:
            return np.ones(chunk.rows)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(chunk, w) + self.shift, -40, 40)))


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, mean weight) of the distinct features of each family over all texts."""
    parts: list[list] = [[] for _ in range(FAMILIES)]
    for chunk in X.chunks(pa.array(texts, pa.string())):
        for part, (idx, bounds) in zip(parts, features(chunk, X.words(chunk))):
            n = np.diff(bounds)
            pairs, count = np.unique((np.repeat(np.arange(chunk.rows), n) << BITS) | idx, return_counts=True)
            row = pairs >> BITS
            part.append(((row + chunk.first).astype(np.int32), (pairs & ((1 << BITS) - 1)).astype(np.int32), (_SCALE * count / n[row]).astype(np.float32)))
    return [tuple(np.concatenate([p[k] for p in part]) for k in range(3)) for part in parts]


def train(texts: list[str], y: np.ndarray, epochs: int = 80, l2: float = 1e-4) -> QualityModel:
    """Full-batch Adam on four fifths of the rows; Platt scaling on the last fifth."""
    y = np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros((FAMILIES, 1 << BITS), np.float32), 0.0, empty=not len(y) or bool(y[0] == 1))
    parts = _sparse(texts)
    fit = np.arange(len(y)) % 5 != 4
    if len(set(y[fit].tolist())) < 2:
        fit[:] = True
    weight, bias = np.zeros((FAMILIES, 1 << BITS)), 0.0
    m, v, mb, vb = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * fit

    def logits() -> np.ndarray:
        return bias + sum(np.bincount(row, weight[k][idx] * value, len(y)) for k, (row, idx, value) in enumerate(parts))

    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(logits(), -40, 40)))
        g = (p - y) * balance
        grad = np.stack([np.bincount(idx, g[row] * value, 1 << BITS) for row, idx, value in parts]) + l2 * weight
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weight -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    weight = weight.astype(np.float32)
    z = logits()
    held = ~fit if len(set(y[~fit].tolist())) == 2 else fit
    slope, shift = platt(z[held], y[held])
    return QualityModel(weight, float(bias), slope, shift)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton steps for P(1) = sigmoid(slope * z + shift), with smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, a, b = np.where(y == 1, hi, lo), 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * z * z).sum() + 1e-6, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def learned(docs: DataFrame, labels: DataFrame, label: str, train: Callable, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, where=None) -> object:
    """``train(texts, y)`` on at most ``rows`` labelled texts, whole, in one task; the driver sees the result only."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull())
    if where is not None:
        known = known.where(where(F.col("k")))

    def work(found: list[dict]) -> object:
        found.sort(key=lambda r: (r["k"], r["y"], r["t"] or ""))
        return train([r["t"] or "" for r in found], np.array([r["y"] for r in found]))

    return in_one_task(sampled(docs, known, rows, text, key), work)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> QualityModel:
    return learned(docs, labels, "quality", train, key, text)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def quality_rules(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", threshold: float = KEEP_PROBABILITY) -> DataFrame:
    """The key, the base counts, base_failed, kept and the calibrated probability of each row."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FAMILIES * 2**BITS floats
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in X.chunks(batch.column(1)):
                w = X.words(chunk)
                counts = base_counts(chunk, w)
                failed, p = base_failed(counts), shared.value.probability(chunk, w)
                cols = [pa.array(c.astype(np.int64)) for c in counts.values()] + [pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), *cols], [key, *counts, "base_failed", "kept", "quality"])

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(score, f"`{key}` {kind}, {SCHEMA}")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("documents", "labels"))
    return quality_rules(docs, fit(docs, labels))
