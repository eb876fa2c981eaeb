"""Benchmark decontamination by SimHash windows, Hamming blocks and exact similarity.

Texts and benchmark items are lower-cased runs of letters and digits (ASCII punctuation separates).  For
an item of L words, every window of L words of every text is compared with it:

1. the 64-bit SimHash fingerprint of each window, over its five-word shingles, comes from running counts of each bit, a
   block of ``BLOCK`` shingles at a time, so a text of any length needs a few megabytes;
2. fingerprints are looked up in four 16-bit blocks, whose tables give distances to what is stored: what lies within ``RADIUS``
   is never farther than that in all blocks together, so every item within the radius is found;
3. a candidate is kept if its weighted Jaccard similarity (shingles weighted by how often they occur in
   either side) reaches the threshold, 0.8; windows that cannot reach it, as too many of their shingles are not
   the item's, are left out before the exact count.

Items travel to the tasks in blocks of at most ``ITEM_BYTES`` of text, one pass over the documents for each,
so a benchmark of any size works with bounded memory; a worker keeps the index of the block that it used last.

Defined cases: null, empty and word-less texts and items match nothing; an item under five words matches its
whole word sequence; a text shorter than an item is one window; of equally similar windows the first is reported;
repeated items each match; rows that repeat, share a key or lack one each give their rows; extra columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _text as X
from ._session import tune

SHINGLE, SIMILARITY = 5, 0.8
#: Hamming radius that the four blocks of 16 bits guarantee, and fingerprints that share the blocks' tables (256 KB).
RADIUS, TOGETHER = 19, 12
#: Bytes of items of one pass, and shingles worked on at once.
ITEM_BYTES, BLOCK = 1 << 20, 1 << 16
GAP = np.zeros(256, bool)
GAP[:128] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    GAP[_c] = False
_BITS = np.arange(64, dtype=np.uint64)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of ``hashes[s : s + n]`` for each start and size."""
    out = np.empty(len(starts), np.uint64)
    for j, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        ones = ((hashes[a : a + n, None] >> _BITS) & np.uint64(1)).sum(axis=0)
        out[j] = ((2 * ones > n).astype(np.uint64) << _BITS).sum(dtype=np.uint64)
    return out


def distances(stored: np.ndarray) -> np.ndarray:
    """Hamming distance of each 16-bit value to the nearest of the stored ones, one bit after another."""
    out = np.full(1 << 16, 64, np.uint8)
    out[stored] = 0
    for bit in range(16):
        out = np.minimum(out, out.reshape(-1, 2, 1 << bit)[:, ::-1].reshape(-1) + np.uint8(1))
    return out


class Hamming:
    """Multi-index over four 16-bit blocks: every stored fingerprint within the radius of a query is found.

    Fingerprints are stored ``TOGETHER`` by ``TOGETHER``.  For each block of such a set, a table gives the distance of any
    16-bit value to the nearest stored one.  A query can be within the radius of one of the set only if its four distances
    add up to the radius or less (so that one of them is a quarter of it at most); only then is it compared with the set."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.size, self.radius = len(prints), radius
        self.sets = []
        for first in range(0, len(prints), TOGETHER):
            some = prints[first : first + TOGETHER]
            blocks = np.ascontiguousarray(some, "<u8").view("<u2").reshape(-1, 4)
            self.sets.append((first, some, [distances(blocks[:, b]) for b in range(4)]))

    def query(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) pairs within the radius, in order."""
        values = np.ascontiguousarray(prints, "<u8").view("<u2").reshape(-1, 4).T.astype(np.intp)
        found = [np.zeros(0, np.int64)]
        for first, some, nearest in self.sets:
            bound = nearest[0].take(values[0])
            for d, value in zip(nearest[1:], values[1:]):
                bound += d.take(value)
            maybe = np.flatnonzero(bound <= self.radius)
            near = np.bitwise_count(prints.take(maybe)[:, None] ^ some) <= self.radius
            if near.any():
                q, s = np.nonzero(near)
                found.append(maybe[q] * self.size + first + s)
        return np.divmod(np.sort(np.concatenate(found)), max(1, self.size))


@dataclass
class Group:
    """The items of one size: ``size`` shingles of ``k`` words each; who they are, their fingerprints and their shingles."""

    k: int
    size: int
    items: np.ndarray
    near: Hamming
    member: np.ndarray  # does an item (by its place here) have a shingle: a filter over hashes of both


def _member_key(shingle: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((shingle ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)


class ItemIndex:
    """Bags of shingles, and groups by size, of one block of items."""

    def __init__(self, ids: list, texts: list[str | None]):
        chunk = next(X.chunks(pa.array([t or "" for t in texts], pa.string()), 1 << 40), None)
        self.ids = ids
        w = X.words(chunk, GAP)
        s, row, _ = X.shingles(X.word_hashes(chunk, w), w, SHINGLE)
        self.words = np.diff(w.bounds)
        bounds = np.searchsorted(row, np.arange(len(ids) + 1))
        self.bags = [np.unique(s[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
        self.groups = []
        for n in np.unique(self.words[self.words > 0]).tolist():
            items = np.flatnonzero(self.words == n)
            size = max(1, n - SHINGLE + 1)
            own = s[(bounds[items][:, None] + np.arange(size)).ravel()]
            member = np.zeros(1 << 18, bool)
            member[_member_key(own, np.repeat(np.arange(len(items)), size))] = True
            prints = fingerprints(own, np.arange(len(items)) * size, np.full(len(items), size))
            self.groups.append(Group(min(n, SHINGLE), size, items, Hamming(prints), member))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (values, counts)."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][x], b[1][y]).sum())
    return common / max(1, int(a[1].sum()) + int(b[1].sum()) - common)


def _kind(most: int) -> type:
    """As few bytes as tell apart the counts in windows of ``most`` shingles."""
    return np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32


def _running(s: np.ndarray, most: int) -> np.ndarray:
    """Counts of each bit in the shingles before each place, modulo what the type holds."""
    bits = np.unpackbits(np.ascontiguousarray(s, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(s) + 1, 64), _kind(most))
    np.cumsum(bits, axis=0, dtype=total.dtype, out=total[1:])
    return total


def _prints(total: np.ndarray, size: int, work: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Fingerprints of all windows of ``size`` shingles, from running counts; ``work`` and ``up`` are room for them."""
    n = len(total) - size
    np.subtract(total[size:], total[:n], out=work[:n])
    np.greater(work[:n], size // 2, out=up[:n])
    return np.packbits(up[:n].reshape(-1), bitorder="little").view("<u8")


def _windows(s: np.ndarray, row: np.ndarray, groups: list[Group], threshold: float) -> Iterator[tuple[Group, np.ndarray, np.ndarray]]:
    """(group, first shingle, place of the item in the group) of the windows that may match."""
    most = max(g.size for g in groups)
    room = min(BLOCK, len(s))
    work, up = np.empty((room, 64), _kind(most)), np.empty((room, 64), bool)
    for base in range(0, len(s), BLOCK):
        part, rows = s[base : base + BLOCK + most - 1], row[base : base + BLOCK + most - 1]
        total = _running(part, most)
        for g in groups:
            starts = min(BLOCK, len(part) - g.size + 1)
            if starts <= 0:
                continue
            q, place = g.near.query(_prints(total[: starts + g.size], g.size, work, up))
            inside = rows[q] == rows[q + g.size - 1]
            q, place = q[inside], place[inside]
            lost = int(g.size * (1 - threshold) / (1 + threshold) + 1e-9)  # shingles that a window may have alone
            for look in (lost + 1, g.size):
                if len(q):
                    have = g.member[_member_key(part[q[:, None] + np.arange(look)], place[:, None])].sum(axis=1)
                    q, place = q[have >= look - lost], place[have >= look - lost]
            if len(q):
                yield g, base + q, place


def scan(chunk: X.Chunk, index: ItemIndex, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, similarity) of the best window of each matching row and item."""
    w = X.words(chunk, GAP)
    if not len(w.start):
        return []
    hashes = X.word_hashes(chunk, w)
    counts = np.diff(w.bounds)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}

    def verify(s: np.ndarray, at: np.ndarray, row: np.ndarray, first: int, size: int, item: int) -> None:
        x = similarity(np.unique(s[first : first + size], return_counts=True), index.bags[item])
        r = int(row[first])
        found = (x, -int(at[first] - w.bounds[r]), min(int(index.words[item]), int(counts[r])))
        if x >= threshold and found > best.get((r, item), (0.0, 0, 0)):
            best[r, item] = found

    for k in sorted({g.k for g in index.groups}):
        groups = [g for g in index.groups if g.k == k]
        s, row, at = X.shingles(hashes, w, k)
        whole = counts[row] >= k
        s, row, at = s[whole], row[whole], at[whole]
        if not len(s):
            continue
        for g, first, place in _windows(s, row, groups, threshold):
            for p, i in zip(first.tolist(), g.items[place].tolist()):
                verify(s, at, row, p, g.size, i)
        # texts shorter than an item: the whole text is the window
        begin = X.runs(row)
        size = np.diff(np.append(begin, len(s)))
        for g in groups:
            short = np.flatnonzero((size < g.size) & (size >= threshold * g.size))
            if len(short):
                q, place = g.near.query(fingerprints(s, begin[short], size[short]))
                for j, i in zip(short[q].tolist(), g.items[place].tolist()):
                    verify(s, at, row, int(begin[j]), int(size[j]), i)
    return [(r, item, -at, size, x) for (r, item), (x, at, size) in sorted(best.items())]


_LAST: list = [None, None]


def _index(block: tuple[list, list]) -> ItemIndex:
    """The index of a block of items, kept by a worker from task to task."""
    if _LAST[0] is not block:
        _LAST[:] = [block, ItemIndex(*block)]
    return _LAST[1]


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """Items in blocks whose texts come to ``ITEM_BYTES`` or so."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // ITEM_BYTES) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()
        if rows:
            yield [r["item"] for r in rows], [r["text"] for r in rows]


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", threshold: float = SIMILARITY) -> DataFrame:
    """(key, item, first_word, n_words, similarity): the best window of each document for each item it holds."""
    tune(docs.sparkSession)
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item].dataType)
    texts = docs.select(key, F.col(text).cast("string").alias("text"))
    schema = f"`{key}` {kind}, `{item}` {item_kind}, first_word long, n_words long, similarity double"
    out = None
    for block in _blocks(items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for batch in batches:
                for chunk in X.chunks(batch.column(1)):
                    if found := scan(chunk, index, threshold):
                        row, i, first, size, x = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows).take(pa.array(row)), pa.array([index.ids[j] for j in i], item_type), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(x, pa.float64())], [key, item, "first_word", "n_words", "similarity"])

        one = texts.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item, without a shuffle: one pass for each block of items."""
    tune(docs.sparkSession)
    at = docs.columns.index(text)
    for block in _blocks(items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for chunk in X.chunks(batch.column(at).cast(pa.string())):
                    clean[[chunk.first + f[0] for f in scan(chunk, index, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("documents", "benchmark"))
    return contamination(docs, items)
