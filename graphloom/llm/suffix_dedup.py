"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte that lies in a ``length``-byte string which also starts anywhere else (same document included)
is removed; strings are judged on the input, overlaps count, and no string crosses a document.

1. *Suffix buckets.*  The suffix that starts at p goes to the bucket of its window's anchor, the leftmost
   minimal k-gram hash in ``[p, p + length)``.  Equal windows have equal anchors at equal offsets, so equal
   windows always meet in one bucket.  Neighbouring suffixes of one anchor form a *unit*; about one unit
   stands for every 75 suffixes, and only units are shuffled, those of a batch that are alike as one row with
   a list of places.  Buckets of a single unit are dropped.
2. *Units that repeat as a whole* (same anchor, offsets and bytes, by two independent 64-bit hashes) are
   settled by a pre-aggregated count.  What is left are the distinct units at the edges of repeats.
3. *Cells.*  The bytes of those units are fetched and cut into cells of ``CELL`` suffixes.  A cell's bucket is the
   bytes that its suffixes' strings share, so buckets get smaller by far; cells are settled as units are.
4. *Bucket sort.*  The cells that are still open are sorted a block at a time, bucket by bucket.  Suffixes are
   refined by their first and last v bytes; long ties are resolved by the ranks of a sample of positions,
   those whose residue mod v lies in a difference cover, computed once per block by doubling to 4v bytes.
   For two tied suffixes some d < v puts both p + d and q + d into the sample, so comparing sample ranks at
   each d settles every tie, and a block never needs more than its own megabyte or so.  A block may end inside a
   bucket, so a bucket of any size is dealt over many tasks: what is alone in its block is counted
   once more over all blocks by window hash.

Every bucket takes these same steps, whatever its size.

Defined cases: null and empty texts, and texts under ``length`` bytes, keep all their bytes; every row is numbered and
is a document of its own, whether it repeats another, shares its key with other texts or has no key (so both copies
of a text lose their repeats); a very long text is cut into segments of ``SEGMENT`` starts that overlap by
``length - 1`` bytes, and its spans are gathered in one row, some 16 bytes for each 75 of its own; extra columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text as X
from ._session import numbered, stage, tune

#: Cells of one sorted block; window starts per segment of a long text; suffixes of a cell; units or cells grouped at once.
BLOCK, SEGMENT, CELL, GROUP = 4096, 1 << 19, 12, 1 << 17
_POS = np.uint64((1 << 20) - 1)


def difference_cover(v: int) -> np.ndarray:
    """A small set D with every residue mod v a difference of two members, grown greedily."""
    cover, seen = [0], {0}
    while len(seen) < v:
        best = max(range(v), key=lambda x: (len(({(x - c) % v for c in cover} | {(c - x) % v for c in cover}) - seen), -x))
        seen |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return np.array(sorted(cover))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` neighbours, from block-wise prefix and suffix minima."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def units(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first suffix, number of suffixes, anchor offset, bucket, class) of each unit of a chunk."""
    k = length // 4
    w = length - k + 1
    n = len(data)
    sizes = np.maximum(0, np.diff(offsets) - length + 1)
    if not sizes.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    prefix = X.prefix_hash(data)
    starts = np.arange(n - k + 1)
    gram = X.span_hash(prefix, starts, starts + k)
    low = sliding_min((gram & ~_POS) | starts.astype(np.uint64), w)
    row = np.repeat(np.arange(len(sizes)), sizes)
    p = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[row]
    anchor = (low[p] & _POS).astype(np.int64)
    first = X.runs(row, anchor)
    count = np.diff(np.append(first, len(p)))
    lo, a = p[first], anchor[first]
    with np.errstate(over="ignore"):
        cls = X.mix(X.span_hash(prefix, lo, lo + count + length - 1) * np.uint64(0x9FB21C651E98DF25) + (a - lo).astype(np.uint64))
    return row[first], lo, count, a - lo, gram[a], cls


def _segments(chunk: X.Chunk, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    if chunk.rows > 1 or len(chunk.data) <= SEGMENT + length:
        yield chunk.data, chunk.offsets, 0
        return
    for base in range(0, len(chunk.data) - length + 1, SEGMENT):
        part = chunk.data[base : base + SEGMENT + length - 1]
        yield part, np.array([0, len(part)]), base


def _pack(lo: np.ndarray, back: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (lo.astype(np.int64) << 24) | (back.astype(np.int64) << 12) | count.astype(np.int64)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 12) & 4095, at & 4095


def _grouped(parts: Iterator[dict[str, np.ndarray]], places: list[str]) -> Iterator[pa.RecordBatch]:
    """(bucket, cls, places): one row for each distinct (bucket, cls) of about ``GROUP`` rows, so that what repeats comes
    together before any shuffle."""

    def batch(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        x = {k: np.concatenate([p[k] for p in held]) for k in held[0]}
        order = np.lexsort((x["cls"], x["bucket"]))
        x = {k: v[order] for k, v in x.items()}
        first = X.runs(x["bucket"], x["cls"])
        fields = pa.StructArray.from_arrays([pa.array(x[k].astype(np.int64)) for k in places], places)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), fields)
        return pa.RecordBatch.from_arrays([pa.array(x[k][first].view(np.int64)) for k in ("bucket", "cls")] + [lists], ["bucket", "cls", "places"])

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part["bucket"])
        if size >= GROUP:
            yield batch(held)
            held, size = [], 0
    if size:
        yield batch(held)


def _unit_rows(length: int):
    """Grouped units of (row, text) batches; places: row, at."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for chunk in X.chunks(batch.column(1)):
                for data, offsets, base in _segments(chunk, length):
                    row, lo, count, back, bucket, cls = units(data, offsets, length)
                    yield {"bucket": bucket, "cls": cls, "row": rows[chunk.first + row], "at": _pack(lo - offsets[row] + base, back, count)}

    return lambda batches: _grouped(parts(batches), ["row", "at"])


def _unit_bytes(length: int):
    """(row, bucket, at, bytes) of the wanted units of each joined document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = memoryview(text.as_buffer())
                for u in wanted.as_py():
                    lo, count = u["at"] >> 24, u["at"] & 4095
                    for col, x in zip(out, (row, u["bucket"], u["at"], raw[lo : lo + count + length - 1])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array([bytes(x) for x in out[3]], pa.binary())], ["row", "bucket", "at", "bytes"])

    return run


def _refine(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members of groups of two or more under (group, key), their new dense group)."""
    order = np.lexsort((key, group))
    first = X.runs(group[order], key[order])
    size = np.diff(np.append(first, len(order)))
    ids = np.repeat(np.arange(len(first)), size)
    many = np.repeat(size > 1, size)
    return order[many], ids[many]


def repeated_suffixes(data: np.ndarray, offsets: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """For each position of ``data`` (units back to back): does its ``length``-byte string occur at another
    suffix of the same bucket?  Positions whose string would leave their unit are false."""
    v = length // 5
    flagged = np.zeros(len(data), bool)
    sizes = np.maximum(0, np.diff(offsets) - length + 1)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    p = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[unit]
    word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for half in (1, 2, 4):  # big-endian words of 8 bytes at every position
        word = (word[:-half] << np.uint64(8 * half)) | word[half:]
    group = bucket[unit]
    for at in [*range(0, v, 8), *range(length - v, length, 8)]:  # first and last v bytes
        keep, group = _refine(group, word[p + at])
        p = p[keep]
    if not len(p):
        return flagged
    cover = difference_cover(v)
    member = np.zeros(v, bool)
    member[cover] = True
    position = np.arange(len(data))
    sample = position[member[position % v]]
    rank = np.zeros(len(data) + 4 * v, np.int64)
    keys = [word[np.minimum(sample + at, len(word) - 1)] for at in range(v - 8, -1, -8)]
    order = np.lexsort(keys)
    new = np.zeros(len(sample), np.int64)
    new[X.runs(*(k[order] for k in keys))] = 1
    rank[sample[order]] = np.cumsum(new)
    for step in (v, 2 * v):  # 2v, then 4v bytes
        a, b = rank[sample], rank[sample + step]
        order = np.lexsort((b, a))
        new = np.zeros(len(sample), np.int64)
        new[X.runs(a[order], b[order])] = 1
        rank[sample[order]] = np.cumsum(new)
    for d in range(v):
        tied = np.flatnonzero(member[(p + d) % v])
        keep, _ = _refine(group[tied], rank[p[tied] + d])
        flagged[p[tied[keep]]] = True
    return flagged


def _sort_blocks(length: int):
    """(bucket, window, row, start, twice) of each suffix: whether its string stands twice in its sorted block."""

    def solve(block: pa.Table) -> pa.RecordBatch:
        chunk = next(X.chunks(block.column("bytes").combine_chunks(), 1 << 40))
        buckets = block.column("bucket").to_numpy()
        _, bucket = np.unique(buckets, return_inverse=True)
        hits = repeated_suffixes(chunk.data, chunk.offsets, bucket, length)
        n = np.diff(chunk.offsets) - length + 1
        cell = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
        p = chunk.offsets[cell] + inner
        window = X.span_hash(X.prefix_hash(chunk.data), p, p + length)
        row, start = (block.column(k).to_numpy() for k in ("row", "start"))
        cols = [buckets[cell], window.view(np.int64), row[cell], start[cell] + inner, hits[p]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "window", "row", "start", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= BLOCK:
                yield solve(held.slice(0, BLOCK))
                held = held.slice(BLOCK).combine_chunks()
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _cells(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(unit, cell, nearest and farthest distance to the anchor) of the cells of some units."""
    _, back, count = _unpack(at)
    low, high = (back - count + 1) // CELL, back // CELL
    n = high - low + 1
    unit = np.repeat(np.arange(len(at)), n)
    c = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n) + low[unit]
    return unit, c, np.maximum(c * CELL, (back - count + 1)[unit]), np.minimum(c * CELL + CELL - 1, back[unit])


def _cell_rows(length: int):
    """Grouped cells of (row, bucket, at, bytes) batches; places: row, at, cell, start, size.

    A cell holds the suffixes whose distance to the anchor is in ``[CELL * c, CELL * (c + 1))``.  Its bucket is
    the hash of the bytes that all its suffixes' strings share; its class that of all its bytes."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for chunk in X.chunks(batch.column(3)):
                rows, buckets, at = (batch.column(k).to_numpy()[chunk.first : chunk.first + chunk.rows] for k in range(3))
                lo, back, _ = _unpack(at)
                unit, c, near, far = _cells(at)
                anchor = chunk.offsets[unit] + back[unit]
                prefix = X.prefix_hash(chunk.data)
                with np.errstate(over="ignore"):
                    shared = X.mix(X.span_hash(prefix, anchor - c * CELL, anchor - c * CELL - CELL + 1 + length) + c.astype(np.uint64) + buckets[unit].view(np.uint64))
                    whole = X.mix(X.span_hash(prefix, anchor - far, anchor - near + length) * np.uint64(0x9FB21C651E98DF25) + (far * 4096 + near).astype(np.uint64))
                yield {"bucket": shared, "cls": whole, "row": rows[unit], "at": at[unit], "cell": c, "start": lo[unit] + back[unit] - far, "size": far - near + length}

    return lambda batches: _grouped(parts(batches), ["row", "at", "cell", "start", "size"])


def _cell_bytes():
    """(bucket, row, start, bytes) of the open cells of (row, bytes, cells) batches; cells: bucket, start in the unit and in the text, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row, raw, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for c in cells:
                    for col, x in zip(out, (c["bucket"], row, c["start"], raw[c["inner"] : c["inner"] + c["size"]])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["bucket", "row", "start", "bytes"])

    return run


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(places of classes that occur twice, one place of each class of the buckets that stay open, with its bucket).

    ``rows`` has bucket, cls and places; a bucket of one class is settled, and so is one whose classes all
    repeat.  Rows are grouped before they are shuffled, counts combine map-side, and sides that can be hot are
    read as tables, so that their joins can be split."""
    n = F.sum(F.size("places")).alias("n")
    shared = stage(rows.groupBy("bucket").agg(n).where("n > 1").select("bucket"), f"{name}-buckets")
    rows = stage(rows.join(shared, "bucket"), f"{name}-rows")
    classes = stage(rows.groupBy("bucket", "cls").agg(n, F.min(F.element_at("places", 1)).alias("rep")), f"{name}-classes")
    whole = rows.join(classes.where("n > 1").select("bucket", "cls"), ["bucket", "cls"]).select(F.explode("places").alias("p")).select("p.*")
    mixed = classes.groupBy("bucket").agg(F.count("*").alias("distinct"), F.min("n").alias("least")).where("distinct > 1 and least = 1")
    mixed = stage(mixed.select("bucket"), f"{name}-mixed", free=False)
    return whole, classes.join(mixed, "bucket").select("bucket", "rep.*")


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """(row, start, size) byte spans, overlapping or not, that cover exactly the repeated strings of (row, text)."""
    if length % 40:
        raise ValueError("length must be a multiple of 40")
    tune(texts.sparkSession)
    texts = texts.where(F.octet_length("text") >= length).select("row", "text")
    units = texts.mapInArrow(_unit_rows(length), "bucket long, cls long, places array<struct<row: long, at: long>>")
    whole, reps = _settle(units, "suffix-units")
    found = whole.select("row", F.shiftright("at", 24).alias("start"), (F.col("at").bitwiseAND(4095) + (length - 1)).alias("size"))
    wanted = reps.groupBy("row").agg(F.collect_list(F.struct("bucket", "at")).alias("wanted"))
    edges = stage(texts.join(wanted, "row").select("row", "text", "wanted").mapInArrow(_unit_bytes(length), "row long, bucket long, at long, bytes binary"), "suffix-edges")
    cells = edges.mapInArrow(_cell_rows(length), "bucket long, cls long, places array<struct<row: long, at: long, cell: long, start: long, size: long>>")
    whole, reps = _settle(cells, "suffix-cells")
    found = found.unionByName(whole.select("row", "start", "size"))
    inner = (F.col("start") - F.shiftright("at", 24)).alias("inner")
    reps = reps.groupBy("row", "at").agg(F.collect_list(F.struct("bucket", inner, "start", "size")).alias("cells"))  # a dozen of a unit at most
    cells = edges.join(reps, ["row", "at"]).select("row", "bytes", "cells").mapInArrow(_cell_bytes(), "bucket long, row long, start long, bytes binary")
    blocks = cells.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket")
    suffixes = stage(blocks.mapInArrow(_sort_blocks(length), "bucket long, window long, row long, start long, twice boolean"), "suffix-sorted")
    across = suffixes.groupBy("bucket", "window").agg(F.count("*").alias("n"), F.bool_or(~F.col("twice")).alias("alone")).where("n > 1 and alone")
    late = suffixes.where("not twice").join(across.select("bucket", "window"), ["bucket", "window"])
    size = F.lit(length).cast("long").alias("size")
    return found.unionByName(suffixes.where("twice").select("row", "start", size)).unionByName(late.select("row", "start", size))


def _cut(n_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, pieces, at, end, removed, runs = len(raw), [], 0, 0, 0, 0
                for s in sorted((s["start"], s["start"] + s["size"]) for s in (spans.as_py() or ())):
                    start, stop = s[0], min(s[1], n)
                    if start >= stop:
                        continue
                    if start > end or not runs:
                        pieces.append(raw[end:start])
                        runs, removed, end = runs + 1, removed + stop - start, stop
                    elif stop > end:
                        removed, end = removed + stop - end, stop
                pieces.append(raw[end:])
                kept = b"".join(pieces)
                for col, x in zip(out, (n, removed, runs, hashlib.sha256(kept).hexdigest(), kept if n_kept else None)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` holds the remaining bytes, if asked for."""
    texts = numbered(docs.withColumn(text, F.col(text).cast("string")), "suffix-texts", key=key, text=text)
    spans = stage(repeated_spans(texts, length), "suffix-spans")
    by_row = spans.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()
    out = texts.join(by_row, "row", "left").select("key", "text", "spans").mapInArrow(_cut(with_bytes), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("key", key)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), 200, with_bytes=False).drop("kept")
