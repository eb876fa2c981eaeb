"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast to every task; tier two is
a cache in each Python worker, filled by encoding what the table misses.  No pre-token is ever shuffled and texts are
cut into pre-tokens once: the frequent ones are taken from a bounded sample of rows, which changes no count.

A byte-level BPE never merges across pre-tokens, so the count of a text is the sum of the counts of its
pre-tokens.  Special strings inside a text are cut out first, each as one token, as the library does by
default.  Nulls and empty texts have zero tokens; rows that repeat, share a key or lack one need no care, since rows are
independent, and neither do ties; a very long text is counted whole, its pre-tokens at once; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import importlib.util
import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._session import in_one_task, sampled, tune

#: The pre-token pattern of the byte-level family (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the broadcast table, rows it is taken from (smallest key hash), and entries of a worker's cache.
TABLE, SAMPLE, CACHE = 1 << 16, 6000, 1 << 20
#: Pre-tokens longer than this are encoded each time, not kept.
KEEP_CHARS = 64


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    found = importlib.util.find_spec("public_tokenizers")
    if found is None:
        raise FileNotFoundError("the public tokenizer files are not installed; pass a path")
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder:
    """Counts of single pre-tokens; ``counts`` is the two-tier lookup."""

    def __init__(self, path: str, table: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path))
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.table, self.cache = table, {}

    def encode(self, piece: str) -> int:
        return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def miss(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.encode(piece)
            if len(piece) <= KEEP_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the special strings in it."""
        if self.special is None or not (found := len(self.special.findall(text))):
            return self.find(text), 0
        return [p for part in self.special.split(text) for p in self.find(part)], found

    def count(self, text: str) -> int:
        pieces, n = self.pieces(text)
        get = self.table.get
        lengths = list(map(get, pieces))
        try:
            return n + sum(lengths)
        except TypeError:
            miss = self.miss
            return n + sum(k if k is not None else miss(p) for k, p in zip(lengths, pieces))


def frequent_table(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> dict[str, int]:
    """Token counts of the ``TABLE`` most frequent pre-tokens of ``SAMPLE`` rows, found and encoded in one task.

    The table decides where a count is looked up and never what it is, so a sample does: a pre-token that it lacks is
    encoded once by each worker that meets it."""

    def work(found: list[dict]) -> dict[str, int]:
        encoder, seen = _Encoder(path, {}), Counter()
        for r in found:
            seen.update(encoder.pieces(r["t"] or "")[0])
        top = sorted((k for k in seen if len(k) <= KEEP_CHARS), key=lambda k: (-seen[k], k))[:TABLE]
        return {k: encoder.encode(k) for k in top}

    return in_one_task(sampled(docs, docs.select(F.col(key).alias("k")), SAMPLE, text, key), work)


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = 1024, table: dict[str, int] | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row."""
    tune(docs.sparkSession)
    path = path or vocabulary()
    if table is None:
        table = frequent_table(docs, path, text, key)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path, shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [encoder.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(score, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), vocabulary("byte_bpe_50k.json"))
