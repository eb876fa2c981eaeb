"""Suffix deduplication against a plain count of every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import suffix_dedup as S


def brute(texts, length=200):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[p : p + length] for b in raw.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[i] = (len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def made(seed=3):
    """Random texts over a small alphabet with passages pasted at any offset, so that edges of all kinds occur."""
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    parts = [word(r.choice([150, 199, 200, 201, 230, 400, 900])) for _ in range(12)]
    texts = {i: "".join(r.choice([word(r.randrange(1, 60)), r.choice(parts), r.choice(parts)[r.randrange(40) :]]) for _ in range(r.randrange(1, 6))) for i in range(120)}
    return texts | {200: "ab" * 400, 201: "x" * 1000, 202: parts[5] + "tail", 203: None, 204: "", 205: "é" * 100}


@pytest.mark.parametrize("block", [64, 3])
def test_made(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)  # small blocks cut buckets anywhere
    monkeypatch.setattr(S, "GROUP", 50)
    texts = made()
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in texts.items()], "doc_id long, text string, key int, bucket string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df).collect()}
    assert got == brute(texts)


def test_documents(docs, texts, nothing):
    rows = S.suffix_dedup(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(texts)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    assert S.suffix_dedup(nothing).count() == 0


def test_long_text_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 700)
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh ") for _ in range(6000))
    texts = {0: long, 1: long[1000:3500] + "!", 2: "q" + long[2900:3200], 3: "short"}
    df = spark.createDataFrame([*texts.items(), (None, "new" + long[4000:4500])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in S.suffix_dedup(df).collect()}
    assert got == {0: 3000, 1: 2500, 2: 300, 3: 0, None: 500}
    twice = spark.createDataFrame([(7, "z" + long[:400]), (7, "z" + long[:400])], "doc_id long, text string")
    assert [r.n_removed for r in S.suffix_dedup(twice).collect()] == [401, 401]


def test_shared_and_missing_keys(spark):
    """Rows of one key or none are documents of their own: texts that occur once keep all their bytes."""
    r = random.Random(2)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    one, two, three = make(600), make(700), make(500)
    rows = [(1, one), (1, two), (2, two), (None, three), (None, "x" + three[:300]), (None, None), (3, "")]
    df = spark.createDataFrame([(k, t, "row") for k, t in rows], "doc_id long, text string, row string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in S.suffix_dedup(df).collect())
    assert got == sorted([(1, 600, 0, 0), (1, 700, 700, 1), (2, 700, 700, 1), (0, 500, 300, 1), (0, 301, 300, 1), (0, 0, 0, 0), (3, 0, 0, 0)])


def test_hot_passage(spark, monkeypatch):
    """A passage in every text, each time between other words: one bucket of many distinct units."""
    monkeypatch.setattr(S, "BLOCK", 40)
    r = random.Random(5)
    make = lambda n: "".join(r.choice("ab c") for _ in range(n))
    passage = "".join(r.choice("abcdefghijk lmnop") for _ in range(320))
    texts = {i: make(r.randrange(90)) + passage[r.choice([0, 0, 3]) : r.choice([320, 320, 310])] + make(r.randrange(90)) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df).collect()}
    assert got == brute(texts)


def test_very_long_text(spark):
    """A text of several chunks and segments against itself and a copy of a part."""
    r = np.random.default_rng(3)
    long = r.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, long + long[500_000:500_400]), (2, "A" + long[2_000_000:2_000_700])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.suffix_dedup(df, with_bytes=False).collect()}
    assert got == {1: (400 + 400 + 700, 3), 2: (700, 1)}


def test_cover():
    for v in (8, 16, 40):
        d = S.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) <= 12
