"""Toxicity: gradients against differences, windows, held-out figures, odd inputs."""

import zlib

import numpy as np
import pyarrow as pa

from graphloom.llm import _text as X
from graphloom.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_gradients():
    texts = ["you are a fool and a clown today", "a calm day " * 20, "fool"]
    v, idx, row = T._merge(texts)
    p = {k: a.astype(np.float64) if k != "known" else a for k, a in T._init(np.sort(v.word)[:5]).items()}
    old, T._F = T._F, np.float64
    try:
        own = T.embedding_rows(p["known"], v.word)
        weights = np.linspace(-1, 1, len(idx))

        def loss(x):
            return float(T.forward(p, {s: T._gates(p, x, s) for s in "fb"}, idx) @ weights)

        x = T.inputs(p, v, own)
        keep = {}
        T.forward(p, {s: T._gates(p, x, s) for s in "fb"}, idx, keep)
        g = T.backward(p, x, idx, keep, weights)
        r = np.random.default_rng(0)
        for name in ("o", "q", "v", "A", "a", "Uf", "Ub", "Wf", "Wb", "cf", "cb", "x"):
            a = x if name == "x" else p[name]
            for _ in range(4):
                at = tuple(r.integers(n) for n in a.shape)
                e = 1e-5
                a[at] += e
                up = loss(x)
                a[at] -= 2 * e
                down = loss(x)
                a[at] += e
                assert abs((up - down) / (2 * e) - g[name][at]) < 1e-5 * max(1, abs(g[name][at])), name
    finally:
        T._F = old


def test_windows():
    first, row = T.windows(np.array([0, 0, 5, 5 + 32, 37 + 33, 70 + 200]))
    assert row.tolist() == [1, 2, 3, 3] + [4] * 8 and first[:4].tolist() == [0, 5, 37, 61]
    for n in range(1, 200):
        f, _ = T.windows(np.array([0, n]))
        assert set(range(n)) == {x for s in f for x in range(s, min(n, s + T.LENGTH))}


def test_scores_do_not_depend_on_chunks():
    texts = ["some words, here and there " * k for k in range(40)] + ["", "x"]
    v, idx, row = T._merge(texts)
    m = T.ToxicityModel(T._init(np.sort(v.word)[:3]))
    whole = m.scores(next(X.chunks(pa.array(texts))))
    parts = np.concatenate([m.scores(c) for c in X.chunks(pa.array(texts), 100)])
    assert np.allclose(whole, parts, atol=1e-5)


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.fit(docs, labels)
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    got = {r.doc_id: r for r in T.toxicity(docs.join(labels.select("doc_id"), "doc_id"), model).collect()}
    hit = sum(got[i].predicted for i in y if y[i] == 1) / sum(y.values())
    false = sum(got[i].predicted for i in y if y[i] == 0) / sum(v == 0 for v in y.values())
    assert hit > 0.85 and false < 0.08
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_odd(spark, docs, texts, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.toxicity(docs, model).collect()}
    assert got.keys() == texts.keys() and all(0 <= s <= 1 for s in got.values())
    assert T.toxicity(nothing, model).count() == 0
    assert not T.fit(docs, labels.limit(0)).params and not T.fit(docs, labels.where("toxic = 0")).params


def test_training_reads_whole_texts(spark, monkeypatch):
    plain, late = "calm words of a day " * 400, "calm words of a day " * 2000 + "utterfool " * 3
    v, idx, row = T._merge([plain, late])
    want = [len(T.window_index(T.vocabulary(next(X.chunks(pa.array([t])))))[0]) for t in (plain, late)]
    assert np.bincount(row).tolist() == want
    monkeypatch.setattr(T, "train", lambda texts, y: dict(zip(y.tolist(), texts)))  # in a task, so the result is what comes back
    docs = spark.createDataFrame([(0, plain), (1, late)], "doc_id long, text string")
    seen = T.fit(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"), where=lambda k: k.isNotNull())
    assert seen == {0.0: plain, 1.0: late}


def test_scale_is_fitted_on_whole_texts(monkeypatch):
    texts = [("calm words of a day " * 300 + ("utterfool " * 4 if i % 2 else "")) for i in range(20)]
    seen = {}
    monkeypatch.setattr(T, "platt", lambda top, y: (seen.update(top=top), (1.0, 0.0))[1])
    m = T.train(texts, np.arange(20) % 2, epochs=1)
    z = m.logits(next(X.chunks(pa.array(texts))))
    assert np.allclose(seen["top"], z[np.arange(20) % 5 == 4], atol=1e-5) and abs(m.floor - z.min()) < 1e-5
