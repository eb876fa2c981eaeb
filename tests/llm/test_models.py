"""The models restated plainly: features and logits of quality, one window of the recurrent network, base hashing."""

import math

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import _text as X
from graphloom.llm import language_id, quality
from graphloom.llm import toxicity as T

TEXTS = ["Plain words, plain WORDS and é ü", "", "one", "a b", "xyz", "\U0001f600 smile é", "long " * 400]


def one(data):
    chunk = next(X.chunks(pa.array(data)))
    return chunk, X.words(chunk)


def digest(raw):
    """Hash of one byte string on its own."""
    return X.span_hash(X.prefix_hash(np.frombuffer(raw, np.uint8)), np.array([0]), np.array([len(raw)]))[0]


def test_quality_logits():
    r = np.random.default_rng(1)
    model = quality.QualityModel(r.normal(size=(quality.FAMILIES, 1 << quality.BITS)).astype(np.float32), 0.25)
    got = model.logits(*one(TEXTS))
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    for text, z in zip(TEXTS, got):
        w = lower(text).split()
        chars = [lower(text)[i : i + 4] for i in range(len(text) - 3)]
        words = np.array([digest(x.encode()) for x in w], np.uint64)
        # a pair is hashed from the hashes of its words; a text of one word has that word as its only pair
        at = X.Words(*(np.arange(len(w)),) * 2, np.zeros(len(w), np.int64), np.array([0, len(w)]))
        pairs = X.shingles(words, at, 2)[0] if len(w) else words
        assert len(pairs) == (max(1, len(w) - 1) if w else 0)
        want = 0.25
        for k, family in enumerate((words, pairs, [digest(c.encode()) for c in chars])):
            if len(family):
                want += 8 * float(np.mean([model.weights[k][int(h) >> (64 - quality.BITS)] for h in family]))
        assert z == pytest.approx(want, abs=1e-4)


def test_pairs_depend_on_order_and_neighbours():
    chunk, w = one(["a b c", "c b a", "a b", "b c"])
    idx, bounds = quality.features(chunk, w)[1]
    rows = [idx[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert rows[0] == rows[2] + rows[3] and not set(rows[0]) & set(rows[1])


def gru(p, side, xs):
    """One direction, one word at a time, one unit at a time."""
    W, U, c, h = p[f"W{side}"], p[f"U{side}"], p[f"c{side}"], T.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))
    H, out = [0.0] * h, []
    for x in xs:
        def dot(k, M, v):
            return sum(float(v[i]) * float(M[i][k]) for i in range(len(v)))

        z = [sig(dot(k, W, x) + c[k] + dot(k, U, H)) for k in range(h)]
        r = [sig(dot(h + k, W, x) + c[h + k] + dot(h + k, U, H)) for k in range(h)]
        n = [math.tanh(dot(2 * h + k, W, x) + c[2 * h + k] + r[k] * dot(2 * h + k, U, H)) for k in range(h)]
        H = [n[k] + z[k] * (H[k] - n[k]) for k in range(h)]
        out.append(H)
    return out


def test_network_restated():
    text = "Some calm words, and a fool here. " * 3
    chunk = next(X.chunks(pa.array([text])))
    v = T.vocabulary(chunk)
    p = T._init(np.sort(v.word)[:4], seed=3)
    p["word"] = np.random.default_rng(2).normal(0, 0.3, p["word"].shape).astype(np.float32)
    p["a"] = np.linspace(-1, 1, T.ATTEND).astype(np.float32)
    p["q"] = np.array([0.3], np.float32)
    m = T.ToxicityModel(p, slope=1.3, shift=-0.2)
    # inputs: a word's own embedding, if known, plus the mean of its grams' embeddings
    known = {int(h): i + 1 for i, h in enumerate(p["known"])}
    x = [p["word"][known.get(int(h), 0)] + p["char"][v.chars[a:b]].mean(axis=0) for h, a, b in zip(v.word, v.bounds, v.bounds[1:])]
    words = [x[i] for i in v.index]
    logits = []
    for first in range(0, len(words), T.STRIDE):
        part = words[first : first + T.LENGTH]
        f, b = gru(p, "f", part), gru(p, "b", part[::-1])[::-1]
        states = [np.array(s + t) for s, t in zip(f, b)]
        score = [float(np.tanh(s @ p["A"] + p["a"]) @ p["v"]) for s in states]
        e = np.exp(np.array(score) - max(score))
        pooled = sum(w * s for w, s in zip(e / e.sum(), states))
        logits.append(float(pooled @ p["o"] + p["q"][0]))
        if first + T.LENGTH >= len(words):
            break
    top = sorted(logits)[-2:]
    want = 1 / (1 + math.exp(-(1.3 * sum(top) / len(top) - 0.2)))
    assert m.scores(chunk)[0] == pytest.approx(want, abs=1e-4)


def test_language_likelihood():
    texts, langs = ["abcd abce", "wxyz wxyy", "ABCD"], ["a", "b", "a"]
    weights = language_id.train(texts, langs, ["a", "b"])
    assert weights.shape == (2, 1 << language_id.BITS)
    bucket = lambda g: ((int.from_bytes(g.encode(), "little") * 2654435761) % (1 << 32)) >> (32 - language_id.BITS)
    count = {lang: [0.5] * (1 << language_id.BITS) for lang in "ab"}
    for t, lang in zip(texts, langs):
        for i in range(len(t) - 3):
            count[lang][bucket(t.lower()[i : i + 4])] += 1
    want = np.log(np.array([count["a"], count["b"]]) / np.sum([count["a"], count["b"]], axis=1, keepdims=True))
    assert np.allclose(weights, want, atol=1e-5)
