"""Decontamination against every window and every item, done plainly; the Hamming index against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from graphloom.llm import _text as X
from graphloom.llm import decontaminate as D


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def words(t):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    out = {}
    for i, t in texts.items():
        w = words(t)
        for j, x in items.items():
            v = words(x)
            n, b = min(len(v), len(w)), bag(v)
            if not n or (len(v) >= 5 > len(w)):
                continue
            for p in range(len(w) - n + 1):
                a = bag(w[p : p + n])
                common = sum((a & b).values())
                if (s := common / (sum(a.values()) + sum(b.values()) - common)) >= 0.8:
                    out[i, j] = max(out.get((i, j), 0), s)
    return out


def test_made(spark):
    r = random.Random(2)
    items = {k: " ".join(f"w{r.randrange(60)}" for _ in range(r.choice([2, 5, 8, 20, 40]))) for k in range(25)} | {30: None, 31: "", 32: "!!", 33: "w1 " * 12}
    texts = {}
    for i in range(150):
        w = [f"w{r.randrange(60)}" for _ in range(r.randrange(80))]
        if r.random() < 0.6:
            v = words(items[r.randrange(25)])
            if len(v) > 12 and r.random() < 0.5:
                v[r.randrange(len(v))] = "edit"
            k = r.randrange(len(w) + 1)
            w[k:k] = v
        texts[i] = "; ".join(w).title()
    texts |= {200: None, 201: "", 202: "W1 w1," * 20}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items.items()], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): x.similarity for x in D.contamination(docs, bench).collect()}
    want = brute(texts, items)
    exact = {k for k, s in want.items() if s == 1}
    assert exact <= set(got) <= set(want) and all(abs(got[k] - want[k]) < 0.2 for k in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 60
    assert D.contamination(docs.limit(0), bench).count() == 0 and D.contamination(docs, bench.limit(0)).count() == 0


def test_documents(spark, docs, texts):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(x.doc_id, x.item_id) for x in D.contamination(docs, bench).collect()}
    assert got == set(brute(texts, {x.item_id: x.text for x in bench.collect()}))


def test_blocks_of_items(spark, docs, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, D.contamination(docs, bench).collect()))
    monkeypatch.setattr(D, "ITEM_BYTES", 2000)
    assert sorted(map(tuple, D.contamination(docs, bench).collect())) == want


def test_hamming_guarantee():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for k in range(300):
        for bit in r.choice(64, r.integers(0, 26), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    q, s = D.Hamming(a).query(b)
    near = np.bitwise_count(b[:, None] ^ a[None, :]) <= D.RADIUS
    assert set(zip(q.tolist(), s.tolist())) == set(zip(*map(lambda x: x.tolist(), np.nonzero(near))))


def scanned(texts, items, threshold=0.8):
    """(text, item): (similarity, first word) by the operator's scan, without Spark."""
    index, out = D.ItemIndex(list(items), list(items.values())), {}
    keys = list(texts)
    for chunk in X.chunks(pa.array(list(texts.values()), pa.string())):
        for r, i, first, _, x in D.scan(chunk, index, threshold):
            out[keys[chunk.first + r], index.ids[i]] = (x, first)
    return out


def test_recall_by_item_length():
    """Edited copies among other words: best windows are those of the plain search, for items of every length."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(5000)}"
    for length in (5, 8, 15, 20, 26, 40, 60, 120, 300):
        items = {j: " ".join(word() for _ in range(length)) for j in range(30)}
        texts = {}
        for i in range(90):
            v = items[i % 30].split()
            for _ in range(r.choice([0, 0, 1 + length // 60])):
                v[r.randrange(length)] = word()
            texts[i] = " ".join([word() for _ in range(r.randrange(30))] + v + [word() for _ in range(r.randrange(30))])
        want, got = brute(texts, items), scanned(texts, items)
        assert len(want) > 45 and set(got) <= set(want)
        right = sum(k in got and abs(got[k][0] - s) < 1e-9 for k, s in want.items())
        assert right >= 0.99 * len(want), (length, right, len(want))


def test_every_window_is_looked_up(monkeypatch):
    """The fingerprints that reach the index are those of all windows of all texts, over block ends too."""
    monkeypatch.setattr(D, "BLOCK", 16)
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(9)}" for _ in range(n)) for n in (3, 12, 40, 11, 70)]
    index = D.ItemIndex([1, 2], [" ".join(texts[4].split()[7:19]), " ".join(texts[2].split()[:9])])
    chunk = next(X.chunks(pa.array(texts)))
    w = X.words(chunk, D.GAP)
    s, row, _ = X.shingles(X.word_hashes(chunk, w), w, 5)
    seen = {g.size: [] for g in index.groups}
    for g in index.groups:
        monkeypatch.setattr(g.near, "query", lambda p, own=seen[g.size]: (own.extend(p.tolist()), (np.zeros(0, np.int64),) * 2)[1])
    assert not list(D._windows(s, row, index.groups, 0.8))
    for size, prints in seen.items():
        starts = np.arange(len(s) - size + 1)
        assert prints == D.fingerprints(s, starts, np.full(len(starts), size)).tolist()


def test_odd_rows_and_keys(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("a", item), ("a", item), (None, "alpha beta")], "item_id string, text string")
    rows = [(1, f"x {item} y"), (1, "nothing"), (1, f"x {item} y"), (None, f"{item}."), (2, None), (3, "z " * 700_000 + item)]
    df = spark.createDataFrame([(k, t, "a", 0.5) for k, t in rows], "doc_id long, text string, item string, similarity double").repartition(3)
    got = sorted((x.doc_id or 0, x.item_id, x.first_word, x.n_words, x.similarity) for x in D.contamination(df, bench).collect())
    assert got == sorted([(1, "a", 1, 10, 1.0)] * 4 + [(0, "a", 0, 10, 1.0)] * 2 + [(3, "a", 700_000, 10, 1.0)] * 2)
    left = D.without_contaminated(df, bench)
    assert left.columns == df.columns and sorted((x.doc_id, x.text) for x in left.collect()) == [(1, "nothing"), (2, None)]
