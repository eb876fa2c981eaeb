"""Held-out accuracy, a plain restatement of the fusion, and odd inputs."""

import numpy as np

from pyspark.sql import functions as F

from graphloom.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.where("doc_id % 3 <> 0"))
    held = docs.where("doc_id % 3 = 0")
    got = {r.id: r.lang for r in L.identify(L.document_records(held), model).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert np.mean([got[i] == want[i] for i in want]) > 0.95
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = L.identify(L.page_records(pages), model).collect()
    assert np.mean([r.lang == r.declared for r in out]) > 0.9


def brute(rows, k):
    """rows: (host, domain, suffix, declared index or None, ll)."""
    p = []
    for *_, ll in rows:
        e = np.exp(np.array(ll) - max(ll))
        p.append(e / e.sum())
    p = np.array(p)
    world = p.sum(0)
    out = []
    for i, (host, domain, suffix, declared, ll) in enumerate(rows):
        q = (world + 1) / (world.sum() + k)
        for level, mine in ((2, suffix), (1, domain), (0, host)):
            if mine is not None:
                c = np.maximum(sum(p[j] for j in range(len(rows)) if rows[j][level] == mine) - p[i], 0) + L.SHRINK * q
                q = c / c.sum()
        s = np.array(ll) + np.log(q)
        if declared is not None:
            table = {d: sum(p[j] for j in range(len(rows)) if rows[j][3] == d) for d in {r[3] for r in rows if r[3] is not None}}
            s += np.log((table[declared] + L.DECLARED_SMOOTH) / (sum(table.values()) + L.DECLARED_SMOOTH * k))
        e = np.exp(s - s.max())
        out.append((int(s.argmax()), float((e / e.sum()).max())))
    return out


def test_fusion(spark):
    r = np.random.default_rng(1)
    langs = ["aa", "bb", "cc"]
    rows = [(*[(None, None, None), ("h1.x.de", "x.de", "de"), ("h2.x.de", "x.de", "de"), ("y.fr", "y.fr", "fr")][r.integers(4)], [None, 0, 1, 2][r.integers(4)], r.normal(0, 2, 3).tolist()) for _ in range(60)]
    df = spark.createDataFrame([(i, h, d, s, langs[x] if x is not None else None, ll) for i, (h, d, s, x, ll) in enumerate(rows)], "id long, host string, domain string, suffix string, declared string, ll array<double>")
    got = {x.id: (langs.index(x.lang), x.posterior) for x in L.fuse(df, langs).collect()}
    want = brute(rows, 3)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-5 for i in range(60))


def test_odd(spark, docs, texts, nothing):
    model = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert L.identify(L.document_records(docs), model).count() == len(texts)
    assert L.identify(L.document_records(nothing), model).count() == 0
    assert L.fit(nothing)[0] == ["und"]
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "nonsense", "<html>no lang</html>", "x"), (3, "https://u@a.example.de:80/x", "<HTML class='q' LANG='de'><body>der die das", "y"), (3, "https://u@a.example.de:80/x", "", "y")], "page_id long, url string, html string, lang string")
    got = L.page_records(pages).collect()
    assert (got[2].host, got[2].domain, got[2].suffix, got[2].declared) == ("a.example.de", "example.de", "de", "de")
    assert L.identify(L.page_records(pages), model).count() == 4
