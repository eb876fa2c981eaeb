"""Mixing: totals match targets, rates solve the least-squares problem, held-out membership, odd inputs."""

import re

import numpy as np

from graphloom.llm import mixing as M

SF = "/root/testdata/sf0.01"


def solve(t, p, target, steps=20000):
    """Plain projected gradient on the same weighted objective, in numpy."""
    r = np.ones(len(t))
    inverse = np.linalg.pinv((p * t[:, None]).T @ p, rcond=1e-10, hermitian=True)
    for _ in range(steps):
        gap = target - (r * t) @ p
        if np.abs(gap).sum() < 1e-9 * target.sum():
            break
        r = np.maximum(0, r + p @ (inverse @ gap))
    return r


def test_totals(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = M.mix(docs, labels).toPandas()
    p = rows[[f"p_{d}" for d in M.DOMAINS]].to_numpy()
    t, r = rows.tokens.to_numpy(float), rows.rate.to_numpy()
    want = {x.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", x.text)) for x in docs.collect()}
    assert dict(zip(rows.doc_id, rows.tokens)) == want
    assert np.allclose(p.sum(1), 1, atol=1e-6) and (r >= 0).all()
    target = np.array(M.default_target(list(t @ p), [True] * 4))
    assert np.abs((r * t) @ p - target).sum() < 1e-5 * target.sum()
    assert np.allclose(r, solve(t, p, target), atol=1e-4)


def test_clipping(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.2] * 4, 300)
    t = rng.integers(0, 500, 300)
    rows = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(300)], "key long, tokens long, p array<double>").repartition(4)
    target = np.array([0.97, 0.01, 0.01, 0.01]) * t.sum()
    rated, achieved = M.fit_rates(rows, target.tolist(), 4, steps=200)
    got = np.array([x.rate for x in rated.orderBy("key").collect()])
    assert (got == 0).any() and (got >= 0).all() and np.abs(np.array(achieved) - target).sum() < 1e-3 * target.sum()
    assert np.allclose((got * t) @ p, achieved)


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = M.mix(docs, labels.where("doc_id % 4 <> 0")).toPandas().set_index("doc_id")
    y = {x.doc_id: x.quality for x in labels.where("doc_id % 4 = 0").collect()}
    good = rows.p_good_clean + rows.p_good_toxic
    right = np.mean([(good[i] > 0.5) == bool(q) for i, q in y.items()])
    assert right > max(np.mean(list(y.values())), 0.9) - 0.02


def test_odd(spark, docs, texts, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = M.mix(docs, labels).collect()
    assert {r.doc_id: r.tokens for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) for i, t in texts.items()}
    assert M.mix(nothing, labels).count() == 0
    assert {r.rate for r in M.mix(docs, labels.limit(0)).collect()} == {1.0}
    one = M.mix(docs, labels.where("quality = 1 and toxic = 0")).collect()
    assert all(r.p_good_clean == 1 for r in one)
    shares = M.mix(docs, labels, shares={"good_clean": 1.0}, budget=1000.0).collect()
    assert sum(r.rate * r.tokens * r.p_good_clean for r in shares) > 900


def test_steps_go_on_until_the_target_is_met(spark):
    """Strongly skewed targets, which take more than forty steps."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3] * 4, 2000)
    t = rng.integers(0, 500, 2000)
    rows = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(2000)], "key long, tokens long, p array<double>").repartition(4)
    for target in ([0.985, 0.005, 0.005, 0.005], [0.004, 0.49, 0.004, 0.502]):
        want = np.array(target) * t.sum()
        _, achieved = M.fit_rates(M.stage(rows, "t"), want.tolist(), 4)
        assert np.abs(np.array(achieved) - want).sum() < 1e-4 * want.sum()


def test_unmet_target_is_reported(spark):
    import pytest

    docs = spark.createDataFrame([(i, f"word{i % 2} other") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="not met"):
        M.mix(docs, labels, shares={"good_clean": 0.0, "bad_clean": 1.0})


def test_repeated_shared_and_missing_keys(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "good words here", 9, "x"), (1, "good words here", 9, "x"), (2, "bad stuff", 9, "x"), (None, "good one", 9, "x"), (None, None, 9, "x")], "doc_id long, text string, rate int, tokens string")
    got = {r.doc_id: r.tokens for r in M.mix(docs, labels).collect()}
    assert got == {1: 6, 2: 2, None: 2}
