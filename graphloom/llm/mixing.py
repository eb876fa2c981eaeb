"""Mixing to target weights with soft membership.  DataFrame functions only.

1. *Classifier.*  The labels table names a domain for some documents (quality and toxicity together: four
   domains).  A multinomial naive Bayes over hashed words is counted from at most ``TRAIN_ROWS`` labelled
   documents (smallest key hash, a documented bound); its table has ``BUCKETS`` rows, so it may be broadcast.
2. *Posteriors.*  Every word of every document looks up its log likelihoods; the mean over a document counts as
   at most ``WORDS`` independent words, which keeps memberships soft.  Sums combine map-side per document.
3. *Rates.*  With tokens t_i (words) and posteriors p_id, document rates r_i >= 0 shall give
   sum_i r_i t_i p_id = target_d.  Weighted least squares by projected gradient, in the metric 1 / t_i and
   weighted by the inverse of the domains' Gram matrix, which makes the unconstrained problem a single step:
   r_i <- max(0, r_i + sum_d p_id m_d), m = s G^-1 (target - achieved), with backtracking on the step size s.
   One aggregate per step brings D + D * D numbers to the driver; all documents take part in each step.

Targets are shares of the budget (default: all tokens), or follow from the labels if none are given: the share
of good clean documents is raised to ``GOOD_SHARE`` and the rest share what is left in proportion.

Defined cases: null and empty texts have no tokens, the prior as posterior, and rate 1 before the steps; domains
without a labelled document cannot be told apart and get no target; without any label every rate is 1; rows that
share a key, or have none, are one document with all their words; documents that tie have equal rates; a very long text is summed
word by word, as others are; a target that no nonnegative rates can meet gives the nearest totals and a warning; extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import os
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._session import stage

#: Bounds of the classifier: labelled rows, and word buckets.
TRAIN_ROWS, BUCKETS = 4000, 1 << 13
WORDS, SMOOTH, GOOD_SHARE = 30, 0.5, 0.9
#: Tokens by which totals may miss (as a share), the gain of a step
#: under which it stalls and how often, steps between tables, and the share of all tokens that is reported as missed.
TOLERANCE, GAIN, STALLS, NEST, MISSED = 1e-7, 1e-3, 8, 4, 1e-3
DOMAINS = ["bad_clean", "bad_toxic", "good_clean", "good_toxic"]


def words(text: Column) -> Column:
    """Lower-cased pieces between white space; the empty ones are no words, and there is always a piece."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[ \t\n\x0B\f\r]+")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def label_domains(labels: DataFrame, key: str) -> DataFrame:
    """(k, d): the domain's index from quality and toxicity; rows with a null in either are left out."""
    d = F.col("quality").cast("int") * 2 + F.col("toxic").cast("int")
    return labels.select(F.col(key).alias("k"), d.alias("d")).where(F.col("k").isNotNull() & F.col("d").between(0, 3))


def train(docs: DataFrame, domains: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, list[float]] | None:
    """(bucket, w0..) log likelihoods as a table of ``BUCKETS`` rows, and log priors; None without labels."""
    picked = domains.orderBy(F.xxhash64("k"), "k", "d").limit(TRAIN_ROWS)
    picked = stage(docs.select(F.col(key).alias("k"), F.col(text).alias("x")).join(F.broadcast(picked), "k").select("d", "x"), "mixing-labelled")
    prior = {r["d"]: r["count"] for r in picked.groupBy("d").count().collect()}
    if not prior:
        return None
    counts = picked.select("d", F.explode(words(F.col("x"))).alias("w")).where("w <> ''").groupBy(_bucket(F.col("w")).alias("bucket"), "d").count()
    wide = counts.groupBy("bucket").agg(*[F.sum(F.when(F.col("d") == i, F.col("count")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(size)])
    wide = stage(docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(wide, "bucket", "left").na.fill(0.0), "mixing-counts")
    total = wide.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(size)]).first()
    table = wide.select("bucket", *[(F.log(F.col(f"c{i}") + SMOOTH) - F.lit(float(np.log(total[i] + SMOOTH * BUCKETS)))).alias(f"w{i}") for i in range(size)])
    n = sum(prior.values())
    return table, [float(np.log(prior[i] / n)) if i in prior else -np.inf for i in range(size)]


def posteriors(docs: DataFrame, model: tuple[DataFrame, list[float]] | None, key: str, text: str, size: int) -> DataFrame:
    """(key, tokens, p): word counts and domain posteriors of every document."""
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("x"))
    if model is None:
        return base.select("key", F.size(F.filter(words(F.col("x")), lambda w: w != "")).cast("long").alias("tokens"), F.array(*[F.lit(1.0 / size)] * size).alias("p"))
    table, prior = model
    live = [i for i in range(size) if np.isfinite(prior[i])]
    # one row per piece; empty pieces have no bucket, and keep texts without words in
    flat = base.select("key", F.explode(words(F.col("x"))).alias("w")).select("key", F.when(F.col("w") != "", _bucket(F.col("w"))).alias("bucket"))
    sums = flat.join(F.broadcast(table), "bucket", "left").groupBy("key").agg(F.count("bucket").alias("tokens"), *[F.sum(f"w{i}").alias(f"s{i}") for i in live])
    scale = F.least(F.lit(1.0), F.lit(float(WORDS)) / F.greatest("tokens", F.lit(1)))
    scores = {i: F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * scale + F.lit(prior[i]) for i in live}
    top = F.greatest(*scores.values()) if len(live) > 1 else next(iter(scores.values()))
    out = sums.withColumn("top", top).select("key", "tokens", *[F.exp(scores[i] - F.col("top")).alias(f"e{i}") for i in live])
    whole = sum((F.col(f"e{i}") for i in live), F.lit(0.0))
    return out.select("key", "tokens", F.array(*[(F.col(f"e{i}") / whole) if i in live else F.lit(0.0) for i in range(size)]).alias("p"))


def fit_rates(rows: DataFrame, target: list[float | None], size: int, steps: int | None = None) -> tuple[DataFrame, list[float]]:
    """Adds ``rate``; target: tokens per domain, None where the domain is free.  Also the achieved totals.

    A step that does not lower the weighted residual is taken back and halved.  Steps go on until the totals meet the target or
    gain nothing any more; ``steps`` may bound them.  The Gram matrix is that of the
    documents with a positive rate, so steps stay long while many rates are zero."""
    live = [i for i in range(size) if target[i] is not None]
    t, p, rate = F.col("tokens").cast("double"), F.col("p"), F.col("rate")
    sums = [F.sum(rate * t * p[i]) for i in range(size)] + [F.sum(F.when(rate > 0, t * p[i] * p[j]).otherwise(0.0)) for i in live for j in live]

    def measure(df: DataFrame) -> tuple[list[float], np.ndarray]:
        got = [float(x or 0.0) for x in df.agg(*sums).first()]
        return got[:size], np.array(got[size:]).reshape(len(live), len(live))

    rows = rows.withColumn("rate", F.lit(1.0))
    achieved, gram = measure(rows)
    if not live:
        return rows, achieved
    want = np.array([target[i] for i in live], float)
    metric = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    scale, nested, stalled = 1.0, 0, 0
    while stalled < STALLS and steps != 0:
        steps = steps and steps - 1
        gap = want - np.array([achieved[i] for i in live])
        if np.abs(gap).sum() <= TOLERANCE * max(1.0, want.sum()) or scale < 1e-6:
            break
        m = scale * np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ gap
        move = sum((p[i] * F.lit(float(m[k])) for k, i in enumerate(live)), F.lit(0.0))
        tried = rows.withColumn("rate", F.greatest(F.lit(0.0), rate + move))
        if nested >= NEST:
            tried = stage(tried, "mixing-rates", free=False)
        now, its = measure(tried)
        left = want - np.array([now[i] for i in live])
        before, after = gap @ metric @ gap, left @ metric @ left
        if after < before:
            stalled = stalled + 1 if after > (1 - GAIN) * before else 0
            rows, achieved, gram, scale = tried, now, its, min(1.0, 2 * scale)
            nested = 0 if nested >= NEST else nested + 1
        else:
            scale /= 2
    return rows, achieved


def default_target(totals: list[float], present: list[bool]) -> list[float | None]:
    """Good clean text to ``GOOD_SHARE`` of all tokens; the other domains share the rest as they are."""
    whole, good = sum(totals), DOMAINS.index("good_clean")
    rest = sum(x for i, x in enumerate(totals) if present[i] and i != good)
    if not present[good] or not rest:
        return [x if present[i] else None for i, x in enumerate(totals)]
    return [None if not present[i] else GOOD_SHARE * whole if i == good else (1 - GOOD_SHARE) * whole * x / rest for i, x in enumerate(totals)]


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, budget: float | None = None, key: str = "doc_id", text: str = "text", train_docs: DataFrame | None = None) -> DataFrame:
    """(key, tokens, rate, p_<domain>...): the nonnegative rate of each document.

    ``key`` names a document; rows that share a key share one result, counted with all their words.
    """
    size = len(DOMAINS)
    model = train(train_docs if train_docs is not None else docs, label_domains(labels, key), key, text, size)
    rows = stage(posteriors(docs, model, key, text, size), "mixing-rows")
    present = [model is not None and bool(np.isfinite(model[1][i])) for i in range(size)]
    sums = rows.agg(*[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(size)]).first()
    totals = [float(x or 0.0) for x in sums]
    if shares is None:
        target = default_target(totals, present)
    else:
        target = [None if not present[i] else shares.get(d, 0.0) * (budget or sum(totals)) for i, d in enumerate(DOMAINS)]
    rated, achieved = fit_rates(rows, target, size)
    missed = {DOMAINS[i]: (round(achieved[i]), round(t)) for i, t in enumerate(target) if t is not None and abs(achieved[i] - t) > MISSED * max(1.0, sum(totals))}
    if missed:  # the posteriors of the documents leave no nonnegative rates that would do better
        warnings.warn(f"mixing targets are not met, tokens as (achieved, target): {missed}", stacklevel=2)
    return rated.select(F.col("key").alias(key), "tokens", F.round("rate", 9).alias("rate"), *[F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(DOMAINS)])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("documents", "labels"))
    return mix(docs, labels)
