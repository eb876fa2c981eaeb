"""Language identification by Bayesian evidence fusion.

For each record (a text with, where known, a host, an address suffix and a declared markup language):

    log P(l | all) = log prior(l | host) + text(l) + log P(declared | l) + constant

* ``text``: byte 4-gram naive Bayes, trained in numpy on a bounded sample of labelled documents; the mean log
  likelihood of a text counts as at most ``TEXT_GRAMS`` independent observations, since neighbouring grams overlap.
* ``P(declared | l)``: how often pages that the text alone calls l declare each language, smoothed, from one
  grouped aggregation over all pages.
* ``prior``: soft counts of the text evidence per host, shrunk towards those of its domain, of its address
  suffix, and of the whole collection (Dirichlet smoothing, strength ``SHRINK`` at each level).  A record's
  own text is taken out of all its counts, so it is not used twice.

The counts are plain sums, so a host with a third of all records is pre-aggregated map-side.

Defined cases: a null or empty text has no text evidence and is judged by the rest; a record without host
uses the collection's prior, one without a declaration skips that term; ties go to the alphabetically first
language; repeated rows are records of their own; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text as X
from ._session import in_one_task, sampled, stage, tune

#: Bound of the labelled sample, buckets of the grams, and the model's strengths.
TRAIN_ROWS, BITS = 4000, 16
TEXT_GRAMS, SHRINK, DECLARED_SMOOTH = 40, 5.0, 1.0


def grams(chunk: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte 4-gram inside a row, bounds of the rows), letters lower-cased."""
    d = X.LOWER[chunk.data].astype(np.uint32)
    if len(d) < 4:
        return np.zeros(0, np.int64), np.zeros(chunk.rows + 1, np.int64)
    g = d[:-3] | (d[1:-2] << np.uint32(8)) | (d[2:-1] << np.uint32(16)) | (d[3:] << np.uint32(24))
    g = ((g * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    inside = np.ones(len(g), bool)
    for back in (1, 2, 3):
        cut = chunk.offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(g))]] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return g[inside], kept[np.minimum(chunk.offsets, len(g))]


def train(texts: list[str], langs: list[str], languages: list[str]) -> np.ndarray:
    """(languages, buckets) log likelihoods with add-half smoothing."""
    counts = np.full((len(languages), 1 << BITS), 0.5)
    at = {x: i for i, x in enumerate(languages)}
    for chunk in X.chunks(pa.array(texts, pa.string())):
        g, bounds = grams(chunk)
        lang = np.repeat([at[x] for x in langs[chunk.first : chunk.first + chunk.rows]], np.diff(bounds)).astype(np.int64)
        counts += np.bincount(lang * (1 << BITS) + g, minlength=counts.size).reshape(counts.shape)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(records: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds ``ll``: the text log likelihood of each language, as an array of doubles; drops ``text``."""
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    others = [c for c in records.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name != "text") + ", ll array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rest = batch.select(others)
            for chunk in X.chunks(batch.column(at)):
                g, bounds = grams(chunk)
                n = np.diff(bounds)
                out = np.empty((chunk.rows, len(shared.value)))
                for k, weight in enumerate(shared.value):
                    total = np.concatenate([[0.0], np.cumsum(weight[g], dtype=np.float64)])
                    out[:, k] = (total[bounds[1:]] - total[bounds[:-1]]) * np.minimum(1, TEXT_GRAMS / np.maximum(1, n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(chunk.rows + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*rest.slice(chunk.first, chunk.rows).columns, lists], [*others, "ll"])

    return records.select(*others, "text").mapInArrow(run, schema)


def _softmax(scores):
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def fuse(records: DataFrame, languages: list[str]) -> DataFrame:
    """records: (..., host, domain, suffix, declared, ll).  Adds lang, posterior, text_lang."""
    k = len(languages)
    base = stage(records.withColumn("p", _softmax(F.col("ll"))), "language-evidence")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    total = base.agg(*sums).first()
    world = [float(total[i] or 0.0) for i in range(k)]

    def level(column: str, name: str) -> DataFrame:
        return stage(base.where(F.col(column).isNotNull()).groupBy(column).agg(*sums).select(column, F.array(*[f"s{i}" for i in range(k)]).alias(name)), f"language-{column}")

    # declared language given the text's: (declared value, language) soft counts, a bounded table
    seen = base.where(F.col("declared").isNotNull() & F.col("declared").isin(languages)).groupBy("declared").agg(*sums).collect()
    table = {r["declared"]: [float(r[f"s{i}"]) for i in range(k)] for r in seen}
    cols = [sum(v[i] for v in table.values()) for i in range(k)]
    chance = {d: [(v[i] + DECLARED_SMOOTH) / (cols[i] + DECLARED_SMOOTH * k) for i in range(k)] for d, v in table.items()}

    own = base
    for column, name in (("suffix", "n_suffix"), ("domain", "n_domain"), ("host", "n_host")):
        own = own.join(level(column, name), column, "left")

    def shrunk(counts, parent):
        """Counts without the record itself, shrunk towards the parent distribution."""
        less = F.transform(F.arrays_zip(counts.alias("c"), F.col("p").alias("p"), parent.alias("q")), lambda x: F.greatest(x["c"] - x["p"], F.lit(0.0)) + SHRINK * x["q"])
        sum_ = F.aggregate(less, F.lit(0.0), lambda a, x: a + x)
        return F.when(counts.isNull(), parent).otherwise(F.transform(less, lambda x: x / sum_))

    w = sum(world)
    out = own.withColumn("q", F.array(*[F.lit((world[i] + 1.0) / (w + k)) for i in range(k)]))
    for name in ("n_suffix", "n_domain", "n_host"):
        out = out.withColumn("q", shrunk(F.col(name), F.col("q")))
    said = F.lit(None).cast("array<double>")
    for d, v in chance.items():
        said = F.when(F.col("declared") == d, F.array(*[F.lit(float(np.log(x))) for x in v])).otherwise(said)
    out = out.withColumn("said", F.coalesce(said, F.array(*[F.lit(0.0)] * k)))
    out = out.withColumn("score", F.transform(F.arrays_zip("ll", "q", "said"), lambda x: x["ll"] + F.log(x["q"]) + x["said"])).withColumn("post", _softmax(F.col("score")))
    names = F.array(*[F.lit(x) for x in languages])

    def best(c):
        return F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))

    return out.withColumn("lang", best(F.col("post"))).withColumn("posterior", F.round(F.array_max("post"), 6)).withColumn("text_lang", best(F.col("p"))).drop("ll", "p", "n_suffix", "n_domain", "n_host", "q", "said", "score", "post")


def page_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Visible text, host, registered domain, address suffix and declared language of raw pages."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    declared = F.lower(F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1), F.lit("")))
    return pages.select(F.col(key).alias("id"), text.alias("text"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), declared.alias("declared"))


def document_records(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents as records; their source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"))


def fit(docs: DataFrame, key: str = "doc_id", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and gram weights from at most ``TRAIN_ROWS`` labelled documents, whole, those of the smallest key hash."""
    known = docs.select(F.col(key).alias("k"), F.col(label).cast("string").alias("y")).where(F.col("y").isNotNull())

    def work(found: list[dict]) -> tuple[list[str], np.ndarray]:
        languages = sorted({r["y"] for r in found}) or ["und"]
        return languages, train([r["t"] or "" for r in found], [r["y"] for r in found], languages)

    return in_one_task(sampled(docs, known, TRAIN_ROWS, key=key), work)


def identify(records: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    tune(records.sparkSession)
    return fuse(text_evidence(records, model[1]), model[0])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document: doc_id or page_id, lang, posterior, text_lang, declared, host."""
    docs, pages = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("documents", "pages"))
    records = document_records(docs).withColumn("kind", F.lit("document")).unionByName(page_records(pages).withColumn("kind", F.lit("page")))
    out = identify(records, fit(docs))
    is_doc = F.col("kind") == "document"
    return out.select(F.when(is_doc, F.col("id")).alias("doc_id"), F.when(~is_doc, F.col("id")).alias("page_id"), "lang", "posterior", "text_lang", "declared", "host")
