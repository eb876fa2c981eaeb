"""The pipeline against its stages restated plainly, and on odd inputs."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from graphloom.llm import toxicity

from . import test_decontaminate, test_ngram_join, test_pii


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """A small folder of tables: the small documents and the odd ones, one of them twice."""
    top = str(tmp_path_factory.mktemp("sf"))
    base = docs.select("doc_id", "text", "lang", "source", docs.n_chars.cast("long").alias("n_chars"))
    base.unionByName(base.where("doc_id % 50 = 0")).write.parquet(os.path.join(top, "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(os.path.join(top, f"{t}.parquet"))
    return top


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(seen[name]) or name == "toxicity"
        assert docs.columns == columns if i < 4 else set(columns) < set(docs.columns)
    start = {r.doc_id: r.text for r in spark.read.parquet(os.path.join(folder, "documents.parquet")).collect()}
    model = toxicity.fit(spark.read.parquet(os.path.join(folder, "documents.parquet")), spark.read.parquet(os.path.join(folder, "labels.parquet")))
    bad = {r.doc_id for r in toxicity.toxicity(spark.read.parquet(os.path.join(folder, "documents.parquet")), model).where("predicted = 1").collect()}
    want = {i: t for i, t in start.items() if i not in bad}
    assert seen["toxicity"] == want
    docs0 = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs0, model).collect()}
    middle = sorted(scores.values())[len(scores) // 2]  # few labels here, so that the stage may reject none; half the scores do
    assert {r.doc_id for r in toxicity.without_toxic(docs0, model, threshold=middle).collect()} == {i for i, x in scores.items() if x < middle}
    root = test_ngram_join.brute(want, 5, 80)
    want = {i: t for i, t in want.items() if root[i][1] == i}
    assert seen["ngram_jaccard"] == want
    items = {x.item_id: x.text for x in spark.read.parquet(os.path.join(folder, "benchmark.parquet")).collect()}
    leaks = {i for i, _ in test_decontaminate.brute(want, items)}
    want = {i: t for i, t in want.items() if i not in leaks}
    assert seen["decontamination"] == want and leaks
    for i, t in seen["pii"].items():
        left = want[i]
        if test_pii.base(left):
            assert t != left and not [x for x in test_pii.base(t) if x[2] in ("email", "phone")]
        elif not re.search("[0-9@]", left or ""):
            assert t == left
    assert seen["pii"].keys() == want.keys()
    assert seen["mixing"].keys() <= want.keys() and all(r.rate > 0 for r in docs.collect())


def test_run_and_empty(spark, folder, tmp_path):
    assert P.run(spark, folder).count() > 50
    top = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(os.path.join(folder, f"{t}.parquet")).limit(0).write.parquet(os.path.join(top, f"{t}.parquet"))
    assert P.run(spark, top).count() == 0


def test_documents_without_ids(spark, folder):
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    extra = spark.createDataFrame([(None, "some calm words about a@b.com and rivers"), (None, "plain words about the hills and rivers")], "doc_id long, text string")
    extra = extra.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars").select(*docs.columns)
    docs = docs.unionByName(extra)
    hidden = {r.text for r in P.redacted(spark, docs, folder).where("doc_id is null").collect()}
    assert hidden == {"some calm words about [email] and rivers", "plain words about the hills and rivers"}
    rates = {r.doc_id: r.rate for r in P.mixing.mix(docs, spark.read.parquet(os.path.join(folder, "labels.parquet"))).collect()}
    left = [r for r in P.mixed(spark, docs, folder).collect() if r.doc_id is None]
    assert rates[None] > 0 and [r.rate for r in left] == [rates[None]] * 2


def test_clashing_columns_and_shared_ids(spark, folder):
    """Documents that bring columns of the names that stages use, ids that several texts share, and no ids at all."""
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet")).where("doc_id < 60")
    clash = {c: F.lit(i) for i, c in enumerate(["rate", "tokens", "p_good_clean", "_k", "_f", "row", "key", "cls", "root", "text_md5", "found", "doc", "at"])}
    extra = spark.createDataFrame([(1, "some other calm words that share an id with one more text"), (None, "mail me at a@b.com about the river and the hills today")], "doc_id long, text string")
    docs = docs.unionByName(extra.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")).select("*", *[v.alias(k) for k, v in clash.items()])
    before = docs.count()
    for name, stage in P.STAGES[1:4]:
        docs = P.stage(stage(spark, docs, folder), f"t-{name}")
        assert docs.columns[-len(clash) :] == list(clash)
    texts = [r.text for r in docs.where("doc_id = 1 or doc_id is null").collect()]
    assert "some other calm words that share an id with one more text" in texts and "mail me at [email] about the river and the hills today" in texts
    out = P.mixed(spark, docs, folder)
    rows = out.collect()
    assert len(rows) <= before and len(set(out.columns)) == len(out.columns) and all(r.rate > 0 and r._k == 3 for r in rows)
