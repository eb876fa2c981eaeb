"""Token counts against the library, quality counts against a plain restatement."""

import re
from collections import Counter

from graphloom.llm import quality, token_counts


def test_token_counts(docs, texts, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary())
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in texts.items()}
    got = token_counts.token_counts(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(docs, table={}).count() == len(want)  # misses only
    assert token_counts.token_counts(nothing).count() == 0


def brute(text):
    text = text or ""
    word = r"[^\x20\x09-\x0D]+"
    w = re.findall(word, text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(word, x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    again = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def test_quality(spark, docs, texts, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.quality_rules(docs, model).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {i: brute(x) for i, x in texts.items()}
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.quality_rules(nothing, model).count() == 0
    assert quality.fit(docs, labels.limit(0)).empty


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 4 != 0"))
    y = {r.doc_id: r.quality for r in labels.where("doc_id % 4 = 0").collect()}
    got = {r.doc_id: r.quality >= 0.5 for r in quality.quality_rules(docs, model).collect() if r.doc_id in y}
    assert sum(got[i] == bool(y[i]) for i in y) / len(y) > 0.9


def test_token_counts_of_odd_rows(spark, monkeypatch):
    """Shared, missing and repeated keys, clashing columns, a very long text, and a table taken from few rows."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "SAMPLE", 3)
    t = Tokenizer.from_file(token_counts.vocabulary())
    texts = ["one text", "another text <|endoftext|> tail", "one text", "no key at all", "words and more, 12345. " * 60_000, "rare zebra pre-tokens"]
    keys = [1, 1, 1, None, 2, 3]
    df = spark.createDataFrame([(k, x, 7, "n") for k, x in zip(keys, texts)], "doc_id long, text string, n_tokens int, k string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df).collect())
    assert got == sorted((k or 0, len(x), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for k, x in zip(keys, texts))
    table = token_counts.frequent_table(df, token_counts.vocabulary())
    assert table and all(n == len(t.encode(p, add_special_tokens=False).ids) for p, n in table.items())


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    texts = ["a good text of ten words or a few more than that", "a bad text of ten words or a few more than that", None, "w " * 400_000]
    df = spark.createDataFrame([(1, texts[0], 5), (1, texts[0], 5), (1, texts[1], 5), (None, texts[1], 5), (2, texts[2], 5), (3, texts[3], 5)], "doc_id long, text string, quality int")
    got = [tuple(r) for r in quality.quality_rules(df, quality.fit(df, labels)).collect()]
    assert len(got) == 6 and {r[0]: r[1:7] for r in got if r[0] == 3} == {3: brute(texts[3])}
    assert sorted(r[1:] for r in got if r[0] == 1)[0][:6] in (brute(texts[0]), brute(texts[1]))
    same = [r[1:] for r in got if r[0] in (1, None)]
    assert len(set(same)) == 2  # equal texts get equal verdicts, whatever their keys
