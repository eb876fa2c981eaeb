"""The n-gram join against all pairs, done plainly."""

import random
import re

import pytest

from graphloom.llm import ngram_join as J


def brute(texts, n=4, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if u and 100 * s >= percent * u:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def made(seed=5):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(300)}" for _ in range(r.choice([3, 5, 12, 40, 90]))] for _ in range(14)]
    texts = {}
    for i in range(220):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            if not w:
                break
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [f"v{r.randrange(50)}"], [w[k], "extra"]])
        texts[i] = " ".join(w) if r.random() < 0.8 else "\n".join(w).upper()
    return texts | {300: None, 301: "", 302: "  "}


@pytest.mark.parametrize("small", [8, 2])
def test_made(spark, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL", small)
    texts = made()
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in texts.items()], "doc_id long, text string, cls int, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(df).collect()}
    assert got == brute(texts)


def test_documents(docs, texts, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(docs).collect()}
    assert got == brute(texts)
    assert J.ngram_components(nothing).count() == 0


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "A B C D E")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in J.ngram_components(df).collect()) == [(0, 3), (3, 3), (5, 3), (5, 3)]


def test_shared_and_missing_keys(spark):
    """Rows are texts of their own: one key with two texts, and a text without a key that links two others."""
    w = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(w), " ".join(w[3:] + ["x1", "x2", "x3"]), " ".join(w[6:] + ["x1", "x2", "x3", "x4", "x5", "x6"])
    df = spark.createDataFrame([(4, a, 0, 1), (None, b, 0, 1), (2, c, 0, 1), (7, "other words of no kin at all", 0, 1), (7, a, 0, 1), (9, None, 0, 1), (9, "", 0, 1)], "doc_id long, text string, row int, key int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in J.ngram_components(df).collect())
    assert got == [(0, 57, 2), (2, 57, 2), (4, 57, 2), (7, 4, 7), (7, 57, 2), (9, 0, 9), (9, 0, 9)]
    left = sorted((r.doc_id, r.text or "", r.row, r.key) for r in J.without_near_copies(df, 4, 85).collect())
    assert left == [(2, c, 0, 1), (7, "other words of no kin at all", 0, 1), (9, "", 0, 1), (9, "", 0, 1)]


def test_near_families(spark):
    """Many unlinked sets around one hot passage, linked families among them: the last links are found in late turns."""
    r = random.Random(11)
    hot = [f"h{i}" for i in range(40)]
    texts = {}
    for i in range(260):
        own = [f"o{r.randrange(90)}" for _ in range(r.choice([2, 4, 6, 8, 10]))]
        k = r.randrange(len(own) + 1)
        texts[i] = " ".join(own[:k] + hot[: r.choice([36, 40])] + own[k:])
        if r.random() < 0.3:
            texts[1000 + i] = texts[i] + f" t{r.randrange(5)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(df).collect()}
    assert got == brute(texts)


def test_partial_counts_add_up(spark):
    """Segments of all fragments together are the sets, and summed counts equal the sizes of intersections."""
    texts = made(9)
    rows = J.numbered(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "t", key="doc_id", text="text")
    order = spark.sparkContext.broadcast((4, 0, *J.frequent_slots(rows.select("text"), 4, 0)))
    parts = rows.select("row", "text").mapInArrow(J._segments(order), "cls long, part int, tokens array<long>, o0 long, o1 long, o2 long, o3 long")
    found = {}
    for x in parts.collect():
        assert x.part not in found.setdefault(x.cls, {})
        found[x.cls][x.part] = set(x.tokens)
    whole = {i: set().union(*f.values()) for i, f in found.items()}
    odd = {r.cls: tuple(r)[1:] for r in parts.groupBy("cls").agg(*[J.F.bit_xor(o) for o in J.ODD]).collect()}
    differ = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(odd[a], odd[b]))
    some = sorted(whole)[:60]
    assert all(differ(a, b) <= len(whole[a] ^ whole[b]) for a in some for b in some) and any(differ(a, b) > 20 for a in some for b in some)
    assert len({p for f in found.values() for p in f}) > 4
    pairs = [(a, b) for a in whole for b in whole if a > b and (a + b) % 7 == 0]
    for percent in (30, 85):
        sizes = spark.createDataFrame([(i, len(t)) for i, t in whole.items()], "cls long, n long")
        got = {tuple(x) for x in J.verified(spark.createDataFrame(pairs, "a long, b long"), parts, sizes, percent).collect()}
        assert got == {(a, b) for a, b in pairs if 100 * len(whole[a] & whole[b]) >= percent * len(whole[a] | whole[b])}
