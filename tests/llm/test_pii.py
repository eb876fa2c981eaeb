"""Base spans against Python's matcher, bootstrapping on planted contexts, redaction."""

import hashlib
import random
import re

from graphloom.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def check(df, texts):
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert [tuple(x) for x in r.base] == want, (texts[r.doc_id], r.base, want)
        assert set(want) <= {tuple(x) for x in r.found} and all(x.kind == "id" for x in r.found if tuple(x) not in want)
    return {r.doc_id: r for r in rows}


def test_documents(docs, texts, nothing):
    check(P.pii_spans(docs), texts)
    assert P.pii_spans(nothing).count() == 0


def test_odd_matches(spark):
    r = random.Random(4)
    bits = ["4111 1111 1111 1111", "a@b.com_x@y.org", "@", "a@b", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "007.1.1.1", "+1 (017) 555-7713", "+", "++4", " ", "-", "é", "\U0001f600", "5", "12", "\n", "x@y.z.w", "99999999999.1.1.1", "4111-1111--1111", "+49.30-1234 567", "%@a-.b"]
    texts = {i: "".join(r.choice(bits) for _ in range(r.randrange(25))) for i in range(400)}
    texts |= {900: "1" * 50_000, 901: "a@" + "b." * 20_000 + "c", 902: "1 " * 30_000, 903: "a" * 60_000, 904: "+" * 500, 905: "1." * 3000}
    check(P.pii_spans(spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, base int").repartition(4)), texts)


def test_bootstrap(spark):
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = {i: f'prose here access token = "{secret(i)}" and more' for i in range(8)}
    texts |= {20: 'prose here access token = "short-id-77" and more', 21: "member number: mail@example.com", 22: "member number: a@example.com", 23: "member number: b@example.com", **{40 + i: f"member number: x{i}@example.com" for i in range(4)}, 24: "é member number: ZX-990-17, ok", 25: "in the year 1999-2001 of"}
    for i in range(30, 36):
        texts[i] = f"born in the year {1900 + i}-{i}00 and so on"
    got = check(P.pii_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)), texts)
    named = {i: [texts[i][x.s : x.e] for x in r.found if x.kind == "id"] for i, r in got.items()}
    assert named[20] == ["short-id-77"] and named[3] == [secret(3)] and named[24] == ["ZX-990-17"]
    assert not any(named[i] for i in [21, 22, 23, 25, *range(30, 36)])


def test_redact(spark):
    texts = {1: "é mail a@b.com or 1.2.3.4 now", 2: None, 3: "clean", 4: "+1 (017) 555-7713"}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    out = {r.doc_id: r.text for r in P.redact(df, P.pii_spans(df)).collect()}
    assert out == {1: "é mail [email] or [ip] now", 2: None, 3: "clean", 4: "[phone]"}


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (None, "a@b.com")], "doc_id long, text string")
    assert [len(r.base) for r in P.pii_spans(df).collect()] == [1, 1, 1]


def ids(spark, texts):
    rows = P.pii_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: [texts[r.doc_id][x.s : x.e] for x in r.found if x.kind == "id"] for r in rows}


def test_context_reaches_over_candidates(spark):
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = {i: f"our accounts: AB-{1000000 + i}, {secret(i)} end" for i in range(15)}
    texts |= {20: "accounts: AB-1234567, ZX-77 and more", 21: "our accounts: AB-1234567, short1 AB-3456789"}
    texts[22] = "accounts:" + " " * 200 + "AB-7654321, q7"
    got = ids(spark, texts)
    assert got[20] == ["ZX-77"] and got[21] == ["short1"] and got[22] == ["q7"] and got[3] == [secret(3)]


def test_rounds_go_on_until_nothing_changes(spark):
    """A chain of patterns, each accepted only through the cores that the one before it found."""
    secret = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    texts, n, depth, steps = {}, 0, 4, "abcd"
    for k in range(depth):
        link = [f"link-{k}-{j}" for j in range(4)]
        back = [f"link-{k - 1}-{j}" for j in range(4)] if k else [secret(("s", j)) for j in range(4)]
        for core in [*[secret(("l", k, j)) for j in range(10)], *back, *link]:
            texts[n] = f"some link{steps[k]} code {core} end"
            n += 1
    got = ids(spark, texts)
    for k in range(depth):
        assert [i for i, t in texts.items() if f"code link-{k}-" in t and len(got[i]) != 1] == [], k


def test_rows_without_keys_are_redacted(spark):
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f"access token = {secret(i)} end" for i in range(8)] + ["access token = short-77 end", "mail a@b.com now", "clean"]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[8]), (1, texts[9])], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text) for r in P.redact(df, P.pii_spans(df)).collect())
    assert out == sorted([(0, "access token = [id] end")] * 9 + [(0, "mail [email] now"), (0, "clean"), (1, "access token = [id] end"), (1, "mail [email] now")])


def test_shared_keys_and_clashing_columns(spark):
    rows = [(1, "write to a@b.com please", "k", "f", 0), (1, "nothing to see in this other text", "k", "f", 1), (None, "mail c@d.com", "k", "f", 2), (1, None, "k", "f", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k string, _f string, text_md5 int")
    out = P.redact(df, P.pii_spans(df))
    assert out.columns == df.columns
    got = {r.text_md5: tuple(r)[:4] for r in out.collect()}
    assert got == {0: (1, "write to [email] please", "k", "f"), 1: rows[1][:4], 2: (None, "mail [email]", "k", "f"), 3: rows[3][:4]}


def test_masks_across_blocks(spark, monkeypatch):
    """Small blocks: spans at, over and beside block ends, overlapping ones, and characters of two code units."""
    monkeypatch.setattr(P, "PIECE", 7)
    monkeypatch.setattr(P, "FOLD", 3)
    r = random.Random(8)
    bits = ["a@b.co", "\U0001f600", "é ", "1.2.3.4", "x", " ", "+49 30 1234 567", "4111 1111 1111 1111", "9\n", "word 12 "]
    texts = {i: "".join(r.choice(bits) for _ in range(r.randrange(40))) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = check(P.pii_spans(df), texts)
    got = {x.doc_id: x.text for x in P.redact(df, P.pii_spans(df)).collect()}
    for i, t in texts.items():
        at, out = 0, ""
        for x in found[i].found:
            if x.s >= at:
                out += t[at : x.s] + f"[{x.kind}]"
            at = max(at, x.e)
        assert got[i] == out + t[at:]


def test_candidates_that_touch_base_spans(spark, monkeypatch):
    monkeypatch.setattr(P, "FOLD", 2)
    r = random.Random(3)
    bits = ["4111 1111 1111 1111", "a@b.com", "1.2.3.4", "+1 (017) 555-7713", "ab1", "7", "word", "x9,", "(5)", "12-3", "@"]
    texts = {i: "go " + " ".join(r.choice(bits) for _ in range(r.randrange(14))) for i in range(200)}
    rows = P.base_and_candidates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").collect()
    assert sum(len(x.candidates) for x in rows) > 500
    for x in rows:
        for c in x.candidates:
            assert c.based == any(b.s < c.e and b.e > c.s for b in x.base), (texts[x.key], c)


def test_long_text_takes_linear_time(spark):
    """200 000 tokens with digits, a tenth of them base spans, found and redacted in seconds."""
    import time

    text = " ".join(f"t{i} 1.2.3.{i % 256}" if i % 10 == 0 else f"w{i}x" for i in range(200_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.monotonic()
    out = P.redact(df, P.pii_spans(df)).first().text
    assert time.monotonic() - begin < 60
    assert out.count("[ip]") == 20_000 and not re.search(r"[0-9]\.[0-9]", out)
