"""Personal data: base patterns, and identifiers found by bootstrapped contexts.  DataFrame functions only.

*Base spans* are leftmost non-overlapping matches per kind (email, ip, card, phone) with their checks, as code
point offsets.  The expressions are the contract's, written so that the JVM's matcher neither recurses nor
rescans: possessive repeats, and a look-behind where a run of one class can only match from its start.

*Bootstrapping.*  Every white-space token with a digit or an at sign is a candidate; its core is the token without outer quotes
and punctuation, its pattern the two words before it (lower case, digits as 0), other candidates included; only a
candidate that opens a text has none.  Seeds are cores that overlap
a base span or have the shape of a secret (``SECRET``).  The bipartite graph of patterns and distinct cores is
scored in rounds: a pattern's confidence is the summed confidence of its instances over their number plus one
(at least ``MIN_INSTANCES`` distinct ones), an instance's is 1 for a seed and else that of its best accepted
pattern.  Confidences only rise from round to round; the rounds end when no pattern is accepted anew and none has
gained.  Accepted patterns (confidence of ``ACCEPT`` or more) mark all their cores as spans of kind ``id``.

Counts are over distinct cores, so thousands of copies of a text weigh no more than one; all aggregates
combine map-side, and the confidence tables are written before they are joined, so a hot pattern is split.

Defined cases: null and empty texts have no spans; equal texts have equal spans, whatever their keys, for rows are
matched by the md5 of the text; repeated rows each give their row, and so do rows that share a key or have none; very
long texts cost time in proportion to their length, as arrays are gathered in blocks; extra columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ._session import stage, unstage

KINDS = ["email", "ip", "card", "phone", "id"]
_LOCAL, _PART = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_PART}++(?:\.{_PART}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Candidate tokens: white-space tokens with a digit or an at sign, found in one pass.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
#: Shape of secrets that serve as seeds beside the base spans.
SECRET = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_/+=-]{20,})$"
MIN_INSTANCES, ACCEPT, SETTLED = 3, 0.7, 1e-6
#: Items gathered at once, and code points of a block of a text that is redacted.
FOLD, PIECE = 256, 4096
_SPAN = "array<struct<m:string,s:int,e:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(items: Column, first: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A left fold that gathers arrays: ``step(state, item)`` gives the next state and an array (of SQL type ``kind``) to append.

    Blocks of ``FOLD`` items are gathered apart, so that long arrays are not copied for each item."""

    def inner(block: Column, state: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            after, more = step(a["at"], x)
            return F.struct(after.alias("at"), F.concat(a["out"], more).alias("out"))

        return F.aggregate(block, F.struct(state.alias("at"), F.array().cast(kind).alias("out")), one)

    def outer(a: Column, block: Column) -> Column:
        return let(inner(block, a["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    blocks = let(items, lambda i: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(i), F.lit(1)) - 1) / FOLD).cast("int")), lambda b: F.slice(i, b * FOLD + 1, F.lit(FOLD))))
    return F.aggregate(blocks, F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), outer, lambda a: F.flatten(a["out"]))


def located(text: Column, pattern: str) -> Column:
    """Matches as an array of (m, s, e): the text, and its start and end in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.arrays_zip(found.alias("m"), gaps.alias("g"))  # the last gap has no match

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["g"]
        e = s + F.length(x["m"])
        return e, F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))

    return folded(F.filter(pairs, lambda x: x["m"].isNotNull()), F.lit(0), _SPAN, step)


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, 1).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.when((n < 12) | (n > 19), F.lit(False)).otherwise(luhn(_digits(m)))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


_MAY = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][0-9\x20-]{10,}"), "phone": lambda t: F.contains(t, F.lit("+"))}


def base_and_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_md5, base, candidates): base spans as (s, k, kind, e), candidates as (pattern, core, s, e, seed)."""
    out = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    none = F.array().cast(_SPAN)
    cols = {kind: F.when(may(F.col("t")), located(F.col("t"), PATTERNS[kind])).otherwise(none) for kind, may in _MAY.items()}
    some = F.col("t").rlike("[0-9@]")
    tokens = F.when(some, located(F.col("t"), TOKEN)).otherwise(none)
    # every word with the two before it; those with a digit or an at sign are the tokens, in the same order
    words = F.filter(F.split(F.col("t"), r"\s+"), lambda w: w != "")
    lead = F.arrays_zip(F.concat(F.array(F.lit(""), F.lit("")), words).alias("a"), F.concat(F.array(F.lit("")), words).alias("b"), words.alias("w"))
    lead = F.transform(F.filter(lead, lambda x: x["w"].rlike("[0-9@]")), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    before = F.when(some, lead).otherwise(F.array().cast("array<string>"))
    out = out.select("key", F.md5(F.col("t").cast("binary")).alias("text_md5"), *[c.alias(k) for k, c in cols.items()], tokens.alias("tokens"), before.alias("before"))

    def spans_of(i: int, kind: str) -> Column:
        return F.transform(F.filter(F.col(kind), lambda x: _valid(kind, x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    spans = [spans_of(i, kind) for i, kind in enumerate(_MAY)]
    out = out.select("key", "text_md5", F.concat(*spans).alias("base"), F.arrays_zip("tokens", "before").alias("z"))

    def candidate(x: Column) -> Column:
        m = x["tokens"]["m"]
        lead = F.length(m) - F.length(F.regexp_replace(m, r"^[\"'`(<\[{]+", ""))
        core = F.regexp_replace(F.substring(m, lead + 1, F.length(m)), r"[\"'`)>\]},.;:!?]++$", "")
        s = x["tokens"]["s"] + lead
        e = s + F.length(core)
        pattern = F.regexp_replace(F.lower(F.trim(x["before"])), "[0-9]", "0")
        return F.struct(pattern.alias("pattern"), core.alias("core"), s.alias("s"), e.alias("e"))

    out = out.withColumn("c", F.filter(F.transform("z", candidate), lambda c: (c["core"] != "") & (c["pattern"] != "")))
    out = out.withColumn("touched", F.when(F.size("base") == 0, F.transform("c", lambda _: F.lit(False))).otherwise(_touched(F.col("base"), F.col("c"))))
    seeded = F.transform(F.arrays_zip("c", "touched"), lambda x: F.struct(*[x["c"][f].alias(f) for f in ("pattern", "core", "s", "e")], x["touched"].alias("based"), x["c"]["core"].rlike(SECRET).alias("secret")))
    return out.select("key", "text_md5", F.array_sort("base").alias("base"), seeded.alias("candidates"))


def _touched(base: Column, candidates: Column) -> Column:
    """Whether each candidate overlaps a base span: one pass over both in order of their starts, and one back."""

    def event(k: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))

    events = F.array_sort(F.concat(F.transform(base, event(0)), F.transform(candidates, event(1))))
    flag = lambda x, test: F.when(x["k"] == 1, F.array(test)).otherwise(F.array().cast("array<boolean>"))

    def ahead(end: Column, x: Column) -> tuple[Column, Column]:  # the farthest end of the base spans so far
        return F.when(x["k"] == 0, F.greatest(end, x["e"])).otherwise(end), flag(x, end > x["s"])

    def back(start: Column, x: Column) -> tuple[Column, Column]:  # the start of the next base span
        return F.when(x["k"] == 0, x["s"]).otherwise(start), flag(x, start < x["e"])

    def both(ev: Column) -> Column:
        there = folded(ev, F.lit(0), "array<boolean>", ahead)
        return F.zip_with(there, F.reverse(folded(F.reverse(ev), F.lit((1 << 31) - 1), "array<boolean>", back)), lambda x, y: x | y)

    return let(events, both)


def accepted_patterns(candidates: DataFrame) -> DataFrame:
    """(pattern, confidence) of the accepted patterns; candidates: (pattern, core, seed)."""
    edges = candidates.groupBy("pattern", "core").agg(F.max("seed").alias("seed"))
    edges = stage(edges, "pii-edges")
    enough = stage(edges.groupBy("pattern").count().where(F.col("count") >= MIN_INSTANCES).select("pattern"), "pii-patterns", free=False)
    edges = stage(edges.join(enough, "pattern"), "pii-graph", free=False)
    known = stage(edges.groupBy("core").agg(F.max(F.col("seed").cast("double")).alias("conf")), "pii-instances", free=False)
    count, total = -1, 0.0
    while True:
        scored = edges.join(known, "core").groupBy("pattern").agg((F.sum("conf") / (F.count("*") + 1)).alias("confidence"))
        seen = Observation()  # the write counts what it writes
        scored = scored.where(F.col("confidence") >= ACCEPT).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("sum"))
        patterns = stage(scored, "pii-scores", free=False)
        n, whole = seen.get["n"], seen.get["sum"]
        if n == count and whole - total <= SETTLED:
            break
        count, total = n, whole
        found = edges.join(patterns, "pattern", "left").groupBy("core").agg(F.greatest(F.max(F.col("seed").cast("double")), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("conf"))
        unstage(known)
        known = stage(found, "pii-instances", free=False)
    return patterns


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_md5, base, found): base spans and all spans of each row, as sorted arrays of (s, k, kind, e)."""
    rows = stage(base_and_candidates(docs, key, text), "pii-rows")
    flat = rows.select("text_md5", F.explode("candidates").alias("c")).select("text_md5", "c.*")
    patterns = accepted_patterns(flat.select("pattern", "core", (F.col("based") | F.col("secret")).alias("seed")))
    hits = flat.where("not based").join(patterns, "pattern").groupBy("text_md5").agg(F.collect_set(F.struct("s", F.lit(4).alias("k"), F.lit("id").alias("kind"), "e")).alias("more"))
    hits = stage(hits, "pii-found", free=False)
    out = rows.select("key", "text_md5", "base").join(hits, "text_md5", "left")
    return out.select(F.col("key").alias(key), "text_md5", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("found"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span as ``[kind]``; a span that starts inside an earlier one adds nothing but its end."""

    def rebuilt(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:  # code points a to b, from the blocks that hold them
            part = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b, (k + 1) * PIECE) - F.greatest(a, k * PIECE))
            of = lambda x: F.floor(x / PIECE).cast("int")
            return F.when(b > a, F.array_join(F.transform(F.sequence(of(a), of(F.greatest(b - 1, a))), part), "")).otherwise(F.lit(""))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            named = F.array(piece(at, x["s"]), F.concat(F.lit("["), x["kind"], F.lit("]")))
            return F.greatest(at, x["e"]), F.when(x["s"] >= at, named).otherwise(F.array().cast("array<string>"))

        end = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.array_join(F.concat(folded(spans, F.lit(0), "array<string>", step), F.array(piece(end, F.length(text)))), "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), rebuilt)


def redact(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` replaced by ``[kind]``; of overlapping spans the first is named.

    Spans are found by the md5 of the text, so shared and missing keys are as good as others."""
    wanted = spans.where(F.size("found") > 0).select("text_md5", "found").dropDuplicates(["text_md5"])
    t = F.coalesce(F.col("doc")[text].cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("doc"))
    out = packed.withColumn("text_md5", F.md5(t.cast("binary"))).join(wanted, "text_md5", "left")
    masked = F.when(F.col("found").isNull(), F.col("doc")[text]).otherwise(_masked(t, F.col("found")))
    return out.select(*[(masked if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_spans(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))

    def count(i: int, kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(i, kind) for i, kind in enumerate(_MAY)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
