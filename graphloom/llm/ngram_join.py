"""N-gram Jaccard self-join by vertical partitioning, down to connected components.

A document is the set of its distinct word n-grams.  All n-grams have one global order: rare ones first (by
hash), then the frequent ones by rising frequency, as a bounded corpus-wide sketch has it.  The sketch only
ranks; any order gives the same result.

* Equal sets are one *class*; only one document of a class goes on, and copies are never paired.
* *Filter by prefixes.*  Two sets that reach the threshold t share at least l n-grams within their prefixes, the
  first ``n - ceil(t n) + l`` of the order, l being a fortieth of the smaller set (one at least).  A set with
  fewer prefix n-grams that any other prefix has cannot link and is left out.
* *Filter by whole sets.*  For the sets that are left, all n-grams are counted exactly; a set of which fewer than
  ``ceil(t n)`` are shared with any other of them cannot link either.
* *Candidates.*  The order is now exact (rarest first), and two linked sets share one of their first
  ``n - ceil(t n) + 1`` n-grams.  A row (n-gram, set) knows how many n-grams of the set stand before it: at the first
  n-gram that a pair shares they are lost to both, which bounds what the pair can still share.  A row stays only while
  that leaves it a chance with some row of its group (the sets that share the n-gram) from another component.
  Groups are worked off in turns: a few *pivots* of each group, four times as many each turn, are compared with
  the rest of it and leave it.  Only pairs whose sizes, positions and *odd sketches* (256 parities a set, which bound the
  difference of two sets from below) leave them a chance come out of that.  A pair within one component cannot change a component and is left out.  So a group
  costs rows in proportion to its size while its sets link, and more only for sets that no bound can tell apart.
* *Vertical partitioning*: the order is cut into fragments, and a set into its segments, one row each.  The overlap of
  a pair is counted in each fragment apart, between two segments; the partial counts are summed per pair, which
  gives the exact Jaccard test in integers.

Defined cases: null, empty and blank texts have no n-gram, size 0, and link with nothing; a text of fewer
words than n has its whole word sequence as its one n-gram; repeated rows and equal texts are one class;
a row with a null key takes part but names no component; rows that share a key are texts of their own, each with the
result of its own text; a very long text is one set like others; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _text as X
from ._components import components
from ._session import counted, numbered, stage, tune, unstage

#: The sketch: slots, slots reported by a task, slots broadcast; the count from which a slot is frequent.
SLOT_BITS, SUMMARY, TABLE, FREQUENT = 22, 1 << 13, 1 << 16, 32
#: Fragments of the rare tier (frequent n-grams are one more), and the group size of which all sets are pivots at once.
FRAGMENTS, SMALL = 8, 8
#: The shared prefix n-grams asked of a set: one for every so many of its n-grams.
EVERY = 40
#: Columns of the odd sketch, 64 parities each.
ODD = ("o0", "o1", "o2", "o3")
_HASH_BITS = 59


def _raw(chunk: X.Chunk, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    w = X.words(chunk)
    h, row, _ = X.shingles(X.word_hashes(chunk, w), w, n)
    return (X.mix(h + np.uint64(seed)) if seed else h), row


def _sketch(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for chunk in X.chunks(batch.column(0)):
                h, _ = _raw(chunk, n, seed)
                slots, counts = np.unique((h >> np.uint64(64 - SLOT_BITS)).astype(np.uint32), return_counts=True)
                total[slots] += counts.astype(np.uint32)
        top = np.argpartition(total, -SUMMARY)[-SUMMARY:]
        top = np.sort(top[total[top] > 1])
        yield pa.RecordBatch.from_arrays([pa.array(top.astype(np.int64)), pa.array(total[top].astype(np.int64))], ["slot", "n"])

    return run


def frequent_slots(texts: DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, tiers 1..15) of the most frequent slots; at most ``TABLE`` of them reach the driver."""
    found = texts.mapInArrow(_sketch(n, seed), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "slot").limit(TABLE).collect()
    slots = np.array([r.slot for r in found], np.int64)
    counts = np.array([r.n for r in found], np.float64)
    if len(counts) == TABLE:  # all slots are busy: only what stands out counts as frequent
        slots, counts = slots[counts > 4 * counts.min()], counts[counts > 4 * counts.min()]
    return slots, np.clip(np.log2(counts / FREQUENT).astype(np.int64) + 1 if len(counts) else counts.astype(np.int64), 1, 15)


class _Order:
    """Tokens: n-grams as integers in the global order (tier, then hash)."""

    def __init__(self, n: int, seed: int, slots: np.ndarray, tiers: np.ndarray):
        self.n, self.seed = n, seed
        self.tier = np.zeros(1 << SLOT_BITS, np.uint8)
        self.tier[slots] = tiers

    def sets(self, chunk: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, bounds): the distinct tokens of each row in order."""
        h, row = _raw(chunk, self.n, self.seed)
        tier = self.tier[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
        # the slot is in the top bits of the hash, so the order within a tier takes the low ones
        token = (tier << np.uint64(_HASH_BITS)) | (h & np.uint64((1 << _HASH_BITS) - 1))
        order = np.lexsort((token, row))
        first = order[X.runs(row[order], token[order])]
        return token[first], np.searchsorted(row[first], np.arange(chunk.rows + 1))


def _sum_rows(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - -(-percent * n // 100) + np.maximum(1, n // EVERY))


def least_shared(n: Column, percent: int) -> Column:
    """Prefix n-grams that a set of n must share with any one set it links with (which may be the smaller)."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100 - 1e-9) / EVERY))


def _profiles(order, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = _Order(*order.value)
        for batch in batches:
            for chunk in X.chunks(batch.column(2)):
                token, bounds = o.sets(chunk)
                n = np.diff(bounds)
                with np.errstate(over="ignore"):
                    one = X.mix(_sum_rows(X.mix(token), bounds) + n.astype(np.uint64))
                    two = X.mix(_sum_rows(X.mix(token * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)), bounds))
                take = prefix_sizes(n, percent)
                offsets = np.concatenate([[0], np.cumsum(take)])
                at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], take) + np.repeat(bounds[:-1], take)
                none = pa.array(n == 0)
                cls = [pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(x.view(np.int64))) for x in (one, two)]
                prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(token[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(chunk.first, chunk.rows) for k in (0, 1)), pa.array(n.astype(np.int64)), *cls, prefix], ["row", "key", "n", "cls", "check", "prefix"])

    return run


def _segments(order):
    """(cls, part, tokens, o0..): the segment of a set in each fragment of the order, which is cut at ranges of the rare tier's
    hashes and before the frequent tiers, and its odd sketch: the parity of its tokens in each of 64 slots a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = _Order(*order.value)
        for batch in batches:
            for chunk in X.chunks(batch.column(1)):
                token, bounds = o.sets(chunk)
                row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
                part = np.minimum(token >> np.uint64(_HASH_BITS - 3), np.uint64(FRAGMENTS)).astype(np.int32)
                first = X.runs(row, part)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(token)), pa.int32()), pa.array(token.view(np.int64)))
                h = X.mix(token)
                bit, lane = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) % np.uint64(len(ODD))
                odd = [np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), first) if len(first) else bit for k in range(len(ODD))]
                cols = [batch.column(0).take(pa.array(chunk.first + row[first])), pa.array(part[first]), lists, *(pa.array(x.view(np.int64)) for x in odd)]
                yield pa.RecordBatch.from_arrays(cols, ["cls", "part", "tokens", *ODD])

    return run


def verified(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity reaches the threshold: one count for each fragment, summed per pair."""
    left = pairs.join(segments.select(F.col("cls").alias("a"), "part", F.col("tokens").alias("x")), "a")
    both = left.join(segments.select(F.col("cls").alias("b"), "part", F.col("tokens").alias("y")), ["b", "part"])
    partial = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("c"))
    total = partial.groupBy("a", "b").agg(F.sum("c").alias("s"))
    total = total.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
    return total.where(100 * F.col("s") >= percent * (F.col("na") + F.col("nb") - F.col("s"))).select("a", "b")


def _sharing(rows: DataFrame, sizes: DataFrame, least, name: str, kept: Column | None = None) -> DataFrame:
    """(cls, n, tokens): of each class its tokens that other classes have too, for classes with at least ``least(n)`` of them.

    rows: (token, cls), none of them twice, so a token is shared if it counts two.  ``kept`` is what is listed in place of the
    token, from ``token`` and its document frequency ``df``.  The join hashes distinct tokens instead of sorting the
    rows, and lists meet their class in one exchange, which also counts them.  The result is written."""
    groups = stage(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), f"{name}-tokens")
    lists = rows.join(groups.hint("shuffle_hash"), "token").groupBy("cls").agg(F.collect_list(F.col("token") if kept is None else kept).alias("tokens"))
    out = stage(lists.join(sizes, "cls").where(F.size("tokens") >= least(F.col("n"))).select("cls", "n", "tokens"), f"{name}-kept")
    unstage(groups)
    return out


def place() -> Column:
    """An n-gram's position in the exact order as one number: its document frequency on a logarithmic scale, then 56 bits of hash
    (two n-grams in one place cost at most a comparison)."""
    scale = F.least(F.floor(F.log2(F.col("df")) * 4), F.lit(126)).cast("long")
    return F.shiftleft(scale, 56).bitwiseOR(F.xxhash64("token").bitwiseAND((1 << 56) - 1))


def ranked_prefixes(whole: DataFrame, percent: int) -> DataFrame:
    """(cls, n, alone, first): the places of the shared n-grams in the prefix of each class, rarest first.

    ``whole`` has the places of all shared n-grams of a class.  ``alone`` counts the n-grams that no other
    class has; they stand before all others and take their places in the prefix unseen.  ``first`` is the
    whole shared prefix."""
    per = whole.select("cls", "n", F.array_sort("tokens").alias("t")).withColumn("alone", F.col("n") - F.size("t"))
    take = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1 - F.col("alone")
    return per.where(take > 0).select("cls", "n", "alone", F.slice("t", 1, F.greatest(take, F.lit(0)).cast("int")).alias("first"))


def possible(percent: int, na: Column, ua: Column, fa: Column, nb: Column, ub: Column, fb: Column) -> Column:
    """Whether two sets can still reach the threshold, from sizes, lone n-grams and prefixes.

    Up to the place where the shorter prefix ends, both sets are fully seen; what one has there and the other has not
    is lost, and so are the lone n-grams.  As the order is rarest first, differences show in the prefixes."""
    need = F.ceil(percent * (na + nb) / (100 + percent) - 1e-9)
    end = F.least(F.element_at(fa, -1), F.element_at(fb, -1))
    common = F.size(F.array_intersect(fa, fb))
    lost_a = ua + F.size(F.filter(fa, lambda x: x <= end)) - common
    lost_b = ub + F.size(F.filter(fb, lambda x: x <= end)) - common
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (na - ua >= need) & (nb - ub >= need) & (na - lost_a >= need) & (nb - lost_b >= need)


def ngram_links(texts: DataFrame, n: int = 4, percent: int = 85, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts: (row, key, text), ``row`` unique.  (row, key, n, cls), (cls, rep, at) and (node, root) over linked classes."""
    spark = texts.sparkSession
    tune(spark)
    kind = texts.schema["key"].dataType.simpleString()
    order = spark.sparkContext.broadcast((n, seed, *frequent_slots(texts.select("text"), n, seed)))
    profiles = stage(texts.select("row", "key", "text").mapInArrow(_profiles(order, percent), f"row long, key {kind}, n long, cls long, check long, prefix array<long>"), "ngram-profiles")
    real = profiles.where("cls is not null")
    classes = stage(real.groupBy("cls").agg(F.min("key").alias("rep"), F.min("row").alias("at"), F.min("check").alias("lo"), F.max("check").alias("hi")), "ngram-classes")
    if classes.where("lo <> hi").limit(1).count():  # two sets under one class: hash again
        return ngram_links(texts, n, percent, seed + 1)
    classes = classes.select("cls", "rep", "at")

    sizes = stage(real.groupBy("cls").agg(F.max("n").alias("n")), "ngram-sizes", free=False)
    tokens = real.join(classes.select(F.col("at").alias("row")), "row").select(F.explode("prefix").alias("token"), "cls")
    once = _sharing(tokens, sizes, lambda n: least_shared(n, percent), "ngram-prefix")
    # classes that went may leave others without partners
    kept = _sharing(once.select(F.explode("tokens").alias("token"), "cls"), sizes, lambda n: least_shared(n, percent), "ngram-prefix")
    unstage(once)
    ids = kept.select("cls").join(classes, "cls").select(F.col("at").alias("row"), "cls")
    # the rows picked are hashed, whatever their number, so that texts are never sorted
    parts = stage(texts.join(ids.hint("shuffle_hash"), "row").select("cls", "text").mapInArrow(_segments(order), "cls long, part int, tokens array<long>, " + ", ".join(f"{o} long" for o in ODD)), "ngram-segments")
    unstage(kept)
    tokens = parts.select("cls", F.explode("tokens").alias("token"))
    whole = _sharing(tokens, sizes, lambda n: F.ceil(n * percent / 100 - 1e-9), "ngram-whole", place())
    heads = stage(ranked_prefixes(whole, percent), "ngram-heads")
    unstage(whole)
    segments = stage(parts.join(heads.select("cls"), "cls"), "ngram-kept-segments")
    heads = stage(heads.join(segments.groupBy("cls").agg(*[F.bit_xor(o).alias(o) for o in ODD]), "cls"), "ngram-sketched")
    unstage(parts)
    roots = linked(heads, segments, sizes, percent)
    return profiles.select("row", "key", "n", "cls"), classes, roots


def _open_rows(rest: DataFrame, roots: DataFrame | None, percent: int, turn: int) -> tuple[DataFrame, int]:
    """The rows (place, cls, n, before, last) that can still link two components, with root and pivot, and their number."""
    c = F.col
    rows = rest.withColumn("root", c("cls")) if roots is None else rest.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = stage(rows, "ngram-labelled")
    group = rows.groupBy("place").agg(F.min(F.struct("before", "cls")).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 <> r1")
    group = stage(group.select("place", "size", c("m.before").alias("least"), c("m.cls").alias("first")), "ngram-groups", free=False)
    rows = rows.join(group, "place").where((100 - percent) * c("n") - 100 * c("before") >= percent * c("least"))
    # pivots: the row with least before it, and as many more as the turn allows, picked by hash
    share = F.pmod(F.xxhash64("place", "cls", F.lit(turn)), c("size"))
    pivot = (c("cls") == c("first")) | (c("size") <= SMALL) | (share < (1 << 2 * turn) - 1)
    return counted(rows.select("place", "cls", "n", "before", "last", "root", *ODD, pivot.alias("pivot")), "ngram-turn")


def linked(heads: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of every class that links, by turns of pivots until no group can link two components any more."""
    c = F.col
    a_head = heads.select(c("cls").alias("a"), c("n").alias("na"), c("alone").alias("ua"), c("first").alias("fa"))
    b_head = heads.select(c("cls").alias("b"), c("n").alias("nb"), c("alone").alias("ub"), c("first").alias("fb"))
    chance = possible(percent, c("na"), c("ua"), c("fa"), c("nb"), c("ub"), c("fb"))
    # each place with the one before it: a pair that shares both has an earlier place in common, and only its first one counts
    places = F.posexplode(F.filter(F.arrays_zip(c("first").alias("place"), F.concat(F.array(F.lit(None).cast("long")), "first").alias("last")), lambda x: x["place"].isNotNull())).alias("i", "x")
    rest = heads.select("cls", "n", "alone", *ODD, places).select(c("x.place").alias("place"), "cls", "n", (c("alone") + c("i")).alias("before"), c("x.last").alias("last"), *ODD)
    links = roots = done = None
    turn = 0
    while True:
        rows, n = _open_rows(rest, roots, percent, turn)
        if not n:
            break
        x = rows.select("place", c("cls").alias("a"), c("n").alias("na"), c("before").alias("ba"), c("last").alias("la"), c("root").alias("ra"), c("pivot").alias("pa"), *[c(o).alias(f"a{o}") for o in ODD])
        y = rows.where("pivot").select("place", c("cls").alias("b"), c("n").alias("nb"), c("before").alias("bb"), c("last").alias("lb"), c("root").alias("rb"), *[c(o).alias(f"b{o}") for o in ODD])
        apart = F.coalesce(c("la") != c("lb"), F.lit(True)) & (c("ra") != c("rb")) & (~c("pa") | (c("a") > c("b"))) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        room = ((100 - percent) * c("na") - 100 * c("ba") >= percent * c("bb")) & ((100 - percent) * c("nb") - 100 * c("bb") >= percent * c("ba"))
        # a token of one set alone flips one parity, so parities that differ bound the sets' difference from below
        differ = sum((F.bit_count(c(f"a{o}").bitwiseXOR(c(f"b{o}"))) for o in ODD), F.lit(0))
        like = differ <= c("na") + c("nb") - 2 * F.ceil(percent * (c("na") + c("nb")) / (100 + percent) - 1e-9)
        pairs = x.join(y, "place").where(apart & room & like).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = pairs.join(a_head, "a").join(b_head, "b").where(chance).select("a", "b")
        pairs, n = counted(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "ngram-pairs")
        if n:
            done = pairs if done is None else done.unionByName(pairs)
            new, n = counted(verified(pairs, segments, sizes, percent), "ngram-links")
        if n:
            links = new if links is None else links.unionByName(new)
            roots = stage(components(links), "ngram-roots")
        rest = rows.where("not pivot").select("place", "cls", "n", "before", "last", *ODD)
        turn += 1
    return roots if roots is not None else heads.sparkSession.createDataFrame([], "node long, root long")


def _components(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(row, key, n, cls, root, component_id) of each row; the last three are null for a row without n-grams."""
    profiles, classes, roots = ngram_links(texts, n, percent)
    labelled = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = labelled.join(labelled.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("cls", "root", "component_id")
    return profiles.join(named, "cls", "left")


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, class_id): component_id is the smallest key that links reach."""
    texts = numbered(docs.withColumn(text, F.col(text).cast("string")), "ngram-texts", key=key, text=text)
    out = _components(texts, n, percent)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), F.col("cls").alias("class_id"))


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: that of the smallest key, then the first; a row without a key only if none has one.

    Rows without n-grams link with nothing; of those that repeat key and text one stays."""
    whole = numbered(docs.select(F.struct("*").alias("doc")), "ngram-docs", doc="doc")
    texts = whole.select("row", F.col("doc")[key].alias("key"), F.col("doc")[text].cast("string").alias("text"))
    found = stage(_components(texts, n, percent), "ngram-found")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    kept = found.where("root is not null").groupBy("root").agg(F.min(order).alias("m")).select("m.row")
    blank = texts.join(found.where("root is null").select("row"), "row", "left_semi").groupBy("key", "text").agg(F.min("row").alias("row")).select("row")
    return whole.join(kept.unionByName(blank), "row", "left_semi").select("doc.*")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), 4, 85).drop("class_id")
