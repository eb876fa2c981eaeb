"""Community detection by local moving, and the modularity that it raises."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .components import number


@dataclass(frozen=True)
class Communities:
    assignment: DataFrame  # (id, community)
    modularity: float
    iterations: int

    def sizes(self) -> DataFrame:
        return self.assignment.groupBy("community").agg(F.count("*").alias("size"))

    def nodes_in(self, community: int) -> DataFrame:
        return self.assignment.where(F.col("community") == community).select("id")


def modularity(assignment: DataFrame, edges: DataFrame) -> float:
    """Sum over distinct linked pairs in one community of (1 - d(i) d(j) / 2m) / 2m; m counts directed edges, d out-edges.

    Without edges it is 0."""
    m = edges.count()
    if not m:
        return 0.0
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    node = assignment.join(d, "id", "left").select("id", "community", F.coalesce("d", F.lit(0)).alias("d"))
    a = node.select(F.col("id").alias("src"), F.col("community").alias("ca"), F.col("d").alias("da"))
    b = node.select(F.col("id").alias("dst"), F.col("community").alias("cb"), F.col("d").alias("db"))
    pairs = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("ca = cb")
    return float(pairs.agg(F.sum((1 - F.col("da") * F.col("db") / (2.0 * m)) / (2.0 * m))).first()[0] or 0.0)


def _sequential(nodes: DataFrame, edges: DataFrame, max_iterations: int, least: float) -> tuple[DataFrame, int]:
    """Nodes in order of id move to the out-neighbours' community of the highest gain, until no node moves.

    ``gain`` is incremental: moving node i changes only the pairs that i is in."""
    kind = nodes.schema["id"].dataType.simpleString()
    flat = edges.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst")))

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["src"]) | set(pdf["dst"].dropna()))
        links = pdf.dropna()
        m = len(links)
        degree = links.groupby("src").size().to_dict()
        out, into = {}, {}
        for s, d in dict.fromkeys(zip(links["src"], links["dst"])):
            out.setdefault(s, []).append(d)
            into.setdefault(d, []).append(s)
        community = {v: i for i, v in enumerate(ids)}
        rounds = 0
        for rounds in range(1, max_iterations + 1):
            moved = False
            for v in ids:
                near = sorted({community[u] for u in out.get(v, ())} - {community[v]})
                if not near:
                    continue
                worth: dict[int, float] = {}
                for u in (*out.get(v, ()), *into.get(v, ())):
                    if u != v:
                        worth[community[u]] = worth.get(community[u], 0.0) + 1 - degree.get(v, 0) * degree.get(u, 0) / (2 * m)
                stay = worth.get(community[v], 0.0)
                best = max(near, key=lambda c: (worth.get(c, 0.0), -c))
                if worth.get(best, 0.0) > stay + max(1e-12, least * 2 * m):
                    community[v], moved = best, True
            if not moved:
                break
        return pd.DataFrame({"id": ids, "c": [community[v] for v in ids], "rounds": rounds})

    rows = stage(flat.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda pdf: move(pdf), f"id {kind}, c long, rounds int"), "louvain")
    return rows.select("id", "c"), int(rows.agg(F.max("rounds")).first()[0] or 0)


def _parallel(nodes: DataFrame, edges: DataFrame, max_iterations: int, least: float) -> tuple[DataFrame, int]:
    """Synchronous local moving: odd rounds move only to larger labels, even rounds only to smaller ones, so that
    neighbours do not swap for ever; the best round's assignment is kept."""
    m = edges.count()
    state = stage(nodes.select("id", F.col("id").alias("c")), "louvain")
    if not m:
        return state, 0
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    state = stage(state.join(d, "id", "left").select("id", "c", F.coalesce("d", F.lit(0)).alias("d")), "louvain")
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    both = stage(pairs.select(F.col("src").alias("v"), F.col("dst").alias("u"), F.lit(True).alias("out")).unionByName(pairs.select(F.col("dst").alias("v"), F.col("src").alias("u"), F.lit(False).alias("out"))), "louvain-pairs")
    best, top, rounds = state, modularity(state.select("id", F.col("c").alias("community")), edges), 0
    for rounds in range(1, max_iterations + 1):
        mine = state.select(F.col("id").alias("v"), F.col("c").alias("cv"), F.col("d").alias("dv"))
        other = state.select(F.col("id").alias("u"), F.col("c").alias("cu"), F.col("d").alias("du"))
        worth = both.join(other, "u").join(mine, "v").groupBy("v", "cv", "cu").agg(F.sum(1 - F.col("dv") * F.col("du") / (2.0 * m)).alias("w"), F.max("out").alias("out"))
        stay = F.max(F.when(F.col("cu") == F.col("cv"), F.col("w")))
        away = (F.col("cu") != F.col("cv")) & F.col("out") & ((F.col("cu") < F.col("cv")) if rounds % 2 == 0 else (F.col("cu") > F.col("cv")))
        choice = worth.groupBy("v").agg(F.coalesce(stay, F.lit(0.0)).alias("stay"), F.max(F.when(away, F.struct("w", "cu"))).alias("go")).where(F.col("go.w") > F.col("stay") + max(1e-12, least * 2 * m))
        state = stage(state.join(choice.select(F.col("v").alias("id"), F.col("go.cu").alias("to")), "id", "left").select("id", F.coalesce("to", "c").alias("c"), "d", F.col("to").isNotNull().alias("moved")), "louvain")
        q = modularity(state.select("id", F.col("c").alias("community")), edges)
        if q > top:
            best, top = state, q
        elif rounds % 2 == 0 and not state.where("moved").limit(1).count():
            break
        state = state.drop("moved")
    return best.select("id", "c"), rounds


def louvain(nodes: DataFrame, edges: DataFrame, max_iterations: int = 100, exact: bool = True, min_improvement: float = 0.0) -> Communities:
    """Communities numbered from 0 in the order of their smallest member, and their modularity.

    The sequential form, one task, unless ``exact`` is false, at every size.  A move must raise modularity by more than
    ``min_improvement``."""
    rows, rounds = (_sequential if exact else _parallel)(nodes, edges, max_iterations, min_improvement)
    least = stage(rows.groupBy("c").agg(F.min("id").alias("least")), "louvain-least", free=False)
    names = number(least.select("least"), "least", "community")
    assignment = stage(rows.join(least, "c").join(names, "least").select("id", "community"), "louvain-assignment")
    return Communities(assignment, modularity(assignment, edges), rounds)
