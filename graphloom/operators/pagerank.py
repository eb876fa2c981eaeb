"""PageRank with the mass of sinks lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import stage


@dataclass(frozen=True)
class Ranks:
    scores: DataFrame  # (id, score)
    iterations: int
    converged: bool

    def top_nodes(self, n: int) -> DataFrame:
        return self.scores.orderBy(F.desc("score"), "id").limit(n)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> Ranks:
    """r(v) = (1 - d) / N + d * sum over in-edges of r(u) / outdegree(u), from 1 / N; parallel edges count each.

    Edges are folded once into (src, dst, share), so an iteration is one join on src and one aggregation with
    map-side sums; the table of ranks is written each time, which cuts the lineage, and the largest change is read
    from it with one aggregate.
    """
    n = nodes.count()
    if n == 0:
        return Ranks(nodes.select("id", F.lit(0.0).alias("score")), 0, True)
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    folded = edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    shares = stage(folded.join(degree, "src").select("src", "dst", (F.col("k") / F.col("degree")).alias("share")), "pagerank-shares")
    ranks = stage(nodes.select("id", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("change")), "pagerank")
    for i in range(1, max_iterations + 1):
        sums = shares.join(ranks.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("s"))
        new = F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("s", F.lit(0.0))
        ranks = stage(ranks.join(sums, "id", "left").select("id", new.alias("score"), F.abs(new - F.col("score")).alias("change")), "pagerank")
        if (ranks.agg(F.max("change")).first()[0] or 0.0) < tolerance:
            return Ranks(ranks.select("id", "score"), i, True)
    return Ranks(ranks.select("id", "score"), max_iterations, False)
