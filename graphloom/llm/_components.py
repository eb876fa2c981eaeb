"""Connected components of a link table by alternating star contraction, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ._session import stage


def components(links: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    Large-star and small-star steps alternate (Kiveris et al. 2014) until nothing changes, which takes a number of rounds
    in proportion to the logarithm of the longest chain squared.  Self links and nulls are ignored; no links give
    an empty table.  The write of a round also counts and sums its links, which tells whether they have changed.
    """
    a, b = F.col(u), F.col(v)
    edges = stage(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = stage(low, "stars-low", free=False)  # read as a table, so that the join can split a hub
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "stars-low", free=False)
        edges = edges.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        seen = Observation()
        edges = stage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "stars")
        now = (seen.get["n"], seen.get["sum"])
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
