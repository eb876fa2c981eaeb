"""Biased random walks over out-edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage


def _uniform(*parts) -> Column:
    """A number in (0, 1) that depends only on its parts, so that walks can be repeated."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def node2vec(nodes: DataFrame, edges: DataFrame, walk_length: int = 80, walks_per_node: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(start, walk, step, id): a row for each place of each walk; a walk ends early at a node without out-edges.

    The first step is uniform; after that an edge back to the previous node weighs 1 / p, one to a node that the
    previous node has an edge to 1, any other 1 / q; parallel edges count each.  A weighted choice is the
    smallest exponential race time -ln(u) / w, an aggregate with map-side combination, so a hub is no hot task.
    """
    walk = nodes.select(F.col("id").alias("start")).withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks_per_node - 1)))) if walks_per_node > 0 else nodes.select(F.col("id").alias("start"), F.lit(0).alias("walk")).limit(0)
    none = F.lit(None).cast(nodes.schema["id"].dataType)
    now = stage(walk.select("start", "walk", none.alias("prev"), F.col("start").alias("cur")), "walks")
    out = now.select("start", "walk", F.lit(0).alias("step"), F.col("cur").alias("id"))
    steps = edges.select(F.col("src").alias("cur"), F.col("dst").alias("next"), "eid")
    plain = p == 1.0 and q == 1.0
    near = edges.select(F.col("src").alias("prev"), F.col("dst").alias("next")).distinct().withColumn("near", F.lit(True))
    for i in range(1, walk_length):
        options = now.join(steps, "cur")
        if plain or i == 1:
            weight = F.lit(1.0)
        else:
            options = options.join(near, ["prev", "next"], "left")
            weight = F.when(F.col("next") == F.col("prev"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
        race = -F.log(_uniform(F.lit(seed), "start", "walk", F.lit(i), "eid")) / weight
        chosen = options.groupBy("start", "walk", F.col("cur").alias("prev")).agg(F.min_by("next", F.struct(race.alias("t"), F.col("eid"))).alias("cur"))
        now = stage(chosen, "walks")
        if not now.limit(1).count():
            break
        out = out.unionByName(now.select("start", "walk", F.lit(i).alias("step"), F.col("cur").alias("id")))
    return out


def walks(rows: DataFrame) -> DataFrame:
    """(start, walk, path): the walks as arrays of ids."""
    return rows.groupBy("start", "walk").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "id"))), lambda x: x["id"]).alias("path"))


def walk_counts(rows: DataFrame) -> DataFrame:
    """(num_walks, total_steps)."""
    return rows.agg(F.count_distinct("start", "walk").alias("num_walks"), F.count("*").alias("total_steps"))
