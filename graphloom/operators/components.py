"""Weakly connected components by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..session import stage


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): root is the smallest id of the component; isolated nodes are their own.  Rounds go on until nothing changes."""
    links = stage(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "components")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-low", free=False)
        links = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = stage(links.groupBy("u").agg(F.min("v").alias("m")), "components-low", free=False)
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        seen = Observation()  # the write counts and sums its links, which tells whether they have changed
        links = links.join(low, "u").select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()
        links = stage(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "components")
        now = (seen.get["n"], seen.get["sum"])
        if now == before:
            break
        before = now
    return nodes.select("id").join(links.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): ids from 0 in the order of the components' smallest members.

    Roots are numbered through one range-partitioned sort of the roots alone (a row for each component).
    """
    found = stage(roots(nodes, edges), "component-roots")
    numbered = number(found.select("root").distinct(), "root", "component")
    return found.join(numbered, "root").select("id", "component")


def number(df: DataFrame, column: str, name: str) -> DataFrame:
    """Dense numbers from 0 in the order of a distinct column, without a single-partition window."""
    spark = df.sparkSession
    ranged = stage(df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), column).withColumn("_p", F.spark_partition_id()), "numbering", free=False)
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    base, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, base))
        base += sizes[p]
    at = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return ranged.withColumn(name, (rank - 1 + F.try_element_at(at, F.col("_p"))).cast("long")).drop("_p")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def nodes_in_component(components: DataFrame, component: int) -> DataFrame:
    return components.where(F.col("component") == component).select("id")


def are_connected(components: DataFrame, a: str, b: str) -> bool:
    got = components.where(F.col("id").isin(a, b)).groupBy("component").agg(F.count_distinct("id").alias("n")).where("n = 2" if a != b else "n = 1")
    return bool(got.limit(1).count())
