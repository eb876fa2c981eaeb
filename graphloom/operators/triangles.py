"""Triangles, clustering coefficients and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


def canonical(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: undirected distinct edges without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): out-edges, parallel ones each."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def undirected_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours either way, without the node itself."""
    e = canonical(edges)
    counts = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z), each triangle once.

    Edges point from the smaller (degree, id) to the larger, so a hub has few out-edges and wedges stay within
    the order of E ** 1.5; wedges are closed by an equi-join with the edges.
    """
    e = stage(canonical(edges), "triangles-edges")
    d = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    d = stage(d, "triangles-degrees", free=False)
    da, db = d.select(F.col("id").alias("a"), F.col("d").alias("da")), d.select(F.col("id").alias("b"), F.col("d").alias("db"))
    low = F.struct(F.col("da").alias("d"), F.col("a").alias("id")) < F.struct(F.col("db").alias("d"), F.col("b").alias("id"))
    oriented = e.join(da, "a").join(db, "b").select(F.when(low, F.struct(F.col("a").alias("u"), F.col("b").alias("v"), F.col("db").alias("dv"))).otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v"), F.col("da").alias("dv"))).alias("e")).select("e.*")
    oriented = stage(oriented, "triangles-oriented")
    first = oriented.select("u", F.col("v").alias("v1"), F.col("dv").alias("d1"))
    second = oriented.select("u", F.col("v").alias("v2"), F.col("dv").alias("d2"))
    ordered = F.struct(F.col("d1").alias("d"), F.col("v1").alias("id")) < F.struct(F.col("d2").alias("d"), F.col("v2").alias("id"))
    wedges = first.join(second, "u").where(ordered).select(F.col("u").alias("x"), F.col("v1").alias("y"), F.col("v2").alias("z"))
    return wedges.join(oriented.select(F.col("u").alias("y"), F.col("v").alias("z")), ["y", "z"]).select("x", "y", "z")


def triangle_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, triangles, degree, coefficient): each triangle once; the coefficient is 0 below two neighbours."""
    corners = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = undirected_degrees(nodes, edges).join(corners, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)).cast("long"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.select("id", "triangles", "degree", F.when(F.col("degree") >= 2, F.col("triangles") / pairs).otherwise(0.0).alias("coefficient"))


def triangle_summary(counts: DataFrame) -> DataFrame:
    """(total, mean_coefficient) of the table of :func:`triangle_counts`; the mean is over nodes of two neighbours or more."""
    return counts.agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("long").alias("total"), F.coalesce(F.avg(F.when(F.col("degree") >= 2, F.col("coefficient"))), F.lit(0.0)).alias("mean_coefficient"))
