"""Weighted shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import InvalidOperation
from ..session import stage
from .traversal import _start


def shortest_paths(nodes: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """(id, distance, previous) of all reached nodes; a negative weight on an out-edge of a reached node is an error.

    Frontier relaxation: only nodes whose distance fell in the last round send theirs on, and only strictly
    smaller distances are accepted, so cycles of weight zero end; rounds go on until no distance falls.  Of equal paths the smallest predecessor
    in the final round of improvement stays.
    """
    kind = nodes.schema["id"].dataType
    links = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    best = stage(_start(nodes, source).select("id", F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("previous"), F.lit(True).alias("fresh")), "paths")
    links = stage(links, "paths-links")
    while True:
        sent = links.join(best.where("fresh").select(F.col("id").alias("src"), "distance"), "src")
        offers = stage(sent.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("d"), F.col("src").alias("p"))).alias("o"), F.min("weight").alias("least")), "paths-offers", free=False)
        if offers.where("least < 0").limit(1).count():
            raise InvalidOperation("negative edge weight")
        met = best.join(offers, "id", "full")
        better = F.col("o").isNotNull() & (F.col("distance").isNull() | (F.col("o.d") < F.col("distance")))
        best = stage(met.select("id", F.when(better, F.col("o.d")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("o.p")).otherwise(F.col("previous")).alias("previous"), better.alias("fresh")), "paths")
        if not best.where("fresh").limit(1).count():
            break
    return best.drop("fresh")


def path_to(paths: DataFrame, target: str, max_length: int = 100_000) -> list[str] | None:
    """Nodes from the source to the target; None if it is not reached."""
    out, at = [], target
    while at is not None and len(out) < max_length:
        row = paths.where(F.col("id") == at).select("previous").first()
        if row is None:
            return None
        out.append(at)
        at = row["previous"]
    return out[::-1]


def distance_to(paths: DataFrame, target: str) -> float | None:
    row = paths.where(F.col("id") == target).select("distance").first()
    return None if row is None else row["distance"]
