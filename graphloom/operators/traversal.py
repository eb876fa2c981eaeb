"""Breadth-first and depth-first search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import NotFound
from ..session import stage


def _start(nodes: DataFrame, start: str) -> DataFrame:
    found = nodes.where(F.col("id") == start).limit(1)
    if not found.count():
        raise NotFound(f"no node {start}")
    return found


def bfs(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """(id, distance, parent) of all nodes that out-edges reach; those at ``max_depth`` are in, but not expanded.

    Level by level: the frontier joins the edges, known nodes are anti-joined away, and of several parents the
    smallest is kept.  The visited set is kept as one table per level, so a level writes only what it found.
    """
    kind = nodes.schema["id"].dataType
    frontier = stage(_start(nodes, start).select("id", F.lit(0).alias("distance"), F.lit(None).cast(kind).alias("parent")), "bfs")
    seen, depth = frontier, 0
    edges = edges.select("src", "dst")
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = stage(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("distance"), "parent"), "bfs")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = stage(seen, "bfs-seen")
    return seen


def dfs(nodes: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """(id, preorder, discovery, finish, parent): depth-first search over out-edges, neighbours by (dst, eid).

    Depth-first order is inherently sequential, so the search itself is one task with an explicit stack; what
    it gets is only the part of the graph that the start reaches, found level by level beforehand.
    """
    reached = bfs(nodes, edges, start).select("id")
    part = edges.join(reached.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "eid")
    kind = nodes.schema["id"].dataType.simpleString()
    own = reached.where(F.col("id") == start).select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("string").alias("eid"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst", "eid"], na_position="first")
        out: dict = {}
        for s, d in zip(pdf["src"], pdf["dst"]):
            if pd.notna(d):
                out.setdefault(s, []).append(d)
        seen, rows, clock = {start: None}, [], 1
        at = {start: (0, clock)}
        stack: list[tuple[object, Iterator]] = [(start, iter(out.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            for d in rest:
                if d not in seen:
                    seen[d] = node
                    clock += 1
                    at[d] = (len(at), clock)
                    stack.append((d, iter(out.get(d, ()))))
                    break
            else:
                stack.pop()
                clock += 1
                rows.append((node, *at[node], clock, seen[node]))
        return pd.DataFrame(rows, columns=["id", "preorder", "discovery", "finish", "parent"])

    return part.unionByName(own).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda pdf: search(pdf), f"id {kind}, preorder long, discovery long, finish long, parent {kind}")
