"""The mutation log: an append-only Parquet dataset in segments, and its replay.

Rows are (lsn, txn_id, op, entity, labels, src, dst, type, props): ``props`` is JSON text.  Operations are
``OPERATIONS``; only those of committed transactions are replayed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import CorruptLog

# The kinds of log records.
OPERATIONS = ("begin", "commit", "abort", "insert_node", "update_node", "delete_node", "insert_edge", "update_edge", "delete_edge", "checkpoint")
SCHEMA = "lsn long, txn_id long, op string, entity string, labels array<string>, src string, dst string, type string, props string"


class MutationLog:
    """One writer at a time; ``lsn`` goes on from the largest that is there."""

    def __init__(self, spark: SparkSession, path: str, segment_size: int = 1000):
        self.spark, self.path, self.segment_size = spark, path.rstrip("/"), segment_size
        self.buffer: list[tuple] = []
        last = self.read().agg(F.max("lsn")).first()[0]
        self.next_lsn = 0 if last is None else last + 1

    def _there(self) -> bool:
        from ..sources.store import _exists

        return _exists(self.spark, self.path)

    def read(self) -> DataFrame:
        """All readable records; ``verified`` tells whether any but the last are missing."""
        if not self._there():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(self.path)

    def verified(self) -> DataFrame:
        """The records, if their numbers run from 0 without a gap or a repetition; else ``CorruptLog``.

        A torn file at the tail leaves no gap and is skipped, like a torn record."""
        log = self.read()
        n, distinct, last = log.agg(F.count("*"), F.count_distinct("lsn"), F.max("lsn")).first()
        if n and (n != last + 1 or distinct != n):
            raise CorruptLog(f"{last + 1 - distinct} records missing and {n - distinct} repeated up to lsn {last}")
        return log

    def append(self, txn_id: int, op: str, entity: str | None = None, labels: Iterable[str] | None = None, src: str | None = None, dst: str | None = None, type: str | None = None, props: Mapping[str, object] | None = None) -> int:
        if op not in OPERATIONS:
            raise ValueError(f"unknown operation {op}")
        lsn = self.next_lsn
        self.next_lsn += 1
        self.buffer.append((lsn, txn_id, op, entity, list(labels) if labels is not None else None, src, dst, type, json.dumps(props) if props is not None else None))
        if len(self.buffer) >= self.segment_size:
            self.flush()
        return lsn

    def flush(self) -> None:
        if self.buffer:
            self.spark.createDataFrame(self.buffer, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.buffer = []

    def checkpoint(self) -> int:
        """A marker; nothing is cut off.  Replay may start after it, from a saved graph."""
        lsn = self.append(-1, "checkpoint")
        self.flush()
        return lsn


def committed(log: DataFrame, after: int | None = None) -> DataFrame:
    """Records of committed transactions, the markers left out."""
    done = log.where("op = 'commit'").select("txn_id").distinct()
    rows = log.where(~F.col("op").isin("begin", "commit", "abort", "checkpoint"))
    return (rows.where(F.col("lsn") > after) if after is not None else rows).join(done, "txn_id", "left_semi")


def replayed_count(log: DataFrame) -> int:
    """Entries of committed transactions, begin and commit markers included."""
    done = log.where("op = 'commit'").select("txn_id").distinct()
    return log.join(done, "txn_id", "left_semi").count()


def replay(log: DataFrame, after: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the log: of each entity the record of the highest lsn, unless that deletes it.

    Edges of a node that is deleted after they were written go with it.
    """
    rows = committed(log, after)
    last = F.max_by(F.struct("op", "labels", "src", "dst", "type", "props", "lsn"), "lsn").alias("r")
    made = F.max_by(F.when(F.col("op").startswith("insert"), F.struct("labels", "src", "dst", "type")), F.when(F.col("op").startswith("insert"), F.col("lsn"))).alias("m")
    node_rows, edge_rows = rows.where(F.col("op").endswith("_node")), rows.where(F.col("op").endswith("_edge"))
    all_nodes = node_rows.groupBy("entity").agg(last, made)
    nodes = all_nodes.where("r.op <> 'delete_node'").select("entity", F.coalesce("r.labels", "m.labels").alias("labels"), F.col("r.props").alias("props"))
    edges = edge_rows.groupBy("entity").agg(last, made).where("r.op <> 'delete_edge'")
    edges = edges.select("entity", F.coalesce("r.src", "m.src").alias("src"), F.coalesce("r.dst", "m.dst").alias("dst"), F.coalesce("r.type", "m.type").alias("type"), F.col("r.props").alias("props"), F.col("r.lsn").alias("lsn"))
    gone = all_nodes.where("r.op = 'delete_node'").select(F.col("entity").alias("g"), F.col("r.lsn").alias("gl"))
    for end in ("src", "dst"):
        edges = edges.join(gone, (F.col(end) == F.col("g")) & (F.col("lsn") < F.col("gl")), "left_anti")
    return nodes, edges.drop("lsn")


def recover(log: DataFrame, onto=None, after: int | None = None):
    """The graph that the log's committed transactions make, onto a saved graph (and only what follows ``after``) or from nothing."""
    from ..model import Graph
    from ..sources.importer import ImportOptions, from_records

    nodes, edges = replay(log, after)
    return from_records(onto or Graph(log.sparkSession), nodes, edges, ImportOptions(max_errors=0)).graph
