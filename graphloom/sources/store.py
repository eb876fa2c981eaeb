"""Graphs on disk: one Parquet folder per table and a catalog file; versioned snapshots on top."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import NotFound
from ..model import EdgeTable, Graph, NodeTable


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet; an empty frame still leaves its schema."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parquet_metadata(spark: SparkSession, path: str) -> dict:
    """Rows and columns of a Parquet folder; the count comes from the footers."""
    df = spark.read.parquet(path)
    return {"num_rows": df.count(), "columns": {f.name: f.dataType.simpleString() for f in df.schema}}


def save(graph: Graph, path: str) -> None:
    """Write every table and the catalog; the catalog is written last, so a broken save is not opened."""
    spark = graph.spark
    catalog: dict = {"nodes": [], "edges": []}
    for t in graph.nodes.values():
        write_parquet(t.df, f"{path}/nodes/{t.name}")
        catalog["nodes"].append({"name": t.name, "key": t.key, "labels": list(t.labels), "props": dict(t.props), "extra": dict(t.extra)})
    for e in graph.edges.values():
        df, key = e.keyed()
        write_parquet(df, f"{path}/edges/{e.name}")
        catalog["edges"].append({"name": e.name, "type": e.type, "src": list(e.src), "dst": list(e.dst), "props": dict(e.props), "key": key})
    spark.createDataFrame([(json.dumps(catalog),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")


def open_graph(spark: SparkSession, path: str) -> Graph:
    if not _exists(spark, f"{path}/catalog"):
        raise NotFound(f"no graph at {path}")
    catalog = json.loads(spark.read.text(f"{path}/catalog").first()["value"])
    g = Graph(spark)
    for t in catalog["nodes"]:
        g = g.with_node_table(NodeTable(t["name"], spark.read.parquet(f"{path}/nodes/{t['name']}"), t["key"], tuple(t["labels"]), t["props"], t["extra"]))
    for e in catalog["edges"]:
        g = g.with_edge_table(EdgeTable(e["name"], e["type"], spark.read.parquet(f"{path}/edges/{e['name']}"), tuple(e["src"]), tuple(e["dst"]), e["props"], e["key"]))
    return g


def stats(graph: Graph, path: str | None = None) -> dict:
    """Node and edge counts, and the bytes under a saved path."""
    size = 0
    if path and _exists(graph.spark, path):
        fs, p = _file_system(graph.spark, path)
        size = fs.getContentSummary(p).getLength()
    return {"node_count": graph.node_count(), "edge_count": graph.edge_count(), "size_on_disk_bytes": size}


class Snapshots:
    """Numbered saves under one folder, listed newest first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _schema(self) -> str:
        return "id string, created_at long, node_count long, edge_count long"

    def list(self) -> DataFrame:
        """(id, created_at, node_count, edge_count), newest first."""
        there = _exists(self.spark, f"{self.path}/metadata")
        df = self.spark.read.schema(self._schema()).json(f"{self.path}/metadata") if there else self.spark.createDataFrame([], self._schema())
        gone = self.spark.read.schema("id string").json(f"{self.path}/deleted") if _exists(self.spark, f"{self.path}/deleted") else self.spark.createDataFrame([], "id string")
        return df.join(gone, "id", "left_anti").orderBy(F.desc("created_at"), F.desc("id"))

    def create(self, graph: Graph, snapshot_id: str | None = None) -> str:
        snapshot_id = snapshot_id or uuid.uuid4().hex
        save(graph, f"{self.path}/data/{snapshot_id}")
        row = [(snapshot_id, time.time_ns() // 1000, graph.node_count(), graph.edge_count())]
        self.spark.createDataFrame(row, self._schema()).coalesce(1).write.mode("append").json(f"{self.path}/metadata")
        return snapshot_id

    def get(self, snapshot_id: str) -> Graph:
        if not self.list().where(F.col("id") == snapshot_id).count():
            raise NotFound(f"no snapshot {snapshot_id}")
        return open_graph(self.spark, f"{self.path}/data/{snapshot_id}")

    def delete(self, snapshot_id: str) -> None:
        if not self.list().where(F.col("id") == snapshot_id).count():
            raise NotFound(f"no snapshot {snapshot_id}")
        self.spark.createDataFrame([(snapshot_id,)], "id string").coalesce(1).write.mode("append").json(f"{self.path}/deleted")
        fs, p = _file_system(self.spark, f"{self.path}/data/{snapshot_id}")
        fs.delete(p, True)

    def cleanup(self, keep: int) -> int:
        """Delete all but the newest; how many went."""
        old = [r["id"] for r in self.list().offset(keep).collect()] if keep else [r["id"] for r in self.list().collect()]
        for x in old:
            self.delete(x)
        return len(old)


def newest(df: DataFrame, keep: int, by: str, partition: str | None = None) -> DataFrame:
    """The ``keep`` newest rows, of each partition if one is named."""
    from pyspark.sql import Window

    if partition is None:
        return df.orderBy(F.desc(by)).limit(keep)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(by)))).where(F.col("_r") <= keep).drop("_r")
