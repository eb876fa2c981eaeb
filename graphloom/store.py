"""A mutable handle on an immutable graph, for programs that add and change things one by one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import NotFound
from .model import Graph
from .operators import components, louvain, mutate, node2vec, pagerank, paths, traversal, triangles
from .sources import importer, render, store


class GraphStore:
    """Nodes and edges by id, labels, properties and query text; single additions are buffered until something reads."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None):
        self.spark, self._graph = spark, graph or Graph(spark)
        self._nodes: list[tuple[str, tuple[str, ...], dict]] = []
        self._edges: list[tuple[str, str, str, str, dict]] = []
        self._alias: dict[str, str] = {}

    # --- buffered additions
    @property
    def graph(self) -> Graph:
        """The graph with all additions in it."""
        if self._nodes:
            self._graph, ids = mutate.add_nodes(self._graph, [(labels, props) for _, labels, props in self._nodes], [h for h, _, _ in self._nodes])
            self._alias.update({h: i for (h, _, _), i in zip(self._nodes, ids)})
            self._nodes = []
        if self._edges:
            rows = [(self._id(s), self._id(d), t, p) for _, s, d, t, p in self._edges]
            self._graph, ids = mutate.add_edges(self._graph, rows, check=False)
            self._alias.update({e[0]: i for e, i in zip(self._edges, ids)})
            self._edges = []
        return self._graph

    @graph.setter
    def graph(self, graph: Graph) -> None:
        self._graph, self._nodes, self._edges = graph, [], []

    def _id(self, handle: str) -> str:
        return self._alias.get(handle, handle)

    def _known(self, handle: str) -> bool:
        if any(h == handle for h, _, _ in self._nodes):
            return True
        try:
            return mutate.exists(self.graph, self._id(handle))
        except NotFound:
            return False

    def add_node(self, labels: list[str], properties: Mapping[str, object] | None = None) -> str:
        import uuid

        h = uuid.uuid4().hex
        self._nodes.append((h, tuple(labels), dict(properties or {})))
        return h

    def add_edge(self, from_id: str, to_id: str, relationship_type: str, properties: Mapping[str, object] | None = None) -> str:
        import uuid

        for end in (from_id, to_id):
            if not self._known(end):
                raise NotFound(f"no node {end}")
        h = uuid.uuid4().hex
        self._edges.append((h, from_id, to_id, relationship_type, dict(properties or {})))
        return h

    # --- reading
    def _rows(self, df: DataFrame) -> list[dict]:
        """Rows without absent properties, ids as the handles that the caller knows."""
        back = {v: k for k, v in self._alias.items()}
        out = []
        for r in df.collect():
            d = {k: v for k, v in render.plain(r).items() if v is not None}
            for k in ("_node_id", "_edge_id", "_src", "_dst"):
                if k in d:
                    d[k] = back.get(d[k], d[k])
            out.append(d)
        return out

    def get_node(self, node_id: str) -> dict | None:
        try:
            rows = self._rows(self.graph.node(self._id(node_id)))
        except NotFound:
            return None
        return rows[0] if rows else None

    def get_edge(self, edge_id: str) -> dict | None:
        g = self.graph
        try:
            rows = self._rows(g.edge(self._id(edge_id)))
        except NotFound:
            return None
        return rows[0] if rows else None

    def find_nodes_by_label(self, label: str) -> list[dict]:
        return self._rows(self.graph.nodes_by_label(label))

    def find_nodes_by_property(self, key: str, value: object) -> list[dict]:
        return self._rows(self.graph.nodes_by_property(key, value))

    def find_edges_by_type(self, type_: str) -> list[dict]:
        return self._rows(self.graph.edges_by_type(type_))

    def get_all_nodes(self) -> list[dict]:
        return self._rows(self.graph.all_nodes())

    def get_all_edges(self) -> list[dict]:
        return self._rows(self.graph.all_edges())

    def get_outgoing_edges(self, node_id: str) -> list[dict]:
        g = self.graph
        return self._rows(g.out_edges(self._id(node_id)))

    def get_incoming_edges(self, node_id: str) -> list[dict]:
        g = self.graph
        return self._rows(g.in_edges(self._id(node_id)))

    def node_count(self) -> int:
        return self.graph.node_count()

    def edge_count(self) -> int:
        return self.graph.edge_count()

    # --- changing
    def update_node(self, node_id: str, properties: Mapping[str, object]) -> None:
        g = self.graph
        self._graph = mutate.update_node(g, self._id(node_id), properties)

    def update_edge(self, edge_id: str, properties: Mapping[str, object]) -> None:
        g = self.graph
        self._graph = mutate.update_edge(g, self._id(edge_id), properties)

    def delete_node(self, node_id: str) -> None:
        g = self.graph
        self._graph = mutate.delete_node(g, self._id(node_id))

    def delete_edge(self, edge_id: str) -> None:
        g = self.graph
        self._graph = mutate.delete_edge(g, self._id(edge_id))

    def clear(self) -> None:
        self.graph = Graph(self.spark)

    # --- queries
    def execute_cypher(self, text: str, params: Mapping[str, object] | None = None) -> dict:
        """Reading: {columns, rows, row_count, execution_time_ms}, a lone returned node or edge spread into columns.
        Writing: the graph changes and the result is empty."""
        from .plans import parser

        if parser.parse(text).writes:
            self._graph = self.graph.apply(text, params)
            return {"columns": [], "rows": [], "row_count": 0, "execution_time_ms": 0}
        df = self.graph.cypher(text, params)
        if len(df.columns) == 1 and df.schema[0].dataType.typeName() == "struct":
            df = df.select(F.col(f"`{df.columns[0]}`.*"))
        return render.to_result(df)

    # --- import, disk
    def import_csv_nodes(self, path: str, options: importer.ImportOptions = importer.ImportOptions()) -> importer.ImportResult:
        return self._imported(importer.import_csv_nodes(self.graph, path, options))

    def import_csv_edges(self, path: str, options: importer.ImportOptions = importer.ImportOptions()) -> importer.ImportResult:
        return self._imported(importer.import_csv_edges(self.graph, path, options))

    def import_json_nodes(self, path: str, options: importer.ImportOptions = importer.ImportOptions()) -> importer.ImportResult:
        return self._imported(importer.import_json_nodes(self.graph, path, options))

    def import_json_edges(self, path: str, options: importer.ImportOptions = importer.ImportOptions()) -> importer.ImportResult:
        return self._imported(importer.import_json_edges(self.graph, path, options))

    def _imported(self, result: importer.ImportResult) -> importer.ImportResult:
        self.graph = result.graph
        return result

    def save(self, path: str) -> None:
        store.save(self.graph, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphStore:
        return cls(spark, store.open_graph(spark, path))

    def stats(self, path: str | None = None) -> dict:
        return store.stats(self.graph, path)

    # --- algorithms, as DataFrames over ids
    def _frames(self, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
        g = self.graph
        return g.vertex_frame(), g.edge_frame(weight=weight)

    def bfs(self, start: str, max_depth: int | None = None) -> DataFrame:
        nodes, edges = self._frames()
        return traversal.bfs(nodes, edges, self._id(start), max_depth)

    def dfs(self, start: str) -> DataFrame:
        nodes, edges = self._frames()
        return traversal.dfs(nodes, edges, self._id(start))

    def dijkstra(self, source: str, weight_property: str = "weight") -> DataFrame:
        nodes, edges = self._frames(weight_property)
        return paths.shortest_paths(nodes, edges, self._id(source))

    def connected_components(self) -> DataFrame:
        return components.connected_components(*self._frames())

    def pagerank(self, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> pagerank.Ranks:
        return pagerank.pagerank(*self._frames(), damping, max_iterations, tolerance)

    def triangle_count(self) -> DataFrame:
        return triangles.triangle_counts(*self._frames())

    def louvain(self, max_iterations: int = 100, min_improvement: float = 0.0) -> louvain.Communities:
        return louvain.louvain(*self._frames(), max_iterations, min_improvement=min_improvement)

    def node2vec(self, walk_length: int = 80, walks_per_node: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
        return node2vec.node2vec(*self._frames(), walk_length, walks_per_node, p, q, seed)
