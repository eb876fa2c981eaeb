"""The property graph as a catalog of label tables and edge tables.

A :class:`NodeTable` is one DataFrame per kind of node, with a raw key column; the node's id is
``<table>:<key>``.  An :class:`EdgeTable` joins exactly one node table to another by raw keys, so a hop is a
plain equi-join and Catalyst prunes columns and pushes predicates into the files.  A :class:`Graph` is
immutable: every mutation returns a new one, and rolling back is dropping the reference.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .errors import NotFound

#: Column of the stable edge key that a table without one gets from its files.
ROW_KEY = "__row"


@dataclass(frozen=True)
class NodeTable:
    name: str
    df: DataFrame
    key: str
    labels: tuple[str, ...]
    props: Mapping[str, str]  # property -> column
    extra: Mapping[str, str] = field(default_factory=dict)  # label -> SQL condition of the nodes that carry it too

    def may_have(self, label: str) -> bool:
        return label in self.labels or label in self.extra

    def with_labels(self, labels: Iterable[str]) -> DataFrame | None:
        """The rows that carry all the labels; None if no row can."""
        df = self.df
        for label in labels:
            if label in self.labels:
                continue
            if label not in self.extra:
                return None
            df = df.where(self.extra[label])
        return df

    def id_of(self, key: Column) -> Column:
        return F.concat(F.lit(f"{self.name}:"), key.cast("string"))

    def labels_of(self) -> Column:
        """Array of the labels of a row of ``df``, fixed labels first."""
        fixed = F.array(*[F.lit(x) for x in self.labels]).cast("array<string>")
        if not self.extra:
            return fixed
        more = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(x)) for x, c in self.extra.items()]))
        return F.concat(fixed, more)

    def type_of(self, prop: str) -> T.DataType | None:
        return self.df.schema[self.props[prop]].dataType if prop in self.props else None


@dataclass(frozen=True)
class EdgeTable:
    name: str
    type: str
    df: DataFrame
    src: tuple[str, str]  # node table, column
    dst: tuple[str, str]
    props: Mapping[str, str] = field(default_factory=dict)
    key: str | None = None  # a unique column; None: the row's place in its file

    def keyed(self) -> tuple[DataFrame, str]:
        """The rows with a column that tells parallel edges apart."""
        if self.key:
            return self.df, self.key
        return self.df.withColumn(ROW_KEY, F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index"))), ROW_KEY

    def type_of(self, prop: str) -> T.DataType | None:
        return self.df.schema[self.props[prop]].dataType if prop in self.props else None


def common_type(kinds: Iterable[T.DataType]) -> T.DataType:
    """The type that a property takes when tables are united: itself, double for numbers, else string."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return T.StringType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    return T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds) else T.StringType()


def as_type(c: Column, own: T.DataType, to: T.DataType) -> Column:
    """A column in a common type; nested values become JSON text where the common type is text."""
    if own == to:
        return c
    nested = isinstance(own, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
    return F.to_json(c) if nested and isinstance(to, T.StringType) else c.cast(to)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns are null and clashing types are widened."""
    kinds: dict[str, list[T.DataType]] = {}
    for p in parts:
        for f in p.schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    types = {c: common_type(k) for c, k in kinds.items()}

    def shaped(p: DataFrame) -> DataFrame:
        own = {f.name: f.dataType for f in p.schema}
        return p.select(*[as_type(F.col(f"`{c}`"), own[c], t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in types.items()])

    return reduce(DataFrame.unionByName, [shaped(p) for p in parts])


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: Mapping[str, NodeTable] = field(default_factory=dict)
    edges: Mapping[str, EdgeTable] = field(default_factory=dict)

    # --- catalog
    def with_node_table(self, t: NodeTable) -> Graph:
        return replace(self, nodes={**self.nodes, t.name: t})

    def with_edge_table(self, t: EdgeTable) -> Graph:
        return replace(self, edges={**self.edges, t.name: t})

    def labels(self) -> list[str]:
        return sorted({x for t in self.nodes.values() for x in (*t.labels, *t.extra)})

    def edge_types(self) -> list[str]:
        return sorted({t.type for t in self.edges.values()})

    # --- queries
    def cypher(self, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
        """The rows of a reading statement, lazily."""
        from .plans.compiler import run_read

        return run_read(self, text, params or {})

    def apply(self, text: str, params: Mapping[str, object] | None = None) -> Graph:
        """The graph after a writing statement."""
        from .plans.compiler import run_write

        return run_write(self, text, params or {})

    def explain(self, text: str, params: Mapping[str, object] | None = None, mode: str = "formatted") -> str:
        """Catalyst's plan of a reading statement."""
        df = self.cypher(text, params)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    # --- scans
    def _node_rows(self, t: NodeTable, df: DataFrame) -> DataFrame:
        return df.select(t.id_of(F.col(t.key)).alias("_node_id"), t.labels_of().alias("_labels"), *[F.col(c).alias(p) for p, c in t.props.items()])

    def _edge_rows(self, t: EdgeTable, df: DataFrame | None = None) -> DataFrame:
        rows, key = replace(t, df=df).keyed() if df is not None else t.keyed()
        return rows.select(
            F.concat(F.lit(f"{t.name}:"), F.col(key).cast("string")).alias("_edge_id"), self.nodes[t.src[0]].id_of(F.col(t.src[1])).alias("_src"), self.nodes[t.dst[0]].id_of(F.col(t.dst[1])).alias("_dst"), F.lit(t.type).alias("_type"),
            *[F.col(c).alias(p) for p, c in t.props.items()],
        )

    def _no_nodes(self) -> DataFrame:
        return self.spark.createDataFrame([], "_node_id string, _labels array<string>")

    def _no_edges(self) -> DataFrame:
        return self.spark.createDataFrame([], "_edge_id string, _src string, _dst string, _type string")

    def all_nodes(self) -> DataFrame:
        """(_node_id, _labels, properties...) of every node; absent properties are null."""
        return union_all([self._node_rows(t, t.df) for t in self.nodes.values()]) if self.nodes else self._no_nodes()

    def all_edges(self) -> DataFrame:
        """(_edge_id, _src, _dst, _type, properties...) of every edge."""
        return union_all([self._edge_rows(t) for t in self.edges.values()]) if self.edges else self._no_edges()

    def nodes_by_label(self, *labels: str) -> DataFrame:
        """Nodes that carry all the labels; an unknown label has none."""
        parts = [self._node_rows(t, df) for t in self.nodes.values() if (df := t.with_labels(labels)) is not None]
        return union_all(parts) if parts else self._no_nodes()

    def nodes_by_property(self, key: str, value: object) -> DataFrame:
        """Nodes whose property has that value and type; a node without it does not match."""
        from .functions.registry import kind_of, kind_of_value

        parts = [self._node_rows(t, t.df.where(F.col(t.props[key]).eqNullSafe(F.lit(value)))) for t in self.nodes.values() if key in t.props and (value is None or kind_of(t.type_of(key)) == kind_of_value(value))]
        return union_all(parts) if parts else self._no_nodes()

    def edges_by_type(self, type_: str) -> DataFrame:
        parts = [self._edge_rows(t) for t in self.edges.values() if t.type == type_]
        return union_all(parts) if parts else self._no_edges()

    def _split(self, node_id: str) -> tuple[NodeTable, str]:
        name, _, key = node_id.partition(":")
        if name not in self.nodes:
            raise NotFound(f"no node {node_id}")
        return self.nodes[name], key

    def node(self, node_id: str) -> DataFrame:
        """The node of an id (no row if there is none); the filter on the raw key reaches the files."""
        t, key = self._split(node_id)
        return self._node_rows(t, t.df.where(F.col(t.key) == F.lit(key).try_cast(t.df.schema[t.key].dataType)))

    def edge(self, edge_id: str) -> DataFrame:
        name, _, key = edge_id.partition(":")
        if name not in self.edges:
            raise NotFound(f"no edge {edge_id}")
        return self._edge_rows(self.edges[name]).where(F.col("_edge_id") == edge_id)

    def _incident(self, node_id: str, side: str) -> DataFrame:
        t, key = self._split(node_id)
        parts = []
        for e in self.edges.values():
            table, column = getattr(e, side)
            if table == t.name:
                rows, own = e.keyed()
                parts.append(self._edge_rows(replace(e, key=own), rows.where(F.col(column) == F.lit(key).try_cast(e.df.schema[column].dataType))))
        return union_all(parts) if parts else self._no_edges()

    def out_edges(self, node_id: str) -> DataFrame:
        return self._incident(node_id, "src")

    def in_edges(self, node_id: str) -> DataFrame:
        return self._incident(node_id, "dst")

    # --- counts
    def node_count(self) -> int:
        return sum(t.df.count() for t in self.nodes.values())

    def edge_count(self) -> int:
        return sum(t.df.count() for t in self.edges.values())

    def label_counts(self) -> DataFrame:
        """(label, nodes): one row for each label that a node carries."""
        return self.all_nodes().select(F.explode("_labels").alias("label")).groupBy("label").agg(F.count("*").alias("nodes"))

    # --- views for the algorithms
    def vertex_frame(self, *labels: str) -> DataFrame:
        """(id) of all nodes, or of those with any of the labels."""
        tables = [t for t in self.nodes.values() if not labels or any(t.may_have(x) for x in labels)]
        parts = []
        for t in tables:
            df = t.df
            if labels and not set(labels) & set(t.labels):
                df = df.where(reduce(Column.__or__, [F.expr(t.extra[x]) for x in labels if x in t.extra]))
            parts.append(df.select(t.id_of(F.col(t.key)).alias("id")))
        return union_all(parts) if parts else self.spark.createDataFrame([], "id string")

    def edge_frame(self, *types: str, weight: str | None = None) -> DataFrame:
        """(src, dst, eid, weight): numeric weights as doubles, anything else counts as 1."""
        parts = []
        for t in self.edges.values():
            if types and t.type not in types:
                continue
            rows, key = t.keyed()
            numeric = weight and isinstance(t.type_of(weight), T.NumericType)
            w = F.coalesce(F.col(t.props[weight]).cast("double"), F.lit(1.0)) if numeric else F.lit(1.0)
            parts.append(rows.select(self.nodes[t.src[0]].id_of(F.col(t.src[1])).alias("src"), self.nodes[t.dst[0]].id_of(F.col(t.dst[1])).alias("dst"), F.concat(F.lit(f"{t.name}:"), F.col(key).cast("string")).alias("eid"), w.alias("weight")))
        return union_all(parts) if parts else self.spark.createDataFrame([], "src string, dst string, eid string, weight double")
