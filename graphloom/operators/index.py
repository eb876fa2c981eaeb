"""Index registry and index-shaped lookups.

An index is an entry table (key, id) sorted by key when it is built, so that Parquet's statistics prune equality and
range lookups; there is nothing to maintain by hand, as tables are immutable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..errors import InvalidOperation, NotFound
from ..functions.registry import kind_of, kind_of_value
from ..model import Graph, union_all
from ..session import stage

HASH, BTREE = "hash", "btree"


@dataclass(frozen=True)
class Index:
    name: str
    kind: str  # hash or btree
    label: str | None = None
    property: str | None = None


def label_entries(graph: Graph) -> DataFrame:
    """(key, id): a row for each label of each node."""
    return graph.all_nodes().select(F.explode("_labels").alias("key"), F.col("_node_id").alias("id"))


def property_entries(graph: Graph, prop: str) -> DataFrame:
    """(key, id) of the nodes that have the property."""
    parts = [t.df.where(F.col(t.props[prop]).isNotNull()).select(F.col(t.props[prop]).alias("key"), t.id_of(F.col(t.key)).alias("id")) for t in graph.nodes.values() if prop in t.props]
    return union_all(parts) if parts else graph.spark.createDataFrame([], "key string, id string")


def entry_stats(entries: DataFrame) -> DataFrame:
    """(total_keys, total_values, max_values_per_key, avg_values_per_key); two levels, both combined map-side."""
    per_key = entries.groupBy("key").agg(F.count("*").alias("n"))
    return per_key.agg(F.count("*").alias("total_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_values"), F.coalesce(F.max("n"), F.lit(0)).alias("max_values_per_key"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_values_per_key"))


@dataclass
class IndexManager:
    """Indices by name.  Looking up something without an index gives no rows; dropping an unknown one is an error."""

    graph: Graph
    indices: dict[str, Index] = field(default_factory=dict)
    entries: dict[str, DataFrame] = field(default_factory=dict)

    def _create(self, index: Index) -> Index:
        if index.name in self.indices:
            raise InvalidOperation(f"index {index.name} exists")
        if (index.label is None) == (index.property is None):
            raise InvalidOperation("an index is on a label or on a property")
        self.indices[index.name] = index
        return index

    def create_hash_index(self, name: str, label: str | None = None, property: str | None = None) -> Index:
        return self._create(Index(name, HASH, label, property))

    def create_btree_index(self, name: str, label: str | None = None, property: str | None = None) -> Index:
        return self._create(Index(name, BTREE, label, property))

    def drop_index(self, name: str) -> None:
        if name not in self.indices:
            raise NotFound(f"no index {name}")
        del self.indices[name]
        self.entries.pop(name, None)

    def has_index(self, name: str) -> bool:
        return name in self.indices

    def list_indices(self) -> list[Index]:
        return sorted(self.indices.values(), key=lambda i: i.name)

    def index_count(self) -> int:
        return len(self.indices)

    def build(self, name: str) -> DataFrame:
        """The entries of an index, written sorted by key, so that lookups prune row groups."""
        if name not in self.indices:
            raise NotFound(f"no index {name}")
        if name not in self.entries:
            i = self.indices[name]
            rows = label_entries(self.graph).where(F.col("key") == i.label) if i.label else property_entries(self.graph, i.property)
            self.entries[name] = stage(rows.repartitionByRange("key").sortWithinPartitions("key"), f"index-{name}", free=False)
        return self.entries[name]

    def _find(self, kinds: tuple[str, ...], **on) -> Index | None:
        return next((i for i in self.list_indices() if i.kind in kinds and all(getattr(i, k) == v for k, v in on.items())), None)

    def _none(self) -> DataFrame:
        return self.graph.spark.createDataFrame([], "id string")

    def lookup_label(self, label: str) -> DataFrame:
        i = self._find((HASH, BTREE), label=label)
        return self.build(i.name).where(F.col("key") == label).select("id") if i else self._none()

    def lookup_property(self, key: str, value: object) -> DataFrame:
        i = self._find((HASH, BTREE), property=key)
        if i is None:
            return self._none()
        rows = self.build(i.name)
        return rows.where(F.col("key") == F.lit(value)).select("id") if kind_of(rows.schema["key"].dataType) == kind_of_value(value) else self._none()

    def range_property(self, key: str, start: object, end: object) -> DataFrame:
        """Nodes whose property is in [start, end), in the property's own order."""
        i = self._find((BTREE,), property=key)
        if i is None:
            if self._find((HASH,), property=key):
                raise InvalidOperation("a hash index has no order")
            return self._none()
        return self.build(i.name).where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end))).select("id")

    def stats(self, name: str) -> dict:
        return self.build(name).transform(entry_stats).first().asDict()
