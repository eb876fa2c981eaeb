"""Mutations: each returns a new graph whose tables are plans over the old ones.

Created rows become tables of their own, one for each label set and property signature, so every table stays typed.
Deletions are anti-joins, and deleting nodes cascades to their edges.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import InvalidOperation, NotFound
from ..functions.registry import kind_of, kind_of_value
from ..model import EdgeTable, Graph, NodeTable, common_type
from ..plans import ast as A
from ..plans.compiler import Matched, Matcher, Scope, _ref
from ..session import stage

_serial = itertools.count()
_TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType()}


def _fresh(prefix: str) -> str:
    return f"{prefix}{next(_serial)}_{uuid.uuid4().hex[:8]}"


def _signature(props: Mapping[str, object]) -> tuple[tuple[str, str], ...]:
    return tuple(sorted((k, kind_of_value(v)) for k, v in props.items()))


def _frame(graph: Graph, fixed: list[tuple[str, T.DataType]], rows: list[tuple], signature: tuple[tuple[str, str], ...], props: list[Mapping[str, object]]) -> DataFrame:
    """Rows with typed property columns ``p_<key>``; lists and maps travel as JSON and become variants."""
    fields = [T.StructField(n, t) for n, t in fixed]
    nested = [k for k, kind in signature if kind in ("list", "other")]
    fields += [T.StructField(f"p_{k}", T.StringType() if k in nested or kind == "null" else _TYPES[kind]) for k, kind in signature]
    data = [(*r, *[json.dumps(p[k]) if k in nested else p[k] for k, _ in signature]) for r, p in zip(rows, props)]
    df = graph.spark.createDataFrame(data, T.StructType(fields))
    return df.withColumns({f"p_{k}": F.parse_json(f"p_{k}") for k in nested}) if nested else df


def add_nodes(graph: Graph, nodes: list[tuple[tuple[str, ...], Mapping[str, object]]], keys: list[str] | None = None) -> tuple[Graph, list[str]]:
    """Add (labels, properties) nodes; their ids, in order.  Keys default to random ones."""
    ids: list[str] = [""] * len(nodes)
    groups: dict[tuple, list[int]] = {}
    for i, (labels, props) in enumerate(nodes):
        groups.setdefault((tuple(dict.fromkeys(labels)), _signature(props)), []).append(i)
    for (labels, signature), members in groups.items():
        name = _fresh("n")
        own = [keys[i] if keys else uuid.uuid4().hex for i in members]
        df = _frame(graph, [("_key", T.StringType())], [(k,) for k in own], signature, [nodes[i][1] for i in members])
        graph = graph.with_node_table(NodeTable(name, df, "_key", labels, {k: f"p_{k}" for k, _ in signature}))
        for i, k in zip(members, own):
            ids[i] = f"{name}:{k}"
    return graph, ids


def exists(graph: Graph, node_id: str) -> bool:
    t, key = graph._split(node_id)
    return bool(t.df.where(F.col(t.key) == F.lit(key).try_cast(t.df.schema[t.key].dataType)).limit(1).count())


def add_edges(graph: Graph, edges: list[tuple[str, str, str, Mapping[str, object]]], check: bool = True) -> tuple[Graph, list[str]]:
    """Add (source id, target id, type, properties) edges; both ends must exist."""
    ids: list[str] = [""] * len(edges)
    groups: dict[tuple, list[int]] = {}
    for i, (src, dst, type_, props) in enumerate(edges):
        if check:
            for end in (src, dst):
                if not exists(graph, end):
                    raise NotFound(f"no node {end}")
        groups.setdefault((graph._split(src)[0].name, graph._split(dst)[0].name, type_, _signature(props)), []).append(i)
    for (s, d, type_, signature), members in groups.items():
        name = _fresh("e")
        own = [uuid.uuid4().hex for _ in members]
        rows = [(k, edges[i][0].partition(":")[2], edges[i][1].partition(":")[2]) for k, i in zip(own, members)]
        df = _frame(graph, [("_key", T.StringType()), ("_src", T.StringType()), ("_dst", T.StringType())], rows, signature, [edges[i][3] for i in members])
        df = df.withColumn("_src", F.col("_src").cast(graph.nodes[s].df.schema[graph.nodes[s].key].dataType)).withColumn("_dst", F.col("_dst").cast(graph.nodes[d].df.schema[graph.nodes[d].key].dataType))
        graph = graph.with_edge_table(EdgeTable(name, type_, df, (s, "_src"), (d, "_dst"), {k: f"p_{k}" for k, _ in signature}, "_key"))
        for i, k in zip(members, own):
            ids[i] = f"{name}:{k}"
    return graph, ids


def delete_nodes(graph: Graph, table: str, keys: DataFrame) -> Graph:
    """Remove the nodes of one table whose key is in the one column of ``keys``, and every edge that touches them."""
    keys = keys.toDF("_gone").where("_gone is not null").distinct()
    t = graph.nodes[table]
    graph = graph.with_node_table(replace(t, df=t.df.join(keys, F.col(t.key) == F.col("_gone"), "left_anti")))
    for e in list(graph.edges.values()):
        for end in (e.src, e.dst):
            if end[0] == table:
                df, key = e.keyed()
                e = replace(e, df=df.join(keys, F.col(end[1]) == F.col("_gone"), "left_anti"), key=key)
                graph = graph.with_edge_table(e)
    return graph


def delete_edges(graph: Graph, table: str, keys: DataFrame) -> Graph:
    """Remove the edges of one table by key; their nodes stay."""
    e = graph.edges[table]
    df, key = e.keyed()
    return graph.with_edge_table(replace(e, df=df.join(keys.toDF("_gone").distinct(), F.col(key) == F.col("_gone"), "left_anti"), key=key))


def delete_node(graph: Graph, node_id: str) -> Graph:
    t, key = graph._split(node_id)
    if not exists(graph, node_id):
        raise NotFound(f"no node {node_id}")
    return delete_nodes(graph, t.name, graph.spark.createDataFrame([(key,)], "k string").select(F.col("k").cast(t.df.schema[t.key].dataType)))


def delete_edge(graph: Graph, edge_id: str) -> Graph:
    name, _, key = edge_id.partition(":")
    if name not in graph.edges or not graph.edge(edge_id).limit(1).count():
        raise NotFound(f"no edge {edge_id}")
    df, own = graph.edges[name].keyed()
    return delete_edges(graph, name, graph.spark.createDataFrame([(key,)], "k string").select(F.col("k").cast(df.schema[own].dataType)))


def _widened(df: DataFrame, column: str, cond: Column, value: Column, kind: T.DataType) -> DataFrame:
    """``column`` (made if absent) with ``value`` where ``cond`` holds; clashing types are widened."""
    if column not in df.columns:
        return df.withColumn(column, F.when(cond, value))
    old = df.schema[column].dataType
    to = old if isinstance(kind, T.NullType) else common_type([old, kind])
    return df.withColumn(column, F.when(cond, value.cast(to)).otherwise(F.col(column).cast(to)))


def _set_literal(df: DataFrame, props: dict[str, str], cond: Column, updates: Mapping[str, object]) -> tuple[DataFrame, dict[str, str]]:
    for k, v in updates.items():
        column = props.get(k, f"p_{k}")
        kind = T.NullType() if v is None else _TYPES.get(kind_of_value(v))
        if kind is None:
            value, kind = F.parse_json(F.lit(json.dumps(v))), T.VariantType()
        else:
            value = F.lit(v).cast(kind) if v is not None else F.lit(None)
        df = _widened(df, column, cond, value, kind)
        props[k] = column
    return df, props


def update_node(graph: Graph, node_id: str, updates: Mapping[str, object], merge: bool = True) -> Graph:
    """Give a node these properties; without ``merge`` its others are dropped (set to null)."""
    t, key = graph._split(node_id)
    if not exists(graph, node_id):
        raise NotFound(f"no node {node_id}")
    wanted = dict(updates) if merge else {**{p: None for p in t.props}, **updates}
    df, props = _set_literal(t.df, dict(t.props), F.col(t.key) == F.lit(key).cast(t.df.schema[t.key].dataType), wanted)
    return graph.with_node_table(replace(t, df=df, props=props))


def update_edge(graph: Graph, edge_id: str, updates: Mapping[str, object], merge: bool = True) -> Graph:
    name, _, key = edge_id.partition(":")
    if name not in graph.edges or not graph.edge(edge_id).limit(1).count():
        raise NotFound(f"no edge {edge_id}")
    e = graph.edges[name]
    df, own = e.keyed()
    wanted = dict(updates) if merge else {**{p: None for p in e.props}, **updates}
    df, props = _set_literal(df, dict(e.props), F.col(own).cast("string") == key, wanted)
    return graph.with_edge_table(replace(e, df=df, props=props, key=own))


def add_label(graph: Graph, table: str, label: str, where: str | None = None) -> Graph:
    """Give all nodes of a table a label, or those that meet a SQL condition on its columns."""
    t = graph.nodes[table]
    if label in t.labels:
        return graph
    if where is None:
        return graph.with_node_table(replace(t, labels=(*t.labels, label), extra={k: v for k, v in t.extra.items() if k != label}))
    old = t.extra.get(label)
    return graph.with_node_table(replace(t, extra={**t.extra, label: f"({old}) or ({where})" if old else where}))


def remove_label(graph: Graph, table: str, label: str) -> Graph:
    t = graph.nodes[table]
    return graph.with_node_table(replace(t, labels=tuple(x for x in t.labels if x != label), extra={k: v for k, v in t.extra.items() if k != label}))


def clear(graph: Graph) -> Graph:
    return Graph(graph.spark)


def dangling(graph: Graph, edge: str) -> DataFrame:
    """Rows of an edge table whose source or target node is missing."""
    e = graph.edges[edge]
    s, d = graph.nodes[e.src[0]], graph.nodes[e.dst[0]]
    left = e.df.join(s.df.select(F.col(s.key).alias("_k")), F.col(e.src[1]) == F.col("_k"), "left_anti")
    right = e.df.join(s.df.select(F.col(s.key).alias("_k")), F.col(e.src[1]) == F.col("_k"), "left_semi").join(d.df.select(F.col(d.key).alias("_l")), F.col(e.dst[1]) == F.col("_l"), "left_anti")
    return left.unionByName(right)


# --- statements
def execute(graph: Graph, s: A.Statement, params: Mapping[str, object]) -> Graph:
    exprs = [e for p in (*s.create, *([s.merge] if s.merge else [])) for e in _pattern_exprs(p)] + [e for prop, x in s.sets for e in (prop, x)]
    if not s.match:
        scope = Scope(graph, {}, params)
        for p in s.create:
            graph = _create_plain(graph, p, scope)
        return _merge_plain(graph, s.merge, params) if s.merge else graph
    bound = {n.var for p in s.match for n in p.nodes} | {r.var for p in s.match for r in p.rels}
    needed = [e for e in exprs if _vars(e) <= bound]
    for e in s.delete:
        if not isinstance(e, A.Var) or e.name not in bound:
            raise InvalidOperation("DELETE takes bound variables")
    found = Matcher(graph, s.match, s.where, needed, params, need_all=tuple(e.name for e in s.delete)).run()
    out = graph
    for p in s.create:
        for m in found:
            out = _create_matched(out, p, m)
    if s.merge:
        for m in found:
            out = _create_matched(out, s.merge, m, merge=True)
    if s.sets:
        out = _set_matched(out, s.sets, found)
    for e in s.delete:
        for m in found:
            b = m.scope.entity(e.name)
            keys = m.df.select(_ref(e.name, " key"))
            out = delete_nodes(out, b.table.name, keys) if b.is_node else delete_edges(out, b.table.name, keys)
    return out


def _vars(e) -> set[str]:
    from ..plans.compiler import variables

    return variables(e)


def _pattern_exprs(p: A.Pattern) -> list:
    return [v for x in (*p.nodes, *p.rels) for _, v in x.props]


def _plain_value(scope: Scope, e) -> object:
    """The Python value of an expression without variables."""
    if isinstance(e, A.Lit):
        return e.value
    if isinstance(e, A.Param):
        if e.name not in scope.params:
            raise InvalidOperation(f"parameter ${e.name} is not given")
        return scope.params[e.name]
    if isinstance(e, A.ListOf):
        return [_plain_value(scope, x) for x in e.items]
    return scope.graph.spark.range(1).select(scope.value(e).col).first()[0]


def _directed(p: A.Pattern):
    for a, r, b in zip(p.nodes, p.rels, p.nodes[1:]):
        if r.type is None or r.direction == "both":
            raise InvalidOperation("a created relationship needs a type and a direction")
        yield (a, r, b) if r.direction == "out" else (b, r, a)


def _create_plain(graph: Graph, p: A.Pattern, scope: Scope) -> Graph:
    distinct: dict[str, A.NodePattern] = {}
    for n in p.nodes:
        distinct.setdefault(n.var, n)
    graph, ids = add_nodes(graph, [(n.labels, {k: _plain_value(scope, v) for k, v in n.props}) for n in distinct.values()])
    at = dict(zip(distinct, ids))
    return add_edges(graph, [(at[a.var], at[b.var], r.type, {k: _plain_value(scope, v) for k, v in r.props}) for a, r, b in _directed(p)], check=False)[0]


def _merge_plain(graph: Graph, p: A.Pattern, params: Mapping[str, object]) -> Graph:
    """Create the pattern unless it is there already as a whole."""
    if any(m.df.limit(1).count() for m in Matcher(graph, (p,), None, [], params).run()):
        return graph
    return _create_plain(graph, p, Scope(graph, {}, params))


def _create_matched(graph: Graph, p: A.Pattern, m: Matched, merge: bool = False) -> Graph:
    """Create new nodes and edges for every matched row; with ``merge``, edges between bound nodes that exist are left out."""
    bound = m.scope.bound
    news = {n.var: n for n in p.nodes if n.var not in bound}
    if merge and news:
        raise InvalidOperation("MERGE after MATCH needs bound nodes")
    df = m.df
    if news:
        # keys are made once: the rows are written before their keys are used twice
        df = stage(df.withColumns({f"{v}. key": F.expr("uuid()") for v in news}), "created")
    tables: dict[str, str] = {}
    for v, n in news.items():
        values = {k: m.scope.value(e) for k, e in n.props}
        name = _fresh("n")
        rows = df.select(F.col(f"`{v}. key`").alias("_key"), *[x.col.alias(f"p_{k}") for k, x in values.items()])
        graph = graph.with_node_table(NodeTable(name, rows, "_key", n.labels, {k: f"p_{k}" for k in values}))
        tables[v] = name
    for a, r, b in _directed(p):
        ends = [tables.get(x.var) or bound[x.var].table.name for x in (a, b)]
        values = {k: m.scope.value(e) for k, e in r.props}
        rows = df.select(F.col(f"`{a.var}. key`").alias("_src"), F.col(f"`{b.var}. key`").alias("_dst"), *[x.col.alias(f"p_{k}") for k, x in values.items()])
        if merge:
            rows = rows.dropDuplicates()
            for e in list(graph.edges.values()):
                if (e.type, e.src[0], e.dst[0]) == (r.type, *ends) and set(values) <= set(e.props):
                    there = e.df.select(F.col(e.src[1]).alias("_s"), F.col(e.dst[1]).alias("_d"), *[F.col(e.props[k]).alias(f"_{k}") for k in values])
                    same = (F.col("_src") == F.col("_s")) & (F.col("_dst") == F.col("_d"))
                    for k in values:
                        same &= F.col(f"p_{k}").eqNullSafe(F.col(f"_{k}"))
                    rows = rows.join(there, same, "left_anti")
        rows = stage(rows.withColumn("_key", F.expr("uuid()")), "created")
        graph = graph.with_edge_table(EdgeTable(_fresh("e"), r.type, rows, (ends[0], "_src"), (ends[1], "_dst"), {k: f"p_{k}" for k in values}, "_key"))
    return graph


def _set_matched(graph: Graph, sets: tuple, found: list[Matched]) -> Graph:
    for prop, expr in sets:
        for m in found:
            b = m.scope.entity(prop.var)
            v = m.scope.value(expr)
            if v.kind == "null" and prop.key not in b.table.props:
                continue  # an absent property is null already
            rows = m.df.select(_ref(prop.var, " key").alias("_k"), v.col.alias("_v"), F.lit(True).alias("_hit"))
            rows = rows.groupBy("_k").agg(F.max("_v").alias("_v"), F.max("_hit").alias("_hit")) if v.kind != "null" else rows.select("_k", F.lit(None).cast("string").alias("_v"), "_hit").distinct()
            t = graph.nodes[b.table.name] if b.is_node else graph.edges[b.table.name]
            df, key = (t.df, t.key) if b.is_node else t.keyed()
            kind = T.NullType() if v.kind == "null" else rows.schema["_v"].dataType
            column = t.props.get(prop.key, f"p_{prop.key}")
            joined = _widened(df.join(rows, F.col(key) == F.col("_k"), "left"), column, F.col("_hit"), F.col("_v"), kind).drop("_k", "_v", "_hit")
            t = replace(t, df=joined, props={**t.props, prop.key: column}, key=key)
            graph = graph.with_node_table(t) if b.is_node else graph.with_edge_table(t)
    return graph
