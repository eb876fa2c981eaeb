"""From syntax tree and catalog to DataFrames.

The patterns of a MATCH are resolved against the catalog: every consistent choice of one table for each variable is an
*assignment*, a chain of equi-joins on raw keys.  Expressions are compiled for each assignment, where all types are
known; the assignments' results are united, and aggregation, DISTINCT, ORDER BY and LIMIT work on the union.
Only the columns that a statement names are selected, filters on one variable are placed on its table before any
join, and the chain starts at the most selective end; join strategies are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import InvalidOperation
from ..functions.registry import AGGREGATES, Value, arithmetic, call, compare, kind_of, literal, truth
from ..model import EdgeTable, Graph, NodeTable, as_type, common_type, union_all
from . import ast as A
from .parser import parse


# --- the tree
def children(e) -> tuple:
    if isinstance(e, A.Binary):
        return (e.left, e.right)
    if isinstance(e, A.Unary):
        return (e.arg,)
    if isinstance(e, A.Call):
        return e.args
    return e.items if isinstance(e, A.ListOf) else ()


def walk(e) -> Iterator:
    yield e
    for c in children(e):
        yield from walk(c)


def variables(e) -> set[str]:
    return {x.var if isinstance(x, A.Prop) else x.name for x in walk(e) if isinstance(x, (A.Prop, A.Var))}


def is_aggregate(e) -> bool:
    return isinstance(e, A.Call) and (e.star or e.name.lower() in AGGREGATES)


def has_aggregate(e) -> bool:
    return any(is_aggregate(x) for x in walk(e))


def conjuncts(e) -> list:
    if isinstance(e, A.Binary) and e.op == "AND":
        return [*conjuncts(e.left), *conjuncts(e.right)]
    return [] if e is None else [e]


# --- scope: variables bound to tables
@dataclass(frozen=True)
class Bound:
    table: NodeTable | EdgeTable

    @property
    def is_node(self) -> bool:
        return isinstance(self.table, NodeTable)


def col_name(var: str, prop: str) -> str:
    return f"{var}.{prop}"


def _ref(var: str, prop: str) -> Column:
    return F.col(f"`{col_name(var, prop)}`")


class Scope:
    """Compiles expressions against the bound columns ``var.prop`` of one assignment."""

    def __init__(self, graph: Graph, bound: Mapping[str, Bound], params: Mapping[str, object]):
        self.graph, self.bound, self.params = graph, bound, params
        self.shapes: Mapping[str, Mapping[str, T.DataType]] = {}  # properties of whole entities, the same for all assignments

    def entity(self, var: str) -> Bound:
        if var not in self.bound:
            raise InvalidOperation(f"variable {var} is not defined")
        return self.bound[var]

    def id_of(self, var: str) -> Column:
        b = self.entity(var)
        return F.concat(F.lit(f"{b.table.name}:"), _ref(var, " key").cast("string"))

    def whole(self, var: str) -> Column:
        t = self.entity(var).table
        if isinstance(t, NodeTable):
            head = [self.id_of(var).alias("_node_id"), _ref(var, " labels").alias("_labels")]
        else:
            ends = [self.graph.nodes[end[0]].id_of(_ref(var, f" {side}")).alias(f"_{side}") for side, end in (("src", t.src), ("dst", t.dst))]
            head = [self.id_of(var).alias("_edge_id"), *ends, F.lit(t.type).alias("_type")]
        shape = self.shapes.get(var) or {p: t.type_of(p) for p in t.props}
        return F.struct(*head, *[as_type(_ref(var, p), t.type_of(p), kind).alias(p) if p in t.props else F.lit(None).cast(kind).alias(p) for p, kind in shape.items()])

    def value(self, e) -> Value:
        if isinstance(e, A.Lit):
            return literal(e.value)
        if isinstance(e, A.Param):
            if e.name not in self.params:
                raise InvalidOperation(f"parameter ${e.name} is not given")
            return literal(self.params[e.name])
        if isinstance(e, A.ListOf):
            items = [self.value(x) for x in e.items]
            return Value(F.array(*[v.col for v in items]), "list")
        if isinstance(e, A.Prop):
            t = self.entity(e.var).table
            if e.key not in t.props:
                return Value(F.lit(None), "null")
            return Value(_ref(e.var, e.key), kind_of(t.type_of(e.key)))
        if isinstance(e, A.Var):
            return Value(self.whole(e.name), "node" if self.entity(e.name).is_node else "edge")
        if isinstance(e, A.Unary):
            if e.op == "-":
                v = self.value(e.arg)
                return arithmetic("-", literal(0 if v.kind == "int" else 0.0), v)
            if e.op == "NOT":
                return Value(~truth(self.value(e.arg)), "bool")
            v = self.value(e.arg)
            known = F.lit(False) if v.kind == "null" else _ref(e.arg.name, " key").isNotNull() if isinstance(e.arg, A.Var) else v.col.isNotNull()
            return Value(known if e.op == "IS NOT NULL" else ~known, "bool")
        if isinstance(e, A.Binary):
            return self.binary(e)
        if isinstance(e, A.Call):
            return self.call(e)
        raise InvalidOperation(f"cannot compile {e}")

    def binary(self, e: A.Binary) -> Value:
        if e.op in ("AND", "OR", "XOR"):
            a, b = truth(self.value(e.left)), truth(self.value(e.right))
            return Value(a & b if e.op == "AND" else a | b if e.op == "OR" else (a & ~b) | (~a & b), "bool")
        if e.op == "IN" and isinstance(e.right, A.ListOf):
            tests = [compare("=", self.value(e.left), self.value(x)).col for x in e.right.items]
            return Value(reduce(Column.__or__, tests), "bool") if tests else literal(False)
        if isinstance(e.left, A.Var) and isinstance(e.right, A.Var) and e.op in ("=", "<>") and {e.left.name, e.right.name} <= set(self.bound):
            a, b = self.id_of(e.left.name), self.id_of(e.right.name)
            return Value(a == b if e.op == "=" else a != b, "bool")
        a, b = self.value(e.left), self.value(e.right)
        if e.op == "IN":
            if b.kind != "list":
                raise InvalidOperation("IN needs a list")
            return Value(F.array_contains(b.col, a.col), "bool")
        if e.op in ("CONTAINS", "STARTS", "ENDS"):
            if (a.kind, b.kind) != ("str", "str"):
                return Value(F.lit(None).cast("boolean"), "bool")
            return Value({"CONTAINS": F.contains, "STARTS": F.startswith, "ENDS": F.endswith}[e.op](a.col, b.col), "bool")
        return arithmetic(e.op, a, b) if e.op in "+-*/%" else compare(e.op, a, b)

    def call(self, e: A.Call) -> Value:
        name = e.name.lower()
        if is_aggregate(e):
            raise InvalidOperation(f"{e.name} is not allowed here")
        if len(e.args) == 1 and isinstance(e.args[0], A.Var) and name in ("id", "labels", "type", "properties", "keys", "startnode", "endnode"):
            var = e.args[0].name
            t = self.entity(var).table
            if name == "id":
                return Value(self.id_of(var), "str")
            if name == "labels" and isinstance(t, NodeTable):
                return Value(_ref(var, " labels"), "list")
            if name == "type" and isinstance(t, EdgeTable):
                return Value(F.lit(t.type), "str")
            if name in ("startnode", "endnode") and isinstance(t, EdgeTable):
                end, side = (t.src, "src") if name == "startnode" else (t.dst, "dst")
                return Value(self.graph.nodes[end[0]].id_of(_ref(var, f" {side}")), "str")
            if name == "properties":
                return Value(F.struct(*[_ref(var, p).alias(p) for p in t.props]) if t.props else F.lit(None), "other")
            if name == "keys":
                return Value(F.array_compact(F.array(*[F.when(_ref(var, p).isNotNull(), F.lit(p)) for p in t.props])) if t.props else F.array().cast("array<string>"), "list")
            raise InvalidOperation(f"{e.name} does not apply to {var}")
        return call(e.name, [self.value(a) for a in e.args])


# --- matching
@dataclass(frozen=True)
class Matched:
    """One assignment: its rows, with a column for each needed property, and the tables of its variables."""

    df: DataFrame
    scope: Scope


class Matcher:
    def __init__(self, graph: Graph, patterns: tuple[A.Pattern, ...], where, exprs: list, params: Mapping[str, object], need_all: tuple[str, ...] = ()):
        self.graph, self.patterns, self.params = graph, patterns, params
        self.node_patterns: dict[str, list[A.NodePattern]] = {}
        self.rels: list[tuple[str, A.RelPattern, str]] = []
        for p in patterns:
            for n in p.nodes:
                self.node_patterns.setdefault(n.var, []).append(n)
            for a, r, b in zip(p.nodes, p.rels, p.nodes[1:]):
                self.rels.append((a.var, r, b.var))
        names = [r.var for _, r, _ in self.rels]
        if len(set(names)) < len(names) or set(names) & set(self.node_patterns):
            raise InvalidOperation("a relationship variable is used twice")
        inline = [A.Binary("=", A.Prop(n.var, k), v) for ns in self.node_patterns.values() for n in ns for k, v in n.props]
        inline += [A.Binary("=", A.Prop(r.var, k), v) for _, r, _ in self.rels for k, v in r.props]
        self.filters = [*inline, *conjuncts(where)]
        every = [*self.filters, *exprs]
        known = set(self.node_patterns) | set(names)
        for e in every:
            for v in variables(e):
                if v not in known:
                    raise InvalidOperation(f"variable {v} is not defined")
        self.props: dict[str, set[str]] = {v: set() for v in known}
        self.whole: set[str] = set(need_all)
        for e in every:
            for x in walk(e):
                if isinstance(x, A.Prop):
                    self.props[x.var].add(x.key)
                elif isinstance(x, A.Var):
                    self.whole.add(x.name)

    # tables
    def node_tables(self, var: str) -> list[tuple[NodeTable, DataFrame]]:
        labels = [x for n in self.node_patterns[var] for x in n.labels]
        return [(t, df) for t in self.graph.nodes.values() if (df := t.with_labels(labels)) is not None]

    def assignments(self) -> Iterator[tuple[dict[str, tuple[NodeTable, DataFrame]], dict[str, tuple[EdgeTable, str]]]]:
        """Consistent choices: a table for each node variable, a table and a direction for each relationship."""
        options = {v: {t.name: (t, df) for t, df in self.node_tables(v)} for v in self.node_patterns}

        def extend(k: int, nodes: dict, rels: dict):
            if k == len(self.rels):
                free = [v for v in options if v not in nodes]
                if not free:
                    yield nodes, rels
                    return
                for choice in options[free[0]].values():
                    yield from extend(k, nodes | {free[0]: choice}, rels)
                return
            a, r, b = self.rels[k]
            for e in self.graph.edges.values():
                if r.type is not None and e.type != r.type:
                    continue
                for direction in ("out", "in") if r.direction == "both" else (r.direction,):
                    x, y = (e.src[0], e.dst[0]) if direction == "out" else (e.dst[0], e.src[0])
                    if x not in options[a] or y not in options[b] or a == b and x != y:
                        continue
                    if nodes.get(a, options[a][x])[0].name != x or nodes.get(b, options[b][y])[0].name != y:
                        continue
                    yield from extend(k + 1, nodes | {a: options[a][x], b: options[b][y]}, rels | {r.var: (e, direction)})

        yield from extend(0, {}, {})

    # rows
    def _select(self, var: str, df: DataFrame, table: NodeTable | EdgeTable, key: str) -> DataFrame:
        cols = [F.col(key).alias(col_name(var, " key"))]
        wanted = set(table.props) if var in self.whole else self.props[var] & set(table.props)
        if isinstance(table, NodeTable):
            if var in self.whole:
                cols.append(table.labels_of().alias(col_name(var, " labels")))
        else:
            cols += [F.col(table.src[1]).alias(col_name(var, " src")), F.col(table.dst[1]).alias(col_name(var, " dst"))]
        return df.select(*cols, *[F.col(table.props[p]).alias(col_name(var, p)) for p in table.props if p in wanted])

    def rows(self, nodes: dict, rels: dict) -> Matched:
        scope = Scope(self.graph, {v: Bound(t) for v, (t, _) in nodes.items()} | {v: Bound(e) for v, (e, _) in rels.items()}, self.params)
        pending = list(self.filters)

        def take(bound: set[str]) -> list:
            ready = [e for e in pending if variables(e) <= bound]
            for e in ready:
                pending.remove(e)
            return ready

        def filtered(df: DataFrame, bound: set[str]) -> DataFrame:
            for e in take(bound):
                df = df.where(truth(scope.value(e)))
            return df

        def equalities(var: str) -> int:
            return sum(variables(e) == {var} for e in self.filters) + len({x for n in self.node_patterns[var] for x in n.labels}) / 10

        twice = {e.name for i, (e, _) in enumerate(rels.values()) for j, (o, _) in enumerate(rels.values()) if i != j and e.name == o.name}
        side_of = {v: self._select(v, df, t, t.key) for v, (t, df) in nodes.items()}
        tables = {v: filtered(df, {v}) for v, df in side_of.items()}

        def edge_frame(var: str) -> DataFrame:
            e, _ = rels[var]
            if e.name in twice or var in self.whole or e.key:
                rows, key = e.keyed()
            else:
                rows, key = e.df, e.src[1]
            return filtered(self._select(var, rows, e, key), {var})

        def needs_table(v: str) -> bool:
            """A node with no property, label condition or filter in play is known by its key in the edge."""
            t, df = nodes[v]
            return v in self.whole or bool(self.props[v] & set(t.props)) or df is not t.df or any(variables(e) == {v} for e in self.filters)

        def known_by_edge(df: DataFrame, v: str, key: Column) -> DataFrame:
            """The edge's own key stands for the node; edges are validated, so it exists."""
            return df.withColumn(col_name(v, " key"), key)

        out, bound, left = None, set(), list(self.rels)
        while left or set(nodes) - bound:
            reach = [x for x in left if x[0] in bound or x[2] in bound]
            if not reach:  # start a new component at its most selective node
                free = [v for v in nodes if v not in bound]
                start = max(free, key=equalities)
                touched = [x for x in left if start in (x[0], x[2])]
                if touched and not needs_table(start):
                    a, r, b = touched[0]
                    left.remove(touched[0])
                    part = self._edge_part(edge_frame(r.var), r.var, *rels[r.var], a, b, nodes)
                    part = known_by_edge(known_by_edge(part[0], a, part[1]), b, part[2]) if a != b else known_by_edge(part[0].where(part[1] == part[2]), a, part[1])
                    for v in {a, b}:
                        if needs_table(v):
                            part = part.join(tables[v].withColumnRenamed(col_name(v, " key"), " k"), _ref(v, " key") == F.col("` k`")).drop(" k")
                    new = {a, b, r.var}
                else:
                    part, new = tables[start], {start}
                out = part if out is None else out.crossJoin(part)
                bound |= new
                out = filtered(out, bound)
                continue
            a, r, b = max(reach, key=lambda x: (x[0] in bound) + (x[2] in bound) + equalities(x[2] if x[0] in bound else x[0]) / 10)
            left.remove((a, r, b))
            edge, ka, kb = self._edge_part(edge_frame(r.var), r.var, *rels[r.var], a, b, nodes)
            if a in bound and b in bound:
                out = out.join(edge, (ka == _ref(a, " key")) & (kb == _ref(b, " key"))) if a != b else out.join(edge.where(ka == kb), ka == _ref(a, " key"))
            else:
                have, add, kh, kadd = (a, b, ka, kb) if a in bound else (b, a, kb, ka)
                out = out.join(edge, kh == _ref(have, " key"))
                out = out.join(tables[add], kadd == _ref(add, " key")) if needs_table(add) else known_by_edge(out, add, kadd)
                bound.add(add)
            bound.add(r.var)
            out = filtered(out, bound)
        names = list(rels)
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                if rels[x][0].name == rels[y][0].name:
                    out = out.where(_ref(x, " key") != _ref(y, " key"))
        return Matched(filtered(out, bound), scope)

    def _edge_part(self, df: DataFrame, var: str, e: EdgeTable, direction: str, a: str, b: str, nodes: dict) -> tuple[DataFrame, Column, Column]:
        src, dst = _ref(var, " src"), _ref(var, " dst")
        # an undirected hop meets a self-loop from both sides; the second time is dropped
        loop = next(r for x, r, y in self.rels if r.var == var).direction == "both" and direction == "in" and e.src[0] == e.dst[0]
        return (df.where(src != dst) if loop else df, *((src, dst) if direction == "out" else (dst, src)))

    def run(self) -> list[Matched]:
        found = [self.rows(nodes, rels) for nodes, rels in self.assignments()]
        for var in self.whole:  # whole entities look alike in every assignment, so that they can be united
            kinds: dict[str, list[T.DataType]] = {}
            for m in found:
                t = m.scope.bound[var].table
                for p in t.props:
                    kinds.setdefault(p, []).append(t.type_of(p))
            shape = {p: common_type(k) for p, k in kinds.items()}
            for m in found:
                m.scope.shapes = {**m.scope.shapes, var: shape}
        return found


# --- reading
def _typed_null(df: DataFrame) -> DataFrame:
    """Columns of unknown type become strings, so that results can be written."""
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f"`{f.name}`") for f in df.schema])


def run_read(graph: Graph, text: str, params: Mapping[str, object]) -> DataFrame:
    s = parse(text)
    if s.writes:
        raise InvalidOperation("a writing statement gives a graph, not rows; use apply")
    order = [o.expr for o in s.order]
    aliases = {i.alias: i.expr for i in s.returns}
    by_expr = {i.expr: i.alias for i in s.returns}
    hidden = [e for e in order if e not in by_expr and not (isinstance(e, A.Var) and e.name in aliases)]
    exprs = [i.expr for i in s.returns] + [e for e in hidden]
    matcher = Matcher(graph, s.match, s.where, [e for e in exprs], params)
    found = matcher.run()
    grouped = any(has_aggregate(e) for e in exprs)
    if hidden and (s.distinct or grouped and not all(has_aggregate(e) for e in hidden)):
        raise InvalidOperation("ORDER BY after DISTINCT or aggregation needs returned expressions")
    outputs = [(i.alias, i.expr) for i in s.returns] + [(f" order {k}", e) for k, e in enumerate(hidden)]

    if not grouped:
        parts = [m.df.select(*[m.scope.value(e).col.alias(n) for n, e in outputs]) for m in found]
    else:
        return _finish(s, _aggregated(graph, found, outputs), outputs, by_expr, aliases, hidden)
    df = union_all(parts) if parts else graph.spark.createDataFrame([], ", ".join(f"`{n}` string" for n, _ in outputs))
    return _finish(s, df, outputs, by_expr, aliases, hidden)


def _aggregated(graph: Graph, found: list[Matched], outputs: list[tuple[str, object]]) -> DataFrame:
    """Implicit grouping: results without an aggregate are the keys."""
    keys = [(n, e) for n, e in outputs if not has_aggregate(e)]
    calls: list[A.Call] = []
    for _, e in outputs:
        for x in walk(e):
            if is_aggregate(x) and x not in calls:
                if any(has_aggregate(y) for a in x.args for y in walk(a)):
                    raise InvalidOperation("aggregates cannot be nested")
                if not x.star and len(x.args) != 1:
                    raise InvalidOperation(f"{x.name} takes one argument")
                calls.append(x)

    def argument(m: Matched, c: A.Call) -> Column:
        if c.star:
            return F.lit(1)
        a = c.args[0]
        if isinstance(a, A.Var) and c.name.lower() == "count":
            return m.scope.id_of(a.name) if c.distinct else F.lit(1)
        return m.scope.value(a).col

    parts = [m.df.select(*[m.scope.value(e).col.alias(n) for n, e in keys], *[argument(m, c).alias(f" arg {i}") for i, c in enumerate(calls)]) for m in found]
    if parts:
        rows = union_all(parts)
    else:
        rows = graph.spark.createDataFrame([], ", ".join([f"`{n}` string" for n, _ in keys] + [f"` arg {i}` string" for i in range(len(calls))]))
    aggs = []
    for i, c in enumerate(calls):
        arg = F.col(f"` arg {i}`")
        if c.name.lower() in ("sum", "avg") and rows.schema[f" arg {i}"].dataType.typeName() in ("string", "void"):
            arg = arg.try_cast("double")
        if c.name.lower() == "avg" and c.distinct:
            aggs.append((F.sum_distinct(arg) / F.count_distinct(arg)).alias(f" agg {i}"))
        else:
            aggs.append((F.count("*") if c.star else AGGREGATES[c.name.lower()](arg, c.distinct)).alias(f" agg {i}"))
    out = _typed_null(rows).groupBy(*[F.col(f"`{n}`") for n, _ in keys]).agg(*aggs)
    kinds = {f.name: kind_of(f.dataType) for f in out.schema}

    class After(Scope):
        def value(self, e) -> Value:
            if is_aggregate(e):
                n = f" agg {calls.index(e)}"
                return Value(F.col(f"`{n}`"), kinds[n])
            for n, k in keys:
                if k == e:
                    return Value(F.col(f"`{n}`"), kinds[n])
            return super().value(e)

    scope = After(graph, {}, found[0].scope.params if found else {})
    return out.select(*[scope.value(e).col.alias(n) for n, e in outputs])


def _finish(s: A.Statement, df: DataFrame, outputs, by_expr, aliases, hidden) -> DataFrame:
    df = _typed_null(df)
    if s.distinct:
        df = df.dropDuplicates()
    if s.order:
        cols = []
        for o in s.order:
            name = by_expr.get(o.expr) or (o.expr.name if isinstance(o.expr, A.Var) and o.expr.name in aliases else f" order {hidden.index(o.expr)}")
            c = F.col(f"`{name}`")
            cols.append(c.desc_nulls_first() if o.descending else c.asc_nulls_last())
        df = df.orderBy(*cols)
    if s.skip:
        df = df.offset(s.skip)
    if s.limit is not None:
        df = df.limit(s.limit)
    return df.select(*[F.col(f"`{i.alias}`") for i in s.returns]) if hidden else df


# --- writing
def run_write(graph: Graph, text: str, params: Mapping[str, object]) -> Graph:
    from ..operators import mutate

    s = parse(text)
    if not s.writes:
        raise InvalidOperation("a reading statement gives rows; use cypher")
    if not s.match and (s.sets or s.delete):
        raise InvalidOperation("SET and DELETE need a MATCH that binds their variables")
    return mutate.execute(graph, s, params)
