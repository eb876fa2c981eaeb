"""CSV and JSON bulk import: typed label tables, edges resolved through the id map, rejects in a table of their own."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..errors import InvalidOperation
from ..model import EdgeTable, Graph, NodeTable, union_all
from ..operators.mutate import _fresh
from ..session import counted, stage

# Names that edge columns may have, in any case.
FROM, TO, TYPE = ("from", "source", "src"), ("to", "target", "dst"), ("type", "relationship", "rel_type")
_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
_LONG = r"^[+-]?[0-9]{1,19}$"


@dataclass(frozen=True)
class ImportOptions:
    header: bool = True
    delimiter: str = ","
    label_separator: str = ";"
    default_label: str = "Node"
    skip_invalid: bool = True
    max_errors: int = 100  # 0: no limit
    multiline: bool | None = None  # whether CSV cells may hold line ends; None: if a quote is seen that its line does not close


@dataclass(frozen=True)
class ImportResult:
    graph: Graph
    nodes_imported: int = 0
    edges_imported: int = 0
    rejects: DataFrame | None = None  # (reason, record)
    duration_ms: int = 0
    errors: list[str] = field(default_factory=list)


def infer_value(text: Column) -> Column:
    """The kind of one trimmed text: bool, int, float or str; null for an empty one."""
    t = F.trim(text)
    return (
        F.when(t.isNull() | (t == ""), F.lit(None))
        .when(F.lower(t).isin("true", "false"), F.lit("bool"))
        .when(t.rlike(_LONG) & t.try_cast("long").isNotNull(), F.lit("int"))
        .when(t.rlike(_FLOAT), F.lit("float"))
        .otherwise(F.lit("str"))
    )


# Kinds as bits, so that one number holds those that a column has.
_BITS = {"bool": 1, "int": 2, "float": 4, "str": 8}


def with_kinds(df: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` written, and one kind for each column, seen by the write: the common one, float for a mix of numbers, else str."""
    if not columns:
        return stage(df, name), {}
    seen = Observation()
    bit = F.create_map(*[F.lit(x) for pair in _BITS.items() for x in pair])
    out = stage(df.observe(seen, *[F.bit_or(bit[infer_value(F.col(f"`{c}`"))]).alias(str(i)) for i, c in enumerate(columns)]), name)
    got, kinds = seen.get, {}
    for i, c in enumerate(columns):
        found = {k for k, b in _BITS.items() if (got[str(i)] or 0) & b}
        kinds[c] = next(iter(found)) if len(found) == 1 else "float" if found == {"int", "float"} else "str"
    return out, kinds


def typed(text: Column, kind: str) -> Column:
    t = F.trim(text)
    some = F.when(t != "", t)
    if kind == "bool":
        return F.lower(some) == "true"
    return some.cast({"int": "long", "float": "double"}[kind]) if kind in ("int", "float") else F.when(t != "", t)


def _unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        k, x = 1, n
        while x in out:
            k, x = k + 1, f"{n}_{k}"
        out.append(x)
    return out


def _open_quotes(spark, path: str) -> bool:
    """Whether some line has an odd number of quotes, as the first line of a cell with line ends has."""
    text = F.col("value")
    return bool(spark.read.text(path).where((F.length(text) - F.length(F.replace(text, F.lit('"')))) % 2 == 1).limit(1).count())


def read_csv(spark, path: str, options: ImportOptions) -> DataFrame:
    """All columns as text; without a header they are ``col0``, ``col1``, ...  Files are split unless cells hold line ends."""
    multi = _open_quotes(spark, path) if options.multiline is None else options.multiline
    df = spark.read.csv(path, sep=options.delimiter, header=options.header, quote='"', escape='"', multiLine=multi, enforceSchema=False)
    names = [c.strip() for c in df.columns] if options.header else [f"col{i}" for i in range(len(df.columns))]
    return df.toDF(*_unique(names))


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", F.monotonically_increasing_id())


def _labels(text: Column, options: ImportOptions) -> Column:
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), re.escape(options.label_separator)), F.trim), lambda x: x != "")
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit(options.default_label)))


def _with_ids(df: DataFrame, given: Column) -> DataFrame:
    """Adds ``_id`` to a written table with ``_n``: the given id, or node_<n> where there is none; of rows that share one, the last
    in order stays.  Only the ids are exchanged, and the ids that rows share meet the rows again."""
    df = df.withColumn("_id", F.coalesce(F.when(F.trim(given) != "", F.trim(given)), F.concat(F.lit("node_"), F.col("_n").cast("string"))))
    shared = df.groupBy("_id").agg(F.max("_n").alias("_last"), F.count("*").alias("_rows")).where("_rows > 1").select("_id", "_last")
    return df.join(shared, "_id", "left").where("_last is null or _n = _last").drop("_n", "_last")


def _node_tables(graph: Graph, df: DataFrame, props: dict[str, str]) -> tuple[Graph, int]:
    """One node table for each label set of ``df`` (_id, _labels, columns)."""
    df, n = counted(df, "import-nodes")
    used = [F.max(F.col(f"`{c}`").isNotNull()).alias(str(i)) for i, c in enumerate(props.values())]
    sets = df.groupBy("_labels").agg(F.count("*").alias("rows"), *used).collect()  # label sets are schema, not data
    for r in sorted(sets, key=lambda r: r["_labels"]):
        own = df.where(F.col("_labels") == F.array(*[F.lit(x) for x in r["_labels"]]))
        graph = graph.with_node_table(NodeTable(_fresh("i"), own, "_id", tuple(r["_labels"]), {p: c for i, (p, c) in enumerate(props.items()) if r[str(i)]}))
    return graph, n


def import_csv_nodes(graph: Graph, path: str, options: ImportOptions = ImportOptions()) -> ImportResult:
    """A column ``id`` and a column ``labels`` (both optional, any case) and properties; empty cells are absent."""
    begin = time.monotonic()
    df = read_csv(graph.spark, path, options)
    at = {c.lower(): c for c in df.columns}
    special = {at[k] for k in ("id", "labels", "label") if k in at}
    props = [c for c in df.columns if c not in special]
    df, kinds = with_kinds(_numbered(df), props, "import-text")
    labels = F.col(f"`{at['labels']}`") if "labels" in at else F.col(f"`{at['label']}`") if "label" in at else F.lit(None).cast("string")
    rows = _with_ids(df, F.col(f"`{at['id']}`") if "id" in at else F.lit(None).cast("string"))
    rows = rows.select("_id", _labels(labels, options).alias("_labels"), *[typed(F.col(f"`{c}`"), kinds[c]).alias(f"p_{c}") for c in props])
    graph, n = _node_tables(graph, rows, {c: f"p_{c}" for c in props})
    return ImportResult(graph, nodes_imported=n, duration_ms=int(1000 * (time.monotonic() - begin)))


def id_map(graph: Graph) -> DataFrame:
    """(ext, table, key) of every imported or created node."""
    parts = [t.df.select(F.col(t.key).cast("string").alias("ext"), F.lit(t.name).alias("table")) for t in graph.nodes.values()]
    return union_all(parts) if parts else graph.spark.createDataFrame([], "ext string, table string")


def _edge_tables(graph: Graph, rows: DataFrame, records: DataFrame, props: dict[str, str], options: ImportOptions, begin: float) -> ImportResult:
    """rows: (_n, _from, _to, _type, columns); unmatched ends and missing fields are rejected, with their text in ``records`` (_n, record)."""
    ids = id_map(graph)
    s, d = ids.toDF("_from", "_stable"), ids.toDF("_to", "_dtable")
    joined = rows.join(s, "_from", "left").join(d, "_to", "left")
    reason = F.when(F.col("_from").isNull() | F.col("_to").isNull() | F.col("_type").isNull(), F.lit("missing field")).when(F.col("_stable").isNull(), F.concat(F.lit("source not found: "), "_from")).when(F.col("_dtable").isNull(), F.concat(F.lit("target not found: "), "_to"))
    seen = Observation()
    joined = joined.withColumn("_reason", reason).withColumn("_key", F.expr("uuid()")).observe(seen, F.count("*").alias("rows"), F.count("_reason").alias("bad"))
    joined = stage(joined, "import-edges")
    bad = seen.get["bad"]
    rejects = joined.where("_reason is not null").select("_n", F.col("_reason").alias("reason")).join(records, "_n").select("reason", "record")
    if bad and not options.skip_invalid:
        raise InvalidOperation(f"{bad} invalid edges, first: {rejects.first()['reason']}")
    if options.max_errors and bad > options.max_errors:
        raise InvalidOperation(f"{bad} invalid edges exceed the limit of {options.max_errors}")
    good = joined.where("_reason is null")
    shapes = good.select("_type", "_stable", "_dtable").distinct().collect()  # schema, not data
    for type_, st, dt in sorted(map(tuple, shapes)):
        own = good.where((F.col("_type") == type_) & (F.col("_stable") == st) & (F.col("_dtable") == dt))
        graph = graph.with_edge_table(EdgeTable(_fresh("i"), type_, own, (st, "_from"), (dt, "_to"), props, "_key"))
    messages = [r["reason"] for r in rejects.limit(options.max_errors or 100).collect()] if bad else []
    return ImportResult(graph, edges_imported=seen.get["rows"] - bad, rejects=rejects, duration_ms=int(1000 * (time.monotonic() - begin)), errors=messages)


def import_csv_edges(graph: Graph, path: str, options: ImportOptions = ImportOptions()) -> ImportResult:
    """Columns for source, target and type (see ``FROM``, ``TO``, ``TYPE``), and properties."""
    begin = time.monotonic()
    df = read_csv(graph.spark, path, options)
    at = {c.lower(): c for c in df.columns}
    names = []
    for wanted in (FROM, TO, TYPE):
        found = [at[w] for w in wanted if w in at]
        if not found:
            raise InvalidOperation(f"no column {' or '.join(wanted)}")
        names.append(found[0])
    props = [c for c in df.columns if c not in names]
    record = F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias("record")
    df, kinds = with_kinds(_numbered(df), props, "import-text")
    ends = [F.when(F.trim(F.col(f"`{n}`")) != "", F.trim(F.col(f"`{n}`"))).alias(a) for n, a in zip(names, ("_from", "_to", "_type"))]
    rows = df.select("_n", *ends, *[typed(F.col(f"`{c}`"), kinds[c]).alias(f"p_{c}") for c in props])
    return _edge_tables(graph, rows, df.select("_n", record), {c: f"p_{c}" for c in props}, options, begin)


def read_json(spark, path: str) -> DataFrame:
    """(v): one variant for each object of a top-level array, or of JSON lines, which are split like any lines.

    The first character tells which; a file that is an array is read as a whole."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    first = lines.first()
    if first is None or first["value"].startswith("{"):
        return lines.where(F.startswith("value", F.lit("{"))).select(F.try_parse_json("value").alias("v"))
    array = spark.read.text(path, wholetext=True).select(F.parse_json(F.trim("value")).alias("a"))
    return array.select(F.explode(F.variant_get("a", "$", "array<variant>")).alias("v"))


def _json_props(df: DataFrame) -> tuple[list[str], dict[str, str]]:
    """Property keys of ``v.properties`` and a kind for each."""
    df = df.select(F.try_variant_get("v", "$.properties", "map<string,variant>").alias("m")).where("m is not null")
    pairs = df.select(F.explode("m").alias("k", "x")).select("k", F.schema_of_variant("x").alias("t")).distinct().collect()  # schema, not data
    kinds: dict[str, set[str]] = {}
    for k, t in pairs:
        kind = "bool" if t == "BOOLEAN" else "int" if t == "BIGINT" else "float" if t.startswith(("DECIMAL", "DOUBLE", "FLOAT")) else "str" if t == "STRING" else None if t == "VOID" else "json"
        if kind:
            kinds.setdefault(k, set()).add(kind)
        else:
            kinds.setdefault(k, set())
    return sorted(kinds), {k: next(iter(s)) if len(s) == 1 else "float" if s and s <= {"int", "float"} else "str" for k, s in kinds.items()}


def _json_column(key: str, kind: str) -> Column:
    x = F.try_variant_get("v", "$.properties", "map<string,variant>")[key]
    if kind == "json":
        return F.to_json(x)
    types = {"bool": "boolean", "int": "long", "float": "double"}
    if kind in types:
        return F.try_variant_get(x, "$", types[kind])
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).when(F.schema_of_variant(x) != "VOID", F.to_json(x))


def import_json_nodes(graph: Graph, path: str, options: ImportOptions = ImportOptions()) -> ImportResult:
    """Objects {id?, labels?, properties?}; labels are a string or an array; nested values become JSON text."""
    begin = time.monotonic()
    df = stage(_numbered(read_json(graph.spark, path)), "import-json")
    keys, kinds = _json_props(df)
    label = F.try_variant_get("v", "$.labels", "string")
    listed = F.try_variant_get("v", "$.labels", "array<string>")
    labels = F.when(F.size(listed) > 0, F.array_distinct(listed)).when(label.isNotNull(), F.array(label)).otherwise(F.array(F.lit(options.default_label)))
    rows = _with_ids(df, F.try_variant_get("v", "$.id", "string"))
    rows = rows.select("_id", labels.alias("_labels"), *[_json_column(k, kinds[k]).alias(f"p_{k}") for k in keys])
    graph, n = _node_tables(graph, rows, {k: f"p_{k}" for k in keys})
    return ImportResult(graph, nodes_imported=n, duration_ms=int(1000 * (time.monotonic() - begin)))


def import_json_edges(graph: Graph, path: str, options: ImportOptions = ImportOptions()) -> ImportResult:
    """Objects {from, to, type, properties?}; ends that are not strings are rejected."""
    begin = time.monotonic()
    df = stage(_numbered(read_json(graph.spark, path)), "import-json")
    keys, kinds = _json_props(df)

    def text(name: str) -> Column:
        raw = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))

    rows = df.select("_n", text("from").alias("_from"), text("to").alias("_to"), text("type").alias("_type"), *[_json_column(k, kinds[k]).alias(f"p_{k}") for k in keys])
    return _edge_tables(graph, rows, df.select("_n", F.to_json("v").alias("record")), {k: f"p_{k}" for k in keys}, options, begin)


def from_records(graph: Graph, nodes: DataFrame, edges: DataFrame, options: ImportOptions = ImportOptions()) -> ImportResult:
    """Add nodes (entity, labels, props) and edges (entity, src, dst, type, props), with props as JSON text."""
    begin = time.monotonic()

    def with_props(df: DataFrame) -> DataFrame:
        return stage(_numbered(df).withColumn("v", F.parse_json(F.concat(F.lit('{"properties":'), F.coalesce("props", F.lit("{}")), F.lit("}")))), "records")

    df = with_props(nodes)
    keys, kinds = _json_props(df)
    labels = F.coalesce("labels", F.array(F.lit(options.default_label)))
    graph, n = _node_tables(graph, df.select(F.col("entity").alias("_id"), labels.alias("_labels"), *[_json_column(k, kinds[k]).alias(f"p_{k}") for k in keys]), {k: f"p_{k}" for k in keys})
    df = with_props(edges)
    keys, kinds = _json_props(df)
    rows = df.select("_n", F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("type").alias("_type"), *[_json_column(k, kinds[k]).alias(f"p_{k}") for k in keys])
    r = _edge_tables(graph, rows, df.select("_n", F.to_json(F.struct("entity", "src", "dst", "type")).alias("record")), {k: f"p_{k}" for k in keys}, options, begin)
    return ImportResult(r.graph, n, r.edges_imported, r.rejects, r.duration_ms, r.errors)
