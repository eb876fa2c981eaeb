"""Typed expressions: a :class:`Value` is a Column with the kind that the compiler knows of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..errors import InvalidOperation


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str  # int, float, str, bool, null, list, node, edge, or other (dates and the like)


def kind_of(t: T.DataType | None) -> str:
    if t is None or isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "str"
    return "list" if isinstance(t, T.ArrayType) else "other"


def kind_of_value(x: object) -> str:
    for kind, type_ in (("bool", bool), ("int", int), ("float", float), ("str", str), ("list", (list, tuple))):
        if isinstance(x, type_):
            return kind
    return "null" if x is None else "other"


def literal(x: object) -> Value:
    kind = kind_of_value(x)
    if kind == "null":
        return Value(F.lit(None), "null")
    if kind == "int":
        return Value(F.lit(x).cast("long"), "int")
    if kind == "list":
        return Value(F.array(*[literal(y).col for y in x]), "list")
    return Value(F.lit(x), kind)


NUMBERS = ("int", "float")


def truth(v: Value) -> Column:
    """A condition: booleans are themselves, null is unknown, any other value is true where it is there."""
    if v.kind == "bool":
        return v.col
    return F.lit(None).cast("boolean") if v.kind == "null" else v.col.isNotNull()


def compare(op: str, a: Value, b: Value) -> Value:
    """Numbers compare as numbers; equality across other kinds is false and ordering is unknown."""
    if "null" in (a.kind, b.kind):
        return Value(F.lit(None).cast("boolean"), "bool")
    same = a.kind == b.kind or a.kind in NUMBERS and b.kind in NUMBERS or "other" in (a.kind, b.kind) and "list" not in (a.kind, b.kind)
    x, y = a.col, b.col
    if same and a.kind != b.kind and "other" in (a.kind, b.kind):  # a date against text
        if "str" not in (a.kind, b.kind):
            same = False
        else:
            x, y = x.cast("timestamp"), y.try_cast("timestamp") if b.kind == "str" else y.cast("timestamp")
            x = a.col.try_cast("timestamp") if a.kind == "str" else x
    if not same:
        if op not in ("=", "<>"):
            return Value(F.lit(None).cast("boolean"), "bool")
        return Value(F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "<>")), "bool")
    return Value({"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Null instead of an error: on overflow, division by zero, or operands that do not fit."""
    if op == "+" and a.kind == b.kind == "str":
        return Value(F.concat(a.col, b.col), "str")
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return Value(F.lit(None), "null")
    whole = a.kind == b.kind == "int"
    kind = "int" if whole else "float"
    x, y = (a.col.cast("long"), b.col.cast("long")) if whole else (a.col.cast("double"), b.col.cast("double"))
    if op == "/":
        return Value(F.when(y != 0, F.call_function("div", x, y)) if whole else F.try_divide(x, y), kind)
    return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](x, y), kind)


def _fixed(f: Callable[..., Column], kind: str, n: tuple[int, ...] = (1,)) -> tuple:
    return (lambda *a: Value(f(*[v.col for v in a]), kind), n)


def _same(f: Callable[[Column], Column]) -> tuple:
    return (lambda v: Value(f(v.col), v.kind) if v.kind in NUMBERS else Value(F.lit(None), "null"), (1,))


def _coalesce(*a: Value) -> Value:
    known = [v for v in a if v.kind != "null"]
    if not known:
        return Value(F.lit(None), "null")
    kinds = {v.kind for v in known}
    if len(kinds) == 1:
        return Value(F.coalesce(*[v.col for v in known]), known[0].kind)
    kind = "float" if kinds <= set(NUMBERS) else "str"
    return Value(F.coalesce(*[v.col.cast("double" if kind == "float" else "string") for v in known]), kind)


def _size(v: Value) -> Value:
    return Value((F.length(v.col) if v.kind == "str" else F.size(v.col)).cast("long"), "int")


#: Scalar functions by lower-case name: (maker, allowed argument counts).  Those of nodes and edges are the compiler's.
SCALARS: dict[str, tuple] = {
    "coalesce": (_coalesce, tuple(range(1, 33))),
    "size": (_size, (1,)),
    "length": (_size, (1,)),
    "toupper": _fixed(F.upper, "str"),
    "tolower": _fixed(F.lower, "str"),
    "trim": _fixed(F.trim, "str"),
    "reverse": _fixed(F.reverse, "str"),
    "substring": (lambda s, i, *n: Value(F.substring(s.col.cast("string"), i.col.cast("int") + 1, n[0].col.cast("int") if n else F.lit(2**31 - 1)), "str"), (2, 3)),
    "replace": _fixed(F.replace, "str", (3,)),
    "split": (lambda s, d: Value(F.split(s.col, F.concat(F.lit("\\Q"), d.col, F.lit("\\E"))), "list"), (2,)),
    "abs": _same(F.abs),
    "sign": (lambda v: Value(F.signum(v.col).cast("long"), "int"), (1,)),
    "round": (lambda v, *n: Value(F.round(v.col.cast("double"), n[0].col.cast("int") if n else F.lit(0)), "float"), (1, 2)),
    "floor": _fixed(lambda x: F.floor(x.cast("double")).cast("double"), "float"),
    "ceil": _fixed(lambda x: F.ceil(x.cast("double")).cast("double"), "float"),
    "sqrt": _fixed(lambda x: F.when(x >= 0, F.sqrt(x.cast("double"))), "float"),
    "tointeger": (lambda v: Value(v.col.try_cast("double").try_cast("long") if v.kind == "str" else v.col.cast("long"), "int"), (1,)),
    "tofloat": (lambda v: Value(v.col.try_cast("double"), "float"), (1,)),
    "tostring": _fixed(lambda x: x.cast("string"), "str"),
    "toboolean": (lambda v: Value(F.lower(v.col.cast("string")).try_cast("boolean"), "bool"), (1,)),
    "head": _fixed(lambda x: F.try_element_at(x, F.lit(1)), "other"),
    "last": _fixed(lambda x: F.try_element_at(x, F.lit(-1)), "other"),
    "exists": (lambda v: Value(v.col.isNotNull(), "bool"), (1,)),
}
#: Aggregates by lower-case name: maker of the aggregate over the argument column, and the kind of the result.
AGGREGATES = {
    "count": lambda c, d: F.count_distinct(c) if d else F.count(c),
    "sum": lambda c, d: F.coalesce(F.sum_distinct(c) if d else F.sum(c), F.lit(0)),
    "avg": lambda c, d: F.avg(c) if not d else F.expr("NULL"),
    "min": lambda c, d: F.min(c),
    "max": lambda c, d: F.max(c),
    "collect": lambda c, d: F.collect_set(c) if d else F.collect_list(c),
}


def call(name: str, args: list[Value]) -> Value:
    found = SCALARS.get(name.lower())
    if found is None:
        raise InvalidOperation(f"unknown function {name}")
    make, counts = found
    if len(args) not in counts:
        raise InvalidOperation(f"{name} takes {' or '.join(map(str, counts[:3]))} arguments")
    return make(*args)
