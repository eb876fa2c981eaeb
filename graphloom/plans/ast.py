"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    key: str


@dataclass(frozen=True)
class Unary:
    op: str  # NOT, -, +, IS NULL, IS NOT NULL
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class NodePattern:
    var: str
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class RelPattern:
    var: str
    type: str | None
    direction: str  # out, in, both
    props: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool


@dataclass(frozen=True)
class Statement:
    match: tuple[Pattern, ...] = ()
    where: object | None = None
    returns: tuple[Item, ...] = ()
    distinct: bool = False
    order: tuple[Order, ...] = ()
    skip: int | None = None
    limit: int | None = None
    create: tuple[Pattern, ...] = ()
    merge: Pattern | None = None
    sets: tuple[tuple[Prop, object], ...] = ()
    delete: tuple = ()
    kinds: tuple[str, ...] = field(default=())

    @property
    def writes(self) -> bool:
        return not self.returns
