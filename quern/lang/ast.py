"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    pass


@dataclass
class Path(Node):
    parts: list[str]
    at: int = 0


@dataclass
class Section(Node):
    """A tabular section in a projection with its fields: Lines.(Part, Quantity), or Lines.*."""

    path: Path
    fields: list[str] | None


@dataclass
class Star(Node):
    source: str | None = None


@dataclass
class Literal(Node):
    value: Any
    kind: str  # string, number, boolean, date, null, undefined, binary


@dataclass
class Param(Node):
    name: str


@dataclass
class Unary(Node):
    op: str  # - or NOT
    value: Node


@dataclass
class Binary(Node):
    op: str  # + - * / = <> < > <= >= AND OR
    left: Node
    right: Node


@dataclass
class Tuple(Node):
    items: list[Node]


@dataclass
class In(Node):
    value: Node
    items: list[Node] | None
    query: "Query | None"
    negated: bool
    hierarchy: bool = False


@dataclass
class Between(Node):
    value: Node
    low: Node
    high: Node
    negated: bool


@dataclass
class Like(Node):
    value: Node
    pattern: Node
    escape: str | None
    negated: bool


@dataclass
class IsNull(Node):
    value: Node
    negated: bool


@dataclass
class Refs(Node):
    value: Node
    target: list[str]


@dataclass
class Case(Node):
    operand: Node | None
    whens: list[tuple[Node, Node]]
    otherwise: Node | None


@dataclass
class Call(Node):
    name: str  # canonical English name
    args: list[Node]
    at: int = 0


@dataclass
class Aggregate(Node):
    name: str  # COUNT SUM MIN MAX AVG
    arg: Node | None
    distinct: bool = False


@dataclass
class Cast(Node):
    value: Node
    target: list[str]
    sizes: list[int]
    rest: list[str] = field(default_factory=list)


@dataclass
class Value(Node):
    parts: list[str]


@dataclass
class TypeOf(Node):
    parts: list[str]


@dataclass
class Source(Node):
    alias: str | None
    parts: list[str] = field(default_factory=list)
    args: list[Node | None] | None = None
    query: "Query | None" = None
    param: str | None = None


@dataclass
class Join(Node):
    how: str  # inner left right full
    left: Node
    right: Node
    on: Node


@dataclass
class Select(Node):
    items: list[tuple[Node, str | None]]
    sources: list[Node]
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    having: Node | None = None
    distinct: bool = False
    top: int | None = None
    allowed: bool = False


@dataclass
class Totals(Node):
    fields: list[tuple[Node, str | None]]
    overall: bool
    points: list[tuple[Node, str, str | None]]  # expression, mode (plain, hierarchy, only), alias


@dataclass
class Query(Node):
    branches: list[tuple[Select, bool]]  # the flag: UNION ALL before it
    order: list[tuple[Node, bool]] = field(default_factory=list)  # descending
    totals: Totals | None = None
    into: str | None = None
    add: str | None = None
    index: list[Node] = field(default_factory=list)


@dataclass
class Rule(Node):
    """The text of a restriction: an alias of the restricted rows, joins (their left sides are those rows), a condition, a source that names the rows' object."""

    alias: str | None
    joins: list[Join]
    condition: Node
    source: Source | None = None


@dataclass
class Drop(Node):
    name: str


def children(x: Any):
    """The nodes directly inside a node."""
    for v in vars(x).values() if isinstance(x, Node) else x if isinstance(x, (list, tuple)) else ():
        if isinstance(v, Node):
            yield v
        elif isinstance(v, (list, tuple)):
            yield from (n for n in _flat(v) if isinstance(n, Node))


def _flat(v):
    for x in v:
        if isinstance(x, (list, tuple)):
            yield from _flat(x)
        else:
            yield x


def walk(x: Node, into_queries: bool = True):
    stack = [x]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in children(n) if into_queries or not isinstance(c, Query)]
