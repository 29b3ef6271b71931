"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    pass


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Matcher:
    """label op value, with op one of = != =~ !~."""

    label: str
    op: str
    value: str


@dataclass(frozen=True)
class Selector(Node):
    """Instant selector; with `range` (ms) a range selector."""

    name: str | None
    matchers: tuple[Matcher, ...] = ()
    range: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Subquery(Node):
    """expr[range:step]; step 0 stands for the query's own step."""

    expr: Node
    range: int
    step: int
    offset: int = 0


@dataclass(frozen=True)
class Unary(Node):
    op: str
    expr: Node


@dataclass(frozen=True)
class Matching:
    """How two vectors' series find each other."""

    on: tuple[str, ...] | None = None
    ignoring: tuple[str, ...] = ()
    group: str = ""  # "left", "right" or ""
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    bool: bool = False
    matching: Matching = Matching()


@dataclass(frozen=True)
class Aggregate(Node):
    op: str
    expr: Node
    param: Node | None = None
    by: tuple[str, ...] | None = None
    without: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()


class QueryError(ValueError):
    """A query that cannot be parsed, or that does not type."""
