"""Queries as data: immutable nodes that the planner turns into Columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    term: str
    field: str = "body"


@dataclass(frozen=True)
class Bool(Node):
    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    filter: tuple[Node, ...] = ()
    least: int = 0


@dataclass(frozen=True)
class Constant(Node):
    query: Node
    score: float = 1.0


@dataclass(frozen=True)
class Phrase(Node):
    """``slop`` bounds the spread of the terms' displacements from their places in the phrase."""

    terms: tuple[str, ...]
    slop: int = 0
    field: str = "body"


@dataclass(frozen=True)
class MultiPhrase(Node):
    terms: tuple[tuple[str, ...], ...]
    field: str = "body"


@dataclass(frozen=True)
class Ordered(Node):
    """Alternatives in order; the shortest such interval is at most ``width`` positions wide."""

    terms: tuple[tuple[str, ...], ...]
    width: int = 10
    field: str = "body"


@dataclass(frozen=True)
class Near(Node):
    """Two or more terms in order with at most ``slop`` other positions between them."""

    terms: tuple[tuple[str, ...], ...]
    slop: int = 10
    field: str = "body"


@dataclass(frozen=True)
class First(Node):
    term: str
    within: int = 5
    field: str = "body"


@dataclass(frozen=True)
class Prefix(Node):
    prefix: str
    field: str = "body"


@dataclass(frozen=True)
class Wildcard(Node):
    pattern: str
    field: str = "body"


@dataclass(frozen=True)
class Fuzzy(Node):
    term: str
    edits: int = 2
    field: str = "body"


@dataclass(frozen=True)
class Range(Node):
    """Inclusive at both ends; None is open."""

    column: str
    low: int | float | None
    high: int | float | None


@dataclass(frozen=True)
class OneOf(Node):
    column: str
    values: tuple


@dataclass(frozen=True)
class Exists(Node):
    column: str


@dataclass(frozen=True)
class Sampled(Node):
    """The deterministic share of documents, by dense ordinal."""

    percent: float
    column: str = "ordinal"


@dataclass(frozen=True)
class DisMax(Node):
    queries: tuple[Node, ...]
    tie: float = 0.0


@dataclass(frozen=True)
class Combined(Node):
    """BM25F: the terms over weighted fields before one saturation."""

    terms: tuple[str, ...]
    fields: tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class Knn(Node):
    """By a vector stated in numbers, or by the words whose vectors are to be added up."""

    vector: tuple[float, ...] = ()
    words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Request:
    """A task: what to search and what to do with the hits."""

    category: str
    query: Node
    count: bool = False
    top: int = 100
    sort: str | None = None
    after: int | float | None = None
    group: str | None = None
    facets: tuple[str, ...] = ()
    drill_down: tuple[tuple[str, tuple[str, ...]], ...] = ()
    drill_sideways: bool = False
    highlight: bool = False
    respell: str | None = None
    pre_filter: bool = False
    notes: tuple[str, ...] = field(default=(), compare=False)
