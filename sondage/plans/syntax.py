"""Syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Boosted:
    text: str
    boost: float = 2.0


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class Near:
    terms: tuple[str, ...]
    distance: int = 10


@dataclass(frozen=True)
class And:
    nodes: tuple


@dataclass(frozen=True)
class Or:
    nodes: tuple


@dataclass(frozen=True)
class Not:
    node: object


Node = Empty | Literal | Boosted | Phrase | Regex | Near | And | Or | Not


@dataclass
class Filters:
    path: str | None = None
    filename: str | None = None
    ext: str | None = None
    lang: str | None = None
    size_min: int | None = None
    size_max: int | None = None
    line_start: int | None = None
    line_end: int | None = None
    mtime_min: int | None = None
    mtime_max: int | None = None

    def any(self) -> bool:
        return any(x is not None for x in vars(self).values())


@dataclass
class Query:
    root: Node
    filters: Filters = field(default_factory=Filters)
    sort: str = "score"
    limit: int = 100
    ignore_case: bool = False

    def is_empty(self) -> bool:
        """Whether there is nothing to search for: exactly an empty root and no filter."""
        return isinstance(self.root, Empty) and not self.filters.any()
