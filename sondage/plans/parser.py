"""Parser of the query language.  It takes any string and never fails.

A query is a disjunction (``|``) of conjunctions (blanks) of terms; ``-`` negates and ``^`` boosts the term after it.  Terms are
words, ``"phrases"``, ``re:/patterns/``, parentheses, and ``field:value``, whose filters and options hold for the whole query.
"""

from __future__ import annotations

import datetime
import re

from .syntax import And, Boosted, Empty, Filters, Literal, Near, Node, Not, Or, Phrase, Query, Regex

DAY = 86400
DEFAULT_DISTANCE = 10
_UNSIGNED = re.compile(r"\+?\d+", re.ASCII)
_BOOST = re.compile(r"[0-9.]*:", re.ASCII)
_FLOAT = re.compile(r"(?:\d+\.?\d*|\.\d+)", re.ASCII)


def _number(text: str, bits: int = 64) -> int | None:
    if _UNSIGNED.fullmatch(text) and (n := int(text)) < 2**bits:
        return n
    return None


def parse_date(text: str) -> int | None:
    """Unix seconds of midnight on ``YYYY-MM-DD``; days up to 31 spill into the next month, years begin at 1970."""
    parts = text.split("-")
    if len(parts) < 3:
        return None
    year, month, day = (_number(p, 31) for p in parts[:3])
    if None in (year, month, day) or not (1970 <= year <= 9999 and 1 <= month <= 12 and 1 <= day <= 31):
        return None
    return (datetime.date(year, month, 1).toordinal() - datetime.date(1970, 1, 1).toordinal() + day - 1) * DAY


def parse_timestamp(text: str) -> int | None:
    n = _number(text)
    return parse_date(text) if n is None else n


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.filters, self.sort, self.limit = Filters(), "score", 100

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, char: str) -> bool:
        found = self.peek() == char
        self.at += found
        return found

    def skip_blanks(self) -> None:
        while self.peek().isspace():
            self.at += 1

    def until(self, stop) -> str:
        start = self.at
        while self.peek() and not stop(self.peek()):
            self.at += 1
        return self.text[start : self.at]

    def disjunction(self) -> Node:
        nodes = [self.conjunction()]
        self.skip_blanks()
        while self.take("|"):
            nodes.append(self.conjunction())
            self.skip_blanks()
        return nodes[0] if len(nodes) == 1 else Or(tuple(nodes))

    def conjunction(self) -> Node:
        nodes: list[Node] = []
        self.skip_blanks()
        while self.peek() not in ("", ")", "|"):
            nodes.append(self.unary())
            self.skip_blanks()
        if len(nodes) > 1:
            return And(tuple(nodes))
        return nodes[0] if nodes else Empty()

    def unary(self) -> Node:
        if self.take("-"):
            return Not(self.primary())
        if not self.take("^"):
            return self.primary()
        boost = 2.0
        if given := _BOOST.match(self.text, self.at):
            self.at = given.end()
            if _FLOAT.fullmatch(given[0][:-1]):
                boost = float(given[0][:-1])
        elif re.fullmatch(r"[0-9.]+", self.text[self.at :], re.ASCII):
            # Digits up to the end are taken as the start of a boost that never comes.
            self.at = len(self.text)
        inner = self.primary()
        return Boosted(inner.text, boost) if isinstance(inner, Literal | Phrase) else inner

    def primary(self) -> Node:
        self.skip_blanks()
        if self.take("("):
            inner = self.disjunction()
            self.take(")")
            return inner
        if self.take('"'):
            phrase = self.until(lambda c: c == '"')
            self.take('"')
            return Phrase(phrase)
        if self.text.startswith("re:/", self.at):
            self.at += 4
            pattern = self.until(lambda c: c == "/")
            self.take("/")
            return Regex(pattern)
        return self.term()

    def term(self) -> Node:
        start = self.at
        while (c := self.peek()) and (c.isalnum() or c in "_:"):
            self.at += 1
            if c == ":":
                return self.fielded(self.text[start : self.at - 1])
        if self.at > start:
            return Literal(self.text[start : self.at])
        word = self.until(lambda c: c.isspace() or c in "|()")
        return Literal(word) if word else Empty()

    def fielded(self, name: str) -> Node:
        value = self.until(lambda c: c.isspace() or c in "|)")
        f = self.filters
        match name.lower():
            case "path":
                f.path = value
            case "file" | "name":
                f.filename = value
            case "ext":
                f.ext = value
            case "lang":
                f.lang = value
            case "size":
                n = _number(value[1:])
                if n is not None and value[0] == ">":
                    f.size_min = n
                elif n is not None and value[0] == "<":
                    f.size_max = n
            case "line":
                first, dash, last = value.partition("-")
                if dash:
                    f.line_start, f.line_end = _number(first, 32), _number(last, 32)
                elif (n := _number(value, 32)) is not None:
                    f.line_start = f.line_end = n
            case "mtime":
                if value[:1] == ">":
                    f.mtime_min = parse_timestamp(value[1:])
                elif value[:1] == "<":
                    f.mtime_max = parse_timestamp(value[1:])
                elif "-" in value and len(value.encode()) >= 10:
                    if (day := parse_date(value)) is not None:
                        f.mtime_min, f.mtime_max = day, day + DAY
                elif (n := _number(value)) is not None:
                    f.mtime_min, f.mtime_max = n, n + DAY
            case "near":
                return self.near(value)
            case "sort":
                kinds = {"recency": "recency", "recent": "recency", "mtime": "recency", "path": "path", "name": "path"}
                self.sort = kinds.get(value.lower(), "score")
            case "top":
                if (n := _number(value)) is not None:
                    self.limit = n
            case _:
                return Literal(f"{name}:{value}")
        return Empty()

    @staticmethod
    def near(value: str) -> Node:
        parts = value.split(",")
        if len(parts) < 2:
            return Empty()
        distance = _number(parts[-1].strip(), 32)
        terms = [p.strip() for p in (parts if distance is None else parts[:-1])]
        terms = [t for t in terms if t]
        if len(terms) > 1:
            return Near(tuple(terms), DEFAULT_DISTANCE if distance is None else distance)
        return Literal(terms[0]) if terms else Empty()


def parse_query(text: str, ignore_case: bool = False) -> Query:
    parser = _Parser(text)
    root = parser.disjunction()
    return Query(root, parser.filters, parser.sort, parser.limit, ignore_case)


def build_pattern(patterns: list[str], word: bool = False) -> str:
    """Query for command-line patterns: one stays as it is; several, or ``word``, become a pattern of escaped literals."""
    from ..functions.patterns import escape

    if not patterns:
        return ""
    if len(patterns) == 1 and not word:
        return patterns[0]
    return "re:/" + "|".join(rf"\b{escape(p)}\b" if word else escape(p) for p in patterns) + "/"
