"""From a syntax tree to columns: whole-text predicates and arrays of matching lines.

Everything stays in the plan's own expressions, so that filters reach the scan and no text leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..functions.patterns import glob_to_regex, java_regex, regex_prefix
from .syntax import And, Boosted, Empty, Filters, Literal, Near, Node, Not, Or, Phrase, Regex

ROWS = "array<struct<line_number:int,line:string,match_start:int,match_end:int>>"


def _compiles(pattern: str) -> bool:
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (CapturedException, Py4JJavaError):
        return False
    return True


def _java(pattern: str, ignore_case: bool, whole_text: bool = False) -> str | None:
    """Java pattern, or None if it is invalid and matches nothing."""
    if ignore_case and not pattern.startswith("(?i)"):
        pattern = "(?i)" + pattern
    out = java_regex(pattern, whole_text)
    return out if out is not None and _compiles(out) else None


def pruned(node: Node) -> Node | None:
    """The tree without its empty parts; None if nothing is left to verify."""
    match node:
        case Empty():
            return None
        case And(nodes) | Or(nodes):
            kept = tuple(x for x in map(pruned, nodes) if x is not None)
            return kept[0] if len(kept) == 1 else type(node)(kept) if kept else None
        case Not(inner):
            left = pruned(inner)
            return None if left is None else Not(left)
    return node


def _literal(line: Column, needle: str, fold: bool) -> tuple[Column, Column, Column]:
    """Whether a line holds a literal, and the byte range of its first occurrence; folded offsets are the folded line's."""
    where = F.lower(line) if fold else line
    sought = needle.lower() if fold else needle
    start = T.bytes_before(where, F.locate(sought, where)) if sought else F.lit(0)
    return F.contains(where, F.lit(sought)), start, start + len(needle.encode())


def leaf(line: Column, node: Node, ignore_case: bool) -> tuple[Column, Column, Column]:
    """Predicate, start and end of a single-line term within ``line``."""
    match node:
        case Literal(text) | Boosted(text, _):
            return _literal(line, text, True)
        case Phrase(text):
            return _literal(line, text, ignore_case)
        case Regex(pattern):
            java = _java(pattern, ignore_case)
            if java is None:
                return F.lit(False), F.lit(0), F.lit(0)
            start = T.bytes_before(line, F.regexp_instr(line, F.lit(java)))
            found = F.coalesce(F.regexp_substr(line, F.lit(java)), F.lit(""))
            return F.rlike(line, F.lit(java)), start, start + F.octet_length(found)
    raise TypeError(node)


def is_leaf(node: Node) -> bool:
    return isinstance(node, Literal | Boosted | Phrase | Regex)


def _hits(numbered: Column, node: Node, ignore_case: bool) -> Column:
    kept = F.filter(numbered, lambda x: leaf(x["line"], node, ignore_case)[0])

    def row(x: Column) -> Column:
        _, start, end = leaf(x["line"], node, ignore_case)
        return F.struct(x["line_number"], x["line"], start.cast("int").alias("match_start"), end.cast("int").alias("match_end"))

    return F.transform(kept, row)


def numbered_lines(text: Column) -> Column:
    return F.transform(T.lines(text), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` spells it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _near(numbered: Column, node: Near) -> Column:
    """Hits of the first term with all others near, in time linear in the lines: the numbers of lines that are near are spelled out."""
    if any("\n" in t or "\r" in t for t in node.terms):
        return F.array().cast(ROWS)

    def places(all_: Column, term: str) -> Column:
        return F.transform(F.filter(all_, lambda x: F.contains(F.lower(x["line"]), F.lit(term.lower()))), lambda x: x["line_number"])

    def around(all_: Column, term: str) -> Column:
        def covered(found: Column) -> Column:
            # From where the line before left off, so that no number comes twice.
            def own(p: Column, i: Column) -> Column:
                first = F.greatest(p - node.distance, F.lit(1), F.coalesce(F.get(found, i - 1) + node.distance + 1, F.lit(1)))
                last = F.least(p + node.distance, F.size(all_))
                return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

            return F.flatten(F.transform(found, own))

        return _let(places(all_, term), covered)

    def hits(all_: Column) -> Column:
        near = reduce(F.array_intersect, (around(all_, t) for t in node.terms[1:]), places(all_, node.terms[0]))

        def row(n: Column) -> Column:
            line = F.get(all_, n - 1)["line"]
            _, start, end = leaf(line, Literal(node.terms[0]), False)
            return F.struct(n.alias("line_number"), line.alias("line"), start.cast("int").alias("match_start"), end.cast("int").alias("match_end"))

        return F.transform(near, row)

    return _let(numbered, hits)


def rows(numbered: Column, node: Node, ignore_case: bool) -> Column:
    """Matching rows of a text as an array: a bag, in the order of the terms."""
    match node:
        case Near():
            return _near(numbered, node)
        case And(nodes):
            parts = F.struct(*(rows(numbered, n, ignore_case).alias(f"p{k}") for k, n in enumerate(nodes)))
            each = lambda p: [p[f"p{k}"] for k in range(len(nodes))]
            return _let(parts, lambda p: F.when(reduce(and_, (F.size(x) > 0 for x in each(p))), F.concat(*each(p))).otherwise(F.array().cast(ROWS)))
        case Or(nodes):
            return F.concat(*(rows(numbered, n, ignore_case) for n in nodes))
        case Not(inner):
            first = F.coalesce(F.get(numbered, F.lit(0))["line"], F.lit(""))
            stand_in = F.struct(F.lit(1).alias("line_number"), first.alias("line"), F.lit(0).alias("match_start"), F.lit(0).alias("match_end"))
            return F.when(F.size(rows(numbered, inner, ignore_case)) == 0, F.array(stand_in)).otherwise(F.array().cast(ROWS))
    return _hits(numbered, node, ignore_case)


def file_matches(text: Column, node: Node, ignore_case: bool) -> Column:
    """Whether a whole text matches; patterns see the text as one string."""
    match node:
        case Literal(needle) | Boosted(needle, _):
            return F.contains(F.lower(text), F.lit(needle.lower()))
        case Phrase(needle):
            return F.contains(F.lower(text), F.lit(needle.lower())) if ignore_case else F.contains(text, F.lit(needle))
        case Regex(pattern):
            java = _java(pattern, ignore_case, whole_text=True)
            return F.lit(False) if java is None else F.rlike(text, F.lit(java))
        case Near():
            return maybe(text, node, ignore_case) & (F.size(_near(numbered_lines(text), node)) > 0)
        case And(nodes):
            return reduce(and_, (file_matches(text, n, ignore_case) for n in nodes))
        case Or(nodes):
            return reduce(or_, (file_matches(text, n, ignore_case) for n in nodes))
        case Not(inner):
            return ~file_matches(text, inner, ignore_case)
    raise TypeError(node)


def maybe(text: Column, node: Node, ignore_case: bool) -> Column:
    """A cheap predicate that every text with a matching row passes."""
    match node:
        case Literal(needle) | Boosted(needle, _):
            return F.contains(F.lower(text), F.lit(needle.lower()))
        case Phrase(needle):
            return F.contains(F.lower(text), F.lit(needle.lower())) if ignore_case else F.contains(text, F.lit(needle))
        case Regex(pattern):
            if _java(pattern, ignore_case) is None:
                return F.lit(False)
            # A border of a word takes no room.
            rest = pattern.removeprefix(r"(?-u:\b)").removeprefix(r"\b")
            prefix = None if ignore_case or rest.startswith("(?") else regex_prefix(rest)
            return F.lit(True) if prefix is None else F.contains(text, F.lit(prefix))
        case Near(terms, _):
            return reduce(and_, (F.contains(F.lower(text), F.lit(t.lower())) for t in terms))
        case And(nodes):
            return reduce(and_, (maybe(text, n, ignore_case) for n in nodes))
        case Or(nodes):
            return reduce(or_, (maybe(text, n, ignore_case) for n in nodes))
    return F.lit(True)


def document_filter(filters: Filters, every_language: bool = False) -> Column:
    """Conditions on a document's metadata; the line range is not among them."""
    path = F.col("path")
    terms = [model.is_valid(F.col("flags"))]
    if filters.path is not None and (regex := glob_to_regex(filters.path)) is not None:
        plain = not any(c in filters.path for c in "*?[]{}\\")
        terms.append(path == filters.path if plain else F.rlike(path, F.lit(regex)))
    if filters.filename is not None:
        name, sought = F.lower(model.basename(path)), filters.filename.lower()
        if any(c in sought for c in "*?["):
            regex = glob_to_regex(sought)
            terms.append(F.lit(True) if regex is None else F.rlike(name, F.lit(regex)))
        else:
            terms.append(name == sought)
    if filters.ext is not None:
        terms.append(model.extension(path) == filters.ext.lower())
    if filters.lang is not None:
        terms.append(F.col("language") == model.parse_language(filters.lang, every_language))
    for column, low, high in (("size", filters.size_min, filters.size_max), ("mtime", filters.mtime_min, filters.mtime_max)):
        if low is not None:
            terms.append(F.col(column) >= low)
        if high is not None:
            terms.append(F.col(column) <= high)
    return reduce(and_, terms)


def line_range(number: Column, filters: Filters) -> Column | None:
    terms = []
    if filters.line_start is not None:
        terms.append(number >= filters.line_start)
    if filters.line_end is not None:
        terms.append(number <= filters.line_end)
    return reduce(and_, terms) if terms else None


def search_terms(node: Node | None) -> list[str]:
    """Lower-cased words of a query that file names are compared with; negated ones don't count."""
    found: list[str] = []

    def walk(x: Node | None) -> None:
        match x:
            case Literal(text) | Phrase(text) | Boosted(text, _):
                found.extend(w for w in text.split() if len(w.encode()) >= 2)
            case Regex(pattern):
                k = next((i for i, c in enumerate(pattern) if not (c.isalnum() or c == "_")), len(pattern))
                if len(pattern[:k].encode()) >= 2:
                    found.append(pattern[:k])
            case Near(terms, _):
                found.extend(t for t in terms if len(t.encode()) >= 2)
            case And(nodes) | Or(nodes):
                for n in nodes:
                    walk(n)

    walk(node)
    return list(dict.fromkeys(t.lower() for t in found))


def boost_of(node: Node | None) -> float:
    match node:
        case Boosted(_, boost):
            return boost
        case And(nodes) | Or(nodes):
            return max([1.0, *map(boost_of, nodes)])
    return 1.0
