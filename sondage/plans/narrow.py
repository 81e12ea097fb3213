"""Narrowing a query's documents by the index.  It only ever leaves out documents that can't match."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import query_tokens, query_trigrams, regex_prefix, whole_tokens
from .syntax import And, Boosted, Literal, Near, Node, Not, Or, Phrase, Query, Regex

#: Trigrams of a term that are looked up; any subset is sound, the rarest narrow most.
RAREST = 4
#: Segments up to which only their partitions are read.
FEW_SEGMENTS = 2000
_WHOLE_WORDS = re.compile(r"\\b([A-Za-z0-9]+(?: [A-Za-z0-9]+)*)\\b")


class Narrowing:
    """What the index knows of a query, as a plan; ``None`` narrows nothing.

    ``grams`` are trigrams that a document must hold, ``tokens`` whole tokens with ordinals that it must have at just these distances;
    ``and``, ``or`` combine plans, and ``but`` takes documents away that are sure to match what a query denies.
    """

    def __init__(self, ignore_case: bool = False, tokens: bool = True):
        self.ignore_case, self.tokens = ignore_case, tokens

    def of(self, node: Node):
        match node:
            case Literal(text) | Boosted(text, _):
                return self._grams(text)
            case Phrase(text):
                return self._all([self._grams(text), None if self.ignore_case else self._adjacent(whole_tokens(text))])
            case Regex(pattern):
                if self.ignore_case or pattern.startswith("(?"):
                    return None
                if words := _WHOLE_WORDS.fullmatch(pattern):
                    return self._all([self._grams(words[1]), self._adjacent(query_tokens(words[1]))])
                prefix = regex_prefix(pattern)
                return None if prefix is None else self._grams(prefix)
            case Near(terms, _):
                return self._all([self._grams(t) for t in terms])
            case And(nodes):
                found = self._all([self.of(n) for n in nodes if not isinstance(n, Not)])
                denied = [d for n in nodes if isinstance(n, Not) and (d := self.sure(n.node)) is not None]
                return ("but", (found, *denied)) if found is not None and denied else found
            case Or(nodes):
                parts = [self.of(n) for n in nodes]
                return None if any(p is None for p in parts) else ("or", tuple(parts))
        return None

    def sure(self, node: Node):
        """Plan of documents that are sure to match a term, or None if the index can't tell."""
        match node:
            case Literal(text) | Boosted(text, _):
                if self.tokens and re.fullmatch("[A-Za-z0-9]{2,128}", text):
                    return ("tokens", ((text.lower(), 0),))
                if text.isascii() and len(text) == 3 and "\n" not in text and "\r" not in text:
                    return ("grams", tuple(query_trigrams(text.lower())))
            case Or(nodes):
                parts = tuple(p for n in nodes if (p := self.sure(n)) is not None)
                return ("or", parts) if parts else None
        return None

    @staticmethod
    def _grams(text: str):
        # The index has trigrams of lower-cased text; only ASCII is folded alike by every runtime.
        found = tuple(query_trigrams(text.lower())) if text.isascii() else ()
        return ("grams", found) if found else None

    def _adjacent(self, phrase: list[tuple[str, int]]):
        return ("tokens", tuple(phrase)) if self.tokens and phrase else None

    @staticmethod
    def _all(parts: list):
        kept = tuple(p for p in parts if p is not None)
        return kept[0] if len(kept) == 1 else ("and", kept) if kept else None


def _terms(plan) -> set[int]:
    kind, parts = plan
    return set(parts) if kind == "grams" else set() if kind == "tokens" else set().union(*map(_terms, parts))


def trigrams(query: Query) -> list[int]:
    """All trigrams that narrowing by an index without tokens looks up."""
    plan = Narrowing(query.ignore_case, tokens=False).of(query.root)
    return sorted(_terms(plan)) if plan else []


def _documents(plan, postings: DataFrame, tokens: DataFrame | None, frequency: dict[int, int], stops: set[int], exact: bool = False) -> DataFrame | None:
    from ..operators import index as I

    kind, parts = plan
    if kind == "grams":
        useful = sorted((g for g in parts if exact or g not in stops), key=lambda g: (frequency.get(g, 0), g))[:RAREST]
        return I.holding_all(postings, useful) if useful else None
    if kind == "tokens":
        return I.holding_all(tokens, [parts[0][0]], "token") if len(parts) == 1 else I.adjacent(tokens, list(parts))
    if kind == "but":
        out = _documents(parts[0], postings, tokens, frequency, stops)
        for p in parts[1:] if out is not None else ():
            out = out.join(_documents(p, postings, tokens, frequency, stops, exact=True), list(I._keys(out)), "left_anti")
        return out
    found = [_documents(p, postings, tokens, frequency, stops, exact) for p in parts]
    if kind == "or":
        if any(f is None for f in found):
            return None
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out.distinct()
    out = None
    for f in found:
        if f is not None:
            out = f if out is None else out.join(f, list(I._keys(out)), "left_semi")
    return out


def candidates(query: Query, postings: DataFrame, frequency: DataFrame, documents: int, stops: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame | None:
    """Ids of the documents that the index leaves, or None if it can't narrow the query.

    One small lookup on the driver fetches the frequencies of the query's own trigrams.
    """
    plan = Narrowing(query.ignore_case, tokens is not None).of(query.root)
    if plan is None:
        return None
    wanted = sorted(_terms(plan))
    known = {r["gram"]: r["df"] for r in frequency.where(F.col("gram").isin(*wanted)).collect()}
    if stops is None:
        common = {g for g, n in known.items() if n >= documents // 2 + 1}
    else:
        common = {r["gram"] for r in stops.where(F.col("gram").isin(*wanted)).collect()}
    return _documents(plan, postings, tokens, known, common)


def narrowed(docs: DataFrame, query: Query, postings: DataFrame, frequency: DataFrame, documents: int, stops: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """``docs`` without the documents that the index rules out.

    Where the postings name segments, those of the documents that are left are looked up first, so that of ``docs`` partitioned by
    segment only theirs are read.
    """
    found = candidates(query, postings, frequency, documents, stops, tokens)
    if found is None:
        return docs
    if "segment_id" in found.columns and "segment_id" in docs.columns:
        segments = [r[0] for r in found.select("segment_id").distinct().limit(FEW_SEGMENTS + 1).collect()]
        if len(segments) <= FEW_SEGMENTS:
            docs = docs.where(F.col("segment_id").isin(*sorted(segments)))
        return docs.join(found, ["segment_id", "doc_id"], "left_semi").select(docs.columns)
    return docs.join(found.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
