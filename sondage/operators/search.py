"""Matching lines, matching files, counts and ranked results over a ``docs`` frame.

``docs`` has the columns of :data:`sondage.model.DOCS`.  Matching shuffles nothing; only the final order does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..plans import compile as C
from ..plans.syntax import Query


@dataclass(frozen=True)
class Weights:
    """How a ranked match is scored."""

    match_count: float = 1.0
    filename: float = 2.0
    depth: float = 0.05
    max_depth: float = 0.5
    recency: float = 1.0
    half_life: float = 604800.0
    least: float = 0.1


def _nothing(docs: DataFrame) -> DataFrame:
    return docs.where(F.lit(False))


def candidates(docs: DataFrame, query: Query, every_language: bool = False) -> DataFrame:
    """Documents that pass the filters and could match."""
    if query.is_empty():
        return _nothing(docs)
    node = C.pruned(query.root)
    kept = docs.where(C.document_filter(query.filters, every_language))
    return kept if node is None else kept.where(C.maybe(F.col("text"), node, query.ignore_case))


def match_rows(docs: DataFrame, query: Query, every_language: bool = False, keep_lines: bool = False) -> DataFrame:
    """One row a match (:data:`sondage.model.MATCH`), unordered; a bag, as a line may match twice.

    A query of filters alone gives one row a file, with line 1 and no text.  ``keep_lines`` adds the text's lines.
    """
    found = candidates(docs, query, every_language)
    node = C.pruned(query.root)
    extra = ["lines"] if keep_lines else []
    if keep_lines:
        found = found.withColumn("lines", T.lines(F.col("text")))
    if node is None:
        return found.select("doc_id", "path", F.lit(1).alias("line_number"), F.lit("").alias("line"), F.lit(0).alias("match_start"), F.lit(0).alias("match_end"), *extra)
    if C.is_leaf(node):
        # A single term needs no array of rows: lines are generated, filtered and measured one by one.
        each = found.select("doc_id", "path", *extra, F.posexplode(T.lines(F.col("text"))).alias("place", "line"))
        hit, start, end = C.leaf(F.col("line"), node, query.ignore_case)
        number = (F.col("place") + 1).alias("line_number")
        out = each.where(hit).select("doc_id", "path", number, "line", start.cast("int").alias("match_start"), end.cast("int").alias("match_end"), *extra)
    else:
        numbered = found.withColumn("numbered", C.numbered_lines(F.col("text")))
        matched = numbered.select("doc_id", "path", *extra, F.explode(C.rows(F.col("numbered"), node, query.ignore_case)).alias("m"))
        out = matched.select("doc_id", "path", "m.line_number", "m.line", "m.match_start", "m.match_end", *extra)
    wanted = C.line_range(F.col("line_number"), query.filters)
    return out if wanted is None else out.where(wanted)


def _around(lines: Column, number: Column, before: int, after: int) -> tuple[Column, Column]:
    def numbered(low: Column, n: Column) -> Column:
        part = F.slice(lines, low, F.greatest(n, F.lit(0)))
        return F.transform(part, lambda x, i: F.struct((low + i).cast("int").alias("line_number"), x.alias("line")))

    low = F.greatest(number - before, F.lit(1))
    return numbered(low, F.least(number, F.size(lines) + 1) - low), numbered(number + 1, F.least(F.lit(after), F.size(lines) - number))


def grep(docs: DataFrame, query: Query, before: int = 0, after: int = 0, limit: int = 0, every_language: bool = False) -> DataFrame:
    """Matching lines in order of path and line, with ``before`` and ``after`` lines of context in arrays if asked for.

    ``sort:`` and ``top:`` don't count here; ``limit`` 0 means all.
    """
    context = before > 0 or after > 0
    out = match_rows(docs, query, every_language, keep_lines=context)
    if context:
        ahead, behind = _around(F.col("lines"), F.col("line_number"), before, after)
        alone = C.pruned(query.root) is None
        none = F.array().cast("array<struct<line_number:int,line:string>>")
        out = out.withColumn("context_before", none if alone else ahead).withColumn("context_after", none if alone else behind).drop("lines")
    out = out.orderBy("path", "line_number", "match_start", "match_end")
    return out.limit(limit) if limit else out


def files(docs: DataFrame, query: Query, limit: int = 0, every_language: bool = False) -> DataFrame:
    """Paths of matching files in order.  Patterns are tried on whole texts, and the line range doesn't count."""
    found = candidates(docs, query, every_language) if not query.is_empty() else _nothing(docs)
    node = C.pruned(query.root)
    if node is not None and not query.is_empty():
        found = docs.where(C.document_filter(query.filters, every_language)).where(C.file_matches(F.col("text"), node, query.ignore_case))
    out = found.select("path").distinct().orderBy("path")
    return out.limit(limit) if limit else out


def count_by_file(docs: DataFrame, query: Query, every_language: bool = False) -> DataFrame:
    """Number of match rows of each file, in order of path."""
    return match_rows(docs, query, every_language).groupBy("path").agg(F.count("*").alias("n_matches")).orderBy("path")


def files_with_matches(docs: DataFrame, query: Query) -> DataFrame:
    """How many files match, and how many rows there are."""
    return match_rows(docs, query).agg(F.countDistinct("path").alias("n_files"), F.count("*").alias("n_rows"))


def score(n: Column, in_name: Column, path: Column, mtime: Column, boost: float, now: int, weights: Weights = Weights()) -> Column:
    """Score of a file's matches at time ``now`` (unix seconds)."""
    depth = F.size(F.split(path, "/", -1))
    age = F.greatest(F.lit(now) - mtime, F.lit(0))
    fresh = F.when((mtime == 0) | F.lit(now == 0), F.lit(0.0)).otherwise(weights.recency * F.exp(-age.cast("double") * 0.693 / weights.half_life))
    plain = (
        F.log2(n.cast("double") + 1) * weights.match_count
        + F.when(in_name, F.lit(weights.filename)).otherwise(F.lit(0.0))
        - F.least(depth * F.lit(weights.depth), F.lit(weights.max_depth))
        + fresh
    )
    return F.greatest(F.lit(weights.least), plain * (boost if boost > 0 else 1.0))


def name_hit(path: Column, terms: list[str]) -> Column:
    name = F.lower(model.basename(path))
    return reduce(or_, (F.contains(name, F.lit(t)) for t in terms)) if terms else F.lit(False)


def ranked(docs: DataFrame, query: Query, now: int, weights: Weights = Weights(), within: DataFrame | None = None) -> DataFrame:
    """Best matches (:data:`sondage.model.RANKED`) in the query's order, ``top:`` of them or all if that is 0.

    Files whose name holds a term of the query but whose text has no match come with line 1 and score 2, if they pass the
    filters, ``top:`` of them at most in order of id.  All matches are scored before the best are taken.  ``within`` are the documents
    that can match, where an index has left out others; names are looked for in all.
    """
    node = C.pruned(query.root)
    kept = docs.where(C.document_filter(query.filters)) if not query.is_empty() else _nothing(docs)
    terms = C.search_terms(node)
    if node is None:
        hits = kept.select("doc_id", "path", "mtime", F.lit(1).alias("line_number"), F.lit(1.0).alias("score"))
    else:
        texts = kept if within is None else within.where(C.document_filter(query.filters))
        numbered = texts.where(C.maybe(F.col("text"), node, query.ignore_case)).withColumn("numbered", C.numbered_lines(F.col("text")))
        found = C.rows(F.col("numbered"), node, query.ignore_case)
        wanted = C.line_range(F.col("line_number"), query.filters)
        if wanted is not None:
            found = F.filter(found, lambda r: C.line_range(r["line_number"], query.filters))
        matched = numbered.select("doc_id", "path", "mtime", F.transform(found, lambda r: r["line_number"]).alias("numbers")).where(F.size("numbers") > 0)
        points = score(F.size("numbers"), name_hit(F.col("path"), terms), F.col("path"), F.col("mtime"), C.boost_of(node), now, weights)
        hits = matched.select("doc_id", "path", "mtime", F.explode("numbers").alias("line_number"), points.alias("score"))
        if terms and query.limit:
            named = kept.where(name_hit(F.col("path"), terms))
            paths = matched.select("path").where(name_hit(F.col("path"), terms))
            rest = named.join(paths, "path", "left_anti").orderBy("doc_id").limit(query.limit)
            hits = hits.union(rest.select("doc_id", "path", "mtime", F.lit(1), F.lit(2.0)))
    hits = hits.withColumn("score", F.round("score", 6))
    order = {"score": [F.desc("score"), "path", "line_number"], "recency": [F.desc("mtime"), "path", "line_number"], "path": ["path", "line_number"]}
    out = hits.orderBy(*order[query.sort], "doc_id").select("doc_id", "path", "line_number", "score")
    return out.limit(query.limit) if query.limit else out
