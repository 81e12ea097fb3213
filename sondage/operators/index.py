"""The inverted index as tables: trigram postings, token postings with positions, frequencies and stop-grams."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T

STOP_GRAMS = 512
#: Ranges that rows are numbered by, and values that these are cut from.
RANGES = 512
RANGE_SAMPLE = 16384


def _keys(docs: DataFrame) -> tuple[str, ...]:
    return ("doc_id", "segment_id") if "segment_id" in docs.columns else ("doc_id",)


def grams(docs: DataFrame, lower: bool = True, only: list[int] | None = None) -> DataFrame:
    """Postings ``gram, doc_id`` and, if ``docs`` have it, ``segment_id``: every distinct byte trigram of each text, or those of ``only``.

    Of lower-cased text by default, which serves exact and case-blind queries alike.
    """
    return T.trigrams(docs, lower, _keys(docs), only=only).select("gram", *_keys(docs))


def tokens(docs: DataFrame) -> DataFrame:
    """Postings ``token, doc_id`` (and ``segment_id``, if ``docs`` have it) with ascending ordinals in ``positions``.

    Each text gives its own; they are shuffled only if an id comes twice, which a look at the ids alone tells.
    """
    keys = _keys(docs)
    each = T.token_lists(docs, keys)
    if docs.groupBy(*keys).count().where("count > 1").isEmpty():
        return each
    return each.groupBy("token", *keys).agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def token_documents(docs: DataFrame) -> DataFrame:
    """Postings ``token, doc_id`` (and ``segment_id``, if ``docs`` have it) without positions; needs no shuffle."""
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("token"), *_keys(docs))


def document_frequency(postings: DataFrame, term: str = "gram") -> DataFrame:
    return postings.groupBy(term).agg(F.count("*").alias("df"))


def stop_grams(frequency: DataFrame, documents: int, cap: int = STOP_GRAMS) -> DataFrame:
    """Trigrams of more than half of all documents, the ``cap`` most frequent; ties go to the lower trigram."""
    return frequency.where(F.col("df") >= documents // 2 + 1).orderBy(F.desc("df"), "gram").limit(cap)


def posting_lists(postings: DataFrame, term: str) -> DataFrame:
    """Ascending ids of the documents of each term."""
    return postings.groupBy(term).agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def holding_all(postings: DataFrame, terms: list, term: str = "gram") -> DataFrame:
    """Ids (``doc_id`` and, if ``postings`` have it, ``segment_id``) of documents that hold every one of ``terms``.

    ``postings`` hold no pair twice.
    """
    wanted, keys = sorted(set(terms)), _keys(postings)
    found = postings.where(F.col(term).isin(*wanted)).select(term, *keys)
    if len(wanted) == 1:
        return found.select(*keys)
    return found.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(*keys)


def containing(token_postings: DataFrame, needle: str) -> DataFrame:
    """Ids of documents with a token that holds ``needle``."""
    return token_postings.where(F.contains("token", F.lit(needle.lower()))).select(*_keys(token_postings)).distinct()


def adjacent(token_postings: DataFrame, phrase: list[tuple[str, int]]) -> DataFrame:
    """Ids of documents that have the tokens of ``phrase`` (token, ordinal) with exactly its gaps."""
    keys = _keys(token_postings)
    if not phrase:
        return token_postings.select(*keys).limit(0)
    base = phrase[0][1]
    parts = [F.when(F.col("token") == t, F.transform("positions", lambda p: p - (o - base))) for t, o in phrase]
    starts = [F.max(p).alias(f"p{k}") for k, p in enumerate(parts)]
    found = token_postings.where(F.col("token").isin(*sorted({t for t, _ in phrase}))).groupBy(*keys).agg(*starts)
    common = F.col("p0")
    for k in range(1, len(parts)):
        common = F.array_intersect(common, F.col(f"p{k}"))
    # A token that is missing leaves its column null, and so the condition.
    return found.where(F.size(common) > 0).select(*keys)


def _ranges(files: DataFrame, order: str) -> list:
    """Values that cut ``order`` into some :data:`RANGES` ranges of about the same number of rows: quantiles of the rows with the least hashes."""
    least = files.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(RANGE_SAMPLE)
    some = sorted({r[0] for r in least.collect()})
    return sorted({some[k * len(some) // RANGES] for k in range(1, RANGES)}) if some else []


def _range_of(value: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` aren't above ``value``, found in two steps of about a root of them each."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    below = lambda some: F.size(F.filter(some, lambda c: c <= value))
    groups = [cuts[k : k + step - 1] for k in range(0, len(cuts), step)]
    tops = cuts[step - 1 :: step]
    kind = "bigint" if isinstance(cuts[0], int) else "string"
    array = lambda values: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    groups += [[]] * (len(tops) + 1 - len(groups))
    group = below(array(tops)) if tops else F.lit(0)
    return group * step + below(F.get(F.array(*map(array, groups)), group))


def assign_segments(files: DataFrame, chunk: int = model.FILES_PER_SEGMENT, first_id: int = 1, order: str = "path") -> DataFrame:
    """Consecutive ids from ``first_id`` in order of ``order``, and segments of ``chunk`` files from 1; 0 makes one segment.

    The numbering is distributed: rows are cut into ranges by their values, counted by range, and numbered within it.  A row's range
    depends on its value alone, never on the partition that holds it, which another evaluation of the same plan may change.
    """
    placed = files.withColumn("__range", _range_of(F.col(order), cuts := _ranges(files, order)))
    size = {r[0]: r[1] for r in placed.groupBy("__range").count().collect()}
    before = [0, *itertools.accumulate(size.get(k, 0) for k in range(len(cuts)))]
    row = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    number = F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), F.col("__range")) + row
    out = placed.withColumn("__number", number).withColumn("doc_id", (F.col("__number") + (first_id - 1)).cast("bigint"))
    segment = F.lit(1) if chunk == 0 else (F.floor((F.col("__number") - 1) / chunk) + 1).cast("int")
    return out.withColumn("segment_id", segment).drop("__range", "__number")


def bloom_size(elements: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for so many elements."""
    bits = max(64, math.ceil(-max(1, elements) * math.log(rate) / math.log(2) ** 2))
    return bits, min(16, max(1, round(bits / max(1, elements) * math.log(2))))


def segment_blooms(postings_by_segment: DataFrame, rate: float = 0.01) -> DataFrame:
    """Bloom filter of each segment's trigrams, ``segment_id, n_bits, n_hashes, bits`` with the set bits in order."""
    distinct = postings_by_segment.select("segment_id", "gram").distinct()
    size = distinct.groupBy("segment_id").agg(F.count("*").alias("n"))
    size = size.withColumn("n_bits", F.greatest(F.lit(64), F.ceil(-F.greatest(F.col("n"), F.lit(1)) * math.log(rate) / math.log(2) ** 2)).cast("bigint"))
    size = size.withColumn("n_hashes", F.least(F.lit(16), F.greatest(F.lit(1), F.round(F.col("n_bits") / F.greatest(F.col("n"), F.lit(1)) * math.log(2)))).cast("int"))
    placed = distinct.join(size, "segment_id").select("segment_id", "n_bits", "n_hashes", F.explode(_bloom_places(F.col("gram"), F.col("n_bits"), F.col("n_hashes"))).alias("bit"))
    return placed.groupBy("segment_id", "n_bits", "n_hashes").agg(F.sort_array(F.collect_set("bit")).alias("bits"))


def _bloom_places(gram, bits, hashes):
    one, two = F.xxhash64(gram), F.xxhash64(gram, F.lit(1))
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(F.pmod(one, bits) + i * F.pmod(two, bits), bits))


def might_contain(blooms: DataFrame, trigrams: list[int]) -> DataFrame:
    """Segments whose filter passes all of ``trigrams``."""
    out = blooms
    for g in trigrams:
        gram = F.lit(g).cast("int")
        out = out.where(F.forall(_bloom_places(gram, F.col("n_bits"), F.col("n_hashes")), lambda b: F.array_contains("bits", b)))
    return out.select("segment_id")


def language_counts(docs: DataFrame) -> DataFrame:
    """Files by language, most first; deleted files still count."""
    return docs.groupBy("language").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "language")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents, valid ones, tombstones, their share, and bytes of text."""
    dead = F.count_if(F.col("flags").bitwiseAND(model.TOMBSTONE) != 0)
    return docs.agg(
        F.count("*").alias("n_docs"),
        F.count_if(model.is_valid(F.col("flags"))).alias("n_valid"),
        dead.alias("n_tombstones"),
        F.round(F.coalesce(F.try_divide(dead, F.count("*")), F.lit(0.0)), 6).alias("tombstone_ratio"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"),
    )
