"""Benchmark decontamination by winnowing.

Each text is reduced to the least k-gram hash of every window of ``w`` word k-grams.  Any run of ``w + k - 1`` words
that a document shares with a benchmark item has at least one fingerprint in common, so that joining the fingerprints
misses none; each hit is then extended word by word to the maximal shared run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, matched, small, table, without
from .wordgrams import WORD_PATTERN, gram_codes, signed, slices, winnow, words_of

#: A shared run of that many words is contamination; 13 is the usual choice of published decontamination reports.
MIN_WORDS = 13
GRAM_WORDS = 8

HITS = "doc_id bigint, item_id bigint, doc_start int, doc_end int, item_start int, item_end int, n_words int"


def fingerprints(texts: DataFrame, k: int, w: int) -> DataFrame:
    """Columns ``id, pos, gram`` of the winnowed fingerprints of a frame with ``id, text``; null texts have none."""

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                grams, valid = gram_codes(words, k)
                doc = words.doc
                at = winnow(grams, valid, doc, w)
                which = doc[at]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(which)), pa.array((at - words.first[which]).astype(np.int32)), signed(grams[at])],
                    names=["id", "pos", "gram"],
                )

    return texts.mapInArrow(emit, "id bigint, pos int, gram bigint")


def _extended(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int, int]]:
    """Maximal runs that are equal in ``a`` and ``b`` and hold a seed (place in ``a``, place in ``b``)."""
    out, reached = [], {}
    for i, j in sorted(seeds):
        diagonal = i - j
        if reached.get(diagonal, -1) > i:
            continue
        lo_a = max(0, diagonal)
        n = min(len(a) - lo_a, len(b) - (lo_a - diagonal))
        same = a[lo_a : lo_a + n] == b[lo_a - diagonal : lo_a - diagonal + n]
        at = i - lo_a
        if not same[at]:
            continue
        breaks = np.flatnonzero(~same)
        k = np.searchsorted(breaks, at)
        start = int(breaks[k - 1]) + 1 if k else 0
        end = int(breaks[k]) if k < len(breaks) else n
        reached[diagonal] = lo_a + end
        if end - start >= least:
            out.append((lo_a + start, lo_a + end, lo_a - diagonal + start, lo_a - diagonal + end))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, k: int = GRAM_WORDS) -> DataFrame:
    """Every maximal run of at least ``min_words`` words that a document and a benchmark item share.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns are ignored, whatever
    their names.  Columns of the result: ``doc_id, item_id``, the run's half-open word ranges in both, and ``n_words``.

    Null, empty and wordless texts share nothing; rows with a null id are left out.  Repeated rows (same id and text)
    count once; if an id has several texts, each counts.  Equal items each get their rows.  Case and punctuation don't matter.
    """
    k = min(k, min_words)
    w = min_words - k + 1
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null").distinct()
    wanted = cut(fingerprints(items, k, w).select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "gram"))
    found = fingerprints(texts, k, w).join(small(wanted), "gram")
    seeds = cut(
        found.groupBy("id", "item_id").agg(F.collect_set(F.struct(F.col("pos").alias("a"), F.col("item_pos").alias("b"))).alias("seeds"))
    )
    pairs = (
        matched(texts, seeds.withColumnRenamed("id", "doc"), "id", "doc")
        .select("doc", "text", "item_id", "seeds")
        .join(items.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
        .select("doc", "text", "item_id", "item_text", "seeds")
    )

    def extend(batches):
        for batch in batches:
            rows = []
            for part in slices(batch, "text"):
                a, b = words_of(part.column("text")), words_of(part.column("item_text"))
                ids, items_ = part.column("doc").to_pylist(), part.column("item_id").to_pylist()
                for r, seeds_ in enumerate(part.column("seeds").to_pylist()):
                    left, right = a.code[a.first[r] : a.first[r + 1]], b.code[b.first[r] : b.first[r + 1]]
                    inside = [(s["a"], s["b"]) for s in seeds_ if s["a"] < len(left) and s["b"] < len(right)]
                    for x in _extended(left, right, inside, min_words):
                        rows.append((ids[r], items_[r], *x, x[1] - x[0]))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])],
                    names=["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "n_words"],
                )

    return pairs.mapInArrow(extend, HITS).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without those that share a run of ``min_words`` words with a benchmark item; the others stay as they are."""
    hits = cut(contaminated(docs, benchmark, min_words).select("doc_id").distinct())
    return without(docs, hits, "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_PATTERN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_PATTERN}') AS w FROM benchmark),
dg AS (SELECT doc_id, i AS pos, array_to_string(w[i + 1 : i + {MIN_WORDS}], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS i FROM d)),
bg AS (SELECT item_id, i AS pos, array_to_string(w[i + 1 : i + {MIN_WORDS}], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS i FROM b)),
m AS (SELECT DISTINCT doc_id, item_id, dg.pos AS p, bg.pos AS q FROM dg JOIN bg USING (g)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM m)
SELECT doc_id, item_id, CAST(min(p) AS INTEGER) AS doc_start, CAST(max(p) + {MIN_WORDS} AS INTEGER) AS doc_end,
       CAST(min(q) AS INTEGER) AS item_start, CAST(max(q) + {MIN_WORDS} AS INTEGER) AS item_end,
       CAST(max(p) - min(p) + {MIN_WORDS} AS INTEGER) AS n_words
FROM r GROUP BY doc_id, item_id, p - q, island
"""
