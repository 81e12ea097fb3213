"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined to the positions of the same hashes in license templates.  A
match votes for its diagonal, the offset between the two positions; Spark counts the votes of each diagonal and merges
neighbouring ones, since an inserted or lost word moves the rest of a license to the next.  Merged spans that cover enough of
the template are verified word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_templates import TEMPLATES
from .runtime import among, cut, fits, small, table
from .wordgrams import WORD_PATTERN, gram_codes, signed, slices, words_of

GRAM_WORDS = 3
#: Share of a template's words that a span must cover.
MIN_COVERAGE = 0.75
#: Diagonals at most so far apart are merged.
DRIFT = 4

SPANS = "doc_id bigint, license string, start_word int, end_word int, covered int, template_words int, coverage double"


def template_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)], "template_id int, license string, form string, text string")


def rolling(texts: DataFrame, k: int) -> DataFrame:
    """Columns ``id, version, pos, gram`` of every word k-gram of a frame with ``id, version, text``."""

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                grams, valid = gram_codes(words, k)
                doc = words.doc[: len(grams)][valid]
                at = np.flatnonzero(valid) - words.first[doc]
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(of), part.column("version").take(of), pa.array(at.astype(np.int32)), signed(grams[valid])], names=["id", "version", "pos", "gram"]
                )

    return texts.mapInArrow(emit, "id bigint, version bigint, pos int, gram bigint")


def diagonals(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Columns ``id, version, template, words, license, diagonal, votes, places, first, last`` from k-grams of documents and of templates.

    A diagonal is a text's position less a template's; ``places`` are the template's positions that vote for it, ``first`` and ``last``
    the text's.  They are counted before anything is gathered, so that a row is as small as its template, however often the text holds it.
    """
    of = ["id", "version", "template", "words", "license", (F.col("pos") - F.col("q")).alias("diagonal")]
    return (
        docs.join(small(places), "gram")
        .groupBy(*of)
        .agg(F.array_sort(F.collect_set("q")).alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        .withColumn("votes", F.size("places"))
    )


def merged(found: DataFrame, k: int, drift: int = DRIFT) -> DataFrame:
    """Spans of neighbouring diagonals: ``id, version, template, words, license, start, end, diagonals, covered``.

    Of one text and template, diagonals are neighbours if the next is at most ``drift`` away.  Neighbours are taken in order of
    their first position in the text; one whose first place in the template is not beyond that of the one before begins a span
    of its own, as there the license begins again.
    """
    one = ["id", "version", "template", "words", "license"]
    far = F.col("diagonal") - F.lag("diagonal").over(Window.partitionBy(*one).orderBy("diagonal")) > drift
    near = found.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("cluster", F.sum("far").over(Window.partitionBy(*one).orderBy("diagonal")))
    order = Window.partitionBy(*one, "cluster").orderBy("first", "diagonal")
    again = F.element_at("places", 1) <= F.lag(F.element_at("places", 1)).over(order)
    parts = near.withColumn("again", F.coalesce(again, F.lit(False)).cast("int")).withColumn("part", F.sum("again").over(order))
    spans = parts.groupBy(*one, "cluster", "part").agg(
        F.min("first").alias("start"), (F.max("last") + k).alias("end"), F.collect_list("diagonal").alias("diagonals"), F.flatten(F.collect_list("places")).alias("places")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda q: F.sequence(q, q + (k - 1))))))
    return spans.select(*one, "start", "end", "diagonals", covered.alias("covered"))


def covering(words: list[str], template: list[str], diagonals: list[int], k: int) -> int:
    """How many words of ``template`` are in runs of at least ``k`` that ``words`` repeats on one of ``diagonals``."""
    seen: set[int] = set()
    for d in diagonals:
        run = 0
        for q in range(max(0, -d), min(len(template), len(words) - d)):
            run = run + 1 if template[q] == words[q + d] else 0
            if run >= k:
                seen.update(range(q - k + 1, q + 1) if run == k else (q,))
    return len(seen)


def outermost(spans: list[tuple]) -> list[tuple]:
    """``(start, end, license, covered, words)`` that lie in no longer span, nor in an equal one that is better covered or sorts before."""
    kept, reach = [], -1
    for s in sorted(set(spans), key=lambda s: (s[0], -s[1], -s[3] / s[4], -s[3], s[2])):
        if s[1] > reach:
            kept.append(s)
            reach = s[1]
    return kept


def _words(text: str) -> list[str]:
    found = words_of(pa.array([text]))
    data = found.data.tobytes()
    return [data[a:b].decode() for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]


def licenses(docs: DataFrame, templates: DataFrame | None = None, k: int = GRAM_WORDS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Spans of license texts in documents: ``doc_id, license``, half-open word range, template words covered and their share.

    ``docs`` needs ``doc_id`` and ``text``, ``templates`` ``template_id, license, text``; other columns are ignored.  Texts that
    are null or shorter than ``k`` words have no spans, nor have rows with a null id.  Equal rows of the result count once, and so do
    repeated rows of ``docs``; each of an id's texts is scanned by itself.  A span inside a longer one, or an equal span of a license
    that covers less of its template or, if as much, whose name sorts later, is left out.  Very long texts are scanned whole; what is gathered
    of a text is bounded by the licenses that it holds.
    """
    spark = docs.sparkSession
    forms = (template_frame(spark) if templates is None else templates).select(F.col("template_id").cast("bigint").alias("id"), F.col("license").cast("string").alias("license"), "text")
    forms = forms.where("id is not null and license is not null and text is not null").withColumn("version", F.lit(0).cast("bigint"))
    grams = rolling(forms, k).select(F.col("id").alias("template"), F.col("pos").alias("q"), "gram")
    places = grams.join(grams.groupBy("template").agg((F.max("q") + k).alias("words")), "template").join(forms.select(F.col("id").alias("template"), "license"), "template")
    # An id may have several texts; the hash tells them apart.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("version"), "text").where("id is not null and text is not null")
    spans = merged(diagonals(rolling(texts, k), cut(places)), k).where(F.col("covered") >= F.lit(min_coverage) * F.col("words"))
    wanted = cut(
        spans.join(forms.select(F.col("id").alias("template"), F.col("text").alias("form")), "template")
        .groupBy(F.col("id").alias("doc"), F.col("version").alias("of"))
        .agg(F.collect_list(F.struct("license", "form", "start", "end", "diagonals")).alias("spans"))
    )
    # Beyond what may be broadcast, few texts without a span are shuffled.
    near = texts if fits(wanted) else texts.where(among(wanted.select("doc"))(F.col("id")))
    pairs = near.join(small(wanted), (F.col("id") == F.col("doc")) & (F.col("version") == F.col("of"))).select("id", "text", "spans")

    def verify(batches):
        known: dict[str, list[str]] = {}
        for batch in batches:
            rows = []
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans")), strict=True):
                words, found = _words(text), []
                for s in spans:
                    if s["form"] not in known:
                        known[s["form"]] = _words(s["form"])
                    form = known[s["form"]]
                    n = covering(words, form, s["diagonals"], k)
                    if n >= min_coverage * len(form):
                        found.append((s["start"], s["end"], s["license"], n, len(form)))
                rows += [(i, name, a, b, n, w, round(n / w, 6)) for a, b, name, n, w in outermost(found)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "license", "start_word", "end_word", "covered", "template_words", "coverage"])

    return pairs.mapInArrow(verify, SPANS).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
WITH f AS (SELECT template, license, regexp_extract_all(lower(t), '{WORD_PATTERN}') AS w
           FROM (VALUES {", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, _, text) in enumerate(TEMPLATES))}) AS v(template, license, t)),
fg AS (SELECT template, license, len(w) AS words, i AS q, array_to_string(w[i + 1 : i + {GRAM_WORDS}], ' ') AS g
       FROM (SELECT *, unnest(range(0, len(w) - {GRAM_WORDS - 1})) AS i FROM f)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{WORD_PATTERN}') AS w
      FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
dg AS (SELECT r, doc_id, i AS p, array_to_string(w[i + 1 : i + {GRAM_WORDS}], ' ') AS g
       FROM (SELECT *, unnest(range(0, len(w) - {GRAM_WORDS - 1})) AS i FROM d)),
s AS (SELECT r, doc_id, template, license, words, p - q AS diagonal, list(q) AS places, min(q) AS low, min(p) AS first, max(p) AS last
      FROM dg JOIN fg USING (g) GROUP BY ALL),
c AS (SELECT *, sum(far) OVER (PARTITION BY r, template ORDER BY diagonal) AS cluster
      FROM (SELECT *, CAST(coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {DRIFT}, false) AS INT) AS far FROM s)),
h AS (SELECT *, sum(again) OVER (PARTITION BY r, template, cluster ORDER BY first, diagonal) AS part
      FROM (SELECT *, CAST(coalesce(low <= lag(low) OVER (PARTITION BY r, template, cluster ORDER BY first, diagonal), false) AS INT) AS again FROM c)),
m AS (SELECT r, doc_id, template, license, words, min(first) AS a, max(last) + {GRAM_WORDS} AS b,
             len(list_distinct(flatten(list_transform(flatten(list(places)), lambda q: range(q, q + {GRAM_WORDS}))))) AS n
      FROM h GROUP BY r, doc_id, template, license, words, cluster, part),
x AS (SELECT DISTINCT r, doc_id, license, a, b, n, words FROM m WHERE n >= {MIN_COVERAGE} * words),
o AS (SELECT *, max(b) OVER (PARTITION BY r ORDER BY a, b DESC, n / words DESC, n DESC, license ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)
SELECT DISTINCT doc_id, license, CAST(a AS INTEGER) AS start_word, CAST(b AS INTEGER) AS end_word, CAST(n AS INTEGER) AS covered,
       CAST(words AS INTEGER) AS template_words, round(n / words, 6) AS coverage
FROM o WHERE reach IS NULL OR b > reach
"""
