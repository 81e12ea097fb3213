"""Index tables, narrowing and upkeep."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sondage.functions.patterns import query_tokens
from sondage.operators import index as I
from sondage.operators import search as S
from sondage.operators import upkeep as U
from sondage.plans import narrow
from sondage.plans.parser import parse_query
from sondage.queries import QUERIES
from sondage.sources.corpus import from_documents

FILES = [("a.rs", "hello world foo"), ("b.rs", "hello big world"), ("c.py", "the helloWorld_test"), ("d.md", ""), ("e.md", "world hello")]


@pytest.fixture(scope="module")
def index(spark, sf):
    docs = from_documents(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("segment_id", (F.col("doc_id") / 20).cast("int"))
    grams = I.grams(docs).cache()
    return docs, grams, I.document_frequency(grams).cache(), I.tokens(docs).cache()


@pytest.mark.parametrize(
    "query",
    ["license", "LICENSE the", "fn", ".0", '"der the MI"', "license | re:/[0-9]+/", "near:license,the,3", "re:/License/", "-license", "license -the", "größe", "zzzz", "ext:rs license", "^2:license | version",
     '"the Apache License, Ver"', r"re:/\bMIT\b/", r"re:/\bGNU General\b/", "license -mit", "license -the -(lic | apache)", "(license -mit) | reserved", "the -lic"],
)
def test_narrowing_never_changes_results(index, query):
    docs, grams, frequency, tokens = index
    q = parse_query(query)
    whole = sorted(map(tuple, S.match_rows(docs, q).collect()))
    for positions in (None, tokens):
        narrowed = S.match_rows(narrow.narrowed(docs, q, grams, frequency, docs.count(), tokens=positions), q)
        assert sorted(map(tuple, narrowed.collect())) == whole


def test_tokens_narrow_only_what_is_whole(make_docs):
    files = [("a", "xlic Apache Licensee"), ("b", "the apacheLicense, Ver"), ("c", "the Apache License, Version"), ("d", "MIT"), ("e", "xMIT MITx"), ("f", "_MIT é"), ("g", "camelMIT here"), ("h", "the conShell"), ("i", "a MIT. b"), ("j", "")]
    docs = make_docs(files).withColumn("segment_id", F.col("doc_id").cast("int"))
    grams, tokens = I.grams(docs).cache(), I.tokens(docs).cache()
    frequency = I.document_frequency(grams)
    for query in ('"ache Lic"', '"the Apache License, Ver"', '" MIT."', '"MIT"', r"re:/\bMIT\b/", "onsh", "the -MIT", "the -onsh", '"the conS"', "apache -lic", "the -(mit | con)", '"c A"', "MIT | the"):
        q = parse_query(query)
        whole = sorted(r["path"] for r in S.match_rows(docs, q).collect())
        assert sorted(r["path"] for r in S.match_rows(narrow.narrowed(docs, q, grams, frequency, 10, tokens=tokens), q).collect()) == whole, query
    left = lambda q: sorted(r["doc_id"] for r in narrow.candidates(parse_query(q), grams, frequency, 10, tokens=tokens).collect())
    assert left(r"re:/\bMIT\b/") == [4, 5, 6, 7, 9] and left("the -mit -con") == [2, 3] and left('"the Apache License, Ver"') == [3]


def test_what_narrows(index):
    docs, grams, frequency, _ = index
    n = docs.count()
    size = lambda q: (lambda c: None if c is None else c.count())(narrow.candidates(parse_query(q), grams, frequency, n))
    assert size("zzzz") == 0 and size("fn") is None and size("license | x") is None and size("-license") is None
    assert size("license") < n and size("license | zzzz") == size("license")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_postings(make_docs):
    docs = make_docs(FILES)
    tokens = I.tokens(docs).cache()
    assert {(r["token"], r["doc_id"], tuple(r["positions"])) for r in tokens.collect() if r["token"] == "world"} == {("world", 1, (1,)), ("world", 2, (2,)), ("world", 3, (2,)), ("world", 5, (0,))}
    assert ids(I.holding_all(tokens, ["hello", "world"], "token")) == [1, 2, 3, 5]
    assert ids(I.holding_all(tokens, ["hello", "nope"], "token")) == []
    assert ids(I.containing(tokens, "OR")) == [1, 2, 3, 5]
    assert ids(I.adjacent(tokens, query_tokens("hello world"))) == [1, 3]
    assert ids(I.adjacent(tokens, query_tokens("hello x world"))) == [2]
    assert ids(I.adjacent(tokens, query_tokens("world world"))) == [] and ids(I.adjacent(tokens, [])) == []
    assert {r["token"]: r["doc_ids"] for r in I.posting_lists(I.token_documents(docs), "token").collect()}["hello"] == [1, 2, 3, 5]


def test_registered_byte_trigrams_are_all_of_them(spark, tmp_path):
    texts = ["Größe", "größe ÄÖ", "日本語", "ab", "", "Größe größe", "größer"]
    rows = [(k, t, "de", "src1", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [t.lower().encode() for t in texts]
    want = Counter(g for b in raw for g in {b[i : i + 3].hex().upper() for i in range(len(b) - 2)})
    assert {r["gram"]: r["df"] for r in QUERIES["trigram_df"](spark, tmp_path).collect()} == want
    assert {r["gram"]: r["df"] for r in QUERIES["stop_grams"](spark, tmp_path).collect()} == {g: n for g, n in want.items() if n >= 4} != {}


def test_stop_grams(spark):
    frequency = spark.createDataFrame([(1, 10), (2, 6), (3, 5), (4, 6)], "gram int, df bigint")
    assert [r["gram"] for r in I.stop_grams(frequency, 10).collect()] == [1, 2, 4]
    assert [r["gram"] for r in I.stop_grams(frequency, 10, cap=2).collect()] == [1, 2]
    assert I.stop_grams(frequency, 100).count() == 0


def test_bloom_filters(spark):
    postings = spark.createDataFrame([(s, g) for s in (1, 2) for g in range(s * 1000, s * 1000 + 300)], "segment_id int, gram int")
    blooms = I.segment_blooms(postings).cache()
    assert [r[0] for r in I.might_contain(blooms, [1005, 1200]).collect()] == [1]
    false = sum(1 for g in range(5000, 5050) for r in I.might_contain(blooms, [g]).collect())
    assert false <= 10
    assert I.bloom_size(1000)[1] == 7 and I.bloom_size(0)[0] == 64


def test_segments(make_docs):
    docs = make_docs([(f"f{k:03}", "x") for k in range(25)]).select("path", "text")
    rows = I.assign_segments(docs, 10).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(1, 26)) and [r["path"] for r in rows] == sorted(r["path"] for r in rows)
    assert [r["segment_id"] for r in rows] == [1] * 10 + [2] * 10 + [3] * 5
    assert {r["segment_id"] for r in I.assign_segments(docs, 0).collect()} == {1}
    assert I.assign_segments(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", ["path", "key"])
def test_numbering_does_not_depend_on_partitions(spark, order):
    # Adaptive execution puts together other partitions where the texts are read than where rows are counted.
    n = 20_000
    files = spark.range(n).select(F.concat(F.lit("src/"), F.xxhash64("id").cast("string")).alias("path"), (F.xxhash64("id") % 1_000_000_007 * 64 + F.col("id") % 64).alias("key"), F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(4))).alias("text"))
    files = files.dropDuplicates([order])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = I.assign_segments(files, 300, 7, order).select(order, "doc_id", "segment_id", F.length("text")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted(r[0] for r in files.select(order).collect())
    assert sorted((r[1], r[0], r[2]) for r in got) == [(k + 7, v, k // 300 + 1) for k, v in enumerate(want)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 10, 50, 511])
def test_ranges(spark, n):
    cuts = list(range(0, 3 * n, 3))
    values = spark.range(-2, 3 * n + 2).select("id", I._range_of(F.col("id"), cuts).alias("range")).collect()
    assert all(r["range"] == sum(c <= r["id"] for c in cuts) for r in values)


def test_difference(spark, make_docs):
    docs = make_docs([("same", "x"), ("older", "x"), ("gone", "x")], mtime=100)
    scan = spark.createDataFrame([("same", 100), ("older", 50), ("new", 1), ("bad", 7), ("bad2", 8)], "path string, mtime bigint")
    rejected = spark.createDataFrame([("bad", 7), ("bad2", 9)], "path string, mtime bigint")
    assert {tuple(r) for r in U.difference(scan, docs, rejected).collect()} == {("older", "modified"), ("gone", "deleted"), ("new", "new"), ("bad2", "new")}
    assert U.difference(docs.select("path", "mtime"), docs).count() == 0


def test_thresholds():
    assert not U.should_rebuild(30, 100) and not U.should_rebuild(309, 1000) and U.should_rebuild(31, 100) and U.should_rebuild(0, 0)
    assert U.should_compact(15, 0, 0, 10) and not U.should_compact(14, 0, 0, 10) and not U.should_compact(20, 10, 0, 10)
    assert U.should_compact(0, 0, 16, 100) and not U.should_compact(0, 0, 15, 100) and not U.should_compact(0, 0, 5, 0)


def test_delta_and_compaction(spark, make_docs):
    docs = make_docs([("a", "one"), ("b", "two"), ("c", "three")], mtime=5)
    gone = spark.createDataFrame([("b",), ("c",)], "path string")
    fresh = spark.createDataFrame([("b", 3, 9, 0, "2!")], "path string, size bigint, mtime bigint, flags int, text string")
    after = U.apply_delta(docs, gone, fresh, 4, 2)
    assert sorted((r["doc_id"], r["path"], r["flags"], r["segment_id"]) for r in after.collect()) == [(1, "a", 0, 1), (2, "b", 32, 1), (3, "c", 32, 1), (4, "b", 0, 2)]
    assert [(r["path"], r["line_number"]) for r in S.match_rows(after, parse_query("2")).collect()] == [("b", 1)]
    small = U.compacted(after)
    assert sorted((r["doc_id"], r["path"], r["segment_id"]) for r in small.collect()) == [(1, "a", 1), (2, "b", 1)]
    assert {tuple(r) for r in U.renumbering(after).collect()} == {(1, 1), (4, 2)}
    s = I.corpus_stats(after).first()
    assert (s["n_docs"], s["n_valid"], s["n_tombstones"], s["tombstone_ratio"]) == (4, 2, 2, 0.5)
    assert I.corpus_stats(after.where(F.lit(False))).first()["tombstone_ratio"] == 0
