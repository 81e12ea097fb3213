"""Matching semantics on small corpora, and against a plain Python matcher on random ones."""

import random
import re

import pytest

from sondage.operators import search as S
from sondage.plans import compile as C
from sondage.plans.parser import parse_query
from sondage.plans.syntax import And, Boosted, Literal, Near, Not, Or, Phrase, Regex

MAIN = "src/main.rs"
FILES = [
    (MAIN, "fn main() {\n    let Config = load();\n    println!(\"{}\", 1);\n}\n"),
    ("src/lib.rs", "// TODO: optimise\npub fn load() -> config {\r\n    handleError(1);\n}"),
    ("docs/readme.md", "The config file\n\nGröße is ERROR here\nünïcode error"),
    ("empty.txt", ""),
    ("src/util/deep/x.py", "def handle_error():\n    return 'a->b std::vector 1.0.0'\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    from sondage import model

    rows = [(k, p, len(t.encode()), 1000 + k, 0, 1, t) for k, (p, t) in enumerate(FILES, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, size bigint, mtime bigint, flags int, segment_id int, text string")
    return df.withColumn("language", model.language_of(F.col("path"))).cache()


def plain_lines(text):
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def plain_rows(text, node, fold=False):
    """Rows of a text by definition: (line number, line, start, end)."""
    lines = plain_lines(text)

    def literal(needle, fold):
        out = []
        for k, line in enumerate(lines, 1):
            where, sought = (line.lower(), needle.lower()) if fold else (line, needle)
            at = where.find(sought)
            if at >= 0:
                start = len(where[:at].encode())
                out.append((k, line, start, start + len(needle.encode())))
        return out

    match node:
        case Literal(t) | Boosted(t, _):
            return literal(t, True)
        case Phrase(t):
            return literal(t, fold)
        case Regex(p):
            try:
                found = re.compile(p, re.IGNORECASE if fold else 0)
            except re.error:
                return []
            return [(k, s, len(s[: m.start()].encode()), len(s[: m.end()].encode())) for k, s in enumerate(lines, 1) if (m := found.search(s))]
        case Near(terms, d):
            others = [{r[0] for r in literal(t, True)} for t in terms[1:]]
            return [r for r in literal(terms[0], True) if all(any(abs(n - r[0]) <= d for n in o) for o in others)]
        case And(nodes):
            parts = [plain_rows(text, n, fold) for n in nodes]
            return sum(parts, []) if all(parts) else []
        case Or(nodes):
            return sum((plain_rows(text, n, fold) for n in nodes), [])
        case Not(inner):
            return [] if plain_rows(text, inner, fold) else [(1, lines[0] if lines else "", 0, 0)]
    raise TypeError(node)


def got(docs, query, fold=False, **options):
    rows = S.grep(docs, parse_query(query, fold), **options).collect()
    return [(r["path"], r["line_number"], r["line"], r["match_start"], r["match_end"]) for r in rows]


def expected(query, fold=False, files=FILES):
    node = C.pruned(parse_query(query, fold).root)
    return sorted((p, *r) for p, t in files for r in plain_rows(t, node, fold))


QUERIES = [
    "error", "ERROR", "config", "größe", "ünïcode", '"config"', '"Config"', '"TODO: opt"', "load error", "error | config", "load -todo",
    "-load", "error | -config", "(error | config) (load | here)", "^2:error", "near:fn,error,2", "near:config,error,1", "near:handle,the",
    r"re:/\w+Error/", r"re:/^pub/", r"re:/\)$/", "re:/[unclosed/", r"re:/a(?=b)/", "std::vector", "1.0.0", "a->b", "error error", '""', "x|y", "handle_error",
]


@pytest.mark.parametrize("query", QUERIES)
def test_rows(docs, query):
    assert sorted(got(docs, query)) == expected(query)


@pytest.mark.parametrize("query", ['"config"', r"re:/todo/", "error", '"größe IS"'])
def test_rows_without_case(docs, query):
    assert sorted(got(docs, query, True)) == expected(query, True)


def test_random_texts(spark, make_docs):
    rng = random.Random(5)
    words = ["Foo", "foo", "bar", "baz", "é", "x", "\n", "\n", "\r\n", " "]
    files = [(f"f{k}.txt", "".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    docs = make_docs(files).cache()
    for query in ("foo", '"Foo"', "foo bar", "foo | bar", "foo -baz", "near:foo,bar,1", "-foo", "(foo | é) -(bar baz)", r"re:/o+b/"):
        assert sorted(got(docs, query)) == expected(query, files=files), query


def paths(docs, query, **options):
    return [r["path"] for r in S.files(docs, parse_query(query), **options).collect()]


def test_filters(docs):
    assert paths(docs, "ext:rs") == ["src/lib.rs", "src/main.rs"]
    assert paths(docs, "lang:python") == ["src/util/deep/x.py"]
    assert paths(docs, "path:src/*.rs") == ["src/lib.rs", "src/main.rs"]
    assert paths(docs, "path:src/**") == ["src/lib.rs", "src/main.rs", "src/util/deep/x.py"]
    assert paths(docs, "path:src") == []
    assert paths(docs, "file:MAIN.rs") == ["src/main.rs"] and paths(docs, "file:main") == []
    assert paths(docs, "file:*.md") == ["docs/readme.md"]
    assert paths(docs, "size:<0") == ["empty.txt"]
    assert paths(docs, "mtime:>1004") == ["empty.txt", "src/util/deep/x.py"]
    assert paths(docs, "path:[ error") == paths(docs, "error")
    assert paths(docs, "") == [] and paths(docs, "near:x") == []
    assert len(paths(docs, "sort:path top:3")) == 5
    assert paths(docs, "-ext:rs error") == ["src/lib.rs"]
    assert paths(docs, "ext:rs", limit=1) == ["src/lib.rs"]


def test_filters_alone_give_one_row_a_file(docs):
    assert got(docs, "ext:rs") == [("src/lib.rs", 1, "", 0, 0), ("src/main.rs", 1, "", 0, 0)]


def test_line_range_comes_last(docs):
    assert [r[:2] for r in got(docs, "line:1-2 load")] == [("src/lib.rs", 2), ("src/main.rs", 2)]
    assert got(docs, "line:3 load -todo") == []


def test_patterns_see_whole_texts_in_file_lists(docs):
    assert paths(docs, r"re:/main\(\) \{\s+let/") == ["src/main.rs"]
    assert got(docs, r"re:/main\(\) \{\s+let/") == []
    assert paths(docs, r"re:/^fn/") == ["src/main.rs"] and paths(docs, r"re:/^pub/") == []
    assert paths(docs, r"re:/}$/") == ["src/lib.rs"]


def test_deleted_documents_never_match(docs):
    from pyspark.sql import functions as F

    assert paths(docs.withColumn("flags", F.lit(32)), "error") == []


def test_context(docs):
    row = S.grep(docs, parse_query("println"), 1, 5).first()
    assert [tuple(x) for x in row["context_before"]] == [(2, "    let Config = load();")]
    assert [tuple(x) for x in row["context_after"]] == [(4, "}")]
    row = S.grep(docs, parse_query("main"), 3, 0).first()
    assert row["context_before"] == [] and row["context_after"] == []


def test_counts_include_repeated_and_stand_in_rows(docs):
    n = {r["path"]: r["n_matches"] for r in S.count_by_file(docs, parse_query("load -optimize load")).collect()}
    assert n == {"src/lib.rs": 3, "src/main.rs": 3}
    assert tuple(S.files_with_matches(docs, parse_query("error")).first()) == (3, 4)


def test_ranking(docs):
    import math

    def score(n, depth, name=0.0, boost=1.0, age=None, now=2000):
        fresh = math.exp(-(now - age) * 0.693 / 604800)
        return round(max(0.1, boost * (math.log2(n + 1) + name - min(0.05 * depth, 0.5) + fresh)), 6)

    rows = [tuple(r)[1:] for r in S.ranked(docs, parse_query("error"), 2000).collect()]
    assert rows == [
        ("docs/readme.md", 3, score(2, 2, age=1003)),
        ("docs/readme.md", 4, score(2, 2, age=1003)),
        ("src/lib.rs", 3, score(1, 2, age=1002)),
        ("src/util/deep/x.py", 1, score(1, 4, age=1005)),
    ]
    assert [r["path"] for r in S.ranked(docs, parse_query("error sort:recency top:1"), 2000).collect()] == ["src/util/deep/x.py"]
    named = [tuple(r)[1:] for r in S.ranked(docs, parse_query("main"), 2000).collect()]
    assert named == [("src/main.rs", 1, score(1, 2, 2.0, age=1001))]
    assert [tuple(r)[1:] for r in S.ranked(docs, parse_query("readme"), 2000).collect()] == [("docs/readme.md", 1, 2.0)]
    assert S.ranked(docs, parse_query("readme top:0"), 2000).count() == 0
    assert S.ranked(docs, parse_query("readme ext:rs"), 2000).count() == 0
    assert [tuple(r)[1:] for r in S.ranked(docs, parse_query("ext:rs sort:path"), 2000).collect()] == [("src/lib.rs", 1, 1.0), ("src/main.rs", 1, 1.0)]
    assert S.ranked(docs, parse_query("^0.01:println"), 2000).first()["score"] == 0.1


def test_search_terms_and_boosts():
    node = parse_query('Foo -bar "a bc DE" re:/load_x.*/ near:q,Zed ^3:foo').root
    assert C.search_terms(C.pruned(node)) == ["foo", "bc", "de", "load_x", "zed"]
    assert C.boost_of(node) == 3.0 and C.boost_of(parse_query("^0.5:x").root) == 0.5 and C.boost_of(parse_query("^0.5:x y").root) == 1.0


def test_filters_reach_the_scan_and_matching_shuffles_nothing(spark, sf):
    from sondage.sources.corpus import from_documents

    docs = from_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = S.match_rows(docs, parse_query("license ext:rs"))._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Exchange", "EvalPython", "MapInArrow", "n_chars"):
        assert unwanted not in plan
    assert "IsNotNull(text)" in plan
