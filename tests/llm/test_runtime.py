import pytest
from pyspark.sql import functions as F

from sondage.llm import runtime


def test_tables_are_cut_in_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) AS text")
    out = runtime.cut(df)
    assert out.dtypes == df.dtypes and sorted(out.collect()) == sorted(df.collect())
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") in out.inputFiles()[0]


def test_broadcasts_are_checked(spark, monkeypatch):
    df = spark.range(100)
    plan = lambda x: x._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(runtime.small(df))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 100)
    assert "broadcast" not in plan(runtime.small(df))


def test_rows_are_measured(spark, monkeypatch):
    one = lambda text, n: spark.createDataFrame([(1, text, [(2, "x" * 10)] * n, None)], "a bigint, b string, c array<struct<d:int,e:string>>, f array<string>")
    for df, size in ((one("y" * 50, 3), 32 + 8 + 74 + 24 + 3 * 58 + 24), (one(None, 0), 32 + 8 + 24 + 24 + 24), (one("", 1).limit(0), 0)):
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", size)
        assert runtime.fits(df)
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", size - 1)
        assert not runtime.fits(df)


def test_filters_by_id_with_and_without_room(spark, monkeypatch):
    rows = [(k if k % 10 else None, f"t{k}") for k in range(-2000, 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = runtime.cut(spark.range(-500, 700, 3).select(F.col("id").alias("doc_id")))
    held = {r["doc_id"] for r in ids.collect()}
    inside = sorted(t for i, t in rows if i in held)
    others = sorted(t for i, t in rows if i not in held)
    for room in (64 << 20, 5000, 600, -1):
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", room)
        assert sorted(r["text"] for r in runtime.only(docs, ids, "doc_id").collect()) == inside
        assert sorted(r["text"] for r in runtime.without(docs, ids, "doc_id").collect()) == others
        assert sorted(r["text"] for r in runtime.matched(docs, ids.withColumnRenamed("doc_id", "other"), "doc_id", "other").collect()) == inside
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 5000)
    # Few others pass the filter.
    passed = docs.where(runtime.among(ids)(F.col("doc_id"))).count()
    assert len(inside) <= passed < len(inside) + 0.05 * len(others)
    none = ids.limit(0)
    assert runtime.only(docs, none, "doc_id").count() == 0 and runtime.without(docs, none, "doc_id").count() == len(rows)


def test_cut_tables_are_deleted(spark):
    import os

    with runtime.released():
        out = runtime.cut(spark.range(10))
        path = out.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        runtime.shared_dir(Session())


def test_operators_give_the_same_without_broadcasts(spark, docs, sf, monkeypatch):
    from sondage.llm import decontaminate, htmltext, licenses, mixing, repeats, simhash

    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet")

    def all_of():
        frames = (decontaminate.contaminated(docs, benchmark), simhash.deduplicate(docs).select("doc_id"), repeats.occurrences(repeats.repeats(docs)), mixing.mix(docs).select("doc_id"), mixing.mix(docs, {"src1": 1}, 5000).select("doc_id"), licenses.licenses(docs), htmltext.main_texts(pages))
        return [sorted(map(tuple, f.collect())) for f in frames]

    want = all_of()
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    assert all_of() == want
