import random

import duckdb
import pytest
from plain import shared_runs, words

from sondage.llm import decontaminate as D


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, item_id bigint, seeds int"),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string"),
    )


@pytest.mark.parametrize("trial", range(3))
def test_equals_brute_force(spark, trial):
    rng = random.Random(trial)
    word = lambda: rng.choice("abc" if trial == 2 else "abcdefghijkl")
    items = [(k, " ".join(word() for _ in range(rng.randint(3, 30)))) for k in range(5)]
    docs = []
    for k in range(25):
        w = [word() for _ in range(rng.randint(0, 20))]
        if rng.random() < 0.7:
            source = words(rng.choice(items)[1])
            a = rng.randrange(len(source))
            w[len(w) // 2 : len(w) // 2] = source[a : a + rng.randint(4, 20)]
        docs.append((k, "! ".join(w).upper()))
    least = (6, 7, 9)[trial]
    got = {tuple(r)[:6] for r in D.contaminated(*frames(spark, docs, items), least).collect()}
    want = {(i, k, *run) for i, t in docs for k, u in items for run in shared_runs(words(t), words(u), least)}
    assert got == want and want


def test_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = D.query(spark, sf), c.execute(D.SQL)
    assert got.columns == [x[0] for x in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "sat on the mat and looked at the dog"), (2, None), (None, "word " * 20), (3, ""), (1, "sat on the mat and looked at the dog")], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_words"]) for r in D.contaminated(odd, items, 5).collect())
    assert got == [(1, 1, 9), (10, 1, 9)]
    kept = D.decontaminate(odd, items, 5)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert D.contaminated(empty, items).count() == 0 and D.contaminated(odd, items.limit(0)).count() == 0
    assert D.decontaminate(odd, items.limit(0)).count() == odd.count()
